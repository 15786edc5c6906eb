"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as a hashed word vector beside the element-wise maximum of its hashed character n-gram vectors.
Two gated recurrent passes read a window of words both ways, attention pools their states, and a logistic
unit scores the window. Windows overlap by half and cover the whole text; a text's score is its worst window's.

Labels belong to texts, so training is by rounds: first the windows of a toxic text count as toxic that hold
the word or n-gram most typical of toxic texts, then those that the network so far scores highest; clean windows that score high
are shown again. Words and n-grams of few sample texts keep a zero vector. The sample of labelled texts is bounded; scoring sees everything.
"""

from __future__ import annotations

import zlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import chunks, docs_of, training_row

#: Bounds of the training sample: texts of each label, and windows of one text.
SAMPLE_DOCS, SAMPLE_WINDOWS = 1200, 60
#: Windows of a clean text shown in a round, and texts out of 2,400 that a word or n-gram needs for a vector (3 at least).
SHOWN, MIN_TEXTS = 12, 6
#: Steps of a round at least, so that a small sample is seen often enough.
LEAST_STEPS = 120
WINDOW, STRIDE = 32, 16
WORD_BUCKETS, GRAM_BUCKETS = 1 << 16, 1 << 15
WORD_DIM, GRAM_DIM, HIDDEN, ATTENTION = 8, 8, 8, 8
#: Words whose inputs a worker keeps.
CACHE_WORDS = 200_000
F4 = np.float32


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word's 3-, 4- and 5-grams of bytes, with marks at its ends, word after word; and where each word's start."""
    marked = [b"<" + (w or b" ") + b">" for w in words]
    sizes = np.array([len(m) for m in marked])
    octets = np.frombuffer(b"".join(marked), dtype=np.uint8).astype(np.uint32)
    owner, left = np.repeat(np.arange(len(words)), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(octets))
    found, whose = [], []
    hashed = octets * np.uint32(2654435761)
    for n in range(2, 6):  # a polynomial of the bytes, longer by one each time
        hashed = hashed[:-1] * np.uint32(0x01000193) + octets[n - 1:] * np.uint32(2654435761) if len(hashed) else hashed
        if n > 2:
            at = np.flatnonzero(left[:len(hashed)] >= n)
            mixed = hashed[at]
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            found.append((mixed ^ (mixed >> np.uint32(13))) % GRAM_BUCKETS)
            whose.append(owner[at])
    order = np.argsort(np.concatenate(whose), kind="stable")
    counts = np.bincount(owner[np.flatnonzero(left >= 3)], minlength=len(words)) + sum(np.bincount(w, minlength=len(words)) for w in whose[1:])
    return np.concatenate(found)[order].astype(np.int64), np.cumsum(counts) - counts


def window_starts(n: int) -> list[int]:
    """Starts of overlapping windows over n words; the last reaches the end."""
    return list(range(0, max(1, n - WINDOW + STRIDE), STRIDE))


@dataclass
class Network:
    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 11) -> Network:
        r = np.random.default_rng(seed)
        d, h, k = WORD_DIM + GRAM_DIM, HIDDEN, ATTENTION
        init = lambda *s, scale=None: (r.standard_normal(s) * (scale or s[-1] ** -0.5)).astype(F4)
        p = {"words": init(WORD_BUCKETS, WORD_DIM, scale=0.1), "grams": init(GRAM_BUCKETS, GRAM_DIM, scale=0.1)}
        for s in "fb":
            p |= {f"W{s}": init(3 * h, d), f"U{s}": init(3 * h, h), f"b{s}": np.zeros(3 * h, F4)}
        p |= {"A": init(k, 2 * h), "v": init(k), "w": init(2 * h), "c": np.zeros(1, F4)}
        return cls(p)

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words, dim) inputs; the word buckets; the flat n-gram buckets; where each word's n-grams start."""
        flat, starts = grams(words)
        buckets = np.fromiter((zlib.crc32(w) % WORD_BUCKETS for w in words), dtype=np.int64, count=len(words))
        return self.mixed(buckets, flat, starts), buckets, flat, starts

    def mixed(self, buckets: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.concatenate([self.p["words"][buckets], np.maximum.reduceat(self.p["grams"][flat], starts, axis=0)], axis=1)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """(words, 2 * 3H): what a word adds to the gates of both passes."""
        p = self.p
        return np.concatenate([x @ p["Wf"].T + p["bf"], x @ p["Wb"].T + p["bb"]], axis=1)

    def run(self, table: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows: index (B, T) of rows in the projected table, mask (B, T). keep: also what backward needs."""
        p, h, (size, steps) = self.p, HIDDEN, index.shape
        states = np.empty((2, steps, h, size), F4)
        saved: dict = {}
        live = np.ascontiguousarray(mask.T)
        for s, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            U, cols, state = p[f"U{s}"], slice(0, 3 * h) if s == "f" else slice(3 * h, 6 * h), np.zeros((h, size), F4)
            for t in order:
                x = np.ascontiguousarray(table[index[:, t], cols].T)
                u = U @ state
                gates = np.tanh((x[:2 * h] + u[:2 * h]) * F4(0.5)) * F4(0.5) + F4(0.5)
                z, r = gates[:h], gates[h:]
                n = np.tanh(x[2 * h:] + r * u[2 * h:])
                new = n + z * (state - n)
                new = state + live[t] * (new - state)
                if keep:
                    saved[s, t] = (state, z, r, n, u[2 * h:])
                state = new
                states[0 if s == "f" else 1, t] = state
        both = states.transpose(1, 0, 2, 3).reshape(steps, 2 * h, size)
        act = np.tanh(np.einsum("ka,tab->tkb", p["A"], both, optimize=True))
        score = np.einsum("k,tkb->tb", p["v"], act) + np.where(live > 0, F4(0), F4(-1e9))
        score -= score.max(axis=0)
        alpha = np.exp(score)
        alpha /= alpha.sum(axis=0)
        pooled = np.einsum("tb,tab->ab", alpha, both)
        logit = p["w"] @ pooled + p["c"][0]
        return (logit, (saved, both, act, alpha, pooled, live)) if keep else logit

    def gradients(self, table: np.ndarray, index: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """Gradients of the weighted logistic loss: of the dense weights, and of the rows of the projected table."""
        p, h, (size, steps) = self.p, HIDDEN, index.shape
        logit, (saved, both, act, alpha, pooled, live) = self.run(table, index, mask, keep=True)
        d = ((1 / (1 + np.exp(-logit)) - y) * weight / weight.sum()).astype(F4)
        g = {"w": pooled @ d, "c": np.array([d.sum()], F4)}
        dp = p["w"][:, None] * d
        dalpha = np.einsum("ab,tab->tb", dp, both)
        dscore = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        g["v"] = np.einsum("tb,tkb->k", dscore, act)
        dact = p["v"][None, :, None] * dscore[:, None] * (1 - act * act)
        g["A"] = np.einsum("tkb,tab->ka", dact, both)
        dboth = alpha[:, None] * dp[None] + np.einsum("ka,tkb->tab", p["A"], dact)
        dtable = np.zeros((steps, 6 * h, size), F4)
        for s, order in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
            U, dU, dstate, rows = p[f"U{s}"], np.zeros_like(p[f"U{s}"]), np.zeros((h, size), F4), slice(0, h) if s == "f" else slice(h, 2 * h)
            for t in order:
                state, z, r, n, un = saved[s, t]
                dnew = dstate + dboth[t, rows]
                carried = dnew * (1 - live[t])
                dnew = dnew * live[t]
                dn = dnew * (1 - z) * (1 - n * n)
                dz = dnew * (state - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                du = np.concatenate([dz, dr, dn * r])
                dU += du @ state.T
                dstate = carried + dnew * z + U.T @ du
                dtable[t, slice(0, 3 * h) if s == "f" else slice(3 * h, 6 * h)] = np.concatenate([dz, dr, dn])
            g[f"U{s}"] = dU
        flat = dtable.transpose(2, 0, 1).reshape(size * steps, 6 * h)
        order = np.argsort(index.ravel(), kind="stable")
        rows, starts = np.unique(index.ravel()[order], return_index=True)
        return g, rows, np.add.reduceat(flat[order], starts, axis=0), logit


def _windows(words: list[bytes], ids: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW) indices and mask of one text; a text without words is one empty window."""
    starts = window_starts(len(words))
    row = np.array([ids[w] for w in words], dtype=np.int64)
    row = np.concatenate([row, np.zeros(starts[-1] + WINDOW - len(row), dtype=np.int64)]) if starts[-1] + WINDOW > len(row) else row
    at = np.array(starts)[:, None] + np.arange(WINDOW)
    return row[at], (at < len(words)).astype(F4)


def _typical(seen: list[np.ndarray], size: int, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the number of texts that hold it, and the log ratio of its rates in toxic and in clean texts."""
    hold = np.zeros((2, size))
    for buckets, label in zip(seen, toxic, strict=True):
        hold[label, buckets] += 1
    rates = (hold + 0.5) / (np.bincount(toxic, minlength=2)[:, None] + 1)
    return hold.sum(axis=0), np.log(rates[1] / rates[0])


def train(texts: list[bytes], toxic: list[int], seed: int = 11, rounds: tuple[int, ...] = (3, 2), batch: int = 512) -> Network:
    """Fit a network to labelled texts; the same texts in the same order give the same network."""
    net, r = Network.new(seed), np.random.default_rng(seed)
    p = net.p
    ids: dict[bytes, int] = {}
    indices, masks, owner, words_of = [], [], [], []
    for d, text in enumerate(texts):
        words = text.lower().split()
        for w in words:
            ids.setdefault(w, len(ids))
        words_of.append(np.unique(np.array([ids[w] for w in words], dtype=np.int64)))
        i, m = _windows(words, ids)
        if len(i) > SAMPLE_WINDOWS:
            some = np.sort(r.choice(len(i), SAMPLE_WINDOWS, replace=False))
            i, m = i[some], m[some]
        indices.append(i)
        masks.append(m)
        owner += [d] * len(i)
    index, mask, owner_ = np.concatenate(indices), np.concatenate(masks), np.array(owner)
    ids.setdefault(b"", len(ids))
    _, buckets, flat, starts = net.inputs(list(ids))
    ends = np.append(starts[1:], len(flat))
    label = np.array(toxic, dtype=np.int64)
    y_doc = label.astype(F4)[owner_]
    texts_w, ratio_w = _typical([buckets[w] for w in words_of], WORD_BUCKETS, label)
    texts_g, ratio_g = _typical([np.concatenate([flat[starts[w]:ends[w]] for w in words]) if len(words) else words for words in words_of], GRAM_BUCKETS, label)
    enough = max(3, len(texts) * MIN_TEXTS // 2400)
    free = {"words": texts_w >= enough, "grams": texts_g >= enough}
    for k in free:
        p[k][~free[k]] = 0
    ratio_w[~free["words"]] = -np.inf
    ratio_g[~free["grams"]] = -np.inf
    of_word = np.maximum(ratio_w[buckets], np.maximum.reduceat(ratio_g[flat], starts))
    scores = np.where(mask > 0, of_word[index], -np.inf).max(axis=1)
    dense = [k for k in p if k not in ("words", "grams")]
    m1, m2, step = {k: np.zeros_like(p[k]) for k in dense}, {k: np.zeros_like(p[k]) for k in dense}, 0
    acc = {k: np.full(len(p[k]), 1e-6, F4) for k in ("words", "grams")}

    def learn(part: np.ndarray, weight: np.ndarray) -> None:
        nonlocal step
        step += 1
        rows, inner = np.unique(index[part], return_inverse=True)
        n = ends[rows] - starts[rows]
        flat_ = flat[np.repeat(starts[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        starts_ = np.cumsum(n) - n
        x = net.mixed(buckets[rows], flat_, starts_)
        g, at, dtable, _ = net.gradients(net.projected(x), inner.reshape(len(part), WINDOW), mask[part], y_doc[part], weight)
        dx = np.zeros_like(x)
        for s, cols in (("f", slice(0, 3 * HIDDEN)), ("b", slice(3 * HIDDEN, 6 * HIDDEN))):
            g[f"W{s}"] = dtable[:, cols].T @ x[at]
            g[f"b{s}"] = dtable[:, cols].sum(axis=0)
            dx[at] += dtable[:, cols] @ p[f"W{s}"]
        for k in dense:
            m1[k] += 0.1 * (g[k] - m1[k])
            m2[k] += 0.001 * (g[k] * g[k] - m2[k])
            p[k] -= (0.01 * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)).astype(F4)
        # the maximum passes its gradient to the n-gram that holds it
        held = p["grams"][flat_] == np.repeat(x[:, WORD_DIM:], n, axis=0)
        for name, where, grad in (("words", buckets[rows], dx[:, :WORD_DIM]), ("grams", flat_, held * np.repeat(dx[:, WORD_DIM:], n, axis=0))):
            order = np.argsort(where, kind="stable")
            slots, first = np.unique(where[order], return_index=True)
            total = np.add.reduceat(grad[order], first, axis=0)
            slots, total = slots[free[name][slots]], total[free[name][slots]]
            acc[name][slots] += (total * total).mean(axis=1)
            p[name][slots] -= (0.05 * total / np.sqrt(acc[name][slots])[:, None]).astype(F4)

    for number, epochs in enumerate(rounds):
        if number:
            table = net.projected(net.mixed(buckets, flat, starts))
            scores = np.concatenate([net.run(table, index[a:a + 2048], mask[a:a + 2048]) for a in range(0, len(index), 2048)])
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner_, scores)
        top = (y_doc == 1) & (scores >= best[owner_] - 1e-6)
        # of a clean text: windows at random, and after the first round those with the highest scores
        rank = np.argsort(np.lexsort((r.random(len(owner_)), owner_)))
        rank = rank - np.searchsorted(owner_, owner_)
        shown = rank < SHOWN
        if number:
            high = np.argsort(np.lexsort((-scores, owner_))) - np.searchsorted(owner_, owner_)
            shown |= high < SHOWN // 3
        chosen = np.flatnonzero(top | ((y_doc == 0) & shown))
        share = max(1, (y_doc[chosen] == 0).sum()) / max(1, (y_doc[chosen] == 1).sum())
        for _ in range(max(epochs, -(-LEAST_STEPS // -(-len(chosen) // batch)))):
            order = r.permutation(chosen)
            for a in range(0, len(order), batch):
                part = order[a:a + batch]
                learn(part, np.where(y_doc[part] == 1, F4(min(share, 3.0)), F4(1)))
    return net


class Scorer:
    """Scores texts with a network; keeps the inputs of the words it met, up to a bound."""

    def __init__(self, net: Network):
        self.net = net
        self.ids: dict[bytes, int] = {}
        self.table = np.zeros((1024, 6 * HIDDEN), F4)

    def _admit(self, texts: list[list[bytes]]) -> None:
        if len(self.ids) > CACHE_WORDS:
            self.ids.clear()
        new = list({w: None for words in texts for w in words if w not in self.ids})
        for a in range(0, len(new), 50_000):
            part = new[a:a + 50_000]
            start = len(self.ids)
            while start + len(part) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[start:start + len(part)] = self.net.projected(self.net.inputs(part)[0])
            self.ids.update(zip(part, range(start, start + len(part)), strict=True))

    def score(self, data: list[bytes]) -> np.ndarray:
        """The highest window score of each text, 0 to 1."""
        texts = [d.lower().split() for d in data]
        self._admit(texts)
        best = np.empty(len(texts))
        index, mask, counts, first = [], [], [], 0
        held = 0

        def flush(upto: int) -> None:
            nonlocal index, mask, counts, first, held
            i, m = np.concatenate(index), np.concatenate(mask)
            logits = np.concatenate([self.net.run(self.table, i[a:a + 4096], m[a:a + 4096]) for a in range(0, len(i), 4096)])
            best[first:upto] = np.maximum.reduceat(logits, np.cumsum([0] + counts[:-1]))
            index, mask, counts, first, held = [], [], [], upto, 0

        for d, words in enumerate(texts):
            i, m = _windows(words, self.ids)
            index.append(i)
            mask.append(m)
            counts.append(len(i))
            held += len(i)
            if held >= 8192:
                flush(d + 1)
        if counts:
            flush(len(texts))
        return 1 / (1 + np.exp(-np.clip(best, -60, 60)))


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All labelled texts of the sample in, the parameters of the network out; nothing where one of the labels has no text."""
    rows = sorted((i, bytes(d), t) for b in batches for i, d, t in zip(b["doc_id"].to_pylist(), b["data"].to_pylist(), b["toxic"].to_pylist()))
    if len({t for _, _, t in rows}) == 2:
        net = train([d for _, d, _ in rows], [t for _, _, t in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net.p)], pa.binary())], ["net"])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, sample_docs: int = SAMPLE_DOCS) -> dict[str, np.ndarray] | None:
    """Parameters of a network fitted to at most `sample_docs` texts of each label, of ids outside the held-out fold, by smallest hash of the id.

    An id labelled twice is toxic if any label says so; null ids and labels do not count. None if either label has no text. The sample
    meets in one task, which trains; the driver gets the parameters, about 4 MB.
    """
    known = (labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
             .filter(training_row(F.col("doc_id"), folds, held_out)))
    order = (F.xxhash64("doc_id", F.lit(31)), F.col("doc_id"))
    chosen = known.filter("toxic = 1").orderBy(*order).limit(sample_docs).unionByName(known.filter("toxic = 0").orderBy(*order).limit(sample_docs))
    # bounded: 2 * sample_docs texts, one for each id
    sample = docs_of(docs).join(chosen, "doc_id").groupBy("doc_id").agg(F.min(F.struct("data", "toxic")).alias("r")).select("doc_id", "r.data", "r.toxic")
    found = sample.repartition(1).mapInArrow(_train_rows, "net binary").collect()
    return pickle.loads(bytes(found[0]["net"])) if found else None


def _score_with(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Network(shared.value)) if shared.value else None
        for batch in chunks(batches):
            data = [bytes(x) for x in batch["data"].to_pylist()]
            yield batch.drop_columns(["data"]).append_column("score", pa.array(scorer.score(data) if scorer else np.zeros(len(data)), pa.float64()))

    return run


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every text; one pass without a shuffle once the network is fitted.

    Null texts count as empty and are scored too. Without labels of both kinds all scores are 0. Rows may repeat or lack an id.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds, held_out))  # a fixed size, about 4 MB
    scored = docs_of(docs).mapInArrow(_score_with(shared), "doc_id long, score double")
    return scored.select("doc_id", (~training_row(F.col("doc_id"), folds, held_out)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs without the rows whose score reaches the threshold; same columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Network(shared.value)) if shared.value else None
        for batch in chunks(batches):
            if scorer:
                data = [(x or "").encode() for x in batch["text"].to_pylist()]
                batch = batch.filter(pa.array(scorer.score(data) < threshold))
            yield batch

    return docs.mapInArrow(run, schema)
