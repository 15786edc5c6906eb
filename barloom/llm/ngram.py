"""Language-model scoring by deleted interpolation.

A token's probability mixes a uniform share, its relative frequency, and its relative frequency after the token
before it. The weights depend on how often that token was seen (a bucket per power of two) and
are learned by expectation-maximisation on counts from which the token itself is deleted.

Texts are packed into blocks: a vocabulary of word hashes and the tokens as indices into it. A block sends
each of its distinct keys once, with its own count, to the task that owns the key's range of hashes, and gets back what
other blocks add. So what is shuffled is one entry per distinct key of a block, never one per token, and a very
frequent word is one entry per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import chunks, docs_of, stage, training_row

#: Tokens of a block (a longer text is a block of its own), and distinct keys a range should hold in all blocks together.
BLOCK_TOKENS, RANGE_KEYS = 2_000_000, 2_000_000
#: Marks beside words, which are never empty and hold no blank.
END, START = b"", b" "
#: Steps of the histogram on which weights are learned: two per power of two.
FINE = 2
EM_STEPS = 60


def pack(values: np.ndarray) -> bytes:
    """An array of integers by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()) if len(values) else b""


def unpack(data: bytes, dtype: str) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=dtype)
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


BLOCKS = "block long, n long, docs array<long>, train array<boolean>, lengths array<int>, vocab binary, tokens binary"


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    names = BLOCKS.replace(",", "").split()[::2]
    ids: dict[bytes, int] = {START: 0, END: 1}
    docs, train, lengths, tokens, held = [], [], [], [], 0

    def out() -> pa.RecordBatch:
        nonlocal number, ids, docs, train, lengths, tokens, held
        vocab = np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in ids), dtype=np.uint64, count=len(ids))
        flat = np.concatenate(tokens)
        row = ([number], [len(flat)], [docs], [train], [lengths], [pack(vocab)], [pack(flat)])
        number, ids, docs, train, lengths, tokens, held = number + 1, {START: 0, END: 1}, [], [], [], [], 0
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)

    for batch in chunks(batches):
        for doc, data, learns in zip(batch["doc_id"].to_pylist(), batch["data"].to_pylist(), batch["train"].to_pylist(), strict=True):
            words = data.lower().split()
            if held and held + len(words) > BLOCK_TOKENS:
                yield out()
            put = ids.setdefault
            flat = np.empty(len(words) + 2, dtype=np.uint32)
            flat[0], flat[-1] = 0, 1
            flat[1:-1] = [put(w, len(ids)) for w in words]
            docs.append(doc)
            train.append(learns)
            lengths.append(len(flat))
            tokens.append(flat)
            held += len(flat)
    if docs:
        yield out()


class Block:
    """Distinct keys of a block in the order of their hashes, for single tokens (0) and pairs (1)."""

    def __init__(self, lengths, train, vocab: bytes, tokens: bytes):
        self.lengths = np.asarray(lengths, dtype=np.int64)
        self.train = np.asarray(train, dtype=bool)
        self.tokens = unpack(tokens, "<u4").astype(np.int64)
        self.vocab = unpack(vocab, "<u8")
        self.first = np.cumsum(self.lengths) - self.lengths
        self.learns = np.repeat(self.train, self.lengths)

    def keys(self, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted keys, counts in training texts, entry of each token). A pair's entry stands at its second token; a text's first place has none (-1)."""
        if kind == 0:
            order = np.argsort(self.vocab, kind="stable")
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            entry = place[self.tokens]
            return self.vocab[order], np.bincount(entry[self.learns], minlength=len(order)).astype(np.uint32), entry
        second = np.ones(len(self.tokens), dtype=bool)
        second[self.first] = False
        at = np.flatnonzero(second)
        pairs, inner = np.unique(self.tokens[at - 1] * len(self.vocab) + self.tokens[at], return_inverse=True)
        with np.errstate(over="ignore"):
            keys = self.vocab[pairs // len(self.vocab)] * np.uint64(0x9E3779B97F4A7C15) + self.vocab[pairs % len(self.vocab)]
            keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            keys = keys ^ (keys >> np.uint64(32))
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        entry = np.full(len(self.tokens), -1, dtype=np.int64)
        entry[at] = place[inner]
        return keys[order], np.bincount(entry[at][self.learns[at]], minlength=len(order)).astype(np.uint32), entry


def _send(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            b = batch.to_pylist()[0]
            block = Block(b["lengths"], b["train"], b["vocab"], b["tokens"])
            for kind in (0, 1):
                keys, counts, _ = block.keys(kind)
                part = keys >> np.uint64(64 - bits)
                ranges, starts = np.unique(part, return_index=True)
                ends = np.append(starts[1:], len(keys))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ranges), kind, dtype=np.int32)), pa.array(ranges.astype(np.int64)), pa.array(np.full(len(ranges), b["block"])),
                     pa.array([pack(np.diff(keys[a:e], prepend=np.uint64(0))) for a, e in zip(starts, ends)], pa.binary()),
                     pa.array([pack(counts[a:e]) for a, e in zip(starts, ends)], pa.binary())], ["kind", "range", "block", "keys", "counts"])

    return run


#: Hash of the start mark, which is no token.
_START_KEY = np.uint64(xxhash.xxh64_intdigest(START, 1))


def _total(group: pd.DataFrame) -> pd.DataFrame:
    """What the other blocks add to each block's counts in one range, and the range's token and type totals."""
    keys = [np.cumsum(unpack(k, "<u8"), dtype=np.uint64) for k in group["keys"]]
    counts = [unpack(c, "<u4").astype(np.uint64) for c in group["counts"]]
    sizes = [len(k) for k in keys]
    flat, own = np.concatenate(keys), np.concatenate(counts)
    unique, inner = np.unique(flat, return_inverse=True)
    totals = np.zeros(len(unique), dtype=np.uint64)
    np.add.at(totals, inner, own)
    added = np.split(totals[inner] - own, np.cumsum(sizes)[:-1])
    kind, rng = int(group["kind"].iloc[0]), int(group["range"].iloc[0])
    known = (totals > 0) & (unique != _START_KEY)
    answers = pd.DataFrame({"block": group["block"].to_numpy(), "kind": kind, "range": rng, "added": [pack(a) for a in added], "tokens": 0, "types": 0})
    sums = pd.DataFrame({"block": [-1], "kind": [kind], "range": [rng], "added": [b""], "tokens": [int(totals[known].sum())], "types": [int(known.sum())]})
    return pd.concat([answers, sums], ignore_index=True)


ANSWERS = "block long, kind int, range long, added binary, tokens long, types long"
RESOLVED = "block long, docs array<long>, train array<boolean>, lengths array<int>, single binary, pair binary"


def _resolve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """A block's tokens with the corpus counts of each token and of each pair."""
    b = left.iloc[0]
    block = Block(b["lengths"], b["train"], b["vocab"], b["tokens"])
    found = []
    for kind in (0, 1):
        _, own, entry = block.keys(kind)
        mine = right[right["kind"] == kind].sort_values("range")
        total = own + np.concatenate([unpack(a, "<u8") for a in mine["added"]] or [np.zeros(0, dtype="<u8")])
        found.append(pack(np.where(entry >= 0, total[entry], 0).astype("<u8")))
    return pd.DataFrame({"block": [b["block"]], "docs": [b["docs"]], "train": [b["train"]], "lengths": [b["lengths"]], "single": [found[0]], "pair": [found[1]]})


class Counts:
    """Of a resolved block: per token (start marks left out) its count, its context's count, the pair's count, and its text."""

    def __init__(self, row: dict):
        lengths = np.asarray(row["lengths"], dtype=np.int64)
        first = np.cumsum(lengths) - lengths
        token = np.ones(int(lengths.sum()), dtype=bool)
        token[first] = False
        at = np.flatnonzero(token)
        single = unpack(row["single"], "<u8").astype(np.int64)
        self.single, self.context, self.pair = single[at], single[at - 1], unpack(row["pair"], "<u8").astype(np.int64)[at]
        self.learns = np.repeat(np.asarray(row["train"], dtype=bool), lengths)[at]
        self.starts = first - np.arange(len(lengths))
        self.tokens = lengths - 1


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 more than the whole part of the count's binary logarithm."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)


def _histogram(n: int, v: int):
    """Counts of training tokens by bucket and by how far the two estimates exceed the uniform one, each token deleted from its own counts."""
    def level(ratio: np.ndarray) -> np.ndarray:
        return np.where(ratio > 0, np.round(np.log2(np.maximum(ratio, 1e-300)) * FINE), -10_000).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            c = Counts(batch.to_pylist()[0])
            single, context, pair = ((x[c.learns] - 1) for x in (c.single, c.context, c.pair))
            one = level(single / max(n - 1, 1) * (v + 1))
            two = level(np.where(context > 0, pair / np.maximum(context, 1), 0) * (v + 1))
            rows, times = np.unique(np.stack([bucket(context), one, two]), axis=1, return_counts=True) if len(one) else (np.zeros((3, 0), dtype=np.int64), np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(times)], ["bucket", "one", "two", "times"])

    return run


def learn_weights(cells: list[tuple[int, int, int, int]], steps: int = EM_STEPS) -> np.ndarray:
    """(buckets, 3) weights of the uniform, single and pair estimates by expectation-maximisation; 65 buckets hold any count.

    cells: (bucket, level of the single estimate, level of the pair estimate, times). A bucket without data takes the weights of the
    next lower one with data (of the next higher one, if there is none).
    """
    weights = np.full((65, 3), np.nan)
    data = np.array(cells, dtype=np.int64).reshape(-1, 4)
    for b in np.unique(data[:, 0]):
        own = data[data[:, 0] == b]
        p = np.stack([np.ones(len(own)), *(np.where(own[:, i] > -10_000, 2.0 ** (own[:, i] / FINE), 0.0) for i in (1, 2))])
        w = np.full(3, 1 / 3)
        for _ in range(steps):
            share = w[:, None] * p
            w = (share / share.sum(axis=0) * own[:, 3]).sum(axis=1) / own[:, 3].sum()
        w = np.maximum(w, 1e-9)  # no estimate is ruled out for good
        weights[b] = w / w.sum()
    known = np.flatnonzero(~np.isnan(weights[:, 0]))
    if not len(known):
        return np.tile([1.0, 0.0, 0.0], (65, 1))
    return weights[[known[max(0, np.searchsorted(known, b, "right") - 1)] for b in range(65)]]


def _score(n: int, v: int, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            row = batch.to_pylist()[0]
            c = Counts(row)
            base = np.log10((c.single + 0.5) / (n + 0.5 * (v + 1)))
            w = weights[bucket(c.context)]
            p = w[:, 0] / (v + 1) + w[:, 1] * c.single / max(n, 1) + w[:, 2] * np.where(c.context > 0, c.pair / np.maximum(c.context, 1), 0)
            per = lambda x: np.add.reduceat(x, c.starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["docs"], pa.int64()), pa.array(c.tokens), pa.array(per((c.single > 0).astype(np.int64))), pa.array(per(base)), pa.array(per(np.log10(p)))],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, folds: int = 5, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text; counts come from all texts outside the held-out fold.

    A null text counts as empty: one end token. Repeated rows are texts of their own. A null id counts as a training id. An empty table gives an empty result.
    """
    learns = docs_of(docs).withColumn("train", training_row(F.col("doc_id"), folds, held_out))
    blocks = stage(learns.mapInArrow(_block, BLOCKS))
    size = blocks.agg(F.sum("n")).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(1.0, size / RANGE_KEYS)))))
    sent = blocks.mapInArrow(_send(bits), "kind int, range long, block long, keys binary, counts binary")
    answers = stage(sent.groupBy("kind", "range").applyInPandas(_total, ANSWERS))
    totals = answers.filter("block = -1 and kind = 0").agg(F.sum("tokens"), F.sum("types")).first()
    n, v = int(totals[0] or 0), int(totals[1] or 0)
    resolved = stage(blocks.groupBy("block").cogroup(answers.filter("block >= 0").groupBy("block")).applyInPandas(_resolve, RESOLVED))
    cells = resolved.mapInArrow(_histogram(n, v), "bucket long, one long, two long, times long").groupBy("bucket", "one", "two").agg(F.sum("times").alias("times"))
    weights = learn_weights([tuple(r) for r in cells.collect()])  # bounded: 65 buckets times the levels of two ratios
    scored = resolved.mapInArrow(_score(n, v, weights), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", (~training_row(F.col("doc_id"), folds, held_out)).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
