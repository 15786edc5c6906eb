"""Nearest neighbours, n-gram scores, toxicity, token files, the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from barloom.llm import ann, ngram, tokenfile, toxicity
from barloom.session import scratch


# ---- nearest neighbours
def test_nearest_equals_brute_force_up_to_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    vectors = (centres[rng.integers(0, 12, 1500)] + 0.4 * rng.standard_normal((1500, 16))).astype(np.float32)
    vectors[100:400] = vectors[100]  # one very frequent vector: ties by id
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 20))
    exact, hits = vectors.astype(np.float64), 0
    for q, found in got.items():
        score = (exact * exact[q]).sum(axis=1)
        score[q] = -np.inf
        best = np.lexsort((np.arange(1500), -score))[:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and all(abs(score[v] - s) < 1e-9 for _, v, s in found)
        hits += len(set(best.tolist()) & {v for _, v, _ in found})
    assert hits >= 0.9 * 10 * len(got)
    copies = [v for _, v, _ in sorted(got[120]) if 100 <= v < 400]
    assert copies == [v for v in range(100, 400) if v != 120][:len(copies)]


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (20, [inf, 1.0]), (40, [None, 1.0]), (60, [0.5, 0.5]), (5, [0.5, 0.5]), (5, [2.0, 0.0]), (None, [1.0, 1.0]), (7, [1.0])]
    got = [tuple(r) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 5, 2.0), (0, 2, 5, 0.5), (0, 3, 60, 0.5), (60, 1, 5, 1.0), (60, 2, 0, 0.5), (60, 3, 5, 0.5)]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


# ---- n-grams
def test_scores_equal_plain_interpolation(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    streams = [(r["doc_id"], ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", low(r["text"])), "</s>"]) for r in rows]
    learns = lambda d: zlib.crc32(str(d).encode() if d is not None else b"") % 5 != 1
    single, pair = Counter(), Counter()
    for d, s in streams:
        if learns(d):
            single.update(s)
            pair.update(zip(s, s[1:]))
    starts = single["<s>"]
    n, v = sum(single.values()) - starts, len(single) - 1
    cells = Counter()
    level = lambda x: round(math.log2(x) * ngram.FINE) if x > 0 else -10_000
    for d, s in streams:
        if learns(d):
            for a, b in zip(s, s[1:]):
                c = single[a] - 1
                cells[int(ngram.bucket(np.array([c]))[0]), level((single[b] - 1) / (n - 1) * (v + 1)), level((pair[a, b] - 1) / c * (v + 1) if c else 0)] += 1
    weights = ngram.learn_weights([(*k, t) for k, t in cells.items()])
    want = Counter()
    for d, s in streams:
        base = sum(math.log10((single[w] + 0.5) / (n + 0.5 * (v + 1))) for w in s[1:])
        score = 0.0
        for a, b in zip(s, s[1:]):
            w = weights[int(ngram.bucket(np.array([single[a]]))[0])]
            score += math.log10(w[0] / (v + 1) + w[1] * single[b] / n + w[2] * (pair[a, b] / single[a] if single[a] else 0))
        want[d, not learns(d), len(s) - 1, sum(single[w] > 0 for w in s[1:]), n, round(base, 3), round(score, 3)] += 1
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3), round(r["score"], 3)) for r in ngram.score_documents(docs).collect())
    assert got == want
    assert ngram.score_documents(empty).count() == 0


def test_weights_raise_the_likelihood():
    cells = [(1, 4, 20, 50), (1, 2, -10_000, 30), (1, 6, 10, 20), (5, 1, 30, 5)]
    w = ngram.learn_weights(cells)
    assert w.shape == (65, 3) and np.allclose(w.sum(axis=1), 1)

    def likelihood(x):
        return sum(t * math.log(x[0] + x[1] * 2 ** (a / 2) + (x[2] * 2 ** (b / 2) if b > -10_000 else 0)) for k, a, b, t in cells if k == 1)

    grid = [(a / 20, b / 20, 1 - a / 20 - b / 20) for a in range(1, 19) for b in range(1, 20 - a)]
    assert likelihood(w[1]) >= max(map(likelihood, grid)) - 1e-3
    assert (w[0] == w[1]).all() and (w[3] == w[1]).all() and (w[9] == w[5]).all()


# ---- toxicity
def test_gradients_equal_differences(monkeypatch):
    monkeypatch.setattr(toxicity, "F4", np.float64)
    net, rng = toxicity.Network.new(1), np.random.default_rng(0)
    table = net.projected(net.inputs([b"w%d" % i for i in range(10)])[0])
    index, y = rng.integers(0, 10, (4, 32)), np.array([0.0, 1, 0, 1])
    mask = (np.arange(32) < np.array([5, 32, 17, 1])[:, None]).astype(float)
    g, rows, dtable, _ = net.gradients(table, index, mask, y, np.ones(4))
    loss = lambda t: np.mean(np.log1p(np.exp(net.run(t, index, mask))) - y * net.run(t, index, mask))
    for name in ("A", "v", "w", "c", "Uf", "Ub"):
        at = tuple(0 for _ in net.p[name].shape)
        net.p[name][at] += 1e-5
        up = loss(table)
        net.p[name][at] -= 2e-5
        down = loss(table)
        net.p[name][at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(g[name][at], rel=1e-4, abs=1e-9)
    for col in range(0, 48, 5):
        shift = np.zeros_like(table)
        shift[rows[2], col] = 1e-5
        assert (loss(table + shift) - loss(table - shift)) / 2e-5 == pytest.approx(dtable[2, col], rel=1e-4, abs=1e-9)


def test_held_out_accuracy_and_edge_cases(spark, docs, labels, empty):
    rng = np.random.default_rng(4)
    rows, marks = [], []
    for i in range(900):
        words = [f"w{x}" for x in rng.integers(0, 3000, 120)]
        bad = i % 3 == 0
        if bad:
            for at in rng.integers(0, 120, 2):
                words[at] = ["vile", "nasty", "hateful"][int(rng.integers(0, 3))]
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    train = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.score_documents(train.unionByName(docs.select("doc_id", "text").filter("doc_id < 0 or doc_id is null")), known).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] >= 0]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    assert sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert {r["score"] for r in toxicity.score_documents(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_documents(docs, labels).count() == docs.count() and toxicity.score_documents(empty, labels).count() == 0
    assert toxicity.drop_toxic(docs, labels.limit(0)).columns == docs.columns


def test_every_window_is_scored():
    assert toxicity.window_starts(0) == [0] and toxicity.window_starts(32) == [0] and toxicity.window_starts(33) == [0, 16]
    for n in range(1, 200):
        s = toxicity.window_starts(n)
        assert s[-1] + toxicity.WINDOW >= n and all(b - a == toxicity.STRIDE for a, b in zip(s, s[1:]))


# ---- token files
def test_blocks_round_trip_and_damage_is_found():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, tokenfile.BLOCK_IDS - 1, tokenfile.BLOCK_IDS, tokenfile.BLOCK_IDS + 1, 3 * tokenfile.BLOCK_IDS + 7):
        for ids in (rng.integers(0, 65535, n), rng.zipf(1.3, n) % 49408, np.full(n, 7)):
            assert (tokenfile.decode_blocks(tokenfile.encode_blocks(ids), n) == ids).all()
    data = tokenfile.pack_segment([3, None], [4, 1], np.array([5, 6, 7, 2, 2]))
    assert tokenfile.unpack_segment(data)[0] == [3, None]
    for at in (7, 40, len(data) - 1):
        with pytest.raises(ValueError):
            tokenfile.unpack_segment(data[:at] + bytes([data[at] ^ 1]) + data[at + 1:])


def test_words_equal_the_library_on_slices_and_odd_texts():
    rnd = random.Random(3)
    parts = ["a", "B", "é", "É", "ÿ", "×", "÷", "à", "'s", "'", "don't", "i'LL", "0", "12", "|", "<|", "|>", "<|startoftext|>", "<|STARTOFTEXT|>", "<|endoftext|>", " ", "\n", "\x0b", "\x1c", "\x00", "\x7f",
             "\x85", "\xa0", ".", "...", "-", "e\u0301", "한", "😀", "Σ", "İ", "\u212a", "ß", "</w>"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(6000)]
    words, library = tokenfile.Words(public_tokenizers.path(tokenfile.MODEL)), Tokenizer.from_file(public_tokenizers.path(tokenfile.MODEL))
    data = pa.array([t.encode() for t in texts], pa.binary())
    got = [ids.tolist() for at in range(0, len(texts), 700) for ids in words.encode(data.slice(at, 700))]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert words.encode(data.slice(0, 0)) == []


def test_words_keep_a_bounded_memory(monkeypatch):
    monkeypatch.setattr(tokenfile, "CACHE_BYTES", 1000)
    words, library = tokenfile.Words(public_tokenizers.path(tokenfile.MODEL)), Tokenizer.from_file(public_tokenizers.path(tokenfile.MODEL))
    for text in ("long" * 5000 + " tail", "tail again", "x" * 999 + "é"):
        assert words.encode(pa.array([text.encode()]))[0].tolist() == library.encode(text, add_special_tokens=False).ids
        assert sum(map(len, words.known)) <= 2000


def test_files_hold_the_librarys_ids(spark, docs, empty):
    folder = f"{scratch(spark)}/ids"
    tokenfile.write_ids(docs, folder)
    library = Tokenizer.from_file(public_tokenizers.path(tokenfile.MODEL))
    encode = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, tokenfile.END_ID]
    texts = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in docs.collect()), key=lambda r: r[:2])
    start, want = 0, Counter()
    for has, doc, text in texts:
        ids = encode(text)
        want[doc if has else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        start += len(ids)
    assert Counter(tuple(r) for r in tokenfile.read_digests(spark, folder).collect()) == want
    assert next(r["ids"] for r in tokenfile.read_ids(spark, folder).collect() if r["doc_id"] == 13) == encode(next(t for _, d, t in texts if d == 13))
    tokenfile.write_ids(empty, f"{folder}-empty")
    assert tokenfile.read_digests(spark, f"{folder}-empty").count() == 0


# ---- the pipeline
def test_stages_follow_each_other(spark, docs, tmp_path):
    spark.createDataFrame([(1, 1, 0), (12, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "pieces"]
    rows = plain
    for name, step in corpus_pipeline.STAGES:
        before, rows = rows, step(spark, rows, str(tmp_path))
        assert name == "pieces" or rows.columns == plain.columns
        rows = spark.createDataFrame(rows.collect(), rows.schema)
        assert name != "toxicity" or rows.count() == before.count()  # no toxic label, nothing goes
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] is not None and r["doc_id"] or 0 for r in got.collect()) == sorted(r["doc_id"] is not None and r["doc_id"] or 0 for r in rows.collect())
