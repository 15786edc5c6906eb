"""Importance resampling, prefix trie, decontamination: brute force, SQL and edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from barloom.llm import decontamination, prefix_trie, queries, resampling
from barloom.llm.ordering import numbered, running_totals

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sql(name, **tables):
    con = duckdb.connect()
    for t, df in tables.items():
        frame = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns)
        con.register(t, frame.astype({c: "Int64" for c, k in df.dtypes if k == "bigint"} | {c: object for c, k in df.dtypes if k == "string"}))
    return sorted(con.execute(queries.ORACLE[name]).fetchall(), key=repr)


def benchmark(spark, rows):
    return spark.createDataFrame([(i, t, 7, "clash") for i, t in rows], "item_id long, text string, h long, span string")


# ---- resampling
def plain_resample(docs, items, percent=25):
    def features(text):
        w = words(text)
        return w + [a + " " + b for a, b in zip(w, w[1:])]

    s, t = (Counter(crc32(f.encode()) % 10000 for _, x in rows for f in features(x)) for rows in (docs, items))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)]
    out = []
    for doc_id, text in docs:
        f = features(text)
        weight = sum(gain[crc32(x.encode()) % 10000] for x in f) // len(f) if f else 0
        h = int(sha(f"7:{'' if doc_id is None else doc_id}")[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(text))])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def test_resample_equals_plain(spark):
    rnd = random.Random(5)
    vocabulary = ["Alpha", "beta", "GAMMA", "ünï", "한국", "x1", "delta"]
    docs = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 3, 19, 20, 21, 60])))) for i in range(700)]
    items = [(i, " ".join(rnd.choice(vocabulary[:3]) for _ in range(15))) for i in range(12)]
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), benchmark(spark, items))
    assert rows_of(got) == plain_resample(docs, items)


def test_resample_edge_cases(spark, docs, empty):
    items = benchmark(spark, [(1, "The cat sat on the mat"), (None, None), (2, ""), (1, "the old dog")])
    got = rows_of(resampling.resample(docs, items))
    assert got == sql("op11_resampling", documents=docs, benchmark=items)
    assert len(got) == docs.count()
    assert resampling.resample(empty, items).count() == 0
    bare = resampling.resample(docs, items.limit(0)).filter("doc_id = 6").first()
    assert (bare["n_features"], bare["weight"], bare["rank"]) == (0, 0, None)


def test_bracket_is_widened_until_it_holds_the_cutoff(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice([None, *range(300)]), 30 if i % 5 else 3, rnd.randrange(3), 0, rnd.choice([5, 5, 5, 9, rnd.randrange(100)])) for i in range(3000)]
    scored = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long")
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for percent, width, accuracy in ((25, 1e-9, 1), (90, 0.0001, 2), (100, 0.002, 1000), (1, 0.5, 5)):
        got = [r for r in resampling.draw(scored, percent, 20, width, accuracy).collect() if r["rank"]]
        want = able[: percent * len(able) // 100]
        assert [(r["score"], r["doc_id"], r["n_features"]) for r in sorted(got, key=lambda r: r["rank"])] == [(r[4], r[0], r[2]) for r in want]
        assert sorted(r["rank"] for r in got) == list(range(1, len(want) + 1))


# ---- ordering
def test_numbers_and_totals_over_many_ranges(spark):
    rows = [(i * 7919 % 5000, i % 3) for i in range(5000)]
    df = spark.createDataFrame(rows, "at long, v long")
    assert all(r["n"] == r["at"] + 1 for r in numbered(df, [F.col("at")], "n", 100).collect())
    got = {r["at"]: r["s"] for r in running_totals(df, "at", 5000, {"s": F.col("v")}, 16).collect()}
    upto, at = 0, dict(rows)
    for i in range(5000):
        upto += at[i]
        assert got[i] == upto


# ---- prefix trie
def plain_trie(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            turns[c].append(((t is not None, t or 0), hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), (r, x)))
    turns = {c: [x for _, _, x in sorted(v)] for c, v in turns.items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c in turns:
        h = crc32(str(c).encode()) % 9
        built = tuple(turns.get(c - int(math.fmod(c, 5)), [])[:h] + turns[c][h:])
        ends[built].append(c)
        for d in range(len(built) + 1):
            nodes[built[:d]].append(c)
    kids = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, members in nodes.items():
        own = (len(members) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += own
    return sorted(((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha(",".join(map(str, sorted(ends[k])))))
                   for k, m in nodes.items()), key=repr)


SCHEMA = "conv_id long, turn long, role string, text string, depth long, part int, a string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 5, 1, "clash") for r in rows], SCHEMA)


def random_conversations(seed, convs, text="ab"):
    rnd = random.Random(seed)
    return [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice([*text, "é", "", None])) for c in convs for t in [*range(rnd.randrange(1, 12)), None][: rnd.randrange(0, 13)]]


def test_trie_equals_plain(spark):
    rows = random_conversations(3, [*range(-12, 60), 10**15, 10**15 + 3])
    df = conversations(spark, rows).repartition(4)
    want = plain_trie(rows)
    assert rows_of(prefix_trie.prefix_trie(df)) == want  # one walk
    assert rows_of(prefix_trie.prefix_trie(df, walk=300)) == want  # rounds of contraction first
    assert rows_of(df.transform(prefix_trie.prefix_trie)) == sql("op12_prefix_trie", conversations=df)


def test_trie_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    long = [(3, t, "user", f"turn {t % 70}") for t in range(150)]  # ten chunks
    same = [(c, t, "user", "hello") for c in range(100, 400) for t in range(2)]
    odd = [(None, 1, "user", "no conversation"), (50, None, None, None), (50, None, None, None), (51, 4, "a", "bc"), (52, 4, "ab", "c"), (53, 9, "user", "x" * 100_000), (54, 1, "u", "tie"), (54, 1, "u", "eit")]
    rows = long + same + odd
    assert rows_of(prefix_trie.prefix_trie(conversations(spark, rows), walk=200)) == plain_trie(rows)
    assert prefix_trie.prefix_trie(conversations(spark, rows).limit(0)).count() == 0
    alone = [(None, 1, "user", "none")]
    assert prefix_trie.prefix_trie(conversations(spark, alone)).count() == 0


# ---- decontamination
def plain_decontaminate(docs, items):
    windows = defaultdict(set)
    for i, text in items:
        w = words(text)
        k = min(10, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[s:s + k])].add("" if i is None else str(i))
    sizes = {len(k) for k in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                if (run := tuple(w[s:s + k])) in windows:
                    hit.update(range(s, s + k))
                    found |= windows[run]
        out.append((doc_id, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=repr)


def planted(seed):
    rnd = random.Random(seed)
    vocabulary = ["the", "Cat", "sat", "é", "on2"]
    items = [(i % 17, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 3, 9, 10, 11, 14, 40])))) for i in range(40)]
    docs = []
    for i in range(300):
        w = [rnd.choice([*vocabulary, f"w{rnd.randrange(50)}"]) for _ in range(rnd.randrange(0, 60))]
        if i % 3 == 0:
            part = words(rnd.choice(items)[1])
            a, b = sorted((rnd.randrange(len(part) + 1), rnd.randrange(len(part) + 1)))
            at = rnd.randrange(len(w) + 1)
            w[at:at] = part[a:b] * rnd.choice([1, 1, 2])
        docs.append((i // 2, ("-" if i % 2 else ", ").join(w).upper() if i % 5 == 0 else " ".join(w)))
    return docs, items


def test_decontamination_equals_plain(spark):
    docs, items = planted(4)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(6), benchmark(spark, items)
    want = plain_decontaminate(docs, items)
    assert sum(r[5] for r in want) > 60
    assert rows_of(decontamination.decontaminate(df, bench)) == want
    assert rows_of(decontamination.decontaminate(df, bench, bits=64)) == want  # a full map lets all through; the joins decide
    assert sql("op13_decontamination", documents=df, benchmark=bench) == want


def test_every_shared_window_shares_its_fingerprint(spark):
    rnd = random.Random(9)
    shared = [f"s{i}" for i in range(10)]
    items = [(i, " ".join([f"i{i}", *shared, f"j{i}"])) for i in range(50)]
    docs = [(d, " ".join([f"d{rnd.randrange(9)}" for _ in range(d % 7)] + (shared if d % 2 else shared[:9]) + [f"e{d}"])) for d in range(400)]
    got = rows_of(decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), benchmark(spark, items)))
    assert got == plain_decontaminate(docs, items)
    assert all(r[2:4] == ((10, 50) if r[0] % 2 else (0, 0)) for r in got)


def test_decontamination_edge_cases(spark, docs, empty):
    items = [(1, "on the MAT and looked at the old dog by the door while rain"), (None, "no id here"), (None, "one"), (2, None), (3, " , "), (3, "same line"), (4, "wört5 x5 wört6 x6 wört7 x7 wört8 x8 wört9 x9")]
    bench = benchmark(spark, items)
    got = rows_of(decontamination.decontaminate(docs, bench))
    assert got == plain_decontaminate([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    assert len([r for r in got if r[5]]) > 5
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert all(r[2:4] == (0, 0) and not r[5] for r in rows_of(decontamination.decontaminate(docs, bench.limit(0))))
