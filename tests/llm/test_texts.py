"""Pieces, fingerprints, quality measures, personal data."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from barloom.llm import pieces, pii, quality, simhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# ---- pieces
def test_viterbi_equals_every_segmentation():
    p = pieces.load(public_tokenizers.path(pieces.MODEL))
    scores = {k: (i, s) for k, (i, _, s) in ((k, p.automaton.get(k)) for k in p.automaton.keys())}
    rnd = random.Random(2)

    def plain(text):
        best, back, n = [0.0] + [-math.inf] * len(text), [None] * (len(text) + 1), len(text)
        for e in range(1, n + 1):
            for s in range(e):
                got = scores.get(text[s:e])
                if got and best[s] + got[1] > best[e]:
                    best[e], back[e] = best[s] + got[1], (s, [got[0]])
            if text[e - 1] not in scores and best[e - 1] + p.unknown > best[e]:
                best[e], back[e] = best[e - 1] + p.unknown, (e - 1, [p.byte_ids[b] for b in text[e - 1].encode()])
        out = []
        while n:
            n, ids = back[n]
            out = ids + out
        return out, best[-1]

    for _ in range(400):
        text = "".join(rnd.choice(" \nabethdnsérü한٣😀.,<0xab") for _ in range(rnd.randint(1, 40)))
        coded, score = p.encode(text)
        ids, want = plain(pieces.SPACE + text.replace(" ", pieces.SPACE))
        assert np.frombuffer(coded, "<u4").tolist() == ids and math.isclose(score, want)
        assert p.decode(ids) == text


def test_encode_and_decode_documents(docs, empty):
    encoded = pieces.encode_documents(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.filter("doc_id is not null").collect()}
    for r in pieces.decode_documents(encoded).filter("doc_id is not null").collect():
        assert r["text"] == (texts[r["doc_id"]] or "").replace(pieces.SPACE, " ")
    digests = {r["doc_id"]: r for r in pieces.round_trip(docs).collect()}
    assert digests[6]["n_tokens"] == 0 and digests[8]["restored"] and not digests[13]["restored"]
    assert pieces.round_trip(empty).count() == 0 and pieces.encode_documents(empty).count() == 0


# ---- fingerprints
def plain_fingerprint(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def plain_classes(prints, radius=3):
    found, todo = {}, set(prints)
    while todo:
        queue = [todo.pop()]
        members = list(queue)
        while queue:
            a = queue.pop()
            near = [b for b in todo if (a ^ b).bit_count() <= radius]
            todo.difference_update(near)
            queue += near
            members += near
        found |= {m: min(members) for m in members}
    return found


def test_near_duplicates_equal_brute_force(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    prints = {r["text"]: plain_fingerprint(r["text"]) for r in rows}
    root = plain_classes(set(prints.values()))
    first = {}
    for r in rows:
        if r["doc_id"] is not None:
            c = root[prints[r["text"]]]
            first[c] = min(first.get(c, r["doc_id"]), r["doc_id"])
    want = Counter((r["doc_id"], f"{prints[r['text']]:016x}", first.get(root[prints[r["text"]]])) for r in rows)
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_links_of_crowded_shards_are_whole(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(6)]
    prints = {0} | {b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 4))) for b in base for _ in range(120)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), tree_size=16).collect()  # forces several trees and slices
    parent = {p: p for p in prints}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for r in links:
        a, b = find(r["u"] % (1 << 64)), find(r["v"] % (1 << 64))
        parent[max(a, b)] = min(a, b)
    assert {p: find(p) for p in prints} == plain_classes(prints)


def test_bk_tree_search_equals_brute_force():
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 64, 300).astype(np.uint64) | (rng.integers(0, 4, 300).astype(np.uint64) << np.uint64(60)))
    forest = simhash.Forest(fps, np.zeros(len(fps), dtype=np.int64))
    q, n = forest.search(fps, np.zeros(len(fps), dtype=np.int64), 3)
    want = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3}
    assert set(zip(q.tolist(), n.tolist())) == want


def test_keep_one_of_each_component(docs, empty):
    kept = [r["doc_id"] for r in simhash.keep_one(docs).collect()]
    classes = {r["component_id"] for r in simhash.near_duplicates(docs).collect() if r["component_id"] is not None}
    assert sorted(i for i in kept if i is not None) == sorted(classes) and kept.count(None) == 1
    assert simhash.keep_one(docs).columns == docs.columns and simhash.keep_one(empty).count() == 0


def similarity(a, b):
    a, b = (set(zip(*[t.split()[i:] for i in range(5)])) for t in (a, b))
    return len(a & b) / len(a | b)


def test_keep_one_drops_near_copies_and_keeps_look_alikes(spark):
    rnd = random.Random(7)

    def prose(n):
        return [f"w{rnd.randrange(400)}" for _ in range(n)]

    def near(words, least):
        """Words replaced one by one at random places while the similarity stays at `least` or more."""
        out = list(words)
        while True:
            more = list(out)
            more[rnd.randrange(len(out))] = f"v{rnd.randrange(10**6)}"
            if similarity(" ".join(words), " ".join(more)) < least:
                return out
            out = more

    rows, groups = [], []
    for least in (0.8, 0.9, 0.95):
        for _ in range(20):
            base = prose(300)
            groups.append(len(rows))
            rows += [" ".join(base), " ".join(near(base, least))]
    for _ in range(20):  # look-alikes: half of the words are shared, and similarity just below 0.8
        base = prose(300)
        groups += [len(rows), len(rows) + 1, len(rows) + 2]
        below = near(base, 0.8)
        while similarity(" ".join(base), " ".join(below)) >= 0.8:
            below[rnd.randrange(300)] = f"u{rnd.randrange(10**6)}"
        rows += [" ".join(base), " ".join(below), " ".join(base[:150] + prose(150))]
    hot = prose(200)
    groups.append(len(rows))
    rows += [" ".join(hot)] + [" ".join(hot[:i] + [f"h{i}"] + hot[i + 1:]) for i in range(10, 190)]
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4))
    assert sorted(r["doc_id"] for r in kept.collect()) == groups


def test_keep_one_keeps_different_texts_of_one_id(spark):
    rows = [(1, "a clean text of its own"), (1, "another text under this id"), (2, "another text under this id"), (3, "the third text is alone"), (3, "the third text is alone")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(tuple(r) for r in kept.collect()) == sorted(set(rows[:2] + rows[3:]))


def test_a_crowd_below_the_similarity_makes_few_pairs(spark):
    """Two thousand texts that share half to three quarters of their words meet in band buckets, and are not listed pair by pair."""
    rnd = random.Random(11)
    shared = [f"w{rnd.randrange(400)}" for _ in range(120)]
    texts = {i: " ".join(shared + [f"o{rnd.randrange(10**6)}" for _ in range(rnd.randrange(42, 110))]) for i in range(1200)}
    for i in range(0, 40, 2):  # among them twenty pairs that are near copies
        words = texts[i].split()
        words[-3] = "changed"
        texts[i + 1] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    sets = docs.select(F.col("doc_id").alias("key"), F.col("text").cast("binary").alias("data")).mapInArrow(simhash._shingle_set, "key long, shingles binary")
    members = sets.select("key", F.expr("int(octet_length(shingles) / 8)").alias("n"), F.col("key").alias("root"))
    pairs = {(r["u"], r["v"]) for r in simhash.crowded_pairs(members, sets).collect()}
    assert {(i, i + 1) for i in range(0, 40, 2)} <= pairs
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept == set(texts) - set(range(1, 40, 2))
    assert len(pairs) < 2 * len(texts)  # of 720,000


def test_crowded_pairs_lose_none(spark):
    """Random sets, many of them alike: every pair of similarity 0.8 or more is a candidate."""
    rnd = random.Random(12)
    groups = [[rnd.getrandbits(64) for _ in range(60)] for _ in range(8)]
    held = []
    for i in range(240):
        own = rnd.sample(groups[i % 8], rnd.randrange(50, 61))
        held.append(sorted(set(own + [rnd.getrandbits(64) for _ in range(rnd.randrange(0, 4))])))
    sets = spark.createDataFrame([(i, bytearray(np.array(s, dtype="<u8").tobytes())) for i, s in enumerate(held)], "key long, shingles binary")
    members = spark.createDataFrame([(i, len(s), i) for i, s in enumerate(held)], "key long, n int, root long")
    got = {(r["u"], r["v"]) for r in simhash.crowded_pairs(members, sets).collect()}
    want = {(i, j) for i in range(240) for j in range(i + 1, 240) if 5 * len(set(held[i]) & set(held[j])) >= 4 * len(set(held[i]) | set(held[j]))}
    assert len(want) > 100 and want <= got


def test_near_copies_meet_in_the_trees_of_fingerprints(spark):
    """With no band in common, near copies are found through SimHash fingerprints; equal fingerprints alone make no link."""
    rnd = random.Random(13)
    rows = []
    for _ in range(30):  # one word of 900 differs
        words = [f"w{rnd.randrange(400)}" for _ in range(900)]
        rows += [" ".join(words), " ".join(words[:700] + ["changed"] + words[701:])]
    rows += ["go on now " * 50 + " ".join(f"t{rnd.randrange(10**6)}" for _ in range(12)) for _ in range(3)]  # three shingles outvote all others
    prints = simhash.fingerprints([r.encode() for r in rows]).tolist()
    assert prints[-1] == prints[-2] == prints[-3] and similarity(rows[-1], rows[-2]) < 0.8
    near = {(i, i + 1) for i in range(0, 60, 2) if (prints[i] ^ prints[i + 1]).bit_count() <= 3}
    assert len(near) > 10 and any(prints[i] != prints[j] for i, j in near)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    printed = simhash.near_copy_prints(docs).withColumn("bands", F.array(F.col("key")))
    of = {r["key"]: r["doc_id"] for r in printed.collect()}
    assert {tuple(sorted((of[r["u"]], of[r["v"]]))) for r in simhash.near_copy_links(docs, printed).collect()} == near


def test_keep_one_with_a_map_column(spark):
    rows = [(1, "a text that stands twice", {"k": 1}), (2, "a text that stands twice", {"k": 2}), (3, "another one", None)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>"))
    assert sorted((r["doc_id"], r["more"]) for r in kept.collect()) == [(1, {"k": 1}), (3, None)]


# ---- quality
def plain_measures(text):
    text = text or ""
    words = WORDS.findall(text)
    runs = list(zip(words, words[1:], words[2:]))
    times, marked = Counter(runs), set()
    for i, r in enumerate(runs):
        if times[r] > 1:
            marked |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


def test_measures_equal_brute_force(docs, labels, empty):
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r["doc_id"], *plain_measures(r["text"])) for r in rows)
    got = quality.judge(docs, labels).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got)
    assert quality.judge(empty, labels).count() == 0 and quality.judge(docs, labels.limit(0)).count() == len(rows)


def test_binomial_tail():
    for k, n, p in ((0, 10, 0.3), (3, 20, 0.05), (20, 20, 0.5), (5, 0, 0.1)):
        want = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1)) if n else 1.0
        assert math.isclose(quality.binomial_tail(k, n, p), min(1.0, want), rel_tol=1e-9)


def test_cutoffs_spare_good_documents(spark):
    word = " ".join(f"w{i}" for i in range(80))
    rows = [(i, " ".join(f"{w}x{i}" for w in word.split()) + (" ### $$$ &&& ***" * 10 if i % 10 == 0 else ""), "en") for i in range(4000)]
    labels = spark.createDataFrame([(i, 0 if i % 10 == 0 else 1) for i, _, _ in rows], "doc_id long, quality int")
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()
    assert all(r["kept"] == (r["doc_id"] % 10 != 0) for r in got)
    few = labels.filter("doc_id < 300")  # too few to certify anything
    assert all(r["kept"] for r in quality.judge(spark.createDataFrame(rows[:300], "doc_id long, text string, lang string"), few).collect())


# ---- personal data
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def holds(kind, m):
        d = "".join(c for c in m if c in "0123456789")
        luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    found = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if holds(k, m[0])]
    return sorted(found, key=lambda s: (s[1], list(BASE).index(s[0])))


def test_base_spans_equal_patterns():
    rnd = random.Random(1)
    for _ in range(20_000):
        text = "".join(rnd.choice("01a@.+-  ().b5%é") for _ in range(rnd.randint(0, 40)))
        assert [s for s in pii.find_spans(text) if s[0] in BASE] == plain_spans(text)


def test_added_spans():
    text = "see https://a.example/x?y=1, IBAN: DE89 3704 0044 0532 0130 00. account 12345678"
    got = [(k, text[a:b]) for k, a, b in pii.find_spans(text) if k not in BASE]
    assert got == [("url", "https://a.example/x?y=1,"[:-1]), ("account", "DE89 3704 0044 0532 0130 00"), ("account", "12345678")]


def test_repeated_schemes_cost_their_length():
    for text in ("ahttp://" * 130_000, "http://" * 150_000, "x http://a " * 90_000):
        begun = time.perf_counter()
        pii.find_spans(text)
        assert time.perf_counter() - begun < 20
    assert [k for k, _, _ in pii.find_spans("ahttp://x b http://y")] == ["url"]


def test_scan_and_mask_documents(docs, empty):
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in pii.scan_documents(docs).collect():
        want = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(pii.digest(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in want) for k in BASE]
    out = {r["doc_id"]: r for r in pii.mask_documents(docs).collect()}
    assert out[12]["text"] == "Mail <email> or <phone>, card <card>, host <ip> and 10.0.0.256" and out[12]["n_chars"] == len(out[12]["text"])
    assert out[6]["text"] is None and out[8]["text"] == texts[8] and pii.mask_documents(docs).columns == docs.columns
    assert pii.scan_documents(empty).count() == 0 and pii.mask_documents(empty).count() == 0


def test_long_runs_of_zeros_and_any_case():
    assert pii.find_spans("0" * 5000 + ".1.1.1") == [("ip", 0, 5006)]
    for text in ("see HTTP://Example.com/a", "see hTTps://Example.com/a", "İ see FTP://Example.com/a"):
        assert [text[a:b] for k, a, b in pii.find_spans(text) if k == "url"] == [text.split("see ")[1]]
    assert [s for s in pii.find_spans("my aCCoUnT: 12345678") if s[0] == "account"] == [("account", 12, 20)]
