"""Benchmark decontamination by winnowing.

A window is a run of 10 words. Of the 6 runs of 5 words (grams) inside a window the one with the smallest hash, the last of
equals, is its fingerprint; neighbouring windows mostly share theirs, so few grams are kept, and two texts that share a
window share its fingerprint at the same place. Fingerprints of documents are joined with those of the benchmark, and a hit is
extended to the windows that chose the fingerprint, which are compared word by word. An item of fewer than 10 words is one window
and its own fingerprint.

Tasks drop fingerprints that a bit map of fixed size rules out; the map only saves work, the joins decide. Hits are joined per
distinct span of words and items per distinct class of windows, so a passage that many documents or items share
is met once, not once per pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import chunks, docs_of, folded_words, stage

WINDOW = 10
GRAM = 5
#: Bits of the map that documents' fingerprints are held against: 2 MiB however large the benchmark is.
MAP_BITS = 1 << 24

_STEP, _FINAL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SPANS = pa.list_(pa.struct([("h", pa.int64()), ("kind", pa.int32()), ("span", pa.string()), ("starts", pa.list_(pa.int32()))]))


def gram_hashes(words: np.ndarray, width: int, kind: int) -> np.ndarray:
    """A 64-bit hash of every run of `width` word hashes; runs of different kinds differ."""
    n = max(0, len(words) - width + 1)
    h = np.full(n, kind, dtype=np.uint64)
    for j in range(width):
        h = (h ^ (h >> np.uint64(29)) ^ words[j:j + n]) * _STEP
    return (h ^ (h >> np.uint64(32))) * _FINAL


def window_prints(grams: np.ndarray, per_window: int) -> np.ndarray:
    """For every run of `per_window` grams the index of its smallest, the last of equals."""
    n = max(0, len(grams) - per_window + 1)
    at = np.arange(n) + per_window - 1
    for j in range(per_window - 2, -1, -1):
        other = np.arange(n) + j
        at = np.where(grams[other] < grams[at], other, at)
    return at


def _texts(batch: pa.RecordBatch) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, hashes of all words in a row, and where each text starts in them."""
    words = [folded_words(t) for t in batch["data"].to_pylist()]
    starts = np.cumsum([0] + [len(w) for w in words])
    hashes = np.fromiter((h for w in words for h in map(crc32, w)), dtype=np.uint64, count=int(starts[-1]))
    return words, hashes, starts


def _inside(starts: np.ndarray, width: int) -> np.ndarray:
    """Whether the `width` words from each place on belong to one text."""
    ends = np.repeat(starts[1:], np.diff(starts))
    return np.arange(len(ends)) + width <= ends


def _item_windows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 64):
            out: list[tuple[str, int, int, str]] = []
            for item, data in zip(batch["item"].to_pylist(), batch["data"].to_pylist()):
                words = folded_words(data)
                kind = min(len(words), window)
                if not kind:
                    continue
                hashes = np.fromiter(map(crc32, words), dtype=np.uint64, count=len(words))
                grams = gram_hashes(hashes, gram if kind == window else kind, kind)
                at = window_prints(grams, window - gram + 1 if kind == window else 1)
                out.extend((item, kind, h, b" ".join(words[s:s + kind]).decode()) for s, h in enumerate(grams[at].view(np.int64).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.string()))],
                                             ["item", "kind", "h", "window"])

    return run


def item_windows(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Distinct (item, kind, h, window): the windows of every item, their length in words and their fingerprint; a null item_id is ''."""
    data = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    return data.mapInArrow(_item_windows(window, gram), "item string, kind int, h long, window string").distinct()


def print_map(prints: DataFrame, bits: int = MAP_BITS) -> np.ndarray:
    """A map of `bits` bits with the bit of every fingerprint (column h) set. At most bits / 64 numbers reach the driver."""
    bit = F.col("h").bitwiseAND(F.lit(bits - 1))
    one = F.expr(f"shiftleft(1L, int((h & {bits - 1}L) % 64))")
    out = np.zeros(bits // 64, dtype=np.int64)
    for r in prints.select(F.shiftright(bit, 6).cast("int").alias("at"), one.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():
        out[r["at"]] = r["bits"]
    return out.view(np.uint64)


def _known(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _doc_spans(bits: np.ndarray, kinds: Sequence[int], window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words, hashes, starts = _texts(batch)
            found: list[dict[tuple[int, int, str], list[int]]] = [{} for _ in words]

            def add(kind: int, h: int, first: int, last: int) -> None:
                """Windows starting at first to last chose one fingerprint."""
                doc = int(np.searchsorted(starts, first, "right")) - 1
                at = first - int(starts[doc])
                span = b" ".join(words[doc][at:at + last - first + kind]).decode()
                found[doc].setdefault((h, kind, span), []).append(at)

            for kind in kinds:
                grams = gram_hashes(hashes, gram if kind == window else kind, kind)
                at = window_prints(grams, window - gram + 1 if kind == window else 1)
                hits = np.flatnonzero(_inside(starts, kind)[:len(at)] & _known(bits, grams)[at])
                if not len(hits):
                    continue
                new = np.concatenate([[True], (np.diff(hits) != 1) | (np.diff(at[hits]) != 0)])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(hits)) - 1
                for a, b in zip(hits[first].tolist(), hits[last].tolist()):
                    add(kind, int(grams[at[a]].view(np.int64)), a, b)
            spans = [[{"h": h, "kind": k, "span": s, "starts": p} for (h, k, s), p in f.items()] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(np.diff(starts)), pa.array(spans, _SPANS)], ["doc_id", "n_words", "spans"])

    return run


def covered(spans: str = "spans") -> str:
    """SQL for the number of places in the union of half-open intervals, an array of (a, b)."""
    return (f"aggregate(array_sort({spans}), named_struct('n', 0L, 'reach', 0), (s, x) -> named_struct("
            "'n', s.n + greatest(0, x.b - greatest(x.a, s.reach)), 'reach', greatest(s.reach, x.b)), s -> s.n)")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = MAP_BITS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs.

    n_hit counts the words of a document that lie inside an occurrence of a window of any item; n_items the items with such
    windows, whose ids are sorted as strings, joined by commas and hashed. Null and empty texts have no words, and no hits. A null
    item_id counts as one item named ''; rows that share an item_id are one item. Repeated documents are rows of their own. Other columns are
    ignored; an empty table of documents gives an empty result, an empty benchmark no hits.
    """
    occurring = stage(item_windows(items, window, gram))
    # windows with the same items form a class, named by one of its windows
    classed = occurring.groupBy("kind", "window", "h").agg(
        F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("x"), F.bit_xor(F.xxhash64(F.lit(2), "item")).alias("y"), F.count("*").alias("n"))
    windows = stage(classed.withColumn("wid", F.monotonically_increasing_id()))
    windows = stage(windows.join(windows.groupBy("x", "y", "n").agg(F.min("wid").alias("class")), ["x", "y", "n"]).select("kind", "window", "h", "wid", "class"))
    prints = windows.select("h").distinct()
    kinds = sorted(r["kind"] for r in windows.select("kind").distinct().collect())  # lengths from 1 to `window`

    found = stage(docs_of(docs).mapInArrow(
        _doc_spans(print_map(prints, bits), kinds, window, gram),
        "doc_id long, n_words long, spans array<struct<h:long,kind:int,span:string,starts:array<int>>>").withColumn("row", F.monotonically_increasing_id()))
    spans = found.filter(F.size("spans") > 0).select("row", F.inline("spans"))
    # fingerprints in common, then the windows of the span that an item has too
    live = spans.select("h", "kind", "span").distinct().join(prints, "h", "left_semi")
    pieces = F.expr("transform(sequence(0, size(split(span, ' ')) - kind), i -> array_join(slice(split(span, ' '), i + 1, kind), ' '))")
    tried = live.select("kind", "span", F.posexplode(pieces).alias("off", "window"))
    hits = tried.join(windows.select("kind", "window", "class"), ["kind", "window"]).groupBy("kind", "span").agg(
        F.collect_set("off").alias("offs"), F.collect_set("class").alias("classes"))
    # a span holds at most window - gram + 1 windows
    placed = spans.join(hits, ["kind", "span"]).select("row", "classes", F.expr(
        "flatten(transform(offs, o -> transform(starts, s -> named_struct('a', s + o, 'b', s + o + kind))))").alias("places"))
    per_row = placed.groupBy("row").agg(F.flatten(F.collect_list("places")).alias("places"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("classes")))).alias("classes"))
    per_row = stage(per_row.select("row", F.expr(covered("places")).alias("n_hit"), "classes", F.md5(F.array_join(F.col("classes").cast("array<string>"), ",").cast("binary")).alias("set")))
    # documents that hit the same classes share their items
    sets = per_row.groupBy("set").agg(F.first("classes").alias("classes")).select("set", F.explode("classes").alias("class"))
    named = windows.filter("wid = class").join(occurring, ["kind", "window", "h"]).select("class", "item")
    items_of = sets.join(named, "class").groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items")).select(
        "set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    hit = per_row.select("row", "n_hit", "set").join(items_of, "set").drop("set")
    with_hits = found.filter(F.size("spans") > 0).select("row", "doc_id", "n_words").join(hit, "row", "left").drop("row")
    without = found.filter(F.size("spans") == 0).select("doc_id", "n_words", F.lit(None).cast("long").alias("n_hit"), F.lit(None).cast("long").alias("n_items"), F.lit(None).cast("string").alias("items_sha256"))
    out = with_hits.unionByName(without)
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                      F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
