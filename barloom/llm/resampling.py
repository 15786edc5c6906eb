"""Importance resampling towards the distribution of target texts.

A text is a bag of words and word pairs, hashed into buckets. A bucket's gain is the log ratio of its share in the target texts
to its share in the corpus; the gains of all buckets are one array, so a text is scored by looking its buckets up. Noise
from a hash of the id (Gumbel) turns the highest scores into a random draw without replacement. The cutoff of
the draw is found by a bracket: a quantile sketch names two scores around it, exact counts of the rows above and inside either
confirm the bracket or widen it, and only the rows inside are sorted.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import chunks, docs_of, folded_words, stage
from barloom.llm.ordering import numbered

BUCKETS = 10_000
#: Half-width of the first bracket, and the accuracy of the quantile sketch, as shares of the rows.
BRACKET = 0.002
ACCURACY = 1000


def buckets_of(words: list[bytes], buckets: int) -> np.ndarray:
    """Buckets of all words, then of all pairs of neighbours; a pair's checksum goes on from its first word's."""
    single = list(map(crc32, words))
    pairs = map(crc32, [b" " + w for w in words[1:]], single)
    return np.fromiter((*single, *pairs), dtype=np.int64, count=max(0, 2 * len(words) - 1)) % buckets


def _histogram(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in chunks(batches, 64):
            counts += np.bincount(np.concatenate([buckets_of(folded_words(t), buckets) for t in batch["data"].to_pylist()]), minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])

    return run


def bucket_counts(data: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all texts (column data). Tasks send one count a bucket; `buckets` totals reach the driver."""
    summed = data.select("data").mapInArrow(_histogram(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in summed.collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of smoothed shares, floored, per bucket."""
    s, t = int(corpus.sum()) + len(corpus), int(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log(((b + 1) * s) / ((a + 1) * t))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(b"%d:%s" % (seed, b"" if doc_id is None else b"%d" % doc_id)).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score(gains: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 64):
            words = [folded_words(t) for t in batch["data"].to_pylist()]
            found = [buckets_of(w, len(gains)) for w in words]
            sums = np.array([int(gains[b].sum()) for b in found], dtype=np.int64)
            n = np.array([len(b) for b in found], dtype=np.int64)
            weight = sums // np.maximum(n, 1)  # floors downwards
            drawn = np.array([noise(i, seed) for i in batch["doc_id"].to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([len(w) for w in words], pa.int64()), pa.array(n), pa.array(weight), pa.array(weight + drawn)],
                ["doc_id", "n_words", "n_features", "weight", "score"])

    return run


def scored_documents(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row, from counts over all texts of both tables."""
    data = docs_of(docs)
    wanted = target.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    gains = bucket_gains(bucket_counts(data, buckets), bucket_counts(wanted, buckets))
    return data.mapInArrow(_score(gains, seed), "doc_id long, n_words long, n_features long, weight long, score long")


def _bracket(scores: DataFrame, rows: int, taken: int, width: float, accuracy: int) -> tuple[int, int, int]:
    """(low, high, rows above high), so that the row with rank `taken` from above lies between low and high."""
    while True:
        at = 1 - taken / rows
        low, high = scores.agg(F.percentile_approx("score", F.array(F.lit(max(0.0, at - width)), F.lit(min(1.0, at + width))), F.lit(accuracy))).first()[0]
        if width >= 1:
            low, high = scores.agg(F.min("score"), F.max("score")).first()
        above, inside = scores.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < taken <= above + inside:
            return low, high, above
        width = width * 4


def draw(scored: DataFrame, percent: int = 25, least_words: int = 20, width: float = BRACKET, accuracy: int = ACCURACY) -> DataFrame:
    """The scored rows with `rank`: 1, 2, 3... for the highest `percent` of those with `least_words` words, null for the others.

    The number drawn is floored. Equal scores go by smaller doc_id (null last), then by fewer features; rows that are still equal are
    alike in every column.
    """
    scored = stage(scored.withColumn("tie", F.monotonically_increasing_id()))
    entitled = scored.filter(F.col("n_words") >= least_words)
    rows = entitled.count()
    taken = percent * rows // 100
    none = F.lit(None).cast("long")
    if taken == 0:
        return scored.withColumn("rank", none).drop("tie")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("tie")]
    low, high, above = _bracket(entitled, rows, taken, width, accuracy)
    inside = numbered(stage(entitled.filter(F.col("score").between(low, high)).select("score", "doc_id", "n_features", "tie")), order, "place")
    cut = inside.filter(F.col("place") == taken - above).first()
    same_id = F.col("doc_id").eqNullSafe(F.lit(cut["doc_id"]).cast("long"))
    earlier_id = F.col("doc_id").isNotNull() if cut["doc_id"] is None else F.coalesce(F.col("doc_id") < cut["doc_id"], F.lit(False))
    within = (F.col("n_features") < cut["n_features"]) | ((F.col("n_features") == cut["n_features"]) & (F.col("tie") <= cut["tie"]))
    drawn = (F.col("n_words") >= least_words) & ((F.col("score") > cut["score"]) | ((F.col("score") == cut["score"]) & (earlier_id | (same_id & within))))
    ranked = numbered(stage(scored.filter(drawn)), order, "rank")
    return scored.filter(~drawn).withColumn("rank", none).unionByName(ranked).drop("tie")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs; rank is null where the row is not drawn.

    Null texts have no words. A null doc_id gives the noise of an empty id. Repeated rows are scored and drawn one by one. An
    empty table gives an empty result; without target texts all buckets are compared with the smoothing alone. Other columns are ignored.
    """
    return draw(scored_documents(docs, target, buckets, seed), percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")
