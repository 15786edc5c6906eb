"""Quality rules with risk-controlled thresholds.

Measures of a text come from one pass over it. A cutoff for a measure is certified in a stratum
(a language) when the exact binomial test on labelled good documents shows that it rejects at most a stated share of good
documents. Cutoffs of a measure are tested from lenient to strict until one fails (fixed-sequence testing, which needs no
correction inside the sequence); the level is split evenly over strata and measures (Bonferroni). Of the certified cutoffs of a
measure the one that rejects most bad documents is used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import chunks, docs_of, stage, training_row

BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_digits long"
SYMBOLS = b"#*$%&|<>"

#: Measures, and whether high (1) or low (-1) values are suspect.
MEASURES = {"symbol_rate": 1, "dup_line_rate": 1, "repeat_rate": 1, "digit_rate": 1, "long_words": 1}
#: Cutoffs tried: fixed steps on the scale of each measure, from lenient to strict; tests stop at the first that fails.
GRIDS = {
    "symbol_rate": [0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01],
    "dup_line_rate": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05],
    "repeat_rate": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05],
    "digit_rate": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05],
    "long_words": [30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0],
}


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found at two places or more, each word once."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple[bytes, bytes, bytes], int] = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered, reach = 0, 0
    for at, w in enumerate(windows):
        if seen[w] > 1:
            covered += at + 3 - max(reach, at)
            reach = at + 3
    return covered


def duplicate_lines(data: bytes) -> int:
    lines = data.split(b"\n")
    if len(lines) < 2 or len(set(lines)) == len(lines):
        return 0
    worded = [x for x in lines if x.strip(b" \t\r\x0b\x0c")]
    return len(worded) - len(set(worded))


_DIGIT = b"0123456789"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        rows = []
        for data in batch["data"].to_pylist():
            words = data.split()
            in_words = sum(map(len, words))
            # continuation bytes of UTF-8 stand in words only
            chars = in_words - (len(data) - len(data.decode("utf-8", "replace")))
            rows.append((len(words), chars, len(data) - len(data.translate(None, SYMBOLS)), duplicate_lines(data), repeated_words(words),
                         sum(1 for x in data.split(b"\n") if x.strip(b" \t\r\x0b\x0c")), len(data) - len(data.translate(None, _DIGIT))))
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits"])


def text_measures(docs: DataFrame) -> DataFrame:
    """Counts of every text; a null text counts as empty. One pass, no shuffle."""
    return docs_of(docs).mapInArrow(_measure, BASE)


def _rates(df: DataFrame) -> DataFrame:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return df.withColumns({
        "symbol_rate": per("n_symbols", "word_chars"), "dup_line_rate": per("n_dup_lines", "n_lines"), "repeat_rate": per("n_repeat_words", "n_words"),
        "digit_rate": per("n_digits", "word_chars"), "long_words": per("word_chars", "n_words"),
        "short_words": per("word_chars", "n_words"), "few_words": F.col("n_words").cast("double")})


def binomial_tail(k: int, n: int, share: float) -> float:
    """Exact P(X <= k) of a binomial with n trials, the p-value against 'more than `share` are rejected'."""
    if n == 0:
        return 1.0
    log_p, log_q = math.log(share), math.log1p(-share)
    total, term = 0.0, n * log_q
    total = math.exp(term)
    for i in range(1, k + 1):
        term += math.log(n - i + 1) - math.log(i) + log_p - log_q
        total += math.exp(term)
    return min(1.0, total)


def certified_cutoffs(rated: DataFrame, labels: DataFrame, max_false_rejection: float = 0.05, level: float = 0.05, folds: int = 5, held_out: int = 1) -> DataFrame:
    """stratum, measure, cutoff: for each stratum and measure the certified cutoff that rejects most bad documents.

    Good documents are labelled ones with quality 1 in the training folds. The level is split over strata and measures, the share of
    good documents that may be rejected over the measures, so a stratum's measures together keep to `max_false_rejection` with
    confidence 1 - level over all strata. A measure with no certified cutoff, or none that rejects a bad document, sets
    none. What is gathered is one row per (stratum, measure, cutoff).
    """
    label = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    known = rated.join(label, "doc_id").filter(training_row(F.col("doc_id"), folds, held_out))
    tried = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(i).alias("turn"), F.lit(c).alias("cutoff"), (F.col(m) > c if MEASURES[m] > 0 else F.col(m) < c).alias("hit"))
                                for m, grid in GRIDS.items() for i, c in enumerate(grid)]))
    # only counts leave this step: one row per (stratum, measure, cutoff)
    counts = known.select("stratum", "quality", tried.alias("t")).groupBy("stratum", "t.measure", "t.turn", "t.cutoff").agg(
        F.sum((F.col("quality") == 1).cast("long")).alias("good"), F.sum(((F.col("quality") == 1) & F.col("t.hit")).cast("long")).alias("good_hit"),
        F.sum(((F.col("quality") == 0) & F.col("t.hit")).cast("long")).alias("bad_hit"))
    # one window over a few dozen rows a stratum
    counts = counts.withColumn("tests", F.count(F.when(F.col("turn") == 0, 1)).over(Window.partitionBy()))
    share = max_false_rejection / len(MEASURES)

    @F.pandas_udf("double")
    def p_value(k: pd.Series, n: pd.Series) -> pd.Series:
        # a count of hits above the allowed share cannot pass
        return pd.Series([binomial_tail(a, b, share) if a <= b * share else 1.0 for a, b in zip(k.astype(int), n.astype(int), strict=True)])

    passes = (F.col("p") <= F.lit(level) / F.col("tests")).alias("passes")
    so_far = F.min("passes").over(Window.partitionBy("stratum", "measure").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    passed = counts.withColumn("p", p_value("good_hit", "good")).select("*", passes).withColumn("certified", so_far).filter("certified and bad_hit > 0")
    best = passed.groupBy("stratum", "measure").agg(F.max(F.struct("bad_hit", (-F.col("good_hit")).alias("kept"), "cutoff")).alias("best"))
    return best.select("stratum", "measure", F.col("best.cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, max_false_rejection: float = 0.05, level: float = 0.05) -> DataFrame:
    """Counts, base_failed and kept of every row of docs.

    base_failed: fewer than 50 words, or more than half of the words in repeated windows. kept: not base_failed and no
    cutoff of the row's language exceeded; a language without certified cutoffs keeps what the base keeps.
    Rows without a language form a stratum of their own and are judged by its cutoffs.
    Repeated rows are judged alike. Rows with null ids are judged but never serve as labelled rows. Empty labels set no cutoff.
    """
    measured = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("data"), F.coalesce("lang", F.lit("")).alias("stratum"))
                     .mapInArrow(_measure_strata, "stratum string, " + BASE))
    rated = _rates(measured)
    cutoffs = certified_cutoffs(rated, labels, max_false_rejection, level)
    wide = cutoffs.groupBy("stratum").pivot("measure", list(MEASURES)).agg(F.first("cutoff"))
    wide = wide.select("stratum", *[F.col(m).alias(f"cut_{m}") for m in MEASURES])
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    beyond = F.lit(False)
    for m, side in MEASURES.items():
        over = F.col(m) > F.col(f"cut_{m}") if side > 0 else F.col(m) < F.col(f"cut_{m}")
        beyond = beyond | F.coalesce(over, F.lit(False))
    return rated.join(wide, "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & ~beyond).alias("kept"))


def _measure_strata(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        for out in _measure(iter([batch])):
            yield pa.RecordBatch.from_arrays([batch["stratum"], *out.columns], ["stratum", *out.schema.names])
