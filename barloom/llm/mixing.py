"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import stage, word_count

#: Hash digits that name a range: 16**3 ranges of a source are about 4,000 rows each at 16 million rows a source.
RANGE_DIGITS = 3


def source_targets(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """One row per source with its share of all sizes.

    Sources by code point, null last, take `weights` in turn. A target above `max_epochs` times the
    source's size stops there and the excess is dealt by weight to the rest, until none is above: with
    the sources in order of size / weight, those before the first that fits at the common level are full.
    The windows run over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((turn - 1) % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", weight.cast("long").alias("weight"))
    cap = (F.col("source_size") * max_epochs).alias("cap")
    per = per.select("*", cap)
    # size / weight orders the sources as 3 * size / weight does
    up = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    whole = Window.partitionBy()
    level = ((F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             / F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
    per = per.select("source", "source_size", "weight", "cap", level.alias("level"))
    per = per.withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    common = F.min(F.when(F.col("fits"), F.struct(F.col("source_size") / F.col("weight"), F.col("level")))).over(whole)["level"]
    target = F.when(F.col("fits"), common * F.col("weight")).otherwise(F.col("cap").cast("double"))
    return per.select("source", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, size: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row.

    A row's key is the MD5 of its id (of its text where the id is null), so the order within a source is
    random and the same in every run. The key's first digits cut a source into ranges of even size,
    however many rows it has; sums run inside ranges and over the ranges' totals. A source whose budget
    holds e whole epochs takes every row e times; the rest of the budget takes rows in key order and cuts
    inside the row that reaches it.

    Nulls: a null text has size 0; null sources form one source, placed last. Repeated rows are rows
    of their own; ones with the same id stand in order of size. An empty table gives an empty result. Other columns are ignored.
    """
    text = F.col("text")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), text, F.lit("")).cast("binary"))
    sized = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                              F.coalesce(size if size is not None else word_count(text), F.lit(0)).cast("long").alias("size"), key.alias("key")))
    targets = source_targets(sized, weights, max_epochs)
    budget = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    targets = targets.withColumns({"budget": budget}).withColumns({
        "epochs": F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long")})
    targets = targets.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    ranged = sized.withColumn("part", F.substring("key", 1, RANGE_DIGITS))
    ranges = ranged.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    before = F.coalesce(F.sum("part_size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("source", "part", before.alias("part_before"))
    ranges = ranges.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select(
        F.col("r.source").alias("r_source"), F.col("part").alias("r_part"), "part_before", "source_size", "target", "epochs", "rest")
    within = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("row_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(ranges, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("part") == F.col("r_part")))
    left = F.col("rest") - F.col("part_before") - F.col("row_before")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """The mix as whole documents: a row stands as often as it is taken, to the nearest whole number, and not at all at 0.

    Same columns as `docs`. Rows without words take no room in the mix; they stay once where their source is taken at all.
    Repeated rows with one id, source and size share what they take evenly.
    """
    taken = mix(docs, weights, max_epochs)
    per = taken.groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("n"), F.max("target").alias("target"))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("n") / F.col("size") + F.lit(0.5))).otherwise((F.col("target") > 0).cast("long"))
    per = per.select(F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("size").alias("__mix_size"),
                     copies.cast("int").alias("__mix_copies")).filter("__mix_copies > 0")
    joined = docs.withColumn("__mix_words", word_count(F.col("text"))).join(
        per, F.col("doc_id").cast("long").eqNullSafe(F.col("__mix_id")) & F.col("source").cast("string").eqNullSafe(F.col("__mix_source"))
        & (F.col("__mix_words") == F.col("__mix_size")))
    return joined.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*[F.col(f"`{n}`") for n in docs.columns])
