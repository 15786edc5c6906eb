"""Positions and running totals in a total order, without one task per table or per key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import stage

#: Rows of one range, at most about this many once the shuffle's own number of ranges is used up.
RANGE_ROWS = 250_000


def in_ranges(df: DataFrame, order: Sequence[Column], range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows with `part`, the number of the range of `order` they lie in; ranges are even whatever the keys.

    `df` is read twice, so it should be a staged table. The cut points of ranges come from samples and differ between runs,
    therefore the rows are staged with their range; rows equal in all of `order` share a range.
    """
    rows = df.count()
    wide = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(rows // 1000, max(wide, rows // range_rows)))
    return stage(df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))


def numbered(df: DataFrame, order: Sequence[Column], name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Row number from 1 over the whole table in `order`: a number inside the range and the rows of the ranges before it."""
    ranged = in_ranges(df, order, range_rows)
    before = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = ranged.groupBy("part").agg(F.count("*").alias("__n")).select("part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = ranged.withColumn("__at", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    return inside.join(starts, "part").withColumn(name, (F.col("__at") + F.col("__start")).cast("long")).drop("part", "__at", "__start")


def running_totals(df: DataFrame, at: str, rows: int, values: Mapping[str, Column], block: int = 65_536) -> DataFrame:
    """Inclusive running totals of `values` in the order of `at`, a gapless position from 0 to rows - 1.

    Blocks of positions hold `block` rows each; totals of blocks are summed the same way, so no task sees more than
    `block` rows of a level; `block` is a power of two.
    """
    of = f"__{at}_block"
    blocked = df.withColumns({of: F.shiftright(F.col(at).cast("long"), block.bit_length() - 1), **{f"__v_{n}": v for n, v in values.items()}})
    inside = Window.partitionBy(of).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.withColumns({n: F.sum(f"__v_{n}").over(inside) for n in values})
    blocks = -(-rows // block)
    if blocks > 1:
        totals = blocked.groupBy(of).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in values])
        upto = running_totals(totals, of, blocks, {f"__u_{n}": F.col(f"__t_{n}") for n in values}, block)
        before = upto.select(of, *[(F.col(f"__u_{n}") - F.col(f"__t_{n}")).alias(f"__c_{n}") for n in values])
        local = local.join(before, of).withColumns({n: F.col(n) + F.col(f"__c_{n}") for n in values})
    return local.select(*df.columns, *values)
