"""Content hashes that ignore file layout and see every value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.frames import CHUNK, Timeline, with_chunks


def canonical_json(columns: Sequence[str]) -> Column:
    """JSON object with sorted keys, no spaces and ASCII letters only; NULL is written as null."""
    text = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    # a character beyond ASCII becomes the escapes of its UTF-16 units
    units = F.regexp_replace(F.lower(F.hex(F.encode(text, "UTF-16BE"))), "(.{4})", "$1 ")
    escaped = F.array_join(F.transform(F.split(F.rtrim(units), " "), lambda u: F.when(
        u < "0080", F.chr(F.conv(u, 16, 10).cast("bigint"))).otherwise(F.concat(F.lit("\\u"), u))), "")
    return F.when(text.rlike("[^\\x00-\\x7F]"), escaped).otherwise(text)


def row_text(columns: Sequence[str]) -> Column:
    """One row as text, its values divided by bars; NULL is the character NUL, and bars and backslashes in values are escaped,
    so different rows have different texts."""
    def cell(c: str) -> Column:
        text = F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
        return F.coalesce(text, F.lit("\0"))

    return F.concat_ws("|", *[cell(c) for c in columns])


def dataset_hash(df: DataFrame, tl: Timeline, text: Column) -> DataFrame:
    """sha256 per key over its rows in time order.

    A chunk holds at most ``chunk`` rows, so its ordered digest is bounded; the key's hash is taken over the ordered
    chunk digests (64 characters per chunk).
    """
    rows = with_chunks(df, tl).select(*tl.on_chunk, F.struct(F.col(tl.ts).alias("t"), text.alias("v")).alias("r"))
    joined = lambda arr, f: F.array_join(F.transform(F.sort_array(arr), f), ";")
    chunks = rows.groupBy(*tl.on_chunk).agg(
        F.sha2(joined(F.collect_list("r"), lambda r: F.concat(r["t"].cast("string"), F.lit("="), r["v"])), 256).alias("_h"))
    return chunks.groupBy(*tl.keys).agg(
        F.sha2(joined(F.collect_list(F.struct(F.col(CHUNK).alias("c"), F.col("_h").alias("h"))), lambda r: r["h"]), 256)
        .alias("dataset_hash"))


def universe_hash(hashes: DataFrame, groups: int = 256) -> DataFrame:
    """Merkle hash over (symbol, hash): ordered digests of symbol groups, then one digest of those."""
    g = F.conv(F.substring(F.md5("symbol"), 1, 2), 16, 10).cast("int")
    leaf = F.struct("symbol", "dataset_hash")
    level = hashes.groupBy(g.alias("g")).agg(F.sha2(F.array_join(F.transform(
        F.sort_array(F.collect_list(leaf)), lambda r: F.concat(r["symbol"], F.lit(":"), r["dataset_hash"])), ";"), 256).alias("h"))
    return level.agg(F.sha2(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("g", "h"))), lambda r: r["h"]), ";"), 256).alias("universe_hash"),
        F.count("*").alias("_n")).select("universe_hash")


def config_hash(columns: Sequence[str]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def artifact_reuse_failures(stored: DataFrame, wanted: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Wanted artifacts that may not be reused, with the fields that differ (NULL equals NULL)."""
    s = stored.select(*keys, *[F.col(f).alias(f"_s_{f}") for f in fields], F.lit(True).alias("_there"))
    none = F.lit(None).cast("string")
    bad = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_s_{f}")), f).otherwise(none) for f in fields]))
    out = wanted.join(s, list(keys), "left")
    return out.select(*keys, F.when(F.col("_there").isNull(), F.array(F.lit("absent"))).otherwise(bad).alias("failures")
                      ).filter(F.size("failures") > 0)
