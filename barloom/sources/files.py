"""Readers of tick, bar and user files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from barloom.functions.scalars import parse_timestamp_ms
from barloom.sources.schemas import HEADER_ALIASES, KLINES, REQUIRED, TRADES

SYMBOL_IN_PATH = r"symbol=([^/]+)"


def _as_text(schema: StructType) -> StructType:
    return StructType([StructField(f.name, StringType()) for f in schema])


def _typed(raw: DataFrame, schema: StructType) -> DataFrame:
    """Cast the text columns; a header line is the row whose first column is not a number."""
    first = schema[0].name
    return raw.filter(F.col(first).try_cast("bigint").isNotNull()).select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema], *[c for c in raw.columns if c not in schema.names])


def _read(spark: SparkSession, paths: str | Sequence[str], schema: StructType) -> DataFrame:
    raw = spark.read.schema(_as_text(schema)).csv(paths if isinstance(paths, str) else list(paths), recursiveFileLookup=True)
    return _typed(raw.withColumn("symbol", F.regexp_extract(F.col("_metadata.file_path"), SYMBOL_IN_PATH, 1)), schema)


def read_zipped(spark: SparkSession, paths: str | Sequence[str], schema: StructType, chunk_rows: int = 200_000) -> DataFrame:
    """CSV members of zip archives, unpacked on the executors in bounded batches; one archive is one task's unit."""
    names = schema.names

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        with archive.open(member) as lines:
                            for part in pd.read_csv(lines, header=None, names=names, dtype=str, chunksize=chunk_rows):
                                yield part.assign(path=path)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths if isinstance(paths, str) else list(paths))
    text = StructType([*_as_text(schema).fields, StructField("path", StringType())])
    raw = files.select("path", "content").mapInPandas(unpack, text)
    return _typed(raw.withColumn("symbol", F.regexp_extract("path", SYMBOL_IN_PATH, 1)).drop("path"), schema)


def read_trades(spark: SparkSession, paths: str | Sequence[str], zipped: bool = False) -> DataFrame:
    """Ticks from CSV, with or without a header line, the symbol taken from the path."""
    raw = read_zipped(spark, paths, TRADES) if zipped else _read(spark, paths, TRADES)
    return raw.select("symbol", F.col("transact_time").alias("ts_ms"), F.col("agg_trade_id").alias("trade_id"), "price", "quantity", "is_buyer_maker")


def read_klines(spark: SparkSession, paths: str | Sequence[str], zipped: bool = False) -> DataFrame:
    raw = read_zipped(spark, paths, KLINES) if zipped else _read(spark, paths, KLINES)
    return raw.select("symbol", F.col("open_time").alias("bar_open_ms"), "open", "high", "low", "close", F.col("volume").alias("v_kline"), "quote_volume")


def _header_key(value):
    return F.lower(F.translate(F.trim(value), "﻿", ""))


def read_ohlcv_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """User bars from any number of CSV files with differing headers.

    Each line is joined with the header of its file and parsed by it, so all files are one plan; the driver sees the distinct headers,
    not the files. ``line`` orders the rows of a file. ``amount`` falls back to volume times close.
    """
    where = paths if isinstance(paths, str) else list(paths)
    lines = spark.read.text(where, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value", F.monotonically_increasing_id().alias("i")).filter(F.trim("value") != "")
    heads = lines.filter("at = 0").groupBy("file").agg(_header_key(F.min_by("value", "i")).alias("form"))
    forms = {r["form"]: [h.strip().strip('"').replace(" ", "_") for h in r["form"].split(",")] for r in heads.select("form").distinct().collect()}
    if not forms:
        raise ValueError("no rows: the files are empty")
    picks: dict[str, Column | None] = {want: None for want in HEADER_ALIASES}
    for form, names in forms.items():
        found = {want: next((a for a in aliases if a in names), None) for want, aliases in HEADER_ALIASES.items()}
        lacking = [c for c in REQUIRED if found[c] is None]
        if lacking:
            raise ValueError(f"missing columns {lacking}; header {names}")
        for want, name in found.items():
            if name:
                cell = F.when(F.col("form") == form, F.col(f"cell.c{names.index(name)}"))
                picks[want] = cell if picks[want] is None else F.coalesce(picks[want], cell)
    width = max(map(len, forms.values()))
    rows = lines.join(heads, "file").filter(~((F.col("at") == 0) & (_header_key(F.col("value")) == F.col("form"))))
    rows = rows.withColumn("cell", F.from_csv("value", ", ".join(f"c{i} string" for i in range(width))))
    number = lambda c: F.trim(picks[c]).try_cast("double") if picks[c] is not None else F.lit(None).cast("double")
    out = rows.select("file", F.struct("at", "i").alias("line"), parse_timestamp_ms(F.trim(picks["timestamp"])).alias("ts_ms"),
                      *[number(c).alias(c) for c in ("open", "high", "low", "close", "volume")], number("amount").alias("_amount"))
    return out.withColumn("amount", F.coalesce("_amount", F.col("volume") * F.col("close"))).drop("_amount")


def load_universe_spec(spark: SparkSession, path: str) -> DataFrame:
    """Universe rows from a JSON-lines or CSV table, defaults filled in."""
    fields = "symbol string, market string, listing_date string, delisting_date string, perp_available boolean, oi_coverage_start string"
    raw = spark.read.schema(fields).csv(path, header=True) if path.endswith(".csv") else spark.read.schema(fields).json(path)
    return raw.withColumns({"market": F.coalesce("market", F.lit("um")), "perp_available": F.coalesce("perp_available", F.lit(True))})


def inventory(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """Path below root, size and sha256 of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", r"^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    digest = F.sha2("content", 256) if content else F.lit(None).cast("string")
    return files.select(rel.alias("path"), F.col("length").alias("size"), digest.alias("sha256"))


def verify_inventory(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row per file with a problem: missing, short, content mismatch or extra."""
    f = files.select("path", F.col("size").alias("_s"), F.col("sha256").alias("_h"), F.lit(True).alias("_f"))
    j = manifest.withColumn("_m", F.lit(True)).join(f, "path", "full_outer")
    status = (F.when(F.col("_f").isNull(), "MISSING").when(F.col("_m").isNull(), "EXTRA").when(F.col("_s") != F.col("size"), "SHORT")
              .when(~F.col("_h").eqNullSafe(F.col("sha256")), "CONTENT MISMATCH"))
    return j.select("path", status.alias("status")).filter("status is not null")


def subset_manifest(manifest: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files whose path component names a wanted symbol."""
    return manifest.withColumn("symbol", F.regexp_extract("path", SYMBOL_IN_PATH, 1)).join(symbols.select("symbol").distinct(), "symbol", "left_semi")


def forecast_export(quantiles: DataFrame, scalars: DataFrame, path: str) -> None:
    """Long CSV of quantiles per (seed, step), and the named scalars beside it."""
    names = [c for c in quantiles.columns if c not in ("seed", "step")]
    quantiles.unpivot(["seed", "step"], names, "quantile", "value").write.mode("overwrite").csv(f"{path}/quantiles", header=True)
    scalars.write.mode("overwrite").csv(f"{path}/scalars", header=True)
