"""The feature lake, shard store, ledger and artifact tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scalars import ms_to_date, ms_to_month
from barloom.operators.bars import bar_open
from barloom.session import pin
from barloom.sources.versions import Store, content_digest

FLOATS = [*[f"x_{d}" for d in range(16)], "sigma", "raw_ret_close", "raw_range"]


def storage_types(df: DataFrame) -> DataFrame:
    """float32 features and byte masks, as stored."""
    casts = {c: F.col(c).cast("float") for c in FLOATS if c in df.columns}
    casts.update({c: F.col(c).cast("byte") for c in df.columns if c.startswith("m_") or c == "is_stale"})
    return df.withColumns(casts)


def write_lake(df: DataFrame, root: str, frequency: str = "1m", by: str = "date", mode: str = "overwrite", files_per_part: int = 1) -> None:
    """Hive partitions (symbol, frequency, date or month), zstd, rows in time order inside a file.

    Only the partitions present in ``df`` are replaced. Rows are spread by (symbol, partition), so a large symbol is
    written by many tasks; ``files_per_part`` splits a single partition further.
    """
    stamp = ms_to_date("bar_open_ms") if by == "date" else ms_to_month("bar_open_ms")
    out = storage_types(df).withColumns({"frequency": F.lit(frequency), by: stamp})
    spread = ["symbol", by] if files_per_part == 1 else ["symbol", by, F.pmod(F.xxhash64("bar_open_ms"), F.lit(files_per_part))]
    (out.repartition(*spread).sortWithinPartitions("symbol", by, "bar_open_ms")
     .write.mode(mode).option("compression", "zstd").option("partitionOverwriteMode", "dynamic")
     .partitionBy("symbol", "frequency", by).parquet(root))


def connect_lake(spark: SparkSession, root: str, view: str = "bars") -> DataFrame:
    df = spark.read.parquet(root)
    df.createOrReplaceTempView(view)
    return df


def compact_lake(spark: SparkSession, src: str, dst: str) -> None:
    """Day partitions to month partitions; the date stays as a column. The content must not change: digests of both sides are compared per symbol."""
    days = spark.read.parquet(src).withColumn("date", F.col("date").cast("string"))
    (days.withColumn("month", ms_to_month("bar_open_ms")).repartition("symbol", "month").sortWithinPartitions("symbol", "month", "bar_open_ms")
     .write.mode("overwrite").option("compression", "zstd").partitionBy("symbol", "frequency", "month").parquet(dst))
    columns = sorted(days.columns)
    was, now = (content_digest(df.select(columns), ["symbol"]) for df in (days, spark.read.parquet(dst)))
    changed = was.exceptAll(now).unionByName(now.exceptAll(was)).first()
    if changed is not None:
        raise ValueError(f"compaction changed the content of {changed['symbol']}")


def partition_check(lake: DataFrame, manifest: DataFrame) -> DataFrame:
    """Symbols on one side only, and symbols whose bar count differs from the manifest."""
    have = lake.groupBy("symbol").agg(F.count("*").alias("n_lake"))
    j = manifest.select("symbol", F.col("n_bars").alias("n_manifest")).join(have, "symbol", "full_outer")
    return j.filter(~F.col("n_lake").eqNullSafe(F.col("n_manifest")))


# ---- shards --------------------------------------------------------------------------------------------------

def shard_store(root: str) -> Store:
    return Store(root, ("symbol", "month"))


def reduce_shards(trades: DataFrame, root: str, reduce: Callable[[DataFrame], DataFrame], step: int) -> DataFrame:
    """Bring the store up to the trades, reducing only (symbol, month) shards whose trades changed; returns the keys of those rebuilt.

    A trade belongs to the month in which its bar of ``step`` milliseconds opens, so a shard holds whole bars only. The digest of
    a shard's trades stands in the manifest of the version that holds its bars. Shards without trades leave the store. A shard that is lost or altered
    is rebuilt like a changed one. Readers see the version before until all is written.
    """
    spark, store = trades.sparkSession, shard_store(root)
    x = trades.withColumn("month", ms_to_month(bar_open("ts_ms", step)))
    keys = list(store.keys)
    plan = pin(content_digest(x, keys).withColumnsRenamed({"n_rows": "n_trades", "h1": "source_h1", "h2": "source_h2"}))
    source = ["n_trades", "source_h1", "source_h2"]
    stored = store.manifest(spark)
    if stored is None:
        todo = plan
    else:
        sound = stored.join(store.check(spark).select(*keys), keys, "left_anti")
        todo = pin(plan.join(sound.select(*keys, *source), [*keys, *source], "left_anti"))
    part = reduce(x.join(todo.select(*keys), keys, "left_semi").drop("month")).withColumn("month", ms_to_month("bar_open_ms"))
    store.commit(part.repartition(*keys), facts=todo, keep=plan)
    return todo.select(*keys)


# ---- ledger and artifacts -------------------------------------------------------------------------------------

def append_ledger(rows: DataFrame, path: str) -> None:
    """Append-only log; a ``lake_built`` row is the commit marker of its unit."""
    rows.withColumn("at", F.current_timestamp()).write.mode("append").json(path)


def built_symbols(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path).filter("event = 'lake_built'").select("symbol").distinct()


def token_store(path: str) -> Store:
    return Store(path, ("symbol",))


def write_token_stream(tokens: DataFrame, path: str, tokenizer_hash: str, dataset_hash: DataFrame, window: int) -> str:
    """Ids as one version of a store whose manifest holds, per symbol, their digest and provenance; returns the version.

    Every symbol must have a dataset hash and every hashed symbol ids.
    """
    odd = tokens.select("symbol").distinct().join(dataset_hash.select("symbol", F.lit(1).alias("_h")), "symbol", "full_outer").join(
        tokens.select("symbol").distinct().withColumn("_t", F.lit(1)), "symbol", "left").filter("_h is null or _t is null").first()
    if odd is not None:
        raise ValueError(f"token stream and dataset hashes do not cover the same symbols: {odd['symbol']}")
    facts = dataset_hash.select("symbol", "dataset_hash").withColumns({"tokenizer_hash": F.lit(tokenizer_hash), "window": F.lit(window)})
    return token_store(path).commit(tokens.repartitionByRange("symbol", "bar_open_ms").sortWithinPartitions("symbol", "bar_open_ms"), facts=facts, keep=facts.limit(0))


def load_token_stream(spark: SparkSession, path: str, tokenizer_hash: str, dataset_hash: DataFrame, window: int) -> DataFrame:
    """Ids of the current version, refused where a row was lost, added or changed, where the provenance of a symbol differs, or where
    symbols are missing or were not expected."""
    store = token_store(path)
    version = store.version(spark)
    facts = store.manifest(spark, version)
    want = dataset_hash.select("symbol", F.col("dataset_hash").alias("_want"))
    good = (F.col("tokenizer_hash") == tokenizer_hash) & (F.col("window") == window) & F.col("dataset_hash").eqNullSafe(F.col("_want"))
    bad = facts.join(want, "symbol", "full_outer").filter(~F.coalesce(good, F.lit(False))).first()
    if bad is not None:
        raise ValueError(f"token stream does not match its tokenizer or data: {bad.asDict()}")
    return store.read(spark, version)


def artifact_hash(columns: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def write_eval_artifacts(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Units with the hash of their content."""
    df.withColumn("content_hash", artifact_hash(columns)).write.mode("overwrite").parquet(path)


def load_eval_artifacts(spark: SparkSession, path: str, expected: DataFrame, keys: Sequence[str], columns: Sequence[str], grid: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(artifacts, problems): units missing, extra, standing twice, altered since they were written, or on another grid than expected.

    ``grid`` names columns, such as horizon, start and number of periods, in which a unit must equal its row of ``expected``.
    """
    df = spark.read.parquet(path)
    have = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    missing = expected.select(*keys).join(have.select(*keys), list(keys), "left_anti").withColumn("problem", F.lit("missing"))
    extra = have.select(*keys).join(expected.select(*keys), list(keys), "left_anti").withColumn("problem", F.lit("extra"))
    twice = have.filter("_n > 1").select(*keys, F.lit("repeated").alias("problem"))
    altered = df.filter(~F.col("content_hash").eqNullSafe(artifact_hash(columns))).select(*keys).withColumn("problem", F.lit("altered"))
    problems = missing.unionByName(extra).unionByName(twice).unionByName(altered)
    if grid:
        want = expected.select(*keys, *[F.col(c).alias(f"_g_{c}") for c in grid])
        off = F.lit(False)
        for c in grid:
            off = off | ~F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        problems = problems.unionByName(df.join(want, list(keys)).filter(off).select(*keys, F.lit("grid").alias("problem")))
    return df.drop("content_hash"), problems


def assert_no_problems(problems: DataFrame) -> None:
    bad = problems.first()
    if bad is not None:
        raise ValueError(f"artifacts are refused: {bad.asDict()}")
