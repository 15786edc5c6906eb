"""A table of shards in versions: immutable runs of files, a manifest of content digests per version, and one pointer.

A commit writes its shards as a new run, reads them back for their digests, writes a manifest that names for every live shard the
run that holds it, and last moves the pointer. Until then readers see the version before; a run that dies leaves files that no
manifest names. Readers are bound to one manifest, so they never meet a mixture, and ``check`` tells a lost or altered shard.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

RUN = "_run"


def content_digest(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Order-free digest per key: row count, a sum and an exclusive or of row hashes; NULL and empty, and a value moved to another column, differ."""
    held = [c for c in (columns or df.columns) if c not in keys]
    # a NULL leaves the running hash as it is, so its place is hashed too
    cells = [v for i, c in enumerate(held) for v in (F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNull(), F.lit(i)))]
    h = F.xxhash64(*cells)
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sum(F.pmod(h, F.lit(1_000_003))).alias("h1"), F.bit_xor(h).alias("h2"))


@dataclass(frozen=True)
class Store:
    """Shards of ``keys`` below ``root``."""

    root: str
    keys: tuple[str, ...]

    # ---- pointer
    def _fs(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm

    def version(self, spark: SparkSession) -> str | None:
        at, fs, _ = self._fs(spark, "CURRENT")
        return spark.read.text(f"{self.root}/CURRENT").first()[0] if fs.exists(at) else None

    def _point(self, spark: SparkSession, version: str, base: str | None) -> None:
        at, fs, jvm = self._fs(spark, f"pointers/{version}")
        out = fs.create(at, True)
        out.write(version.encode())
        out.close()
        if self.version(spark) != base:
            raise RuntimeError(f"another run has committed since {base}; {version} is not published")
        to, _, _ = self._fs(spark, "CURRENT")
        how = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        how[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(at, to, how)

    # ---- manifests
    def manifest(self, spark: SparkSession, version: str | None = None) -> DataFrame | None:
        """keys, run, n_rows, h1, h2 and the facts of every live shard; None before the first commit."""
        version = version or self.version(spark)
        return spark.read.parquet(f"{self.root}/manifests/{version}") if version else None

    def _schema(self, spark: SparkSession, version: str) -> StructType:
        return StructType.fromJson(json.loads(spark.read.text(f"{self.root}/schemas/{version}", wholetext=True).first()[0]))

    def commit(self, rows: DataFrame, facts: DataFrame | None = None, keep: DataFrame | None = None) -> str:
        """Publish ``rows`` as the new content of their shards and return the version.

        ``keep`` holds the keys of stored shards that stay as they are: None keeps all that ``rows`` does not replace, an empty table none, so shards
        that have vanished from the source go. ``facts`` adds columns per shard to the manifest, such as the digest of its source.
        """
        spark = rows.sparkSession
        base = self.version(spark)
        version, keys = uuid.uuid4().hex, list(self.keys)
        data = f"{self.root}/data/{RUN}={version}"
        rows.write.mode("error").option("compression", "zstd").partitionBy(*keys).parquet(data)
        schema = StructType(sorted(rows.schema.fields, key=lambda f: f.name in keys))
        written = spark.read.schema(schema).parquet(data)
        new = content_digest(written, keys).withColumn("run", F.lit(version))
        if facts is not None:
            new = facts.join(new, keys, "left").na.fill({"n_rows": 0, "h1": 0, "h2": 0, "run": version})
        old = self.manifest(spark, base)
        if old is not None:
            kept = old.join(new.select(*keys), keys, "left_anti")
            kept = kept if keep is None else kept.join(keep.select(*keys), keys, "left_semi")
            new = new.unionByName(kept, allowMissingColumns=True)
        new.write.parquet(f"{self.root}/manifests/{version}")
        spark.createDataFrame([(schema.json(),)], "schema string").coalesce(1).write.text(f"{self.root}/schemas/{version}")
        self._point(spark, version, base)
        return version

    # ---- reading
    def _rows(self, spark: SparkSession, version: str | None) -> DataFrame:
        version = version or self.version(spark)
        if version is None:
            raise FileNotFoundError(f"{self.root} has no published version")
        schema = self._schema(spark, version)
        live = self.manifest(spark, version).filter("n_rows > 0").select(*self.keys, F.col("run").alias(RUN))
        runs = [r[0] for r in live.select(RUN).distinct().collect()]  # one per commit that still holds a live shard
        if not runs:
            return spark.createDataFrame([], schema)
        _, fs, jvm = self._fs(spark, "data")
        there = [f"{self.root}/data/{RUN}={r}" for r in runs if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.root}/data/{RUN}={r}"))]
        if not there:
            return spark.createDataFrame([], schema)
        read = spark.read.schema(StructType([*schema.fields, StructField(RUN, StringType())])).option("basePath", f"{self.root}/data").parquet(*there)
        return read.join(live, [*self.keys, RUN], "left_semi").drop(RUN)

    def check(self, spark: SparkSession, version: str | None = None) -> DataFrame:
        """keys and problem of every shard whose rows are lost or are not those that were committed."""
        want = self.manifest(spark, version).filter("n_rows > 0")
        have = content_digest(self._rows(spark, version), self.keys)
        on = [want[k].eqNullSafe(have[k]) for k in self.keys]
        j = want.join(have, on, "left")
        same = (want["n_rows"] == have["n_rows"]) & (want["h1"] == have["h1"]) & (want["h2"] == have["h2"])
        problem = F.when(have["n_rows"].isNull(), "lost").when(~same, "altered")
        return j.select(*[want[k] for k in self.keys], problem.alias("problem")).filter("problem is not null")

    def read(self, spark: SparkSession, version: str | None = None, checked: bool = True) -> DataFrame:
        """The rows of one version; refused where a shard is lost or altered. The check reads the version once."""
        version = version or self.version(spark)
        bad = self.check(spark, version).first() if checked and version else None
        if bad is not None:
            raise ValueError(f"{self.root} version {version}: {bad.asDict()}")
        return self._rows(spark, version)

    def vacuum(self, spark: SparkSession) -> int:
        """Delete the runs that the current manifest does not name, half-written ones included; returns how many."""
        live = {r[0] for r in self.manifest(spark).select("run").distinct().collect()}
        at, fs, _ = self._fs(spark, "data")
        gone = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().partition("=")[2] not in live]
        for path in gone:
            fs.delete(path, True)
        return len(gone)
