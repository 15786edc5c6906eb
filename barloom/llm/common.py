"""Helpers shared by the text operators: reading tables, stages in the shared folder, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import scratch

#: A word is a run of characters other than blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def stage(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write the rows to a new table in the shared folder and read that table.

    Cuts the lineage: several branches can read it, and a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/stage"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*tables: DataFrame | None) -> None:
    """Delete the files of staged tables whose last reader has run; None and tables read from elsewhere are passed over."""
    for df in tables:
        for path in df.inputFiles()[:1] if df is not None else ():
            folder = path.rpartition("/")[0]
            if folder.endswith("/stage") and "/work-" in folder:
                jvm, context = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
                target = jvm.org.apache.hadoop.fs.Path(folder)
                target.getFileSystem(context.hadoopConfiguration()).delete(target, True)


def docs_of(df: DataFrame) -> DataFrame:
    """doc_id and the UTF-8 bytes of the text; a null text counts as the empty one."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"),
                     F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))


def chunks(batches: Iterator[pa.RecordBatch], rows: int = 256, column: str = "data") -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows; keeps the Python objects that are alive at once few."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def training_row(doc_id: Column, folds: int, held_out: int) -> Column:
    """Whether crc32 of the id's decimal digits leaves a remainder other than `held_out`; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds != held_out


#: Bytes of words kept as they are, A to Z in lower case, every other byte a blank.
FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def folded_words(data: bytes) -> list[bytes]:
    """Words of a text: runs of digits, letters (A to Z in lower case) and characters beyond ASCII."""
    return data.translate(FOLDED).split()
