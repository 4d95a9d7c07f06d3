"""What the corpus operators share: reading, word rules, and cutting lineage in shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts list it: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\f\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(c, _UPPER, _LOWER)


def strip_white(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def words_of(text: Column) -> Column:
    """Maximal runs of characters that aren't ASCII white space; no text, no words."""
    bare = strip_white(F.coalesce(text, F.lit("")))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE_CLASS + "+"))


def wide_hash(c: Column) -> tuple[Column, Column]:
    """Two seeded 64-bit lanes; together a 128-bit key that stays collision-free at 10^12 keys."""
    return F.xxhash64(c), F.xxhash64(F.lit(0x5EED), c)


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that the cluster shares between executors; a local one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lanternsift-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Spark deletes the shuffle files of a query under this setting as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, path: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Write to shared storage and read again: lineage ends there, and a lost executor costs nothing.

    What is read again never goes back to the shuffle files of the write, so they are deleted with it.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    writer = df.write.mode("overwrite")
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str, rows_each: int) -> DataFrame:
    """Settled rows by key in enough partitions for what each row becomes; a handful of small files would be two tasks."""
    spark = df.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, -(-df.count() // rows_each))
    return df.repartition(n, key)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that settle() wrote."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def slim(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns only: extra columns of a table can't clash with working columns."""
    return docs.select(*(F.col(f"`{n}`") for n in names))
