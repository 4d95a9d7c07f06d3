"""The scan over streams: it is a narrow projection, so it runs on readStream unchanged; alerts are windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternsift.plans.api import scan


def scanned(stream: DataFrame, text: str = "text") -> DataFrame:
    return scan(stream, text)


def alerts(stream: DataFrame, at: str = "ts", width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """window, type, n of found entities; rows later than the watermark are left out."""
    found = stream.withWatermark(at, late).select(at, F.explode("entities").alias("e"))
    return found.groupBy(F.window(at, width), F.col("e.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))
