"""Run logs as streams (an extension: the data model itself is batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_log(spark: SparkSession, path: str, schema: str, key: list[str], at: str, late: str = "1 day") -> DataFrame:
    """New records of a folder of JSON lines, each key once; state older than the watermark is dropped."""
    return spark.readStream.schema(schema).json(path).withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def windowed_status(stream: DataFrame, at: str, status: str, width: str = "10 minutes") -> DataFrame:
    return stream.groupBy(F.window(at, width), status).agg(F.count(F.lit(1)).alias("n"))
