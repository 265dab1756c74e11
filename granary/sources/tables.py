"""Tables of a data folder, files of records, and what stands in for a missing one."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table in one file of a size between these is dealt over the cores before long work on its rows.
SPREAD_OVER, SPREAD_UNDER = 256 << 10, 64 << 20


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where they stand in one small file: such a file has one row group and would be one task.

    For work that is long for each row. Larger tables, and tables of several files, are left as they are read.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if cores > 1 and SPREAD_OVER < size < SPREAD_UNDER and len(rows.inputFiles()) == 1 else rows


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file; blank lines are skipped and malformed ones dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a file; files that do not parse are dropped."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows by the header's names; all types come from the schema."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def or_empty(spark: SparkSession, read, schema: str) -> DataFrame:
    """``read()``, or an empty table where the path does not exist."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def discover(spark: SparkSession, folder: str, name: str, extensions: list[str], recursive: bool = True) -> DataFrame:
    """Files whose name starts with an id (``name``: its pattern, one group) and ends in one of the extensions."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    base = F.element_at(F.split("path", "/"), -1)
    return (
        files.withColumn("file_name", base)
        .withColumn("source_id", F.upper(F.regexp_extract(base, "(?i)" + name, 1)))
        .withColumn("format", F.lower(F.regexp_extract(base, r"(\.[^.]+)$", 1)))
        .filter((F.col("source_id") != "") & F.col("format").isin(extensions))
        .withColumn("file_sha256", F.sha2("content", 256))
    )


def decode(content: Column) -> Column:
    """Text of bytes: UTF-8 without a byte-order mark if it is valid, else ISO 8859-1."""
    as_utf8 = F.try_validate_utf8(content.cast("string"))
    return F.coalesce(F.regexp_replace(as_utf8, "^﻿", ""), F.decode(content, "ISO-8859-1"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``text`` of whole text files; bytes that are no UTF-8 become replacement characters."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
