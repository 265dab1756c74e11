"""A corpus cleaned in five stages; counted as part of the subpackage ``granary.llm``.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns of ``documents`` (the last one:
the pieces of the packed sequences). ``run`` writes each stage's rows as Parquet to the shared checkpoint folder and
gives what it reads back to the next stage, so a lost executor costs at most one stage's tasks.

Every stage takes an empty table (nothing is left), null ids and texts (null texts have one class in stage 3, no lines, no
items and one id; null ids are kept apart by row), repeated rows and further columns of any name (they are kept).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import common, decontamination, line_dedup, near_dedup, packing, quality


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6, learned from the stage's own input and ``labels``: rejected documents go. Without labels of both kinds all stay."""
    return quality.keep(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3 with the source as the host (null sources are one host); ``n_chars`` follows the text."""
    out, _ = line_dedup.drop_boilerplate(docs, docs["source"])
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each class stays, that of the least id (a null id only where the class has no other)."""
    return near_dedup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that hold a benchmark item go; null items are none."""
    return decontamination.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: what is left, as sequences; an empty or null text is one id."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [("quality", drop_bad), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("decontamination", drop_leaks), ("packing", pack)]

#: The classifier, the sketches and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.table(spark, sf_dir, "documents", spread=True)
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, out, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        out = spark.read.parquet(f"{folder}/{k}-{name}")
    return out
