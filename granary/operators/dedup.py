"""Exact duplicates: groups by hash, a canonical record for each, roles, and checks on the outcome.

Groups are partial sums joined back to the records; no window holds a hot group in one task, and AQE can split the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


#: A group of more records than this is not listed by id, only counted: its members are rows of ``resolve``.
LISTED = 10_000


def id_lists(rows: DataFrame, group: str, key: str, listed: int = LISTED) -> DataFrame:
    """``group``, ``canonical_id`` (the least ``key``), ``n_ids`` and, for groups of at most ``listed`` records, their sorted ``ids``.

    Different records of a group come from a distinct; counts are partial sums, and only the rows of groups short enough are gathered.
    """
    pairs = rows.select(group, key).distinct()
    counts = pairs.groupBy(group).agg(F.min(key).alias("canonical_id"), F.count(F.lit(1)).alias("n_ids")).filter("n_ids > 1")
    short = counts.filter(F.col("n_ids") <= listed).select(F.col(group).alias("_g"))
    lists = pairs.join(short, F.col(group) == F.col("_g"), "left_semi").groupBy(F.col(group).alias("_g")).agg(F.array_sort(F.collect_list(key)).alias("ids"))
    return counts.join(lists, F.col(group) == F.col("_g"), "left").drop("_g")


def hash_groups(rows: DataFrame, key: str, text: str, listed: int = LISTED) -> DataFrame:
    """Texts that several different records have: hash, records (sorted; null for more than ``listed``), the least of them, rows, and the number of different bytes."""
    digest = F.col("file_sha256") if "file_sha256" in rows.columns else F.lit(None).cast("string")
    hashed = rows.select(text_hash(F.col(text)).alias("text_sha256"), key, digest.alias("file_sha256"))
    sizes = hashed.groupBy(F.col("text_sha256").alias("_h")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_sha256").alias("n_files"))
    return id_lists(hashed, "text_sha256", key, listed).join(sizes, F.col("text_sha256") == F.col("_h")).select("text_sha256", "ids", "n", "n_files", "canonical_id")


def file_groups(files: DataFrame, digest: str = "file_sha256") -> DataFrame:
    """``files`` with ``duplicate_file_group``: ``file_sha256:`` and 16 hexadecimal digits where several files have the same bytes, else an empty text."""
    n = files.groupBy(F.col(digest).alias("_of")).agg((F.count(F.lit(1)) > 1).alias("_several"))
    group = F.when(F.col("_several") & (F.col(digest) != ""), F.concat(F.lit("file_sha256:"), F.left(digest, F.lit(16)))).otherwise("")
    return files.join(n, F.col(digest).eqNullSafe(F.col("_of"))).withColumn("duplicate_file_group", group).drop("_of", "_several")


def several_files(files: DataFrame, key: str = "source_id") -> DataFrame:
    """``files`` with ``source_has_multiple_files``."""
    n = files.groupBy(F.col(key).alias("_of")).agg((F.count(F.lit(1)) > 1).alias("source_has_multiple_files"))
    return files.join(n, F.col(key).eqNullSafe(F.col("_of"))).drop("_of")


def resolve(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Each record's canonical record (the least with its text), role and group.

    The group of a copy is ``text_hash_group:`` and 16 hexadecimal digits, that of a canonical record with copies
    ``canonical_for:`` and their number; "none" for others. (Which copies: ``packets.canonical`` lists them.)
    """
    hashed = rows.select(key, text_hash(F.col(text)).alias("text_sha256"))
    groups = hashed.groupBy("text_sha256").agg(F.min(key).alias("canonical_id"), F.count(F.lit(1)).alias("n"))
    copy = F.col(key) != F.col("canonical_id")
    role = F.when(F.col("n") == 1, "primary").when(copy, "alias").otherwise("canonical")
    group = F.when(copy, F.concat(F.lit("text_hash_group:"), F.left("text_sha256", F.lit(16)))).when(F.col("n") > 1, F.concat(F.lit("canonical_for:"), (F.col("n") - 1).cast("string"))).otherwise("none")
    return hashed.join(groups, "text_sha256").select(key, "canonical_id", "text_sha256", role.alias("packet_role"), copy.alias("is_text_duplicate"), group.alias("duplicate_group"))


def first_by(rows: DataFrame, group: str, order: str, value: str, last: bool = False) -> DataFrame:
    """The first (or last) value of each group by order."""
    pick = F.max_by(value, order) if last else F.min_by(value, order)
    return rows.groupBy(group).agg(pick.alias(value))


def validation(packets: DataFrame, key: str, canonical: str, role: str, body: str) -> DataFrame:
    """One row of counts over packets: canonical ones, their distinct bodies, aliases, aliases that still carry their canonical's body, and ``pass``."""
    hashed = packets.select(F.col(key).alias("k"), F.col(canonical).alias("c"), (F.col(role) == "alias").alias("alias"), text_hash(F.col(body)).alias("h"))
    carried = hashed.filter("alias").join(hashed.select(F.col("k").alias("c"), F.col("h").alias("canonical_h")), "c").filter("h = canonical_h").agg(F.count(F.lit(1)).alias("carried"))
    counts = hashed.agg(F.count_if(~F.col("alias")).alias("canonical_packets"), F.countDistinct(F.when(~F.col("alias"), F.col("h"))).alias("unique_canonical_bodies"), F.count_if("alias").alias("alias_packets"))
    # Two one-row tables.
    return counts.join(carried, F.lit(True)).withColumn("pass", F.col("carried") == 0)
