"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly; equal texts stay together.

A *group* is the rows of one text. Each group is a vector (bytes, tokens, rows), each dimension as a share of the
table's total; a shard's capacity is 1 / shards in each. A group goes to the shard where the dot product of its vector
with the residual capacity is highest (Panigrahy et al., 2011), largest groups first.

At scale that runs on two levels, neither of which gathers the groups:

* Groups with more than 1 / (``HEAVY`` * shards) of some dimension - there are at most 3 * ``HEAVY`` * shards - are
  placed by the driver from their sums. One that would fill over half of a shard is split by row hash first, as a
  third of all rows may be one text.
* All other groups are dealt by hash of the text to parts; each part packs its groups into local bins by the same
  rule, ``shards`` of them or more where parts are few. Bins are packed into bins of ``FAN`` parts together, and so on, until
  ``FAN`` parts or fewer are left, with ``shards`` * ``FAN`` bins, about; the driver places those, largest first. What it holds
  does not grow with the table.

``bytes`` is the law that holds: shards' sizes are near equal. Slots number a shard's rows without gaps: rows are
numbered inside (shard, bucket of the row number), and buckets begin where the counts of the ones before end: running sums
of sums, by a window over buckets of a hundred buckets and one inside each.

Defined cases: a null text has size 1, crc32 0 and no tokens and is grouped with other nulls; repeated rows each have a
slot and are dealt by row number, so they spread; an empty table gives an empty result; null ids are dealt like others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARDS, HEAVY, ROWS_A_PART, FAN = 8, 32, 100_000, 256
_VECTOR = ("bytes", "tokens", "rows")
#: Of the dimensions in the dot product: bytes lead, as theirs is the law that holds.
_WEIGHT = np.array([1.0, 0.1, 0.1])


def place(vectors: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Bin of each vector (largest first), with ``residual`` (bins x dimensions) updated in place."""
    out = np.zeros(len(vectors), np.int64)
    for i in np.argsort(-vectors.max(axis=1), kind="stable") if len(vectors) else ():
        out[i] = b = int(np.argmax(residual @ (_WEIGHT * vectors[i])))
        residual[b] -= vectors[i]
    return out


def _pack(bins_: int, totals: list[float], order_by: tuple[str, ...]):
    import pyarrow as pa

    def run(table: pa.Table) -> pa.Table:
        v = np.column_stack([np.asarray(table[c], float) / t for c, t in zip(_VECTOR, totals, strict=True)])
        order = np.lexsort([np.asarray(table[c]) for c in order_by])  # the input's order is not fixed
        bins = np.empty(len(v), np.int64)
        bins[order] = place(v[order], np.tile(v.sum(axis=0) / bins_, (bins_, 1)))
        return table.append_column("bin", pa.array(bins, pa.int32()))

    return run


def _pack_bins(bins: DataFrame, parts: int, shards: int, totals: list[float], fan: int) -> tuple[DataFrame, DataFrame]:
    """Bins (``part``, ``bin``, sums) packed level by level until ``fan`` parts or fewer are left.

    Gives the rows of the last level and, for each first (``part``, ``bin``), the last level's (``top``, ``top_bin``).
    """
    sums = ", ".join(f"{c} long" for c in _VECTOR)
    level = common.cut(bins)
    of = level.select("part", "bin", F.col("part").alias("top"), F.col("bin").alias("top_bin"))
    while parts > fan:
        parts = -(-parts // fan)
        packed = level.select(F.col("part").alias("old_part"), F.col("bin").alias("old_bin"), F.floor(F.col("part") / fan).cast("int").alias("part"), *_VECTOR)
        packed = common.cut(packed.groupBy("part").applyInArrow(_pack(shards * -(-fan // parts), totals, ("old_bin", "old_part")), f"old_part int, old_bin int, part int, {sums}, bin int"))
        up = packed.select(F.col("old_part").alias("top"), F.col("old_bin").alias("top_bin"), F.col("part").alias("next"), F.col("bin").alias("next_bin"))
        of = of.join(up, ["top", "top_bin"]).select("part", "bin", F.col("next").alias("top"), F.col("next_bin").alias("top_bin"))
        level = common.cut(packed.groupBy("part", "bin").agg(*[F.sum(c).alias(c) for c in _VECTOR]))
    return level, of


def running(counts: DataFrame, group: str, at: str, n: str, width: int = 100) -> DataFrame:
    """``group``, ``at`` and ``begin``: the sum of ``n`` over the group's smaller ``at``. No window holds more than a group's coarse sums or ``width`` rows."""
    coarse = counts.withColumn("coarse", F.floor(F.col(at) / width))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = coarse.groupBy(group, "coarse").agg(F.sum(n).alias("of_coarse"))
    sums = sums.select(group, "coarse", F.coalesce(F.sum("of_coarse").over(before(group, "coarse")), F.lit(0)).alias("base"))
    inside = coarse.withColumn("inside", F.coalesce(F.sum(n).over(before(group, "coarse", at)), F.lit(0)))
    return inside.join(sums, [group, "coarse"]).select(group, at, (F.col("base") + F.col("inside")).alias("begin"))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, heavy: int = HEAVY, rows_a_part: int = ROWS_A_PART, fan: int = FAN) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``tokens``, ``law``, ``shard``, ``slot``, ``grown_shard``."""
    spark = docs.sparkSession
    d = common.ids_and_text(docs, id_col, text_col)
    body = F.coalesce("text", F.lit(""))
    rows = common.cut(d.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("crc"),
        F.xxhash64(F.col("text").isNull(), body).alias("hash"),
        F.expr(f"cast(size(filter(split(coalesce(text, ''), r'{common.SPACE}'), w -> w <> '')) as bigint)").alias("tokens"),
    ))
    key = ["hash", "crc", "size"]
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).first()
    totals = [float(x or 1) or 1.0 for x in total]
    parts = max(1, int(totals[2]) // rows_a_part)
    groups = rows.groupBy(*key).agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    large = F.greatest(*[F.col(c) / F.lit(t) for c, t in zip(_VECTOR, totals, strict=True)]) > 1 / (heavy * shards)
    groups = common.cut(groups.withColumn("large", large))

    # Large groups: few by their definition. Those too large for one place are split by row.
    few = groups.filter("large").orderBy(*key).collect()
    pieces = [max(1, int(np.ceil(2 * shards * max(r[c] / t for c, t in zip(_VECTOR, totals, strict=True))))) for r in few]
    schema = "hash long, crc long, size long, pieces int"
    split = F.broadcast(spark.createDataFrame([(r.hash, r.crc, r["size"], n) for r, n in zip(few, pieces, strict=True)], schema))
    piece = F.pmod(F.xxhash64("row", F.lit(7)), "pieces").cast("int")
    heavy_rows = rows.join(split, key).withColumn("piece", piece)
    sums = heavy_rows.groupBy(*key, "piece").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).orderBy(*key, "piece").collect() if few else []

    packed = groups.filter("not large").withColumn("part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int"))
    sums_of = ", ".join(f"{c} long" for c in _VECTOR)
    pack = _pack(shards * -(-fan // parts), totals, ("crc", "hash"))
    packed = common.cut(packed.drop("large").groupBy("part").applyInArrow(pack, f"hash long, crc long, size long, {sums_of}, part int, bin int"))
    last, top_of = _pack_bins(packed.groupBy("part", "bin").agg(*[F.sum(c).alias(c) for c in _VECTOR]), parts, shards, totals, fan)
    bins = last.orderBy("part", "bin").collect()

    residual = np.full((shards, 3), 1 / shards)
    vector = lambda rs: np.array([[r[c] / t for c, t in zip(_VECTOR, totals, strict=True)] for r in rs]).reshape(-1, 3)
    heavy_at = place(vector(sums), residual)
    bin_at = place(vector(bins), residual)
    heavy_map = F.broadcast(spark.createDataFrame([(r.hash, r.crc, r["size"], r.piece, int(s)) for r, s in zip(sums, heavy_at, strict=True)], "hash long, crc long, size long, piece int, shard int"))
    bin_map = F.broadcast(spark.createDataFrame([(r.part, r.bin, int(s)) for r, s in zip(bins, bin_at, strict=True)], "top int, top_bin int, shard int"))

    sharded = packed.join(top_of.join(bin_map, ["top", "top_bin"]).select("part", "bin", "shard"), ["part", "bin"])
    light = rows.join(split.drop("pieces"), key, "left_anti").join(sharded.select(*key, "shard"), key)
    out = ["doc_id", "row", "size", "crc", "tokens", "shard"]
    placed = light.select(*out)
    if sums:
        placed = placed.unionAll(heavy_rows.join(heavy_map, [*key, "piece"]).select(*out))
    placed = common.cut(placed.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(parts * 4)).cast("int")))
    begins = running(placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")), "shard", "bucket", "n")
    inside = Window.partitionBy("shard", "bucket").orderBy("row")
    numbered = placed.withColumn("n", F.row_number().over(inside)).join(begins, ["shard", "bucket"])
    return numbered.select("doc_id", "size", F.col("crc").alias("text_crc32"), "tokens", F.lit("bytes").alias("law"), "shard", (F.col("begin") + F.col("n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir: str) -> DataFrame:
    return shard(common.table(spark, sf_dir, "documents", spread=True))
