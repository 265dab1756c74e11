"""Stupid-backoff language-model scores, computed from n-gram count tables partitioned by hash.

The count table covers every n-gram (orders 1 to ``order``) of the whole corpus. It is spread over
buckets by the high bits of a 64-bit n-gram hash. The n-grams of the documents are exploded chunk
by chunk (a chunk is some tens of MB of text, dealt by hash of the document) and counted inside the
chunk before anything is shuffled, so a very frequent n-gram crosses the network once a chunk, not
once an occurrence. Each bucket joins the chunks' n-grams with its part of the table and returns
the corpus counts; each chunk then scores its documents and sums per document.

Score of word w after history h (Brants et al., 2007): count(h w) / count(h) if the n-gram is in the
table, else ``alpha`` times the score with the history one word shorter; words fall back to
count(w) / tokens of the corpus. N-grams of order 2 and more with a count below ``min_count`` are not
in the table (they then have no evidence besides the text itself). Histories never reach over the
start of a document.

Defined cases: null and wordless texts have 0 tokens, log_score 0.0 and a null mean; repeated rows
(also rows that repeat an id) are scored and counted each; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, counts

ORDER, ALPHA, MIN_COUNT = 3, 0.4, 2
#: Text a chunk holds; with it, what one Python worker keeps in memory.
CHUNK_BYTES = 16 << 20
#: Stands for "a token" in the count table: its count is the number of tokens.
_TOTAL = np.uint64(0x5DEECE66D12345)
SCHEMA = "doc_id long, n_tokens long, log_score double, mean_log_score double, n_backed_off long"


def _grams(words: np.ndarray, offsets: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """Hash of the n-gram that ends at each word, for each order; where a row has too few words before it, 0."""
    place = (np.arange(len(words)) - np.repeat(offsets[:-1], np.diff(offsets))).astype(np.int32)
    for n in range(1, order + 1):
        g = np.zeros(len(words), dtype=np.uint64)
        if len(words) >= n:
            g[n - 1 :] = np.maximum(counts.key(common.roll(words, n)), np.uint64(1))
        g[place < n - 1] = 0
        yield g


def _words_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a chunk and each text's first word, made in parts so that only hashes are held."""
    hashes, starts, at = [np.zeros(0, np.uint64)], [], 0
    for lo in range(0, len(texts), 1000):
        words, offsets = common.hash_words(*common.text_bytes(texts[lo : lo + 1000]))
        hashes.append(words)
        starts.append(offsets[:-1] + at)
        at += len(words)
    return np.concatenate(hashes), np.concatenate([*starts, [at]]).astype(np.int64)


def _chunk_table(texts, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a chunk and their counts in it, with the number of tokens under ``_TOTAL``."""
    words, offsets = _words_of(texts)
    return _table_of(words, offsets, order)


def _table_of(words: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """One order after another, so that only distinct keys of the others are held."""
    each = [counts.tally(g[g != 0]) for g in _grams(words, offsets, order)]
    k, c = counts.tally(np.concatenate([k for k, _ in each]), np.concatenate([c for _, c in each]))
    at = int(np.searchsorted(k, _TOTAL))
    return np.insert(k, at, _TOTAL), np.insert(c, at, np.uint64(len(words)))


def _request(order: int, buckets: int):
    def run(table):
        out = counts.parts(*_chunk_table(table["text"], order), table["chunk"][0].as_py(), buckets)
        common.trim()
        return out

    return run


def _corpus_counts(grams: np.ndarray, keys: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Corpus count of each n-gram (0 for the key 0). Sorting first makes the look-ups run through the table in order."""
    order = np.argsort(grams, kind="stable")
    sorted_ = grams[order]
    new = np.concatenate(([True], sorted_[1:] != sorted_[:-1])) if len(order) else np.zeros(0, bool)
    distinct = sorted_[new]
    found = np.where(distinct != 0, totals[np.minimum(np.searchsorted(keys, distinct), len(totals) - 1)], 0).astype(np.float64)
    out = np.empty(len(grams))
    out[order] = found[np.cumsum(new) - 1]
    return out


def _score(order: int, alpha: float, min_count: int):
    import pyarrow as pa

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "log_score": pa.float64(), "mean_log_score": pa.float64(), "n_backed_off": pa.int64()}
        if not docs.num_rows:
            return pa.table({k: pa.array([], t) for k, t in kinds.items()})
        words, offsets = _words_of(docs["text"])
        keys = _table_of(words, offsets, order)[0]
        totals = counts.join(answers)
        tokens = int(totals[np.searchsorted(keys, _TOTAL)])
        score = before = None
        backed = np.zeros(len(words), bool)
        for g in _grams(words, offsets, order):
            seen = _corpus_counts(g, keys, totals)
            if score is None:
                score = np.log(np.maximum(seen, 1) / max(tokens, 1))
            else:
                history = np.concatenate(([0.0], before[:-1]))
                known, possible = seen >= min_count, seen > 0
                score = np.where(known, np.log(np.maximum(seen, 1) / np.maximum(history, 1)), np.where(possible, score + math.log(alpha), score))
                backed = np.where(known, False, backed | possible)
            before = seen
        del keys, totals, before, seen, words
        n = np.diff(offsets)
        add = lambda v: np.where(n > 0, np.add.reduceat(np.append(v, 0.0), np.minimum(offsets[:-1], len(v))), 0.0)
        total = add(score)
        made = [docs["doc_id"].combine_chunks(), pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1), mask=n == 0), pa.array(add(backed.astype(float)).astype(np.int64))]
        common.trim()
        return pa.table({k: v.cast(t) for (k, t), v in zip(kinds.items(), made, strict=True)})

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of ``docs``: tokens, the sum of log scores, its mean, and positions that backed off."""
    docs = common.ids_and_text(docs, id_col, text_col)
    rows, size = common.total_bytes(docs)
    # a table of few chunks is cut finer, down to a quarter, while there are cores without one
    chunks = max(1, -(-size // chunk_bytes), min(docs.sparkSession.sparkContext.defaultParallelism, -(-size * 4 // chunk_bytes)))
    buckets = chunks * 2
    # The input partition is part of the hash, so that rows that repeat altogether spread over chunks.
    chunk = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(chunks)).cast("int")
    dealt = counts.deal(docs.select("doc_id", F.lower("text").alias("text"), chunk.alias("chunk")), "chunk", chunks)
    told = counts.deal(counts.answer(dealt.groupBy("chunk").applyInArrow(_request(order, buckets), counts.PARTS), buckets), "chunk", chunks)
    return dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_score(order, alpha, min_count), SCHEMA)


def score_by_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """The same columns as ``score`` at order 3, by one row an n-gram: a count table, joined to the exploded n-grams five times.

    Plain to read, and what ``score`` is tested against; it moves several times as much (README), as every occurrence of an
    n-gram crosses the network.
    """
    d = common.ids_and_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    words = common.cut(d.select("doc_id", "row", F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), common.SPACE), lambda w: w != "").alias("ws")))
    w = lambda i, k: F.get("ws", i - k)
    place = F.explode(F.filter(F.sequence(F.lit(0), F.greatest(F.size("ws") - 1, F.lit(0))), lambda i: i < F.size("ws"))).alias("i")
    grams = words.select("row", "ws", place).select("row", w(F.col("i"), 0).alias("c"), F.when(F.col("i") > 0, w(F.col("i"), 1)).alias("b"), F.when(F.col("i") > 1, w(F.col("i"), 2)).alias("a"))
    key = lambda *cs: F.when(F.col(cs[0]).isNotNull(), F.xxhash64(F.lit(len(cs)), *cs))
    grams = grams.select("row", key("c").alias("g1"), key("b", "c").alias("g2"), key("a", "b", "c").alias("g3"), key("b").alias("h1"), key("a", "b").alias("h2"))
    table = common.cut(grams.select(F.explode(F.array("g1", "g2", "g3")).alias("g")).filter("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    tokens = max(1, grams.count())
    for c in ("g1", "g2", "g3", "h1", "h2"):
        grams = grams.join(table.select(F.col("g").alias(c), F.col("n").alias("n_" + c)), c, "left")
    back = math.log(alpha)
    one = F.log(F.col("n_g1") / tokens)
    two = F.when(F.col("g2").isNull(), one).when(F.col("n_g2") >= min_count, F.log(F.col("n_g2") / F.col("n_h1"))).otherwise(one + back)
    three = F.when(F.col("g3").isNull(), two).when(F.col("n_g3") >= min_count, F.log(F.col("n_g3") / F.col("n_h2"))).otherwise(two + back)
    backed = F.when(F.col("g3").isNotNull(), F.col("n_g3") < min_count).otherwise(F.coalesce(F.col("n_g2") < min_count, F.lit(False)))
    sums = grams.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.sum(three).alias("s"), F.count_if(backed).alias("k"))
    out = words.select("doc_id", "row").join(sums, "row", "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_tokens"), F.coalesce("s", F.lit(0.0)).alias("log_score"), (F.col("s") / F.col("n")).alias("mean_log_score"), F.coalesce("k", F.lit(0)).alias("n_backed_off"))


def query(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; sums are rounded to 6 places, as the order of addition is free."""
    out = score(common.table(spark, sf_dir, "documents", spread=True))
    return out.select("doc_id", "n_tokens", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"), "n_backed_off")


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), t AS (
  SELECT doc_id, i, ws[i] AS c, CASE WHEN i > 1 THEN ws[i - 1] END AS b, CASE WHEN i > 2 THEN ws[i - 2] END AS a
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)
), n AS (SELECT count(*) AS n FROM t),
u AS (SELECT c, count(*) AS n1 FROM t GROUP BY c),
bi AS (SELECT b, c, count(*) AS n2 FROM t WHERE b IS NOT NULL GROUP BY b, c),
tri AS (SELECT a, b, c, count(*) AS n3 FROM t WHERE a IS NOT NULL GROUP BY a, b, c),
s AS (
  SELECT t.doc_id,
    CASE WHEN n3 >= 2 THEN ln(n3 / h2.n2) WHEN bi.n2 >= 2 THEN ln(bi.n2 / h1.n1) + CASE WHEN t.a IS NOT NULL THEN ln(0.4) ELSE 0 END
         ELSE ln(u.n1 / n.n) + CASE WHEN t.a IS NOT NULL THEN 2 * ln(0.4) WHEN t.b IS NOT NULL THEN ln(0.4) ELSE 0 END END AS score,
    CASE WHEN t.b IS NULL OR n3 >= 2 OR (t.a IS NULL AND bi.n2 >= 2) THEN 0 ELSE 1 END AS backed
  FROM t CROSS JOIN n JOIN u ON t.c = u.c
  LEFT JOIN bi ON t.b = bi.b AND t.c = bi.c LEFT JOIN u h1 ON t.b = h1.c
  LEFT JOIN tri ON t.a = tri.a AND t.b = tri.b AND t.c = tri.c LEFT JOIN bi h2 ON t.a = h2.b AND t.b = h2.c
)
SELECT d.doc_id, count(s.score) AS n_tokens, round(coalesce(sum(s.score), 0.0), 6) AS log_score,
       round(avg(s.score), 6) AS mean_log_score, coalesce(sum(s.backed), 0)::BIGINT AS n_backed_off
FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""
