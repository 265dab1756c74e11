"""Line dedup by site-relative frequency: lines on too large a part of a host's pages are boilerplate.

For each host and each distinct line (trimmed, not blank): pages of the host that hold the line,
divided by all pages of the host. A line at or over ``ratio`` that at least ``min_pages`` pages of the host
hold (a few copies of one page are no boilerplate) is dropped from every page of that host, all of its
occurrences; other lines stay as they are, in their order.

How: the pages are exploded to (host, 64-bit line hash) with each page's repeats removed inside the
row, so counting needs one shuffle of partial sums and no distinct; lines of a hot host spread over
tasks because the key is (host, line). Boilerplate lines of a host number at most its lines a page
divided by ``ratio``; each host's go as one array to its pages by a join whose page side is salted by text and input partition (equal
and null texts of a hot host spread too), and the lines are dropped inside the row. Texts move once.

Defined cases: null texts stay null, hosts that are null form a host of their own, blank lines always
stay, repeated rows count as pages each, an empty table gives an empty result; a page of nothing but
boilerplate becomes an empty text (not null). Other columns are kept by ``drop_boilerplate``, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RATIO, MIN_PAGES, SALTS = 0.08, 5, 64


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _shape(line: Column) -> Column:
    """What makes two lines the same: the line without spaces and tabs at its ends."""
    return F.trim(line, F.lit(" \t\r"))


def line_counts(pages: DataFrame, host: Column, text: Column, min_pages: int = 1) -> DataFrame:
    """``host``, ``line`` (hash), ``n_pages``, ``n_host``: pages with the line (at least ``min_pages``), and pages of the host."""
    hashed = F.array_distinct(F.transform(F.filter(lines_of(text), lambda x: _shape(x) != ""), lambda x: F.xxhash64(_shape(x))))
    counts = pages.select(host.alias("host"), F.explode(hashed).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_pages")).filter(F.col("n_pages") >= min_pages)
    totals = pages.groupBy(host.alias("of")).agg(F.count(F.lit(1)).alias("n_host"))
    return counts.join(totals, F.col("host").eqNullSafe(F.col("of"))).drop("of")


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float, min_pages: int) -> DataFrame:
    return line_counts(pages, host, text, min_pages).filter(F.col("n_pages") >= F.lit(ratio) * F.col("n_host")).select("host", "line")


def drop_boilerplate(pages: DataFrame, host: Column, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, salts: int = SALTS) -> tuple[DataFrame, str]:
    """``pages`` with the lines taken out of ``text_col``, and the name of an added column: lines dropped."""
    host_, salt_, lines_, n_ = (common.free_name(x, pages.columns) for x in ("host_key", "salt_key", "dropped_lines", "n_dropped"))
    text = pages[text_col]
    bad = boilerplate(pages, host, text, ratio, min_pages)
    # One row a host and salt holds the host's boilerplate; each page meets exactly one of them.
    held = bad.groupBy("host").agg(F.collect_list("line").alias(lines_))
    held = held.select(F.coalesce(F.concat(F.lit("="), "host"), F.lit("null")).alias(host_), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias(salt_), lines_)
    keyed = pages.select("*", F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit("null")).alias(host_), F.pmod(F.xxhash64(F.spark_partition_id(), text), F.lit(salts)).cast("int").alias(salt_))
    joined = keyed.join(held, [host_, salt_], "left")
    kept = F.filter(lines_of(F.col(text_col)), lambda x: (_shape(x) == "") | ~F.array_contains(F.col(lines_), F.xxhash64(_shape(x))))
    new = F.when(F.col(text_col).isNull() | F.col(lines_).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    dropped = F.when(F.col(text_col).isNull() | F.col(lines_).isNull(), F.lit(0)).otherwise(F.size(lines_of(F.col(text_col))) - F.size(kept)).cast("long")
    return joined.select(*[new.alias(c) if c == text_col else joined[c] for c in pages.columns], dropped.alias(n_)), n_


def html_lines(html: Column) -> Column:
    """The visible text of a page, a line for each block of it: comments, scripts, styles and tags go."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "\n")
    broken = F.regexp_replace(bare, r"</?(p|div|h[1-6]|li|ul|ol|nav|footer|header|title|body|head|html|section|article|table|tr|br)( [^>]*)?/?>", "\n")
    return F.regexp_replace(F.regexp_replace(broken, r"<[^>]*>", ""), r"[ \t\r]*\n[ \t\r\n]*", "\n")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def query(spark, sf_dir: str) -> DataFrame:
    """All ``pages`` by the host of their URL; the text is taken out of the HTML once and written."""
    pages = common.cut(common.table(spark, sf_dir, "pages", spread=True).select("page_id", host_of(F.col("url")).alias("host"), html_lines(F.col("html")).alias("text")))
    out, n = drop_boilerplate(pages, pages["host"])
    return out.select("page_id", "host", F.col(n).alias("n_dropped"), "text")


def _sql_counts() -> str:
    return rf"""
l AS (SELECT id, host, text, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM p),
k AS (SELECT *, regexp_replace(line, '^[ \t\r]+|[ \t\r]+$', '', 'g') AS shape FROM l),
h AS (SELECT host, count(*) AS n_host FROM p GROUP BY host),
bad AS (
  SELECT k.host, k.shape FROM k JOIN h ON k.host IS NOT DISTINCT FROM h.host WHERE k.shape <> ''
  GROUP BY k.host, k.shape, n_host HAVING count(DISTINCT id) >= {MIN_PAGES} AND count(DISTINCT id) >= {RATIO} * n_host
),
r AS (
  SELECT k.id, string_agg(CASE WHEN bad.shape IS NULL THEN k.line END, chr(10) ORDER BY k.pos) AS text, count(bad.shape) AS n_dropped
  FROM k LEFT JOIN bad ON k.host IS NOT DISTINCT FROM bad.host AND k.shape = bad.shape GROUP BY k.id
)"""


SQL = rf"""
WITH b AS (
  SELECT page_id AS id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
    regexp_replace(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', chr(10), 'g') AS bare FROM pages
), p AS (
  SELECT id, host, regexp_replace(regexp_replace(regexp_replace(bare, '</?(p|div|h[1-6]|li|ul|ol|nav|footer|header|title|body|head|html|section|article|table|tr|br)( [^>]*)?/?>', chr(10), 'g'), '<[^>]*>', '', 'g'), '[ \t\r]*\n[ \t\r\n]*', chr(10), 'g') AS text FROM b
), {_sql_counts()}
SELECT p.id AS page_id, p.host, coalesce(r.n_dropped, 0) AS n_dropped, CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text
FROM p LEFT JOIN r USING (id)
"""
