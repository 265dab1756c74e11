"""Registration of queries, and pieces of SQL for the independent engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: As ``functions.text.SPACE``, in the other engine's pattern syntax.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Characters of words.
WORD = r"[\p{L}\p{N}_]"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def quoted(value) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, list):
        return "[" + ", ".join(map(quoted, value)) + "]"
    return str(value)


def values(rows: list[tuple]) -> str:
    """``VALUES`` of the rows."""
    return "VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def flatten(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACE}]+', ' ', 'g'))"


def splitlines(x: str) -> str:
    ls = rf"string_split_regex({x}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"
    return f"(CASE WHEN {ls}[-1] = '' THEN {ls}[:-2] ELSE {ls} END)"


def squeeze(x: str) -> str:
    return strip(rf"regexp_replace(regexp_replace({x}, '[\x{{feff}}\x{{ad}}]', '', 'g'), '[ \t\x{{a0}}]+', ' ', 'g')")


def isupper(x: str) -> str:
    return f"(upper({x}) = {x} AND lower({x}) <> {x})"


def page_noise(x: str) -> str:
    """Of a stripped line."""
    return (
        rf"({x} <> '' AND ((length({x}) <= 20 AND regexp_matches({x}, '(?i)^(?:[-–—\s]*)?(?:page\s*)?\d{{1,4}}(?:\s*(?:of|/)\s*\d{{1,4}})?(?:[-–—\s]*)?$'))"
        rf" OR regexp_matches({x}, '(?i)^--\s*\d{{1,4}}\s+of\s+\d{{1,4}}\s*--$') OR regexp_matches({x}, '(?i)^\[\s*page\s+\d{{1,4}}\s*\]$')"
        rf" OR (length({x}) <= 180 AND (regexp_matches({x}, '^[^\p{{L}}\p{{N}}]*\d{{1,4}}\s*[|]\s*.*$') OR regexp_matches({x}, '^.*[|]\s*\d{{1,4}}[^\p{{L}}\p{{N}}]*$')))))"
    )


def share_upper(x: str) -> str:
    return rf"(length(regexp_replace({x}, '\P{{Lu}}', '', 'g')) / nullif(length(regexp_replace({x}, '\P{{L}}', '', 'g')), 0))"


def heading(x: str) -> str:
    return (
        rf"(CASE WHEN regexp_matches({x}, '^\d+(\.\d+)*\.\s+.+$') THEN least(len(string_split(regexp_extract({x}, '^(\d+(\.\d+)*)\.\s', 1), '.')) + 1, 4)"
        rf" WHEN length({x}) BETWEEN 3 AND 100 AND coalesce({share_upper(x)} > 0.8, false) AND len(list_filter(string_split({flatten(x)}, ' '), lambda w: w <> '')) <= 12 THEN 2"
        rf" WHEN right({x}, 1) = ':' AND length({x}) <= 100 THEN 3 ELSE 0 END)::INT"
    )
