"""Lines as rows. Order-preserving work on a text's lines stays inside its row: ``functions.structure``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbered(rows: DataFrame, key: str, lines: Column) -> DataFrame:
    """``key``, ``pos`` (from 0) and ``line`` of an array of lines."""
    return rows.select(key, F.posexplode(lines).alias("pos", "line"))
