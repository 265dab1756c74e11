"""The queries by name, each with the SQL that an independent engine can run over the same tables.

They live by theme: ``scores`` (scores and runs), ``records`` (sources, packets, tables, corpus), ``cleaning`` (lines, blocks, Markdown),
``webpages``, ``edits`` (sentences, rubrics, validators). Importing them registers them.
"""

from __future__ import annotations

from . import cleaning, edits, records, scores, webpages  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401
