"""Text of files by format: plain text, CSV, HTML, PDF, DOCX, XLSX and XLS; one Arrow-batched function over their bytes.

All use the standard library. A caller can put a function of another library in ``EXTRACTORS``.
"""

from __future__ import annotations

import csv
import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pages
from ..operators import dedup
from . import pdf, xls

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def plain(data: bytes) -> str:
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def csv_text(data: bytes) -> str:
    return "\n".join("\t".join(row) for row in csv.reader(io.StringIO(plain(data), newline="")))


class _Visible(pages.Parser):
    def __init__(self):
        super().__init__()
        self.hidden, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(self.written(data))


def html_text(data: bytes) -> str:
    parser = _Visible()
    parser.feed(plain(data))
    parser.close()
    return "\n".join(x for line in "\n".join(parser.parts).splitlines() if (x := line.strip()))


def docx_text(data: bytes) -> str:
    """Paragraphs outside tables, then table rows with tabs between cells."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    lines = [said(p) for p in body.findall(f"{_W}p") if said(p).strip()]
    for row in body.iter(f"{_W}tr"):
        lines.append("\t".join(said(c).strip() for c in row.findall(f"{_W}tc")))
    return "\n".join(lines)


def xlsx_rows(data: bytes) -> list[tuple[str, int, list[str | None]]]:
    """(sheet, row from 1, cells) of every row of every sheet; cells stand in their columns."""
    book = zipfile.ZipFile(io.BytesIO(data))
    names = book.namelist()
    shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    titles = [s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_S}sheet")]
    out = []
    for k, title in enumerate(titles, 1):
        for n, row in enumerate(ElementTree.fromstring(book.read(f"xl/worksheets/sheet{k}.xml")).iter(f"{_S}row"), 1):
            cells: list[str | None] = []
            for c in row.findall(f"{_S}c"):
                letters = "".join(x for x in c.get("r", "") if x.isalpha())
                if letters:
                    at = 0
                    for x in letters:
                        at = at * 26 + ord(x.upper()) - 64
                    cells += [None] * (at - 1 - len(cells))
                v = c.find(f"{_S}v")
                inline = "".join(t.text or "" for t in c.iter(f"{_S}t")) or None
                cells.append(shared[int(v.text)] if c.get("t") == "s" and v is not None else v.text if v is not None else inline)
            out.append((title, int(row.get("r", n)), cells))
        if not any(t == title for t, _, _ in out):
            out.append((title, 0, []))
    return out


def _sheets_text(rows: list[tuple[str, int, list[str | None]]]) -> str:
    """Each sheet under a title line, its rows that are not blank with tabs between cells."""
    out, last = [], None
    for title, _, cells in rows:
        if title != last:
            out.append(f"=== Sheet: {title} ===")
            last = title
        if any((x or "").strip() for x in cells):
            out.append("\t".join(x or "" for x in cells))
    return "\n".join(out)


def xlsx_text(data: bytes) -> str:
    return _sheets_text(xlsx_rows(data))


def xls_text(data: bytes) -> str:
    return _sheets_text(xls.rows(data))


def pdf_lines(data: bytes, most: int = 30) -> str:
    """The text of the first pages, a line end between them."""
    return "\n".join(pdf.pages(data, most))


EXTRACTORS = {".txt": plain, ".csv": csv_text, ".html": html_text, ".htm": html_text, ".pdf": pdf.text, ".docx": docx_text, ".xlsx": xlsx_text, ".xls": xls_text}


def _extract(content: bytes, kind: str) -> tuple[str, str, str | None]:
    if kind not in EXTRACTORS:
        return "", "failed", f"unsupported extension: {kind}"
    try:
        return EXTRACTORS[kind](content).strip(), "ok", None
    except Exception as e:  # a file that cannot be read is a row with a status, not the end of the job
        return "", "failed", f"{type(e).__name__}: {e}"


_GOT = T.StructType([T.StructField(c, T.StringType()) for c in ("text", "status", "error_message")])


@F.pandas_udf(_GOT)
def extract(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_extract(c, k) for c, k in zip(content, kind, strict=True)], columns=["text", "status", "error_message"])


INDEX = ["source_id", "file_path", "file_name", "format", "status", "error_message", "file_size_bytes", "file_sha256", "text_length", "text_sha256", "duplicate_file_group", "source_has_multiple_files", "raw_text_output", "processed_at_utc"]


def extracted(files: DataFrame) -> DataFrame:
    """A row per file (``tables.discover``) with its text, status and error; an empty text has no hash."""
    got = files.withColumn("got", extract("content", "format"))
    text = F.coalesce("got.text", F.lit(""))
    return got.select(
        "source_id", F.col("path").alias("file_path"), "file_name", F.translate("format", ".", "").alias("format"), "got.status", F.coalesce("got.error_message", F.lit("")).alias("error_message"),
        F.col("length").alias("file_size_bytes"), "file_sha256", text.alias("text"), F.length(text).cast("long").alias("text_length"), F.when(text != "", dedup.text_hash(text)).otherwise("").alias("text_sha256"))


def raw_index(texts: DataFrame, run_at: str, folder: str = "raw_text") -> DataFrame:
    """The index of extracted files, without their texts: marks of duplicate bytes and of sources with several files, and where each source's text goes.

    The marks come from small aggregates that are joined back; ``run_at`` is the time of the run, in ISO form.
    """
    rows = dedup.several_files(dedup.file_groups(texts.drop("text")))
    good = texts.filter("status = 'ok'").select(F.col("source_id").alias("_of")).distinct()
    out = rows.join(good, F.col("source_id") == F.col("_of"), "left")
    return out.withColumns({"raw_text_output": F.when(F.col("_of").isNotNull(), F.concat(F.lit(folder + "/"), "source_id", F.lit(".txt"))).otherwise(""), "processed_at_utc": F.lit(run_at)}).select(*INDEX)


def write_index(index: DataFrame, path: str) -> None:
    """The index as CSV with a header, sorted by source and file."""
    index.orderBy("source_id", "file_path").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def same_text_other_bytes(texts: DataFrame) -> DataFrame:
    """Texts that files of different bytes have: hash, files, different bytes."""
    groups = texts.filter("text_sha256 <> ''").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_sha256").alias("n_files"))
    return groups.filter("n_files > 1")


_SHEET = T.ArrayType(T.StructType([T.StructField("sheet", T.StringType()), T.StructField("row_index", T.LongType()), T.StructField("cells", T.ArrayType(T.StringType()))]))


@F.pandas_udf(_SHEET)
def _sheet_rows(content: pd.Series, kind: pd.Series) -> pd.Series:
    read = {".xlsx": xlsx_rows, ".xls": xls.rows}
    return pd.Series([[{"sheet": s, "row_index": n, "cells": c} for s, n, c in read[k](data)] for data, k in zip(content, kind, strict=True)])


def sheets(files: DataFrame) -> DataFrame:
    """Rows of workbooks: the columns of ``files`` but the bytes, and ``sheet``, ``row_index`` (from 1), ``cells``. ``operators.tasks.with_header`` makes records of them."""
    rows = files.withColumn("_row", F.explode(_sheet_rows("content", "format"))).drop("content")
    return rows.select("*", "_row.*").drop("_row").filter("row_index > 0")


def _visible_or_pages(content: bytes, kind: str) -> str:
    if kind in (".html", ".htm"):
        return pages._visible(content.decode("utf-8", "replace"))
    return "\n\n".join(pdf.pages(content)) if kind == ".pdf" else ""


def set_text(content: Column, kind: Column) -> Column:
    """The text of a set's source file again from its bytes: visible blocks of HTML, pages of PDF, else empty."""
    @F.pandas_udf("string")
    def run(data: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([_visible_or_pages(d, k) for d, k in zip(data, kinds, strict=True)])

    return run(content, kind)
