"""Where results go: JSON lines, CSV, sheets, texts by source, packets, the corpus, and copies of a table with cells changed."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def remove(spark: SparkSession, path: str) -> None:
    """A folder of any file system that Spark reads, gone."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def as_cells(df: DataFrame) -> DataFrame:
    """Nested columns as JSON."""
    return df.withColumns({f.name: F.to_json(f.name) for f in df.schema.fields if f.dataType.typeName() in ("struct", "array", "map")})


def write_csv(df: DataFrame, path: str) -> int:
    """CSV with a header; nested columns as JSON. Rows written; the plan runs once, and an empty table leaves no file."""
    seen = Observation()
    as_cells(df).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    if not (n := seen.get["n"]):
        remove(df.sparkSession, path)
    return n


def _sheet_rows(rows: Iterator[list]) -> Iterator[str]:
    for cells in rows:
        said = "".join("<c/>" if v is None else f"<c><v>{v}</v></c>" if isinstance(v, int | float) and not isinstance(v, bool) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v)))}</t></is></c>' for v in cells)
        yield f"<row>{said}</row>"


def write_xlsx(df: DataFrame, path: str, sheet: str = "results") -> int:
    """A workbook of one sheet for a person to read, written by the driver row by row. Rows written; for large tables use CSV or Parquet."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006/relationships"
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{pack}"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pack}"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as raw, io.TextIOWrapper(raw, "utf-8") as out:
            out.write(f'<worksheet xmlns="{main}"><sheetData>')
            out.write(next(_sheet_rows(iter([df.columns]))))
            for row in as_cells(df).toLocalIterator():
                out.write(next(_sheet_rows(iter([list(row)]))))
                n += 1
            out.write("</sheetData></worksheet>")
    return n


def folder_name(value: Column) -> Column:
    """A value as the name of a folder: a slash becomes two underscores."""
    return F.replace(value, F.lit("/"), F.lit("__"))


def write_by(df: DataFrame, path: str, *keys: str) -> None:
    """A folder for each key value."""
    df.withColumns({k: folder_name(F.col(k)) for k in keys}).write.mode("overwrite").partitionBy(*keys).json(path)


def write_texts(df: DataFrame, path: str, key: str, text: str) -> None:
    df.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def write_grouped(files: DataFrame, path: str, key: str = "source_id", order: str = "path", text: str = "text") -> None:
    """A folder for each source with its files' texts in order, each under a header line: read in the order of their names, the parts are one text.

    Ranges of (source, file) are sorted and written where they are, so a source of any size is spread over tasks.
    """
    chunk = F.concat(F.lit("===== FILE: "), F.col(order), F.lit(" =====\n"), F.col(text), F.lit("\n"))
    rows = files.filter("status = 'ok'") if "status" in files.columns else files
    rows.repartitionByRange(F.col(key), F.col(order)).sortWithinPartitions(key, order).select(key, chunk.alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def write_corpus(sections: DataFrame, path: str, order: str, section: str, head: str = "") -> None:
    """One Markdown text in parts that follow each other: the head, then the sections in order."""
    spark = sections.sparkSession
    rows = sections.select(F.lit(1).alias("_part"), F.col(order).cast("string").alias("_order"), F.col(section).alias("value"))
    if head:
        rows = rows.unionAll(spark.createDataFrame([(0, "", head)], "_part int, _order string, value string"))
    rows.repartitionByRange("_part", "_order").sortWithinPartitions("_part", "_order").select("value").write.mode("overwrite").text(path)


def write_packets(packets: DataFrame, path: str, run_at: str) -> None:
    """Packets as Markdown, a folder a source, and their metadata with a preview as JSON lines."""
    from ..operators.packets import preview as shown

    packets.select("source_id", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("source_id").text(f"{path}/markdown")
    meta = packets.withColumns({"normalized_text_path": F.concat(F.lit(f"{path}/markdown/source_id="), "source_id"), "normalized_text_preview": shown(F.col("markdown")), "normalized_at_utc": F.lit(run_at)})
    meta.drop("markdown").write.mode("overwrite").json(f"{path}/metadata")


def preview(body: Column, size: int = 2000) -> Column:
    return F.when(F.length(body) > size, F.concat(F.substring(body, 1, size), F.lit("…"))).otherwise(body)


def merge_updates(base: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` with the cells that ``updates`` (key, ``updates`` map) names replaced; the source is never changed.

    A column that ``base`` does not have is an error.
    """
    if unknown := [c for c in columns if c not in base.columns]:
        raise KeyError(f"unknown columns: {unknown}")
    u = updates.select(F.col(key).alias("_of"), "updates")
    joined = base.join(u, base[key] == F.col("_of"), "left")
    return joined.select(*[F.coalesce(F.col("updates")[c].cast(base.schema[c].dataType), base[c]).alias(c) if c in columns else base[c] for c in base.columns])
