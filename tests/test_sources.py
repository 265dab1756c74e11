import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from granary.operators import tasks
from granary.sources import formats, pdf, sinks, tables, xls


def _pdf() -> bytes:
    one = b"BT /F1 12 Tf 72 700 Td (Hello \\(world\\)) Tj 0 -14 Td [(Sec)-20(ond) -300 (line)] TJ T* <4142> Tj ET"
    two = zlib.compress(b"BT /F2 9 Tf <00010002> Tj ET")
    names = b"beginbfchar\n<0001> <0416>\nendbfchar beginbfrange <0002> <0003> <0041> endbfrange"
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 4 0 R 10 0 R] /Resources << /Font << /F1 7 0 R /F2 8 0 R >> >> >>", b"<< /Type /Page /Contents 5 0 R >>", b"<< /Type /Page /Contents [6 0 R] >>",
        b"<< >> stream\n" + one + b"\nendstream", b"<< /Filter /FlateDecode >> stream\n" + two + b"\nendstream", b"<< /Type /Font >>", b"<< /Type /Font /ToUnicode 9 0 R >>", b"<< >> stream\n" + names + b"\nendstream",
        b"<< /Type /Page /Contents 11 0 R >>", b"<< /Filter /DCTDecode >> stream\nx\nendstream",
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj %s endobj\n" % (k, o) for k, o in enumerate(objects, 1)) + b"%%EOF"


def _xls() -> bytes:
    record = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    text = lambda s: struct.pack("<HB", len(s), 1) + s.encode("utf-16-le")
    sst = struct.pack("<II", 2, 2) + text("имя") + struct.pack("<HB", 8, 0) + b"long"
    head = record(0x809, b"\0" * 16)
    sheet = head + record(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + record(0xFD, struct.pack("<HHHI", 0, 2, 0, 1)) + record(0x203, struct.pack("<HHHd", 2, 0, 0, 1.5)) + record(0x27E, struct.pack("<HHHI", 2, 1, 0, (7 << 2) | 2))
    sheet += record(0xBD, struct.pack("<HHHIHIH", 3, 0, 0, (100 << 2) | 3, 0, (5 << 2) | 2, 1)) + record(0x204, struct.pack("<HHH", 4, 0, 0) + struct.pack("<HB", 2, 0) + b"ok") + record(0x06, struct.pack("<HHH", 4, 1, 0) + b"\0" * 6 + b"\xff\xff" + b"\0" * 8) + record(0x207, struct.pack("<HB", 3, 0) + b"res") + record(0x0A, b"")
    begin = lambda at: record(0x85, struct.pack("<IH", at, 0) + struct.pack("<BB", 1, 0) + b"N")
    tail = record(0xFC, sst) + record(0x3C, b"\x00" + b"er x") + record(0x0A, b"")
    front = head + begin(0) + tail
    book = head + begin(len(front)) + tail + sheet
    book += b"\0" * (-len(book) % 512)
    n = len(book) // 512
    fat = [0xFFFFFFFD, 0xFFFFFFFE, *range(3, 2 + n), 0xFFFFFFFE]
    fat += [0xFFFFFFFF] * (128 - len(fat))
    header = bytearray(512)
    header[:8] = bytes.fromhex("d0cf11e0a1b11ae1")
    struct.pack_into("<HHHHH", header, 24, 0x3E, 3, 0xFFFE, 9, 6)
    struct.pack_into("<I", header, 44, 1)
    struct.pack_into("<II", header, 48, 1, 0)
    struct.pack_into("<IIIII", header, 56, 64, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    struct.pack_into("<109I", header, 76, 0, *[0xFFFFFFFF] * 108)

    def entry(name, kind, first, size):
        e = bytearray(128)
        raw = name.encode("utf-16-le")
        e[: len(raw)] = raw
        struct.pack_into("<HB", e, 64, len(raw) + 2, kind)
        struct.pack_into("<II", e, 116, first, size)
        return bytes(e)

    directory = entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Workbook", 2, 2, len(book))
    return bytes(header) + struct.pack("<128I", *fat) + directory.ljust(512, b"\0") + book


def test_discover_and_index(spark, tmp_path):
    (tmp_path / "S001_a.txt").write_bytes("﻿naïve \n".encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "S001_b.html").write_bytes(b"<html><script>x</script><p>Hi &amp; bye</p></html>")
    (tmp_path / "S002_c.txt").write_bytes("naïve".encode("latin-1"))
    (tmp_path / "S003_d.pdf").write_bytes(b"%PDX")
    (tmp_path / "s004_e.CSV").write_bytes(b'a,"b ""c"" d"\n1,2\n')
    (tmp_path / "S005_f.txt").write_bytes("naïve".encode("latin-1"))
    (tmp_path / "S006_g.txt").write_bytes(b"  \n")
    (tmp_path / "notes.txt").write_bytes(b"no id")
    files = tables.discover(spark, str(tmp_path), r"^(S\d{3})_", [".txt", ".html", ".pdf", ".csv"])
    assert {r.file_name for r in tables.discover(spark, str(tmp_path), r"^(S\d{3})_", [".txt", ".html"], recursive=False).collect()} == {"S001_a.txt", "S002_c.txt", "S005_f.txt", "S006_g.txt"}
    texts = formats.extracted(files)
    said = {r.file_name: r for r in texts.collect()}
    assert said["S001_a.txt"].text == said["S002_c.txt"].text == "naïve" and said["S001_b.html"].text == "Hi & bye" and said["s004_e.CSV"].text == 'a\tb "c" d\n1\t2'
    index = formats.raw_index(texts, "2026-01-01T00:00:00+00:00")
    assert index.columns == formats.INDEX
    got = {r.file_name: r for r in index.collect()}
    assert len(got) == 7 and got["s004_e.CSV"].source_id == "S004" and got["s004_e.CSV"].format == "csv"
    assert got["S003_d.pdf"].status == "failed" and "not a PDF" in got["S003_d.pdf"].error_message and got["S003_d.pdf"].raw_text_output == "" and got["S001_a.txt"].raw_text_output == "raw_text/S001.txt"
    assert got["S001_a.txt"].source_has_multiple_files and not got["S002_c.txt"].source_has_multiple_files
    assert got["S002_c.txt"].duplicate_file_group == got["S005_f.txt"].duplicate_file_group == "file_sha256:" + got["S002_c.txt"].file_sha256[:16] and got["S001_a.txt"].duplicate_file_group == ""
    assert got["S006_g.txt"].text_length == 0 and got["S006_g.txt"].text_sha256 == "" and got["S006_g.txt"].status == "ok"
    assert [(r.n, r.n_files) for r in formats.same_text_other_bytes(texts).collect()] == [(3, 2)]
    formats.write_index(index, str(tmp_path / "index"))
    back = tables.read_csv(spark, str(tmp_path / "index"), ", ".join(f"{c} string" for c in formats.INDEX))
    assert [r.file_name for r in back.collect()] == ["S001_a.txt", "S001_b.html", "S002_c.txt", "S003_d.pdf", "s004_e.CSV", "S005_f.txt", "S006_g.txt"]


def test_decode(spark, tmp_path):
    rows = spark.createDataFrame([(b"\xef\xbb\xbfa",), ("é".encode("latin-1"),)], "c binary")
    assert [r.t for r in rows.select(tables.decode(rows["c"]).alias("t")).collect()] == ["a", "é"]
    (tmp_path / "a.txt").write_bytes(b"a\xffb")
    assert tables.read_texts(spark, str(tmp_path)).first().text == "a�b"


def test_pdf(spark):
    first, second, third = pdf.pages(_pdf())
    assert (first, second) == ("Hello (world)\nSecond line\nAB", "ЖA") and third.startswith("[page 3 extraction error")
    assert pdf.text(_pdf()).startswith(first + "\n\n" + second) and formats.pdf_lines(_pdf(), 1) == first
    with pytest.raises(ValueError):
        pdf.pages(b"no pdf")
    rows = spark.createDataFrame([(_pdf(), ".pdf"), (b"<main><p>one two</p><nav><p>no</p></nav></main>", ".html"), (b"x", ".doc")], "c binary, k string")
    got = [r.t for r in rows.select(formats.set_text(F.col("c"), F.col("k")).alias("t")).collect()]
    assert got[0].startswith(first) and got[1:] == ["one two", ""]


def test_office_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    assert formats.docx_text(data.getvalue()) == "One\na\tb"
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s}><sheets><sheet name="N"/><sheet name="Empty"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>x</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2</v></c></row><row r="4"><c/></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {s}><sheetData/></worksheet>")
    assert formats.xlsx_text(data.getvalue()) == "=== Sheet: N ===\nx\t\t2\n=== Sheet: Empty ==="
    want = [("N", 1, ["имя", None, "longer x"]), ("N", 3, ["1.5", "7.0"]), ("N", 4, ["1.0", "5.0"]), ("N", 5, ["ok", "res"])]
    assert xls.rows(_xls()) == want and formats.xls_text(_xls()) == "=== Sheet: N ===\nимя\t\tlonger x\n1.5\t7.0\n1.0\t5.0\nok\tres"
    with pytest.raises(ValueError):
        xls.rows(b"x" * 600)
    files = spark.createDataFrame([("S1", data.getvalue(), ".xlsx"), ("S2", _xls(), ".xls")], "source_id string, content binary, format string")
    got = [tuple(r) for r in formats.sheets(files).select("source_id", "sheet", "row_index", "cells").collect()]
    assert got[0] == ("S1", "N", 1, ["x", None, "2"]) and got[2] == ("S2", "N", 1, ["имя", None, "longer x"]) and len(got) == 6


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a <b> & \"c\"\n", [1, 2], None), (2, "  é", [], 1.5)], "id int, t string, a array<int>, x double")
    assert sinks.write_xlsx(df, str(tmp_path / "S001_x.xlsx")) == 2
    files = tables.discover(spark, str(tmp_path), r"^(S\d{3})_", [".xlsx"])
    rows = tasks.with_header(formats.sheets(files).select("sheet", "row_index", "cells"))
    assert [(r.row_index, r.record) for r in rows.orderBy("row_index").collect()] == [(2, {"id": "1", "t": "a <b> & \"c\"\n", "a": "[1,2]", "x": ""}), (3, {"id": "2", "t": "  é", "a": "[]", "x": "1.5"})]


def test_rows_of_a_sheet_stay_in_their_tasks(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the sizes of sheets are not known beforehand
    try:
        rows = spark.range(1, 401, 1, 4).select(F.when(F.col("id") % 100 == 0, "B").otherwise("A").alias("sheet"), F.when(F.col("id") <= 100, F.col("id") % 99).otherwise(F.col("id")).alias("row_index"), F.col("id").cast("string").alias("x"))
        cells = F.when(F.col("row_index") == 1, F.array(F.lit("a"), F.lit(" b "), F.lit("a"))).otherwise(F.array(F.lit("no"), F.lit(None), F.col("x")))
        got = tasks.with_header(rows.select("sheet", "row_index", cells.alias("cells"))).withColumn("task", F.spark_partition_id()).collect()
        assert len({r.task for r in got if r.sheet == "A"}) == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    # sheet A: its row 1 is the header, rows 2 to 98 and from 101 follow; B has the header of its own row 1
    assert sorted((r.sheet, r.row_index) for r in got) == [("A", k) for k in [*range(2, 99), *range(101, 400)] if k % 100] + [("B", k) for k in (200, 300, 400)]
    assert all(r.record == {"b": "", "a": str(r.row_index)} for r in got)


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "é, \"q\"\nx", [1, 2])], "id int, t string, a array<int>")
    sinks.append_jsonl(df, str(tmp_path / "j"))
    sinks.append_jsonl(df, str(tmp_path / "j"))
    assert tables.read_jsonl(spark, str(tmp_path / "j"), "id int, t string, a array<int>").collect() == df.collect() * 2
    assert sinks.write_csv(df, str(tmp_path / "c")) == 1
    assert tables.read_csv(spark, str(tmp_path / "c"), "id int, t string, a string").first().t == "é, \"q\"\nx"
    assert sinks.write_csv(df.limit(0), str(tmp_path / "none")) == 0 and not (tmp_path / "none").exists()
    assert tables.or_empty(spark, lambda: spark.read.json(str(tmp_path / "gone")), "id int").count() == 0
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.json").write_text('{"id": 1,\n "t": "x"}')
    (tmp_path / "docs" / "b.json").write_text("{broken")
    assert [tuple(r) for r in tables.read_json_documents(spark, str(tmp_path / "docs"), "id int, t string").collect()] == [(1, "x")]


def test_texts_by_source(spark, tmp_path):
    files = spark.createDataFrame([("S1", "core/b.txt", "two", "ok"), ("S1", "core/a.txt", "one\nline", "ok"), ("S2", "core/c.txt", "x", "ok"), ("S3", "core/d.txt", "", "failed")], "source_id string, path string, text string, status string")
    sinks.write_grouped(files, str(tmp_path / "raw"))
    read = lambda p: "".join(f.read_text() for f in sorted(p.glob("part-*")))
    assert read(tmp_path / "raw" / "source_id=S1") == "===== FILE: core/a.txt =====\none\nline\n\n===== FILE: core/b.txt =====\ntwo\n\n"
    assert {p.name for p in (tmp_path / "raw").glob("source_id=*")} == {"source_id=S1", "source_id=S2"}
    sinks.write_texts(files.select(F.col("path").alias("stem"), "text").withColumn("stem", F.regexp_replace("stem", "[/.]", "_")), str(tmp_path / "one"), "stem", "text")
    assert read(tmp_path / "one" / "stem=core_c_txt") == "x\n"
    sinks.write_by(files.select(F.lit("maker/model").alias("model"), "text"), str(tmp_path / "by"), "model")
    assert (tmp_path / "by" / "model=maker__model").exists()
    sections = spark.createDataFrame([(f"S{k:03d}", f"## {k}\n") for k in range(50)], "id string, section string").repartition(7)
    sinks.write_corpus(sections, str(tmp_path / "corpus"), "id", "section", "# Head")
    assert read(tmp_path / "corpus") == "# Head\n" + "".join(f"## {k}\n\n" for k in range(50))
    packets = spark.createDataFrame([("S1", "# Normalized Source Packet\n\n---\n\n" + "b" * 2500, ["n"])], "source_id string, markdown string, notes array<string>")
    sinks.write_packets(packets, str(tmp_path / "packets"), "now")
    meta = spark.read.json(str(tmp_path / "packets" / "metadata")).first()
    assert meta.normalized_text_preview == "b" * 2000 + "…" and meta.normalized_at_utc == "now" and read(tmp_path / "packets" / "markdown" / "source_id=S1").startswith("# Normalized")


def test_merge_updates(spark):
    base = spark.createDataFrame([(1, "a", "b"), (2, "c", None)], "k int, x string, y string")
    new = spark.createDataFrame([(2, {"y": "d"})], "k int, updates map<string,string>")
    assert sorted(map(tuple, sinks.merge_updates(base, new, "k", ["y"]).collect())) == [(1, "a", "b"), (2, "c", "d")]
    with pytest.raises(KeyError):
        sinks.merge_updates(base, new, "k", ["z"])


def test_small_tables_are_spread(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("id", "uuid() as t", "id % 7 as k").repartition(1)
    rows.write.parquet(str(tmp_path / "one"))
    rows.repartition(3).write.parquet(str(tmp_path / "three"))
    one, three = (spark.read.parquet(str(tmp_path / n)) for n in ("one", "three"))
    assert tables.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    plan = tables.spread(one).filter("k = 3").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,3)" in plan and "uuid" not in plan and "t:string" not in plan
    assert "Exchange" not in tables.spread(three)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in tables.spread(one.limit(5))._jdf.queryExecution().executedPlan().toString()
