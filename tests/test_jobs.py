import json

from granary.__main__ import main
from granary.operators import tasks
from granary.sources import sinks

CELL = "".join(f"**Head {k}**\n- 2: x **gold {k}** y\n- 1: z\n- 0: w\n\n" for k in range(5))
PROMPT, PROMPT_RU = "Find x. Methodological trap: distinguish stocks from flows. Use `source_scope` only. Return: list", "Найдите. Ловушка: различайте запасы и потоки. Результат: список"


def _workbook(spark, path, rows):
    columns = tasks.REQUIRED_COLUMNS
    filled = [[r.get(c, "") for c in columns] for r in rows]
    sinks.write_xlsx(spark.createDataFrame(filled, ", ".join(f"`{c}` string" for c in columns)), str(path), "Core")


def test_sources_to_corpus(spark, tmp_path):
    core = tmp_path / "core"
    core.mkdir()
    for name, text in (("S001_a.txt", "REPORT OF IT\n\nText one.\n\nPage 2 of 3\n"), ("S002_b.txt", "REPORT OF IT\n\nText one.\n\nPage 2 of 3"), ("S003_c.html", "<p>Other text</p>")):
        (core / name).write_text(text)
    out, made = str(tmp_path / "raw"), tmp_path / "made"
    assert main(["extract", str(core), out], spark) == 0
    assert spark.read.option("header", True).csv(f"{out}/index").count() == 3
    sheet = spark.createDataFrame([[f"S00{k}", f"Title {k}", "d", "u", "t", "s", "", "c", "f"] for k in (1, 2, 3, 4)], ", ".join(f"`{c}` string" for c in tasks.CORE_SHEET))
    sinks.write_xlsx(sheet, str(tmp_path / "inventory.xlsx"), "Core Clusters")
    assert main(["packets", str(tmp_path / "inventory.xlsx"), out, str(made)], spark) == 0
    got = {r.source_id: r for r in spark.read.parquet(f"{made}/packets").collect()}
    assert {k: (r.packet_role, r.canonical_source_id) for k, r in got.items()} == {"S001": ("canonical", "S001"), "S002": ("alias", "S001"), "S003": ("canonical", "S003"), "S004": ("canonical", "S004")}
    assert got["S001"].markdown.endswith("# Title 1\n\n## FRAGMENT: main\n\n\n## REPORT OF IT\n\nText one.") and got["S004"].markdown.endswith("_No raw text was available at normalization time._")
    assert [r.mapped for r in spark.read.option("header", True).csv(f"{made}/source_map").orderBy("source_id").collect()] == ["yes", "yes", "yes", "missing"]
    assert main(["corpus", out, str(tmp_path / "corpus")], spark) == 0
    text = "".join(p.read_text() for p in sorted((tmp_path / "corpus").glob("part-*")))
    assert text.startswith("# Clean Core") and text.index("## Core Source S001") < text.index("## Core Source S003") and "Page 2 of 3" not in text


def test_tasks_to_report(spark, tmp_path):
    row = {"batch": "1", "task_number": "1", "task name": "CORE-POL-01", "global domain": "Policy", "final_prompt_text": PROMPT, "final_prompt_text_ru": PROMPT_RU, "fixed_criteria_0_2_each": CELL, "fixed_criteria_0_2_each_ru": CELL}
    before, after = tmp_path / "a.xlsx", tmp_path / "b.xlsx"
    _workbook(spark, before, [row, row | {"task_number": "2", "global domain": "Law"}])
    assert main(["neutralise", str(before), str(after)], spark) == 0 and main(["verify", str(before), str(after)], spark) == 0
    assert main(["strip-scope", str(after), str(tmp_path / "c.xlsx")], spark) == 0
    _workbook(spark, tmp_path / "bad.xlsx", [row | {"final_prompt_text": PROMPT + " It is a trick."}])
    assert main(["neutralise", str(tmp_path / "bad.xlsx"), str(tmp_path / "none.xlsx")], spark) == 1 and not (tmp_path / "none.xlsx").exists()
    _workbook(spark, tmp_path / "d.xlsx", [row | {"rubric_id": "changed"}, row | {"task_number": "2", "global domain": "Law"}])
    assert main(["verify", str(before), str(tmp_path / "d.xlsx")], spark) == 1
    out = tmp_path / "runs"
    assert main(["run", str(tmp_path / "c.xlsx"), str(out), "--dry-run", "--model", "m", "--domain", "policy", "--prompt-field", "final_prompt_text"], spark) == 0
    log = next(out.glob("run_*.jsonl"))
    (record,) = [json.loads(x) for p in log.glob("part-*") for x in p.read_text().splitlines()]
    assert record["prompt"] == "Find x. Distinguish stocks from flows. Return: list" and (record["task_id"], record["task_family"], record["status"]) == ("Core-1-task1-CORE-POL-01", "CORE-POL", "dry_run")
    (tmp_path / "scores.jsonl").write_text(json.dumps({"task_id": "t", "domain": "D", "model": "m", "score_coverage": 2, "score_total": 2}) + "\n")
    assert main(["report", str(log), str(tmp_path / "scores.jsonl"), str(tmp_path / "r.md")], spark) == 0
    assert "| D | 1 | 2.00 | 0.00 | 2 | 2 |" in (tmp_path / "r.md").read_text()
