from datetime import UTC, datetime

from pyspark.sql import functions as F

from granary.operators import packets, reports, runs, scoring, tasks
from granary.sources import sinks


def test_retry_policy_and_responder(spark):
    assert [runs.RetryPolicy().delay(k) for k in range(3)] == [5.0, 10.0, 20.0] and [runs.RetryPolicy(base=3.0, linear=True).delay(k) for k in range(3)] == [3.0, 6.0, 9.0]
    calls, waits = {}, []

    def ask(prompt):
        calls[prompt] = calls.get(prompt, 0) + 1
        if prompt == "flaky" and calls[prompt] < 3:
            return {"http_status": 503, "error": "busy"}
        if prompt == "bad":
            return {"http_status": 400, "error": "no"}
        if prompt == "down":
            return {"error": "no route"}
        return {"response_text": "said " + prompt, "http_status": 200, "token_usage": "{}", "finish_reason": "stop"}

    rows = spark.createDataFrame([(f"t{k}", p) for k, p in enumerate(["fine", "flaky", "bad", "down", " ", None])], "task_id string, final_prompt_text string")
    got = runs.results(runs.respond(rows, "final_prompt_text", ask, runs.RetryPolicy(2, 1.0), waits.append), "final_prompt_text").orderBy("task_id").collect()
    assert [r.status for r in got] == ["ok", "ok", "error", "error", "error_prompt", "error_prompt"]
    assert got[1].response_text == "said flaky" and got[2].error_message == "HTTPError(status=400): no" and got[3].error_message == "HTTPError(status=None): no route"
    assert got[4].error_message == "Task 't4' has an empty 'final_prompt_text' prompt." and got[2].prompt == "" and got[0].prompt_field_used == "final_prompt_text"
    dry = runs.results(rows, "final_prompt_text", dry_run=True).orderBy("task_id").collect()
    assert [r.status for r in dry] == ["dry_run"] * 4 + ["error_prompt"] * 2
    assert [r[0] for r in spark.createDataFrame([(None,), (429,), (404,)], "s int").select(runs.retryable(F.col("s"))).collect()] == [True, True, False]
    assert runs.utc_slug(datetime(2026, 7, 2, 23, 42, 42, tzinfo=UTC)) == "20260702T234242Z"


def test_chat_over_http(spark, tmp_path):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers["Authorization"], body))
            prompt = body["messages"][0]["content"]
            status, reply = {
                "busy": (503, {"error": {"code": 9, "message": "later"}}), "plain": (500, "no json"), "cut": (200, {"choices": [{"message": {"content": ""}, "finish_reason": "length"}]}),
                "parts": (200, {"choices": [{"message": {"content": [{"type": "text", "text": "a"}, {"type": "x"}, {"type": "text", "text": "b"}]}}]}),
            }.get(prompt, (200, {"choices": [{"message": {"content": "said"}, "finish_reason": "stop"}], "usage": {"total_tokens": 7}}))
            data = (reply if isinstance(reply, str) else json.dumps(reply)).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = runs.chat(f"http://127.0.0.1:{server.server_port}/v1/", "maker/m", "secret", max_tokens=5, extra={"reasoning": {"enabled": True}})
    assert ask("hi") == {"http_status": 200, "response_text": "said", "finish_reason": "stop", "token_usage": '{"total_tokens": 7}'}
    path, key, body = seen[0]
    assert (path, key, body["model"], body["max_tokens"], body["reasoning"], body["temperature"]) == ("/v1/chat/completions", "Bearer secret", "maker/m", 5, {"enabled": True}, 0.2)
    assert ask("busy") == {"http_status": 503, "error": "chat error (code=9): later"} and ask("plain") == {"http_status": 500, "error": "chat error : no json"} and ask("parts")["response_text"] == "ab"
    rows = spark.createDataFrame([("t1", "hi"), ("t2", "cut"), ("t3", "busy")], "task_id string, final_prompt_text string")
    replies = runs.logged(runs.respond(rows, "final_prompt_text", ask, runs.RetryPolicy(1, 0.0)), str(tmp_path / "run"))
    got = runs.results(replies, "final_prompt_text").orderBy("task_id").collect()
    assert [r.status for r in got] == ["ok", "error_truncated", "error"] and sum(b["messages"][0]["content"] == "busy" for _, _, b in seen) == 3
    server.shutdown()
    assert "error" in runs.chat("http://127.0.0.1:1", "m", timeout=1)("x")


def test_projections(spark):
    row = spark.createDataFrame([("a/b/run_20260101T000000Z.jsonl", "p", "r", "j", 1)], "path string, prompt string, response_text string, raw_response_json string, k int")
    assert row.select(tasks.run_id(F.col("path"))).first()[0] == "20260101T000000Z" and tasks.summary(row).columns == ["path", "k"]
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, None, 7)], "k int, v string, place int")
    new = spark.createDataFrame([(2, None), (9, "x")], "k int, v string")
    assert [tuple(r) for r in runs.upsert(base, new, "k").orderBy("place").collect()] == [(1, "a", 5), (2, None, 6), (3, None, 7)]


GOLDEN_RUN = """# Run report

**Run ID:** `r1`  
**Model:** `maker/m`  
**Total tasks:** 5  
**Completed (ok):** 3  
**Errors:** 2  
**Scored:** 3  

## Overall Score

| Metric | Value |
|---|---|
| Mean total score | **4.67 / 10** |
| Mean score % | **46.7%** |
| Median total score | 4.0 |
| Min / Max | 0 / 10 |

## Score by Domain

| Domain | n | Mean | Std | Min | Max |
|---|---|---|---|---|---|
| B | 1 | 10.00 | 0.00 | 10 | 10 |
| A | 2 | 2.00 | 2.00 | 0 | 4 |

## Score by Dimension

| Dimension | Mean (0–2) | % of max |
|---|---|---|
| Coverage | 2.00 | 100.0% |
| Accuracy | 1.50 | 75.0% |
| Reasoning | 1.50 | 75.0% |
| Use of Evidence | 1.00 | 50.0% |
| Clarity and Structure | 2.00 | 100.0% |

## Token Usage

| Metric | Value |
|---|---|
| Total tokens used | 1,500 |
| Mean tokens / task | 1500 |
| Max tokens / task | 1,500 |

## Plots

![Score by domain](plots/01_score_by_domain.png)
![Score by dimension](plots/02_score_by_dimension.png)
![Score distribution](plots/03_score_distribution.png)
![Heatmap domain dimension](plots/04_heatmap_domain_dimension.png)

## Error Summary

| Error | Count |
|---|---|
| `busy` | 1 |
| `unknown` | 1 |"""


def test_run_report(spark):
    keys = [reports.score_key(d) for d in reports.DIMENSIONS]
    rows = spark.createDataFrame([("A", 2, 1, 1, 0, None, 1500), ("A", None, None, None, None, None, 0), ("B", 2, 2, 2, 2, 2, None)], "domain string, " + ", ".join(f"{k} int" for k in keys) + ", token_usage_total int")
    scores = scoring.scored(rows, keys, 10)
    assert [r.score_pct for r in scores.collect()] == [40.0, 0.0, 100.0] and scoring.scored(rows, keys, 10, exclude_null=True).count() == 2
    records = spark.createDataFrame([("ok", None, 1), ("ok", None, 2), ("ok", None, 3), ("error", "busy", 4), ("error_prompt", None, 5)], "status string, error_message string, row_index int")
    assert reports.run_report(scores, records, "r1", "maker/m") == GOLDEN_RUN
    assert reports.run_report(scores.limit(0), records.filter("status = 'ok'"), "r2", "m").endswith("No errors.")


def test_edit_report(spark):
    schema = "row_id string, status string, issues array<string>, cost double, trap_type string, new_trap_sentence string, existing_distinctions int, new_distinctions int"
    rows = spark.createDataFrame([("a", "ok", [], 0.01, "kind", "s", 1, 2), ("b", "flag", ["[flag] x"], None, "kind", "Distinguish.", 1, 2), ("c", "reject", ["[reject] y", "[flag] z"], 0.02, "other", None, 3, None), ("d", "error", ["[error] e"], 0.0, None, None, None, None)], schema)
    text = reports.edit_report(rows, "m", "now")
    assert "- rows processed: 4\n- estimated cost: $0.0300" in text and "| flag | 1 | written, needs human review |" in text and "- 2 x kind\n- 1 x other" in text
    assert "## reject (1)\n\n### c\n- distinctions: 3 -> ?\n- [reject] y\n- [flag] z\n\n## error (1)\n\n### d\n- [error] e\n\n## flag (1)\n\n### b\n- proposed trap: Distinguish.\n- distinctions: 1 -> 2\n- [flag] x\n" in text and "### a" not in text


def test_packet_reports_and_sections(spark, tmp_path):
    source_map = spark.createDataFrame([("S1", "Core", "yes"), ("S2", "Core", "missing"), ("SET1", "Set", "yes")], "source_id string, family string, mapped string")
    made = spark.createDataFrame([("S1", "Core", "x" * 300), ("S2", "Core", "tiny"), ("SET1", "Set", "y" * 300)], "source_id string, family string, markdown string")
    check = spark.createDataFrame([(2, 2, 0, 0, True)], "canonical_packets int, unique_canonical_bodies int, alias_packets int, carried int, pass boolean")
    text = reports.normalization_report(source_map, made, check, "now")
    assert "- Core inventory vs packets: PASS (2 vs 2)" in text and "## Missing raw text (Core)\n\n- S2\n" in text and "- Core: S2\n- Set: (none)\n" in text and "body: **0** PASS" in text
    entity = "struct<label:string,cells:array<string>,table_index:int,row_index:int,caption:string,entity_type:string,url:string,is_country_or_region_list:boolean,line_index:int>"
    rows = spark.createDataFrame([("SET1", "SET1_a b.htm", ["lead"], [("x", ["x", "1"], 0, 0, "Cap", "wikitable_row", None, None, None)], "Body here"), ("SET2", "f.pdf", [], [], None)], f"id string, f string, l array<string>, e array<{entity}>, t string")
    got = [r[0] for r in rows.select(packets.set_section(F.col("id"), F.col("f"), [("Page title", F.lit("P")), ("URL", F.lit(None))], F.col("l"), F.col("e"), F.col("t"))).collect()]
    assert got[0] == "## Set Source SET1: SET1_a b.htm\n\n- **Page title:** P\n\n### Lead / Context\n\nlead\n\n### Structured Rows / Entities\n\n```text\nTable: Cap\nx | 1\n```\n\n### Clean Text\n\n```text\nBody here\n```\n"
    assert got[1].endswith("### Clean Text\n\n_No clean text was available for this file._\n") and "Structured" not in got[1]
    counts = "struct<extraction_mode:string,counts:struct<entities_extracted:int>>"
    pages = spark.createDataFrame([("SET1", "SET1_a b.htm", "P", "wh_index", ("wiki_links", (60,))), ("SET2", "SET2_c.pdf", "Q", "unknown", ("x", (2,)))], f"source_id string, source_file string, page_title string, page_class string, e {counts}")
    meta = spark.createDataFrame([("SET1", "c1", "d", "u", 1), ("SET1", "c2", "d", "u", 2)], "source_id string, cluster_id string, domain string, url string, place int")
    index = reports.set_index(pages, meta)
    assert index.columns == reports.SET_INDEX and [tuple(r)[5:] for r in index.orderBy("source_id").collect()] == [(60, "pass_as_index_source", "bounded", "linked_country_or_region_world_heritage_list_pages", "c1", "d", "u", "set/extractions/SET1/a_b.json"), (2, "needs_review", "unknown", "unknown", "", "", "", "set/extractions/SET2/c.json")]
    assert "- **SET1**: 1 files, 60 entities total" in reports.set_summary(index, "now") and sinks.write_xlsx(index, str(tmp_path / "i.xlsx"), "set_extraction") == 2


def test_long_groups_are_counted_not_listed(spark):
    from granary.operators import dedup

    rows = spark.createDataFrame([(k, "same") for k in range(30)] + [(7, "same"), (100, "x"), (101, "x"), (102, "alone"), (103, "alone2")], "k long, t string")
    got = {r.canonical_id: (r.ids, r.n, r.n_files) for r in dedup.hash_groups(rows, "k", "t", 10).collect()}
    assert got == {0: (None, 31, 0), 100: ([100, 101], 2, 0)}
    assert dedup.hash_groups(rows, "k", "t").filter("canonical_id = 0").first().ids == list(range(30))


def test_alias_packet(spark):
    resolved = spark.createDataFrame([("S1", "S1", False, "none", "Own title — x", None), ("S2", "S1", True, "text_hash_group:ab", "", "u")], "source_id string, canonical_source_id string, is_text_duplicate boolean, duplicate_group string, title string, url string")
    for c in ("family", "domain", "source_type", "source_subtype", "status", "cluster_id"):
        resolved = resolved.withColumn(c, F.lit("Core") if c == "family" else F.lit(None).cast("string"))
    raw = spark.createDataFrame([("S1", [("S1.txt", "===== FILE: a.pdf =====\nText of it\n\nSee also\nx")])], "source_id string, parts array<struct<name:string,text:string>>")
    one, two = packets.packets(resolved, raw).orderBy("source_id").collect()
    assert one.title == "Own title" and one.markdown == "# Normalized Source Packet\n\n- **source_id:** S1\n- **canonical_source_id:** S1\n- **family:** Core\n- **title:** Own title\n- **duplicate_group:** none\n- **is_text_duplicate:** False\n- **packet_role:** canonical\n- **raw_fragment_count:** 1\n\n---\n\n# Own title\n\n## FRAGMENT: a.pdf\n\nText of it"
    assert one.notes == ["Trimmed trailing Wikipedia sections (See also, References, categories).", "Applied conservative cleanup without summarization or reordering."]
    assert two.title == "Own title" and two.notes[0] == "Alias packet only; full text stored under S1." and two.notes[1:] == one.notes
    assert "- **normalized_text_ref:** normalized_core/S1.normalized.md\n- **packet_role:** alias\n\n---\n\nThis inventory row is a **duplicate variant**" in two.markdown and two.markdown.endswith("- **Title (step3):** Own title\n- **URL (step3):** u\n- **Source type (step3):** (none)\n- **Source subtype (step3):** (none)\n- **Cluster ID (step3):** (none)")


def test_set_packets_and_source_map(spark):
    from granary.functions import pages as P

    row = lambda label: (label, [label, "1"], 0, 0, "Cap", "wikitable_row", None, None, None)
    pages = [("P1", "f1", ["A lead  of it", "A lead of it", "edit"], [row("x"), row("y")]), (None, "f2.htm", ["Second"], []), ("P3", "f3", None, [row("z")]), ("P4", "f4", ["too late"], None)]
    rows = spark.createDataFrame([("T", pages, "raw"), ("U", None, "Main menu\nBODY OF IT\n\nSee also\nx"), ("V", [], None)], f"t string, p array<struct<page_title:string,source_file:string,lead_paragraphs:array<string>,entities:array<{P.ENTITY}>>>, r string")
    got = [r[0] for r in rows.select(packets.set_body(F.col("t"), F.col("p"), F.col("r"))).collect()]
    assert got[0].body == "# T\n\n\n\n## Lead\n\n\n\nA lead of it\n\nSecond\n\n\n\n## P1\n\n\n\n### Cap\n\n| x | 1 |\n| --- | --- |\n| y | 1 |\n\n\n\n## P3\n\n\n\n### Cap\n\nz | 1"
    assert got[0].notes == ["Preserved structured rows from 4 extraction JSON file(s) as Markdown tables/lists."]
    assert got[1].body == "# U\n\n\n\n# U\n\n## BODY OF IT" and got[1].notes == ["Removed 1 navigation/UI lines (Set/HTML sources)."] and got[2].body == "# V"
    resolved = spark.createDataFrame([("S1", "Core", "S1", "none"), ("S2", "Core", "S1", "text_hash_group:a"), ("S3", "Core", "S3", "none"), ("SET1", "Set", "SET1", "none")], "source_id string, family string, canonical_source_id string, duplicate_group string")
    for c in ("title", "domain", "url", "source_type", "source_subtype", "status"):
        resolved = resolved.withColumn(c, F.lit(None).cast("string"))
    files = packets.raw_files(spark.createDataFrame([("S1", "S1.txt")] + [("SET1", f"b{k}.txt") for k in range(7)], "source_id string, name string"), spark.createDataFrame([("SET1", "b0.txt")], "source_id string, name string"))
    made = packets.source_map(resolved, files, spark.createDataFrame([("SET1",), ("SET1",)], "source_id string"))
    assert made.columns == packets.MAP_COLUMNS
    assert [tuple(r)[10:] for r in made.orderBy("source_id").collect()] == [(1, None, "S1.txt", "yes", "normalized_core/S1.normalized.md"), (1, None, "S1.txt", "yes", "normalized_core/S2.normalized.md"), (0, None, "", "missing", "normalized_core/S3.normalized.md"), (7, 2, "b0.txt; b1.txt; b2.txt; b3.txt; b4.txt; ...", "yes", "normalized_set/SET1.normalized.md")]
