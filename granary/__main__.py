"""The jobs of the data model from a shell: ``python -m granary JOB ...``. Each composes operators and writes what it makes.

extract FOLDER OUT             texts of source files, their index, and the texts by source
packets WORKBOOK RAW OUT       packets and the source map of an inventory, from what ``extract`` wrote
corpus RAW OUT                 the consolidated corpus of what ``extract`` wrote
run WORKBOOK OUT               tasks of a workbook asked of a model (or --dry-run), appended to a run log
report LOG SCORES OUT          a run's report from its log and scores (JSON lines)
neutralise WORKBOOK OUT        prompts without labels; nothing is written while a giveaway word is left
strip-scope WORKBOOK OUT       prompts without the scope sentence; nothing is written while its name is left
verify BEFORE AFTER            problems of an edited workbook; exit code 1 if there are any
"""

from __future__ import annotations

import argparse
import os
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import packets, reports, runs, tasks, validation
from .sources import formats, sinks, tables

EXTENSIONS = [".txt", ".csv", ".html", ".htm", ".pdf", ".docx", ".xlsx", ".xls"]
SOURCE = r"^(S\d{3}|SET\d{3})_"


def extract(spark: SparkSession, folder: str, out: str, run_at: str) -> int:
    """Files that could not be read are rows with a status; returns their number."""
    formats.extracted(tables.discover(spark, folder, SOURCE, EXTENSIONS)).write.mode("overwrite").parquet(f"{out}/raw")
    texts = spark.read.parquet(f"{out}/raw")
    formats.write_index(formats.raw_index(texts, run_at), f"{out}/index")
    sinks.write_grouped(texts.withColumnRenamed("file_path", "path"), f"{out}/raw_text")
    return texts.filter("status <> 'ok'").count()


def sheet_records(spark: SparkSession, workbook: str) -> DataFrame:
    """Rows of a workbook's sheets as records (``operators.tasks.with_header``)."""
    kind = os.path.splitext(workbook)[1].lower()
    files = spark.read.format("binaryFile").load(workbook).select("content", F.lit(kind).alias("format"))
    return tasks.with_header(formats.sheets(files).select("sheet", "row_index", "cells"))


def make_packets(spark: SparkSession, workbook: str, raw: str, out: str, run_at: str) -> int:
    """Packets of the core sources of an inventory (sheets "Core Clusters" and "Set Clusters"); returns how many."""
    records = sheet_records(spark, workbook)
    texts = spark.read.parquet(f"{raw}/raw").filter("status = 'ok'")
    inventory = tasks.inventory(records.filter("sheet = 'Core Clusters'"), "Core", tasks.CORE_SHEET).unionByName(tasks.inventory(records.filter("sheet = 'Set Clusters'"), "Set", tasks.SET_SHEET))
    known = spark.createDataFrame([], "source_id string, canonical_source_id string, duplicate_file_group string, duplicate_reason string")
    resolved = packets.canonical(inventory, known, texts)
    parts = texts.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct(F.col("file_name").alias("name"), "text"))).alias("parts"))
    packets.packets(resolved.filter("family = 'Core'"), parts).write.mode("overwrite").parquet(f"{out}/packets")
    made = spark.read.parquet(f"{out}/packets")
    sinks.write_packets(made, out, run_at)
    names = texts.select("source_id", F.col("file_name").alias("name"))
    none = spark.createDataFrame([], "source_id string")
    sinks.write_csv(packets.source_map(resolved, packets.raw_files(names, names), none).orderBy("source_id"), f"{out}/source_map")
    return made.count()


def corpus(spark: SparkSession, raw: str, out: str, run_at: str) -> None:
    texts = spark.read.parquet(f"{raw}/raw").filter("status = 'ok'")
    section = packets.core_section(F.col("text"), [("Source files", F.col("file_name"))], F.col("source_id"))
    sinks.write_corpus(texts.select(F.concat_ws("/", "source_id", "file_path").alias("place"), section.alias("section")), out, "place", "section", f"# Clean Core and Set Source Corpus\n\nGenerated: {run_at}\n")


def run(spark: SparkSession, workbook: str, out: str, model: str, ask, field: str, dry_run: bool, sheet: str, domain: str | None, limit: int | None, retries: int, run_id: str) -> DataFrame:
    """Records of a run, appended to ``out`` as JSON lines before anything is made of them."""
    rows = tasks.load(sheet_records(spark, workbook), sheet, domain, limit)
    tasks.prompt_for(field)
    asked = rows.drop("metadata")
    answered = asked if dry_run else runs.logged(runs.respond(asked, field, ask, runs.RetryPolicy(retries)), f"{out}/replies_{run_id}")
    records = tasks.enriched(runs.results(answered, field, dry_run), model, run_id)
    sinks.append_jsonl(records, f"{out}/run_{run_id}.jsonl")
    return spark.read.schema(records.schema).json(f"{out}/run_{run_id}.jsonl")


def workbook_columns(spark: SparkSession, workbook: str, sheet: str = "Core") -> DataFrame:
    """A sheet as a table: ``row_index``, and a column for each name of its header."""
    records = sheet_records(spark, workbook).filter(F.lower("sheet") == sheet.lower())
    first = records.select(F.map_keys("record")).first()
    names = [n for n in (first[0] if first else []) if n]
    return records.select("row_index", *[F.coalesce(F.col("record")[n], F.lit("")).alias(n) for n in names])


def rewrite(spark: SparkSession, workbook: str, out: str, change) -> int:
    """A copy of a workbook's sheet with ``change`` made, where no residual is left; returns the rows written."""
    rows = workbook_columns(spark, workbook)
    changed = change(rows)
    validation.gate(changed)
    return sinks.write_xlsx(changed.orderBy("row_index").select(*[c for c in rows.columns if c != "row_index"]), out, "Core")


def verify(spark: SparkSession, before: str, after: str) -> list[tuple]:
    a, b = (workbook_columns(spark, w) for w in (before, after))
    identity = lambda df: df.withColumn("_id", tasks.row_id(F.lit("Core"), F.col("batch"), F.col("task_number"), F.col("`task name`")))
    columns = [c for c in a.columns if c != "row_index" and c in b.columns]
    return [(r.row_index, r.problem) for r in validation.verify(identity(a), identity(b), "row_index", "_id", columns).orderBy("row_index", "problem").collect()]


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="granary", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("job", choices=["extract", "packets", "corpus", "run", "report", "neutralise", "strip-scope", "verify"])
    parser.add_argument("paths", nargs="+")
    parser.add_argument("--url", default="")
    parser.add_argument("--model", default="")
    parser.add_argument("--sheet", default="Core")
    parser.add_argument("--domain")
    parser.add_argument("--limit", type=int)
    parser.add_argument("--prompt-field", default="final_prompt_text_ru", choices=tasks.PROMPT_FIELDS)
    parser.add_argument("--retries", type=int, default=3)
    parser.add_argument("--max-tokens", type=int, default=1800)
    parser.add_argument("--dry-run", action="store_true")
    a = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("granary").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    now = datetime.now(UTC)
    try:
        match a.job, a.paths:
            case "extract", [folder, out]:
                return 2 if extract(spark, folder, out, now.isoformat()) else 0
            case "packets", [workbook, raw, out]:
                print(f"packets: {make_packets(spark, workbook, raw, out, now.isoformat())}")
            case "corpus", [raw, out]:
                corpus(spark, raw, out, now.isoformat())
            case "run", [workbook, out]:
                ask = None if a.dry_run else runs.chat(a.url, a.model, os.environ.get("CHAT_API_KEY", ""), max_tokens=a.max_tokens)
                records = run(spark, workbook, out, a.model, ask, a.prompt_field, a.dry_run, a.sheet, a.domain, a.limit, a.retries, runs.utc_slug(now))
                for r in records.groupBy("status").count().orderBy("status").collect():
                    print(f"{r.status}: {r['count']}")
            case "report", [log, scores, out]:
                keys = ", ".join(f"{reports.score_key(d)} int" for d in reports.DIMENSIONS)
                scored = tables.read_jsonl(spark, scores, f"task_id string, domain string, model string, token_usage_total long, {keys}, score_total int")
                records = tables.read_jsonl(spark, log, "task_id string, status string, error_message string").withColumn("row_index", F.monotonically_increasing_id())
                model = (scored.select("model").first() or ["unknown"])[0]
                run_id = os.path.basename(log.rstrip("/")).removesuffix(".jsonl").replace("run_", "")
                with open(out, "w", encoding="utf-8") as f:
                    f.write(reports.run_report(scored, records, run_id, model))
            case "neutralise", [workbook, out]:
                print(f"rows: {rewrite(spark, workbook, out, lambda rows: validation.neutralise(rows, *tasks.PROMPT_FIELDS))}")
            case "strip-scope", [workbook, out]:
                print(f"rows: {rewrite(spark, workbook, out, lambda rows: validation.strip_scope(rows, *tasks.PROMPT_FIELDS))}")
            case "verify", [before, after]:
                problems = verify(spark, before, after)
                for row, problem in problems:
                    print(f"row {row}: {problem}")
                print("VERIFY FAILED" if problems else "VERIFY OK")
                return 1 if problems else 0
            case _:
                parser.error(f"{a.job}: wrong number of paths")
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
