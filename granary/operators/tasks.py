"""Tasks and their records: keys, families, sheets as rows, projections of records, JSON replies and prompt payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import edits as E
from ..functions import text as T

# Fixed values of the data model.
REQUIRED_COLUMNS = [
    "batch", "task_number", "task name", "global domain", "task_type", "manual_status", "final_prompt_text", "final_prompt_text_ru", "fixed_criteria_0_2_each",
    "fixed_criteria_0_2_each_ru", "rubric_id", "gold_set_id", "correct_items", "acceptable_variants", "optional_distractors", "explicit_exclusion_rules", "boundary_notes",
]
PROMPT_FIELDS = ["final_prompt_text", "final_prompt_text_ru"]
WIDE = ["raw_response_json", "prompt", "response_text"]
CONTEXT_FIELDS = [
    "task name", "global domain", "task_type", "research_object", "answer_unit", "source_anchor", "source_name", "source_scope", "internal_source_boundary",
    "key_facts_from_source_bundle", "expected_response_sections", "common_failure_modes", "borderline_cases",
]
INVENTORY = ["source_id", "family", "title", "domain", "url", "source_type", "source_subtype", "status", "cluster_id", "task_family", "notes"]
#: Columns of the two inventory sheets, in the order of ``INVENTORY`` without family and notes.
CORE_SHEET = ["Source ID", "Original text (EN)", "Domain", "URL", "Source type", "Publication family", "Quality flag", "Cluster ID", "Task family"]
SET_SHEET = ["Source ID", "Original text (EN)", "Domain", "URL", "Source type", "Source family", "QC status", "Cluster ID", "Task family"]


# --- keys and names -----------------------------------------------------------------------------------


def task_id(sheet: Column, batch: Column, number: Column, name: Column) -> Column:
    return F.concat(sheet, F.lit("-"), batch, F.lit("-task"), number, F.lit("-"), name)


def row_id(sheet: Column, batch: Column, number: Column, name: Column) -> Column:
    """As ``task_id``, in the editor's spelling."""
    return F.concat(sheet, F.lit("-batch"), batch, F.lit("-task"), number, F.lit("-"), name)


def task_key(id_: Column) -> Column:
    """What both spellings have in common."""
    return F.replace(id_, F.lit("batch"), F.lit(""))


def task_family(name: Column) -> Column:
    """The first two parts of a name; a name of one part as it is; "Unknown" for none."""
    return F.when(F.size(F.split(name, "-")) >= 2, F.substring_index(name, "-", 2)).when(name != "", name).otherwise("Unknown")


def prompt_for(field: str) -> Column:
    if field not in PROMPT_FIELDS:
        raise ValueError(f"Unsupported prompt field: {field!r}")
    return F.col(field)


def run_id(path: Column) -> Column:
    """The id in a run file's name."""
    return F.replace(F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1), F.lit("run_"), F.lit(""))


# --- sheets -------------------------------------------------------------------------------------------


def with_header(cells: DataFrame, sheet: str = "sheet", index: str = "row_index", values: str = "cells") -> DataFrame:
    """Rows of sheets (``sheet``, ``row_index`` from 1, ``cells`` array) as maps of the sheet's first row to the cells.

    Null cells are empty texts; rows without any cell that is not empty are left out; the row's index stays. The header is
    one small row a sheet, and a workbook has few; it goes to where the rows are, as rows dealt by sheet would all be one
    task's, which sorts them.
    """
    names = F.transform(values, lambda x: T.strip(F.coalesce(x, F.lit(""))))
    head = cells.filter(F.col(index) == 1).select(F.col(sheet).alias("_sheet"), names.alias("_names"))
    # of several columns of one name the last counts: made once a sheet
    last = F.filter(F.sequence(F.lit(0), F.size("_names") - 1), lambda i: ~F.array_contains(F.slice("_names", i + 2, F.size("_names")), F.get("_names", i)))
    head = head.filter(F.size("_names") > 0).withColumn("_at", last).withColumn("_keys", F.transform("_at", lambda i: F.get("_names", i)))
    rows = cells.filter((F.col(index) > 1) & F.exists(values, lambda x: x != ""))
    record = F.map_from_arrays("_keys", F.transform("_at", lambda i: F.coalesce(F.get(F.col(values), i), F.lit(""))))
    return rows.join(F.broadcast(head), F.col(sheet) == F.col("_sheet")).select(sheet, index, record.alias("record"))


def require(columns: list[str]) -> None:
    """An error that names the required columns which are not there."""
    if gone := [c for c in REQUIRED_COLUMNS if c not in columns]:
        raise ValueError(f"Missing required spreadsheet columns: {', '.join(gone)}")


def load(records: DataFrame, sheet: str = "all", domain: str | None = None, limit: int | None = None) -> DataFrame:
    """Tasks of sheet rows (``sheet``, ``row_index``, ``record``): one sheet (by name in any case) or all, one domain, the first ``limit``."""
    rows = records
    if sheet.lower() != "all":
        rows = rows.filter(F.lower("sheet") == sheet.lower())
    cell = lambda c: T.strip(F.col("record")[c])
    out = rows.select(F.col("sheet").alias("sheet_name"), "row_index", *[cell(c).alias(c.replace(" ", "_")) for c in REQUIRED_COLUMNS], F.col("record").alias("metadata"))
    out = out.withColumn("task_id", task_id(F.col("sheet_name"), F.col("batch"), F.col("task_number"), F.col("task_name"))).withColumn("task_family", task_family(F.col("task_name")))
    if domain:
        out = out.filter(F.lower("global_domain") == domain.lower())
    return out.orderBy("sheet_name", "row_index").limit(limit) if limit else out


def inventory(records: DataFrame, family: str, columns: list[str]) -> DataFrame:
    """Rows of an inventory sheet (``record`` maps) in the common shape; without an id no row; a default status."""
    cell = lambda k: F.nullif(F.col("record")[columns[k]], F.lit(""))
    id_ = T.strip(F.coalesce(F.col("record")[columns[0]], F.lit("")))
    made = [id_, F.lit(family), T.strip(F.coalesce(F.col("record")[columns[1]], F.lit(""))), cell(2), cell(3), cell(4), cell(5), F.coalesce(cell(6), F.lit("in_step3_inventory")), cell(7), cell(8), F.lit("")]
    return records.select(*[c.alias(n) for c, n in zip(made, INVENTORY, strict=True)]).filter("source_id <> ''")


def unknown_models(rows: DataFrame, models: DataFrame, key: str = "model") -> DataFrame:
    """Models of ``rows`` that the table of models lacks."""
    return rows.select(key).distinct().join(models.select(key), key, "left_anti")


# --- records ------------------------------------------------------------------------------------------


def summary(records: DataFrame) -> DataFrame:
    return records.drop(*WIDE)


def enriched(records: DataFrame, model: str, run: str) -> DataFrame:
    """Records of results joined to their tasks, with the columns a run log adds; ``task_type`` is the task's."""
    added = {"model": F.lit(model), "run_id": F.lit(run), **{c: F.col(c) for c in ("sheet_name", "task_number", "task_name", "global_domain")}, "task_family": task_family(F.col("task_name"))}
    return records.withColumns(added)


# --- JSON ---------------------------------------------------------------------------------------------


def unwrap(payload: Column, levels: int = 3) -> Column:
    """A JSON object under up to ``levels`` wrappers of a single key, whose value is an object, or a text that is JSON."""
    out = payload
    for _ in range(levels):
        def one(obj: Column) -> Column:
            value = F.get(F.map_values(F.from_json(obj, "map<string,string>")), F.lit(0))
            kind = F.get(F.map_values(F.from_json(obj, "map<string,variant>")), F.lit(0))
            named = F.schema_of_variant(kind)
            opens = named.startswith("OBJECT") | ((named == "STRING") & F.try_parse_json(value).isNotNull())
            return F.when((F.json_object_keys(obj).isNotNull()) & (F.size(F.json_object_keys(obj)) == 1), F.when(F.coalesce(opens, F.lit(False)), value).otherwise(obj)).otherwise(obj)

        out = T.bind(out, one)
    return out


def reply_text(body: Column) -> Column:
    """The text of a chat completion: a string, or the parts of a list that are texts, joined; else empty."""
    path = "$.choices[0].message.content"
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), path, "variant"))
    parts = F.from_json(F.get_json_object(body, path), "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "")
    return F.coalesce(F.when(kind == "STRING", F.get_json_object(body, path)).when(kind.startswith("ARRAY"), joined), F.lit(""))


def payload(id_: Column, fields: dict[str, Column], sentence: Column, body: Column, blocks: Column, gold: Column, previous: Column | None = None) -> Column:
    """The JSON that an editor is asked with: the row's context, its boundary sentence, its rubric, and what must not leak."""
    count = T.distinctions(body)
    context = F.struct(*[F.coalesce(fields[k], F.lit("")).alias(k) for k in CONTEXT_FIELDS])
    parts = [
        id_.alias("row_id"), sentence.alias("existing_trap_sentence"), body.alias("existing_trap_body"), count.alias("existing_distinction_count"), (count + 1).alias("required_distinction_count"),
        gold.alias("gold_values_that_must_never_appear_in_distractors"), context.alias("row_fields"), blocks.alias("current_rubric_bodies"),
    ]
    return F.to_json(F.struct(*parts, *([previous.alias("previous_attempt")] if previous is not None else [])))


def previous_attempt(edit: Column, issues: Column) -> Column:
    """What a rejected record says to the next attempt; null where it says nothing."""
    reasons = F.filter(F.coalesce(issues, F.array().cast("array<string>")), lambda x: x.startswith("[reject]"))
    text = lambda c: F.coalesce(edit[c], F.lit(""))
    made = F.struct(text("new_trap_dimension").alias("rejected_dimension"), text("new_trap_sentence").alias("rejected_sentence"), F.coalesce(edit["optional_distractors"], F.array().cast("array<string>")).alias("rejected_distractors"), reasons.alias("rejection_reasons"))
    return F.when((F.size(reasons) > 0) | edit.isNotNull(), made)


# --- edits --------------------------------------------------------------------------------------------


def publishable(records: DataFrame) -> DataFrame:
    """Edits that are written: ok or flagged, with a cell to change."""
    return records.filter(F.col("status").isin("ok", "flag") & (F.coalesce(F.size(F.map_keys("updates")), F.lit(0)) > 0))


def to_retry(records: DataFrame) -> DataFrame:
    return records.filter(F.col("status").isin("reject", "error"))


def outcome_counts(records: DataFrame) -> DataFrame:
    """Rows and cost by status; a missing cost is 0."""
    return records.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"))


def changed_only(updates: Column, blocks: Column) -> Column:
    """Rubric updates without those that are the present body in other white space."""
    return F.map_filter(updates, lambda k, v: T.flatten(F.coalesce(v, F.lit(""))) != T.flatten(F.coalesce(F.try_element_at(blocks, k), F.lit(""))))


def gold_spans(*cells: Column) -> Column:
    return E.bold(*cells)
