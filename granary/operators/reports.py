"""Markdown reports: Spark aggregates, the driver renders the few rows that are left.

Numbers stay numbers in the tables; they are formatted here, by Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scoring

DIMENSIONS = ["Coverage", "Accuracy", "Reasoning", "Use of Evidence", "Clarity and Structure"]


def score_key(dimension: str) -> str:
    return "score_" + dimension.lower().replace(" ", "_")


def _table(head: list[str], rows: list[list]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + "|".join("---" for _ in head) + "|", *["| " + " | ".join(map(str, r)) + " |" for r in rows]]


def run_report(scores: DataFrame, records: DataFrame, run_id: str, model: str, dimensions: list[str] = DIMENSIONS, most: int = 2, plots: str = "plots") -> str:
    """A run: totals, scores overall, by domain (best first) and dimension, tokens, and its errors by frequency.

    ``scores``: ``domain``, ``score_total``, ``token_usage_total`` and a column a dimension; ``records``: ``status``, ``error_message``, ``row_index``.
    """
    top = most * len(dimensions)
    states = records.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("status") == "ok").alias("ok")).first()
    whole = scoring.overall(scores).first()
    out = ["# Run report", "", f"**Run ID:** `{run_id}`  ", f"**Model:** `{model}`  ", f"**Total tasks:** {states['all']}  ", f"**Completed (ok):** {states['ok']}  ", f"**Errors:** {states['all'] - states['ok']}  ", f"**Scored:** {whole.n}  ", ""]
    if whole.n:
        out += ["## Overall Score", "", *_table(["Metric", "Value"], [["Mean total score", f"**{whole['mean']:.2f} / {top}**"], ["Mean score %", f"**{whole['mean'] / top * 100:.1f}%**"], ["Median total score", f"{whole.median:.1f}"], ["Min / Max", f"{whole.lo} / {whole.hi}"]]), ""]
        domains = scoring.by_domain(scores).orderBy(F.desc("mean"), "domain").collect()
        out += ["## Score by Domain", "", *_table(["Domain", "n", "Mean", "Std", "Min", "Max"], [[r.domain, r.n, f"{r['mean']:.2f}", f"{r['std']:.2f}", r.lo, r.hi] for r in domains]), ""]
        means = {r.dimension: r["mean"] or 0.0 for r in scoring.by_dimension(scores, [score_key(d) for d in dimensions]).collect()}
        out += ["## Score by Dimension", "", *_table(["Dimension", f"Mean (0–{most})", "% of max"], [[d, f"{means[score_key(d)]:.2f}", f"{means[score_key(d)] / most * 100:.1f}%"] for d in dimensions]), ""]
        used = scoring.usage(scores, "token_usage_total").first()
        if used.total:
            out += ["## Token Usage", "", *_table(["Metric", "Value"], [["Total tokens used", f"{used.total:,}"], ["Mean tokens / task", f"{used['mean']:.0f}"], ["Max tokens / task", f"{used.most:,}"]]), ""]
        out += ["## Plots", "", *[f"![{name}]({plots}/{k:02d}_{name.lower().replace(' ', '_')}.png)" for k, name in enumerate(("Score by domain", "Score by dimension", "Score distribution", "Heatmap domain dimension"), 1)], ""]
    errors = scoring.top_errors(records.filter("status <> 'ok'").withColumn("error_message", F.coalesce("error_message", F.lit("unknown"))), "error_message", "row_index", 1000).collect()
    out += ["## Error Summary", "", *(_table(["Error", "Count"], [[f"`{r.message}`", r.n] for r in errors]) if errors else ["No errors."])]
    return "\n".join(out)


MEANINGS = {"ok": "written, no issues", "flag": "written, needs human review", "declined": "model judged the row already exhaustive", "reject": "not written", "error": "API failure, not written"}


def edit_report(records: DataFrame, model: str, generated: str) -> str:
    """Edits of a run: outcomes, kinds of traps by frequency, and every row that was not simply accepted, with its issues.

    ``records``: ``row_id``, ``status``, ``issues``, ``cost``, ``trap_type``, ``new_trap_sentence``, ``existing_distinctions``, ``new_distinctions``. What is gathered
    are rows for a person to read.
    """
    counts = {r.status: (r.n, r.cost) for r in records.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost")).collect()}
    out = ["# Core task hardening report", "", f"- generated: {generated}", f"- model: `{model}`", f"- rows processed: {sum(n for n, _ in counts.values())}", f"- estimated cost: ${sum(c for _, c in counts.values()):.4f}", "", "## Outcome", ""]
    out += [*_table(["status", "rows", "meaning"], [[s, counts.get(s, (0, 0))[0], m] for s, m in MEANINGS.items()]), ""]
    kinds = records.filter("coalesce(trap_type, '') <> ''").groupBy("trap_type").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first")).orderBy(F.desc("n"), "first").collect()
    if kinds:
        out += ["## Trap types added", "", *[f"- {r.n} x {r.trap_type}" for r in kinds], ""]
    order = ["declined", "reject", "error", "flag"]
    rows = records.filter(F.col("status").isin(order)).orderBy("row_id").collect()
    for status in order:
        own = [r for r in rows if r.status == status]
        if own:
            out += [f"## {status} ({len(own)})", ""]
        for r in own:
            out.append(f"### {r.row_id}")
            if r.new_trap_sentence:
                out.append(f"- proposed trap: {r.new_trap_sentence}")
            if r.existing_distinctions is not None:
                out.append(f"- distinctions: {r.existing_distinctions} -> {'?' if r.new_distinctions is None else r.new_distinctions}")
            out += [*[f"- {i}" for i in r.issues or []], ""]
    return "\n".join(out)


def normalization_report(source_map: DataFrame, packets: DataFrame, dedup_check: DataFrame, generated: str) -> str:
    """Counts of a packet run, its checks, sources without a raw text, and very small packets."""
    families = {r.family: r for r in source_map.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("mapped") == "missing").alias("missing")).collect()}
    made = {r.family: r.n for r in packets.groupBy("family").agg(F.count(F.lit(1)).alias("n")).collect()}
    check = dedup_check.first()
    mark = lambda good: "PASS" if good else "FAIL"
    count = lambda f, k: families[f][k] if f in families else 0
    out = ["# Normalization Report", "", f"Generated: {generated}", "", "## Counts", ""]
    for f in ("Core", "Set"):
        out += [f"- {f} sources: **{count(f, 'n')}**", f"- {f} packets: **{made.get(f, 0)}**", f"- {f} with raw text: **{count(f, 'n') - count(f, 'missing')}**", f"- {f} missing raw: **{count(f, 'missing')}**"]
    out += ["", "## Core text-level deduplication", "", f"- Unique canonical body texts: **{check.unique_canonical_bodies}**", f"- Alias packets (metadata only): **{check.alias_packets}**", f"- Variants still copying full canonical body: **{check.carried}** {mark(check['pass'])}", "", "## Validation", ""]
    out += [f"- {f} inventory vs packets: {mark(count(f, 'n') == made.get(f, 0))} ({made.get(f, 0)} vs {count(f, 'n')})" for f in ("Core", "Set")]
    for f in ("Core", "Set"):
        gone = [r.source_id for r in source_map.filter((F.col("family") == f) & (F.col("mapped") == "missing")).select("source_id").orderBy("source_id").collect()]
        out += ["", f"## Missing raw text ({f})", "", *[f"- {s}" for s in gone or ["(none)"]]]
    out += ["", "## Very small outputs (<200 bytes)", ""]
    for f in ("Core", "Set"):
        small = [r.source_id for r in packets.filter((F.col("family") == f) & (F.octet_length("markdown") < 200)).select("source_id").orderBy("source_id").collect()]
        out.append(f"- {f}: {', '.join(small) if small else '(none)'}")
    return "\n".join(out) + "\n"


SET_INDEX = ["source_id", "source_file", "page_title", "page_class", "extraction_mode", "entity_count", "qa_status", "boundedness", "answer_set_type", "cluster_id", "domain", "url_step3", "extraction_json"]


def set_index(extractions: DataFrame, metadata: DataFrame, folder: str = "set/extractions") -> DataFrame:
    """The index of extracted set pages (``source_id``, ``source_file``, ``page_title``, ``page_class``, ``e`` of ``pages.entities``) with the first metadata of each source."""
    from ..functions import pages as P
    from ..functions import text as T

    first = metadata.groupBy(F.col("source_id").alias("_s")).agg(F.min_by(F.struct("cluster_id", "domain", "url"), "place").alias("m"))
    rows = extractions.join(first, F.col("source_id") == F.col("_s"), "left")
    note = P.annotation(F.col("page_class"), F.col("e.counts.entities_extracted"))
    name = F.concat(F.lit(f"{folder}/"), "source_id", F.lit("/"), T.slug(F.regexp_replace(F.replace(F.col("source_file"), F.concat("source_id", F.lit("_")), F.lit("")), r"\.[^.]*$", "")), F.lit(".json"))
    return rows.select(
        "source_id", "source_file", "page_title", "page_class", "e.extraction_mode", F.col("e.counts.entities_extracted").alias("entity_count"), note["qa_status"].alias("qa_status"), note["boundedness"].alias("boundedness"),
        note["candidate_answer_set_type"].alias("answer_set_type"), *[F.coalesce(F.col("m")[c], F.lit("")).alias(n) for c, n in (("cluster_id", "cluster_id"), ("domain", "domain"), ("url", "url_step3"))], name.alias("extraction_json"))


def set_summary(index: DataFrame, generated: str) -> str:
    """Files by class (most frequent first) and by source."""
    classes = index.groupBy("page_class").agg(F.count(F.lit(1)).alias("n"), F.min("source_file").alias("first")).orderBy(F.desc("n"), "first").collect()
    sets = index.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.sum("entity_count").alias("entities")).orderBy("source_id").collect()
    out = ["# Set Extraction Summary", "", f"Generated: {generated}", "", f"- Source files processed: **{sum(r.n for r in sets)}**", f"- Unique SET IDs: **{len(sets)}**", "", "## By page class", ""]
    return "\n".join([*out, *[f"- {r.page_class}: {r.n} files" for r in classes], "", "## By SET ID (file counts)", "", *[f"- **{r.source_id}**: {r.n} files, {r.entities} entities total" for r in sets]]) + "\n"
