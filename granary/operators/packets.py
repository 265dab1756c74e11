"""Source packets: canonical records, the Markdown of canonical and alias packets, source maps, corpus sections.

A packet's body is one row's text; canonical bodies are made once and aliases only point to them, so a text that many
sources share is cleaned and stored once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import structure as S
from ..functions import text as T
from . import dedup

# Fixed values of the data model.
HEADER_KEYS = ["source_id", "canonical_source_id", "family", "title", "domain", "url", "source_type", "source_subtype", "status", "duplicate_group", "is_text_duplicate", "normalized_text_ref"]
MAP_COLUMNS = ["source_id", "family", "canonical_source_id", "title", "domain", "url", "source_type", "source_subtype", "status", "duplicate_group", "raw_file_count", "extraction_json_count", "raw_files", "mapped", "normalized_output"]
NO_TEXT = "_No raw text was available at normalization time._"


def canonical(sources: DataFrame, known: DataFrame, index: DataFrame) -> DataFrame:
    """``sources`` (``source_id``) with ``canonical_source_id``, ``duplicate_group``, ``is_text_duplicate``.

    ``known``: earlier decisions by ``source_id`` (``canonical_source_id``, ``duplicate_file_group``, ``duplicate_reason``). ``index``: raw
    texts (``source_id``, ``text_sha256``); a source with several has its least hash. Sources of one text have the least of them as
    canonical, whatever was decided earlier. A group of very many sources is named by their number (``dedup.LISTED``).
    """
    hashes = index.filter("coalesce(source_id, '') <> '' and coalesce(text_sha256, '') <> ''").groupBy("source_id").agg(F.min("text_sha256").alias("hash"))
    groups = dedup.id_lists(index.filter("coalesce(text_sha256, '') <> ''").withColumnRenamed("text_sha256", "hash"), "hash", "source_id").withColumnRenamed("canonical_id", "_least")
    decided = known.select("source_id", F.col("canonical_source_id").alias("_c"), F.col("duplicate_file_group").alias("_f"), F.col("duplicate_reason").alias("_r"))
    rows = sources.join(decided, "source_id", "left").join(hashes, "source_id", "left").join(groups, "hash", "left")
    own = T.strip(T.truthy(F.col("_c"), F.col("source_id")))
    base = F.coalesce(F.nullif(F.col("_f"), F.lit("")), F.when(own != F.col("source_id"), F.concat(F.lit("variant_of:"), own)), F.nullif(F.col("_r"), F.lit("")), F.lit("none"))
    least = F.col("_least")
    variant = F.coalesce(F.col("source_id") != least, F.lit(False))
    others = F.coalesce(F.array_join(F.array_except("ids", F.array("source_id")), ","), (F.col("n_ids") - 1).cast("string"))
    return rows.withColumns({
        "canonical_source_id": F.when(variant, least).otherwise(own),
        "duplicate_group": F.when(base != "none", base).when(variant, F.concat(F.lit("text_hash_group:"), F.left("hash", F.lit(16)))).when(least.isNotNull(), F.concat(F.lit("canonical_for:"), others)).otherwise("none"),
        "is_text_duplicate": variant | (own != F.col("source_id")),
    }).drop("_c", "_f", "_r", "hash", "ids", "_least", "n_ids")


def header(alias: bool = False, fragments: Column | None = None) -> Column:
    """A packet's head: its fields that are neither null nor empty as bullets, over the columns ``HEADER_KEYS``, ``packet_role``."""
    shown = [(k, F.initcap(F.col(k).cast("string")) if k == "is_text_duplicate" else F.col(k)) for k in HEADER_KEYS] + [("packet_role", F.col("packet_role"))]
    if fragments is not None:
        shown.append(("raw_fragment_count", F.when(F.size(fragments) > 0, F.size(fragments))))
    title = "# Normalized Source Packet" + (" (alias — text duplicate)" if alias else "")
    bullets = S.bullets_of(shown)
    return F.concat(F.lit(title + "\n\n"), bullets, F.lit("\n\n---\n\n"))


def alias_body() -> Column:
    """The body of a packet that only points to its canonical one. Its wording is fixed by the data model."""
    ref = F.concat(F.lit("`normalized_core/"), F.col("canonical_source_id"), F.lit(".normalized.md`"))
    field = lambda label, c: F.concat(F.lit(f"- **{label} (step3):** "), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("(none)")))
    lines = [
        F.lit("This inventory row is a **duplicate variant** of a document whose text is stored once."), F.lit(""),
        F.concat(F.lit("**Canonical source ID:** `"), F.col("canonical_source_id"), F.lit("`")), F.concat(F.lit("**Canonical normalized packet:** "), ref), F.lit(""),
        F.lit("The underlying extracted text is identical to the canonical source. Do not treat this row as independent evidence in clustering or model tasks."), F.lit(""),
        F.lit("### Variant-specific inventory metadata (differs from canonical)"), F.lit(""),
        field("Title", "title"), field("URL", "url"), field("Source type", "source_type"), field("Source subtype", "source_subtype"), field("Cluster ID", "cluster_id"),
    ]
    return F.concat_ws("\n", *lines)


def combined(parts: Column) -> Column:
    """Files of a source ((``name``, ``text``) in order) as (text, labels): each fragment under a mark of its own."""
    each = F.flatten(F.transform(parts, lambda p: F.transform(S.fragments(p["text"]), lambda f: F.struct(F.when(f["label"] == "main", p["name"]).otherwise(f["label"]).alias("label"), F.concat(F.lit("===== FRAGMENT: "), f["label"], F.lit(" =====\n"), f["body"]).alias("text")))))
    return T.bind(each, lambda e: F.struct(F.array_join(F.transform(e, lambda x: x["text"]), "\n\n").alias("text"), F.transform(e, lambda x: x["label"]).alias("labels")))


def core_body(raw: Column, title: Column) -> Column:
    """(body, notes) of a core source's combined text: cleaned, without closing sections and a leading licence, as Markdown."""
    def of(c: Column) -> Column:
        def tail(kept: Column) -> Column:
            def front(rest: Column) -> Column:
                notes = F.concat(c["notes"], F.array_compact(F.array(
                    F.when(F.size(kept) < F.size(c["lines"]), F.lit("Trimmed trailing Wikipedia sections (See also, References, categories).")),
                    F.when(F.size(rest) < F.size(kept), F.lit("Removed leading copyright/license boilerplate block.")),
                    F.lit("Applied conservative cleanup without summarization or reordering."),
                )))
                return F.struct(S.markdown(rest, title).alias("body"), notes.alias("notes"))

            return T.bind(S.strip_license(kept), front)

        return T.bind(S.trim_tail(c["lines"]), tail)

    empty = F.struct(F.lit(NO_TEXT).alias("body"), F.array(F.lit("No raw text available for this source_id.")).alias("notes"))
    return F.when(T.strip(F.coalesce(raw, F.lit(""))) == "", empty).otherwise(T.bind(S.clean_ns(raw, F.lit(False)), of))


def packets(resolved: DataFrame, raw: DataFrame) -> DataFrame:
    """Core packets: ``source_id``, ``canonical_source_id``, ``packet_role``, ``title``, ``markdown``, ``notes``.

    ``resolved``: inventory rows with the columns of ``canonical``; ``raw``: ``source_id``, ``parts`` (array of name and text). Bodies are
    made for canonical sources only; an alias takes the canonical packet's first three notes by a join.
    """
    texts = raw.select(F.col("source_id").alias("_s"), combined(F.col("parts")).alias("_raw"))
    own = resolved.filter("not is_text_duplicate").join(texts, F.col("source_id") == F.col("_s"), "left")
    own = own.withColumn("_text", F.col("_raw.text")).withColumn("title", S.infer_title(F.col("title"), F.coalesce("_text", F.lit("")), F.lit(False), F.col("source_id")))
    with_body = lambda rows: rows.withColumns({"packet_role": F.lit("canonical"), "normalized_text_ref": F.lit(""), "_body": core_body(F.col("_text"), F.col("title"))})
    out = ["source_id", "canonical_source_id", "packet_role", "title", "markdown", "notes"]
    one = F.array_repeat(F.lit(1), F.when(F.col("_text").isNull(), 0).otherwise(1))
    made = with_body(own).withColumns({"markdown": F.concat(header(fragments=one), F.col("_body.body")), "notes": F.col("_body.notes")}).select(*out)
    # only the canonical sources that have aliases are cleaned again, for their notes
    asked = resolved.filter("is_text_duplicate").select(F.col("canonical_source_id").alias("source_id")).distinct()
    known = with_body(own.join(asked, "source_id", "left_semi")).select(F.col("source_id").alias("_c"), F.col("title").alias("_title"), F.slice("_body.notes", 1, 3).alias("_notes"))
    copies = resolved.filter("is_text_duplicate").join(known, F.col("canonical_source_id") == F.col("_c"), "left")
    copies = copies.withColumns({
        "packet_role": F.lit("alias"),
        "normalized_text_ref": F.concat(F.lit("normalized_core/"), F.col("canonical_source_id"), F.lit(".normalized.md")),
        "title": T.truthy(T.strip(F.substring_index(F.coalesce("title", F.lit("")), " — ", 1)), F.col("_title")),
        "notes": F.concat(F.array(F.concat(F.lit("Alias packet only; full text stored under "), F.col("canonical_source_id"), F.lit("."))), F.coalesce("_notes", F.array().cast("array<string>"))),
    })
    return made.unionByName(copies.withColumn("markdown", F.concat(header(alias=True), alias_body())).select(*out))


def set_body(title: Column, payloads: Column, raw: Column, most: int = 3) -> Column:
    """(body, notes) of a set source: leads of its first pages and the entities of all, or, where nothing was extracted, its raw text as Markdown.

    ``payloads``: array of (``page_title``, ``source_file``, ``lead_paragraphs``, ``entities``). A lead counts once, cleaned.
    """
    empty = F.array().cast("array<string>")
    set_ = F.lit(True)

    def lead(text: Column) -> Column:
        return F.array_join(F.filter(clean_set(text)["lines"], lambda x: x != ""), " ")

    def clean_set(text: Column) -> Column:
        return S.clean_ns(text, set_)

    def page(p: Column) -> Column:
        return T.bind(S.entities_markdown(p["entities"]), lambda md: F.when(md != "", F.array(F.lit(""), F.concat(F.lit("## "), T.truthy(p["page_title"], p["source_file"])), F.lit(""), md)).otherwise(empty))

    def of(x: Column) -> Column:
        some = F.size(x["pages"]) > 0
        leads = F.array_distinct(F.filter(F.transform(F.flatten(F.transform(F.slice(x["pages"], 1, most), lambda p: F.coalesce(p["lead_paragraphs"], empty))), lead), lambda v: v != ""))
        shown = T.bind(leads, lambda v: F.when(F.size(v) > 0, F.array(F.lit(""), F.lit("## Lead"), F.lit(""), F.array_join(v, "\n\n"))).otherwise(empty))
        plain = F.when(~some & (T.strip(x["raw"]) != ""), F.array(F.lit(""), S.markdown(S.trim_tail(clean_set(x["raw"])["lines"]), x["title"]))).otherwise(empty)
        body = F.concat(F.array(F.concat(F.lit("# "), x["title"])), shown, F.flatten(F.transform(x["pages"], page)), plain)
        said = F.when(some, F.array(F.concat(F.lit("Preserved structured rows from "), F.size(x["pages"]).cast("string"), F.lit(" extraction JSON file(s) as Markdown tables/lists.")))).otherwise(empty)
        return F.struct(T.strip(F.array_join(body, "\n\n")).alias("body"), F.concat(said, F.when(some, empty).otherwise(F.coalesce(clean_set(x["raw"])["notes"], empty))).alias("notes"))

    return T.bind(F.struct(title.alias("title"), F.coalesce(payloads, F.array_repeat(F.get(payloads, F.lit(0)), 0)).alias("pages"), F.coalesce(raw, F.lit("")).alias("raw")), of)


def source_map(resolved: DataFrame, files: DataFrame, extractions: DataFrame) -> DataFrame:
    """One row a source (``MAP_COLUMNS``): what it was mapped to. ``files``: ``raw_files``; ``extractions``: ``source_id`` a page; a core source's file is its canonical's."""
    pages = extractions.groupBy(F.col("source_id").alias("_p")).agg(F.count(F.lit(1)).alias("_pages"))
    core = F.col("family") == "Core"
    at = F.when(core, F.col("canonical_source_id")).otherwise(F.col("source_id"))
    rows = resolved.join(files.select(F.col("source_id").alias("_f"), "raw_file_count", "raw_files"), at == F.col("_f"), "left").join(pages, F.col("source_id") == F.col("_p"), "left")
    return rows.withColumns({
        "raw_file_count": F.coalesce("raw_file_count", F.lit(0)), "raw_files": F.coalesce("raw_files", F.lit("")), "extraction_json_count": F.when(~core, F.coalesce("_pages", F.lit(0))),
        "mapped": F.when(F.col("_f").isNotNull(), "yes").otherwise("missing"), "normalized_output": F.concat(F.lit("normalized_"), F.lower("family"), F.lit("/"), "source_id", F.lit(".normalized.md")),
    }).select(*MAP_COLUMNS)


def body_of(markdown: Column) -> Column:
    """A packet's text after its head, stripped."""
    at = F.instr(markdown, F.lit("---\n\n"))
    return F.when(at > 0, T.strip(F.substring(markdown, at + 5, F.length(markdown)))).otherwise(markdown)


def preview(markdown: Column, size: int = 2000) -> Column:
    return T.bind(body_of(markdown), lambda b: F.when(F.length(b) > size, F.concat(F.left(b, F.lit(size)), F.lit("…"))).otherwise(b))


def raw_files(listed: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files by ``source_id``: those listed in a folder and those that the index names, each once, by name; their number, and the first five named."""
    both = listed.select("source_id", "name").unionByName(indexed.select("source_id", "name")).distinct()
    n = both.groupBy(F.col("source_id").alias("_s")).agg(F.count(F.lit(1)).cast("int").alias("raw_file_count"))
    # tasks keep five rows of a source before they move
    first = both.withColumn("_k", F.row_number().over(Window.partitionBy("source_id").orderBy("name"))).filter("_k <= 5")
    names = first.groupBy("source_id").agg(F.array_sort(F.collect_list("name")).alias("names"))
    more = F.when(F.col("raw_file_count") > 5, "; ...").otherwise("")
    return names.join(n, F.col("source_id") == F.col("_s")).select("source_id", "raw_file_count", F.concat(F.array_join("names", "; "), more).alias("raw_files"))


def text_of(sources: DataFrame, first: DataFrame, second: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """``sources`` with ``text``: from the first table that has the ``source_id`` (a missing table is an empty one), else from ``extracted``, else empty."""
    tables = [t for t in (first, second, extracted) if t is not None]
    out = sources
    for k, t in enumerate(tables):
        out = out.join(t.select("source_id", F.col("text").alias(f"_t{k}")), "source_id", "left")
    return out.withColumn("text", F.coalesce(*[F.col(f"_t{k}") for k in range(len(tables))], F.lit(""))).drop(*[f"_t{k}" for k in range(len(tables))])


# --- corpus -------------------------------------------------------------------------------------------


def core_section(text: Column, fields: list[tuple[str, Column]], id_: Column) -> Column:
    """A core source in the corpus: fields as bullets, cleaned text between fences."""
    return F.concat(F.lit("## Core Source "), id_.cast("string"), F.lit("\n\n"), S.bullets_of(fields), F.lit("\n\n### Clean Text\n\n"), S.fence(S.clean_bc(text)), F.lit("\n"))


def set_section(id_: Column, file_name: Column, fields: list[tuple[str, Column]], leads: Column, entities: Column, text: Column) -> Column:
    """A set source in the corpus: fields, lead, entities, cleaned text; parts without content are left out."""
    part = lambda title, c, shown: F.when(c != "", F.concat(F.lit(f"### {title}\n\n"), shown, F.lit("\n")))
    made = F.struct(
        F.concat(F.lit("## Set Source "), id_, F.lit(": "), file_name, F.lit("\n\n"), S.bullets_of(fields), F.lit("\n")).alias("head"),
        F.coalesce(S.clean_bc(F.array_join(leads, "\n\n")), F.lit("")).alias("lead"), S.entities_lines(entities).alias("rows"), S.clean_bc(F.coalesce(text, F.lit(""))).alias("clean"))
    return T.bind(made, lambda x: F.concat_ws("\n", x["head"], part("Lead / Context", x["lead"], x["lead"]), part("Structured Rows / Entities", x["rows"], S.fence(x["rows"])),
                                              F.coalesce(part("Clean Text", x["clean"], S.fence(x["clean"])), F.lit("### Clean Text\n\n_No clean text was available for this file._\n"))))
