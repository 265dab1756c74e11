"""Queries over sources, packets, tables and the corpus."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import edits as E
from ..functions import pages as P
from ..functions import structure as S
from ..functions import text as T
from ..operators import dedup, packets, runs, tasks
from ..sources import sinks
from ..sources.tables import spread, table
from .base import local, query, strip, values
from .cleaning import corpus_profile

# --- duplicates ---------------------------------------------------------------------------------------


@query("SELECT sha256(text) AS text_sha256, list(doc_id ORDER BY doc_id) AS ids, count(*) AS n, count(DISTINCT sha256(text || source)) AS n_files, min(doc_id) AS canonical_id FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def text_hash_groups(spark, d):
    """Texts of several documents; text and source together stand for a file's bytes."""
    rows = table(spark, d, "documents").withColumn("file_sha256", dedup.text_hash(F.concat("text", "source")))
    return dedup.hash_groups(rows, "doc_id", "text")


@query("SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY sha256(text)) > 1 THEN 'file_sha256:' || sha256(text)[1:16] ELSE '' END AS duplicate_file_group, count(*) OVER (PARTITION BY source) > 1 AS source_has_multiple_files FROM documents")
def duplicate_file_groups(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("source_id"), dedup.text_hash(F.col("text")).alias("file_sha256"))
    return dedup.several_files(dedup.file_groups(rows)).select("doc_id", "duplicate_file_group", "source_has_multiple_files")


_KNOWN = "(SELECT doc_id::VARCHAR AS source_id, CASE WHEN doc_id % 10 = 3 THEN (doc_id - 1)::VARCHAR END AS c, CASE WHEN doc_id % 20 = 5 THEN 'file_sha256:x' ELSE '' END AS f, CASE WHEN doc_id % 20 = 7 THEN 'same report' END AS r FROM documents WHERE doc_id % 2 = 1)"
_RESOLVED = f"""h AS (SELECT doc_id::VARCHAR AS source_id, sha256(text) AS hash FROM documents), g AS (SELECT hash, list(source_id ORDER BY source_id) AS ids FROM h GROUP BY hash HAVING count(*) > 1),
j AS (SELECT h.source_id, h.hash, g.ids, coalesce(k.c, h.source_id) AS own, coalesce(nullif(k.f, ''), CASE WHEN k.c <> h.source_id THEN 'variant_of:' || k.c END, k.r, 'none') AS base FROM h LEFT JOIN {_KNOWN} k USING (source_id) LEFT JOIN g USING (hash)),
r AS (SELECT source_id, hash, CASE WHEN ids IS NOT NULL AND source_id <> ids[1] THEN ids[1] ELSE own END AS canonical_source_id,
CASE WHEN base <> 'none' THEN base WHEN ids IS NOT NULL AND source_id <> ids[1] THEN 'text_hash_group:' || hash[1:16] WHEN ids IS NOT NULL THEN 'canonical_for:' || array_to_string(list_filter(ids, lambda x: x <> source_id), ',') ELSE 'none' END AS duplicate_group,
(ids IS NOT NULL AND source_id <> ids[1]) OR own <> source_id AS is_text_duplicate FROM j)"""


def _resolved(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_id"), "doc_id", "text")
    known = docs.filter("doc_id % 2 = 1").select("source_id", F.when(F.col("doc_id") % 10 == 3, (F.col("doc_id") - 1).cast("string")).alias("canonical_source_id"), F.when(F.col("doc_id") % 20 == 5, "file_sha256:x").otherwise("").alias("duplicate_file_group"), F.when(F.col("doc_id") % 20 == 7, "same report").alias("duplicate_reason"))
    return packets.canonical(docs.select("source_id"), known, docs.select("source_id", dedup.text_hash(F.col("text")).alias("text_sha256")))


@query(f"WITH {_RESOLVED} SELECT source_id, canonical_source_id, duplicate_group, is_text_duplicate FROM r")
def canonical_resolution(spark, d):
    """Canonical sources by earlier decisions and equal texts."""
    return _resolved(spark, d)


@query(f"WITH {_RESOLVED} SELECT count(*) FILTER (NOT is_text_duplicate) AS core_canonical, count(*) FILTER (is_text_duplicate) AS core_alias, count(*) FILTER (duplicate_group = 'none') AS single, count(*) FILTER (starts_with(duplicate_group, 'variant_of:')) AS decided FROM r")
def pipeline_counters(spark, d):
    r = _resolved(spark, d)
    return r.agg(F.count_if(~F.col("is_text_duplicate")).alias("core_canonical"), F.count_if("is_text_duplicate").alias("core_alias"), F.count_if(F.col("duplicate_group") == "none").alias("single"), F.count_if(F.col("duplicate_group").startswith("variant_of:")).alias("decided"))


@query("WITH r AS (SELECT min(doc_id) OVER (PARTITION BY sha256(text)) AS c, doc_id, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents) SELECT CASE WHEN n = 1 THEN 'primary' WHEN doc_id = c THEN 'canonical' ELSE 'alias' END AS packet_role, count(*) AS n FROM r GROUP BY 1")
def packet_roles(spark, d):
    return dedup.resolve(table(spark, d, "documents"), "doc_id", "text").groupBy("packet_role").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT doc_id, text, min(doc_id) OVER w AS c FROM documents WINDOW w AS (PARTITION BY sha256(text))), p AS (SELECT doc_id, c, doc_id <> c AS alias, CASE WHEN doc_id <> c AND doc_id % 3 <> 0 THEN 'alias of ' || c ELSE text END AS body FROM r)
SELECT count(*) FILTER (NOT p.alias) AS canonical_packets, count(DISTINCT CASE WHEN NOT p.alias THEN p.body END) AS unique_canonical_bodies, count(*) FILTER (p.alias) AS alias_packets, count(*) FILTER (p.alias AND p.body = q.body) AS carried, count(*) FILTER (p.alias AND p.body = q.body) = 0 AS pass FROM p JOIN p q ON q.doc_id = p.c""")
def dedup_validation(spark, d):
    """Packets of which every third alias still carries its canonical's body."""
    docs = table(spark, d, "documents")
    r = dedup.resolve(docs, "doc_id", "text").join(docs.select("doc_id", "text"), "doc_id")
    body = F.when(F.col("is_text_duplicate") & (F.col("doc_id") % 3 != 0), F.concat(F.lit("alias of "), "canonical_id")).otherwise(F.col("text"))
    role = F.when(F.col("is_text_duplicate"), "alias").otherwise("canonical")
    return dedup.validation(r.withColumns({"body": body, "role": role}), "doc_id", "canonical_id", "role", "body")


@query("SELECT source, count(*) AS n, count(*) > 1 AS several FROM documents GROUP BY source")
def multi_file_flag(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) > 1).alias("several"))


_PART = 1000


@query(f"""WITH f AS (SELECT source, doc_id, '===== FILE: ' || source || '/' || doc_id || '.txt =====' || chr(10) || {strip('text')} AS chunk FROM documents),
p AS (SELECT source, doc_id // {_PART} AS part, md5(string_agg(md5(chunk), chr(10) ORDER BY doc_id)) AS digest, sum(length(chunk) + 2)::BIGINT AS n FROM f GROUP BY 1, 2)
SELECT source, md5(string_agg(digest, chr(10) ORDER BY part)) AS digest, sum(n)::BIGINT - 1 AS n_chars FROM p GROUP BY source""")
def grouped_raw_text(spark, d):
    """The texts of a source in order, each under its header line. What is compared are digests, by parts of a source and then
    over them, so that no task holds a whole source; ``sources.sinks.write_grouped`` writes the texts."""
    chunk = F.concat(F.lit("===== FILE: "), "source", F.lit("/"), "doc_id", F.lit(".txt =====\n"), T.strip(F.col("text")))
    rows = table(spark, d, "documents").select("source", "doc_id", F.floor(F.col("doc_id") / _PART).alias("part"), F.md5(chunk).alias("h"), (F.length(chunk) + 2).alias("n"))
    over = lambda key: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "h"))), lambda x: x["h"]), "\n"))
    parts = rows.groupBy("source", "part").agg(over("doc_id").alias("h"), F.sum("n").alias("n"))
    return parts.groupBy("source").agg(over("part").alias("digest"), (F.sum("n") - 1).alias("n_chars"))


# --- inventories ----------------------------------------------------------------------------------------


@query("SELECT source, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source")
def metadata_first_wins(spark, d):
    return dedup.first_by(table(spark, d, "documents"), "source", "doc_id", "lang")


@query("SELECT source, arg_max(lang, doc_id) AS lang FROM documents GROUP BY source")
def metadata_last_wins(spark, d):
    return dedup.first_by(table(spark, d, "documents"), "source", "doc_id", "lang", last=True)


@query("SELECT doc_id, f.lang AS source_lang, l.quality FROM documents LEFT JOIN (SELECT source, arg_min(lang, doc_id) AS lang FROM documents WHERE doc_id % 2 = 0 GROUP BY source) f USING (source) LEFT JOIN labels l USING (doc_id)")
def metadata_left_join(spark, d):
    """Documents with their source's metadata, the first of several, and with labels where there are any."""
    docs = table(spark, d, "documents")
    first = dedup.first_by(docs.filter("doc_id % 2 = 0"), "source", "doc_id", "lang").withColumnRenamed("lang", "source_lang")
    return docs.select("doc_id", "source").join(first, "source", "left").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", "source_lang", "quality")


@query("SELECT count(DISTINCT source) AS sources, count(DISTINCT CASE WHEN doc_id % 5 <> 0 THEN source END) AS written, count(*) AS records, sum(n_chars)::BIGINT AS chars FROM documents")
def group_totals(spark, d):
    return table(spark, d, "documents").agg(F.countDistinct("source").alias("sources"), F.countDistinct(F.when(F.col("doc_id") % 5 != 0, F.col("source"))).alias("written"), F.count(F.lit(1)).alias("records"), F.sum("n_chars").alias("chars"))


@query("SELECT o_custkey, count(*) AS files, sum(o_orderkey % 50)::BIGINT AS entities FROM orders GROUP BY o_custkey")
def set_totals(spark, d):
    """Files and entities by set."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("files"), F.sum(F.col("o_orderkey") % 50).alias("entities"))


def _sheet(rows, name, header, columns):
    """A table as rows of a sheet with a header row and an empty row."""
    spark = rows.sparkSession
    head = local(spark, [(name, 1, [f" {h}" for h in header]), (name, 2, [""] * len(header))], "sheet string, row_index long, cells array<string>")
    return head.unionByName(rows.select(F.lit(name).alias("sheet"), (F.col("place") + 3).alias("row_index"), F.array(*[c.cast("string") for c in columns]).alias("cells")))


def _inventory(spark, d):
    c = table(spark, d, "customer").withColumn("place", F.col("c_custkey"))
    s = table(spark, d, "supplier").withColumn("place", F.col("s_suppkey"))
    core = _sheet(c, "Core Clusters", tasks.CORE_SHEET, [F.when(F.col("c_custkey") % 10 == 0, " ").otherwise(F.concat(F.lit(" S"), "c_custkey")), F.col("c_name"), F.col("c_mktsegment"), F.lit(None), F.lit("report"), F.lit(""), F.when(F.col("c_custkey") % 3 == 0, "checked"), F.col("c_nationkey"), F.lit("fam")])
    sets = _sheet(s, "Set Clusters", tasks.SET_SHEET, [F.concat(F.lit("SET"), "s_suppkey"), F.col("s_name"), F.lit(None), F.lit("u"), F.lit(None), F.lit("wiki"), F.lit(""), F.col("s_nationkey"), F.lit(None)])
    records = tasks.with_header(core.unionByName(sets))
    return tasks.inventory(records.filter("sheet = 'Core Clusters'"), "Core", tasks.CORE_SHEET).unionByName(tasks.inventory(records.filter("sheet = 'Set Clusters'"), "Set", tasks.SET_SHEET))


@query("""SELECT 'S' || c_custkey AS source_id, 'Core' AS family, c_name AS title, c_mktsegment AS domain, NULL::VARCHAR AS url, 'report' AS source_type, NULL::VARCHAR AS source_subtype, CASE WHEN c_custkey % 3 = 0 THEN 'checked' ELSE 'in_step3_inventory' END AS status, c_nationkey::VARCHAR AS cluster_id, 'fam' AS task_family, '' AS notes FROM customer WHERE c_custkey % 10 <> 0
UNION ALL SELECT 'SET' || s_suppkey, 'Set', s_name, NULL, 'u', NULL, 'wiki', 'in_step3_inventory', s_nationkey::VARCHAR, NULL, '' FROM supplier""")
def inventory_union_reshape(spark, d):
    """Two sheets with header rows, blank rows and rows without an id, in one shape of eleven columns."""
    return _inventory(spark, d)


@query("SELECT doc_id, strlen(text) AS n_bytes FROM documents WHERE strlen(text) < 200")
def small_outputs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes")).filter("n_bytes < 200")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'core ' || doc_id WHEN doc_id % 5 = 0 THEN 'raw ' || doc_id WHEN doc_id % 7 = 0 THEN 'page ' || doc_id ELSE '' END AS text FROM documents")
def raw_path_fallback(spark, d):
    """A document's text from the first of three tables that has it; the fourth does not exist and is an empty one."""
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("source_id"))
    some = lambda n, word: docs.filter(F.col("doc_id") % n == 0).select("source_id", F.concat(F.lit(word), "doc_id").alias("text"))
    none = spark.createDataFrame([], "source_id long, text string")
    first = packets.text_of(docs, none, some(3, "core ")).filter("text <> ''").select("source_id", "text")
    return packets.text_of(docs, first, some(5, "raw "), some(7, "page ")).select("doc_id", "text")


@query("""WITH f AS (SELECT DISTINCT o_custkey AS source_id, name FROM (SELECT o_custkey, 'f' || (o_orderkey % 97) || '.txt' AS name FROM orders UNION ALL SELECT o_custkey, 'f' || (o_orderkey % 97 + 1) || '.txt' FROM orders WHERE o_orderkey % 2 = 0)), g AS (SELECT source_id, list(name ORDER BY name) AS names FROM f GROUP BY source_id)
SELECT source_id, len(names)::INT AS raw_file_count, array_to_string(names[1:5], '; ') || CASE WHEN len(names) > 5 THEN '; ...' ELSE '' END AS raw_files FROM g""")
def raw_file_lists(spark, d):
    """Files of a source from a listing and an index, each once, by name; five are named."""
    name = lambda k: F.concat(F.lit("f"), F.col("o_orderkey") % 97 + k, F.lit(".txt")).alias("name")
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "source_id")
    return packets.raw_files(o.select("source_id", name(0)), o.filter("o_orderkey % 2 = 0").select("source_id", name(1)))


# --- packets ------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, '- **name:** ' || p_name || chr(10) || CASE WHEN p_size % 3 = 0 THEN '' ELSE '- **type:** ' || p_type || chr(10) END || '- **size:** ' || p_size AS bullets,
'- one' || chr(10) || '- two' || CASE WHEN p_size % 2 = 0 THEN chr(10) || '- ' || p_name ELSE '' END AS grown, replace(replace(p_name || '|' || chr(10) || p_type, '|', '\\|'), chr(10), ' ') AS cell,
CASE WHEN p_size % 2 = 0 THEN '````text' || chr(10) || '``` ' || p_name || chr(10) || '````' ELSE '```text' || chr(10) || p_name || chr(10) || '```' END AS fenced FROM part""")
def metadata_bullets(spark, d):
    """Fields as bullets without the empty ones, lists that grow, escaped cells and fences."""
    p = table(spark, d, "part")
    kind = F.when(F.col("p_size") % 3 == 0, F.when(F.col("p_size") % 2 == 0, "")).otherwise(F.col("p_type"))
    new = F.array(F.lit("  "), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("- "), "p_name", F.lit(" "))), F.lit(None))
    return p.select("p_partkey", S.bullets_of([("name", F.col("p_name")), ("type", kind), ("size", F.col("p_size"))]).alias("bullets"), F.when(F.col("p_size") % 2 == 0, E.append_bullets(F.lit("- one\n- two\n \n"), new)).otherwise(E.append_bullets(F.lit("- one\n- two"), new)).alias("grown"),
                    S.escape(F.concat("p_name", F.lit("|\n"), "p_type")).alias("cell"), S.fence(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("``` "), "p_name")).otherwise(F.col("p_name"))).alias("fenced"))


def _packets(spark, d):
    docs = spread(table(spark, d, "documents")).select(F.col("doc_id").cast("string").alias("source_id"), "doc_id", "lang", "text")
    field = {c: F.lit(None).cast("string") for c in ("url", "source_type", "source_subtype", "cluster_id")}
    resolved = _resolved(spark, d).join(docs.select("source_id", F.concat(F.lit("Title "), "source_id", F.lit(" — more")).alias("title"), F.col("lang").alias("domain")), "source_id").withColumns({"family": F.lit("Core"), "status": F.lit("ok"), **field})
    raw = docs.filter("doc_id % 4 <> 0").select("source_id", F.array(F.struct(F.concat("source_id", F.lit(".txt")).alias("name"), F.col("text"))).alias("parts"))
    return packets.packets(resolved, raw)


@query(f"""WITH {_RESOLVED}, c AS (SELECT source_id, source_id::BIGINT % 4 = 0 AS empty FROM r WHERE NOT is_text_duplicate)
SELECT r.source_id, r.canonical_source_id, CASE WHEN is_text_duplicate THEN 'alias' ELSE 'canonical' END AS packet_role, 'Title ' || r.source_id AS title,
'# Normalized Source Packet' || CASE WHEN is_text_duplicate THEN ' (alias — text duplicate)' ELSE '' END || chr(10) || chr(10) || '- **source_id:** ' || r.source_id || chr(10) || '- **canonical_source_id:** ' || r.canonical_source_id || chr(10) || '- **family:** Core' || chr(10) || '- **title:** Title ' || r.source_id || chr(10) || '- **domain:** ' || d.lang || chr(10) || '- **status:** ok' || chr(10) || '- **duplicate_group:** ' || duplicate_group || chr(10) || '- **is_text_duplicate:** ' || CASE WHEN is_text_duplicate THEN 'True' ELSE 'False' END || chr(10)
|| CASE WHEN is_text_duplicate THEN '- **normalized_text_ref:** normalized_core/' || r.canonical_source_id || '.normalized.md' || chr(10) ELSE '' END || '- **packet_role:** ' || CASE WHEN is_text_duplicate THEN 'alias' ELSE 'canonical' || CASE WHEN r.source_id::BIGINT % 4 = 0 THEN '' ELSE chr(10) || '- **raw_fragment_count:** 1' END END || chr(10) || chr(10) || '---' AS head,
CASE WHEN is_text_duplicate THEN 'This inventory row is a **duplicate variant** of a document whose text is stored once.' WHEN r.source_id::BIGINT % 4 = 0 THEN '_No raw text was available at normalization time._' ELSE '# Title ' || r.source_id END AS opening,
CASE WHEN is_text_duplicate THEN ['Alias packet only; full text stored under ' || r.canonical_source_id || '.'] ELSE [] END || CASE WHEN coalesce(c.empty, o.empty, false) THEN ['No raw text available for this source_id.'] WHEN NOT is_text_duplicate OR c.source_id IS NOT NULL THEN ['Applied conservative cleanup without summarization or reordering.'] ELSE [] END AS notes
FROM r JOIN documents d ON d.doc_id::VARCHAR = r.source_id LEFT JOIN c ON is_text_duplicate AND c.source_id = r.canonical_source_id LEFT JOIN c o ON NOT is_text_duplicate AND o.source_id = r.source_id""")
def packet_roles_and_map(spark, d):
    """Core packets of all documents: heads, the first line of bodies, and notes; aliases take their canonical's. Every fourth source has no text."""
    p = _packets(spark, d)
    head, body = F.substring_index("markdown", "\n\n---\n\n", 1), packets.body_of(F.col("markdown"))
    plain = F.filter("notes", lambda x: ~x.startswith("Removed ") & ~x.startswith("Merged ") & ~x.startswith("Trimmed "))
    return p.select("source_id", "canonical_source_id", "packet_role", "title", F.concat(head, F.lit("\n\n---")).alias("head"), F.substring_index(body, "\n", 1).alias("opening"), plain.alias("notes"))


@query("SELECT doc_id, CASE WHEN length(trim(b)) > 2000 THEN trim(b)[1:2000] || '…' ELSE trim(b) END AS preview FROM (SELECT doc_id, text AS b FROM (SELECT doc_id, " + strip("text") + " AS text FROM documents))")
def packet_preview(spark, d):
    """The first 2,000 characters of packets' bodies, some packets without a head."""
    md = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# Normalized Source Packet\n\n- **a:** b\n\n---\n\n"), "text")).otherwise(T.strip(F.col("text")))
    return spread(table(spark, d, "documents")).select("doc_id", packets.preview(md).alias("preview"))


@query(corpus_profile("docs AS (SELECT doc_id, text FROM documents)").replace("SELECT d.doc_id, coalesce(", "SELECT d.doc_id, '## Core Source ' || d.doc_id || chr(10) || chr(10) || '- **Source files:** ' || d.doc_id || '.txt' || chr(10) || '- **Domain:** ' || (SELECT lang FROM documents x WHERE x.doc_id = d.doc_id) || chr(10) || chr(10) || '### Clean Text' || chr(10) || chr(10) || '```text' || chr(10) || coalesce(", 1).replace(", '') AS text FROM docs d", ", '') || chr(10) || '```' || chr(10) AS section FROM docs d"))
def corpus_sections(spark, d):
    """A section of the consolidated corpus for each document; ``sources.sinks.write_corpus`` writes them in order."""
    fields = [("Source files", F.concat("doc_id", F.lit(".txt"))), ("Final decision", F.lit(None)), ("Canonical source ID", F.lit("")), ("Domain", F.col("lang"))]
    return spread(table(spark, d, "documents")).select("doc_id", packets.core_section(F.col("text"), fields, F.col("doc_id")).alias("section"))


# --- names ----------------------------------------------------------------------------------------------

_NAMES = [(-1, "SET009_foo bar.htm"), (-2, "..."), (-3, ".hidden"), (-4, "Ünï-côde.v2.PDF"), (-5, "x" * 100 + ".txt"), (-6, "___"), (-7, "")]


@query(f"""WITH n AS (SELECT p_partkey, p_name AS s FROM part UNION ALL SELECT * FROM ({values(_NAMES)}))
SELECT p_partkey, CASE WHEN trim(regexp_replace(s, '[^A-Za-z0-9]+', '_', 'g'), '_')[1:80] = '' THEN 'untitled' ELSE trim(regexp_replace(s, '[^A-Za-z0-9]+', '_', 'g'), '_')[1:80] END AS slug,
trim(regexp_replace(regexp_replace(s, '^(.+)\\.[^.]*$', '\\1'), '[^A-Za-z0-9]+', '_', 'g'), '_') AS stem, replace(s, '/', '__') AS folder FROM n""")
def slug_ids(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("s")).unionByName(local(spark, _NAMES, "p_partkey long, s string"))
    return rows.select("p_partkey", T.slug(F.col("s")).alias("slug"), T.stem(F.col("s")).alias("stem"), sinks.folder_name(F.col("s")).alias("folder"))


_FAMILIES = [(-1, "A"), (-2, ""), (-3, "A-B"), (-4, "A-B-C-D"), (-5, "-A")]


@query(f"""WITH n AS (SELECT p_partkey, 'CORE-' || p_type || '-' || p_partkey AS name, p_size::VARCHAR AS batch FROM part UNION ALL SELECT column0, column1, '1' FROM ({values(_FAMILIES)}) AS v(column0, column1))
SELECT p_partkey, CASE WHEN contains(name, '-') THEN array_to_string(string_split(name, '-')[1:2], '-') WHEN name <> '' THEN name ELSE 'Unknown' END AS family, 'Core-' || batch || '-task' || p_partkey || '-' || name AS task_id, 'Core-batch' || batch || '-task' || p_partkey || '-' || name AS row_id, 'Core-' || batch || '-task' || p_partkey || '-' || name AS task_key FROM n""")
def task_key_normalize(spark, d):
    """Families and both spellings of ids, and the key that they share."""
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("CORE-"), "p_type", F.lit("-"), "p_partkey").alias("name"), F.col("p_size").cast("string").alias("batch")).unionByName(local(spark, [(*f, "1") for f in _FAMILIES], "p_partkey long, name string, batch string"))
    parts = (F.lit("Core"), F.col("batch"), F.col("p_partkey").cast("string"), F.col("name"))
    return rows.select("p_partkey", tasks.task_family(F.col("name")).alias("family"), tasks.task_id(*parts).alias("task_id"), tasks.row_id(*parts).alias("row_id"), tasks.task_key(tasks.row_id(*parts)).alias("task_key"))


@query("SELECT 'Core' AS sheet_name, o_orderkey + 1 AS row_index, o_orderkey::VARCHAR AS task_number, o_orderstatus AS global_domain, 'Core-' || (o_orderkey % 7) || '-task' || o_orderkey || '-A-B' AS task_id FROM orders WHERE lower(o_orderstatus) = 'o' AND o_orderkey % 4 <> 0 ORDER BY o_orderkey LIMIT 25")
def domain_filter_limit(spark, d):
    """Tasks of one sheet (by name in any case) and one domain, the first 25."""
    names = tasks.REQUIRED_COLUMNS
    o = table(spark, d, "orders")
    cell = {"batch": F.col("o_orderkey") % 7, "task_number": F.col("o_orderkey"), "task name": F.lit(" A-B "), "global domain": F.col("o_orderstatus")}
    rows = o.select(F.when(F.col("o_orderkey") % 4 == 0, "Other").otherwise("Core").alias("sheet"), (F.col("o_orderkey") + 1).alias("row_index"), F.array(*[cell.get(c, F.lit(None)).cast("string") for c in names]).alias("cells"))
    head = local(spark, [(s, 1, names) for s in ("Core", "Other")], "sheet string, row_index long, cells array<string>")
    loaded = tasks.load(tasks.with_header(head.unionByName(rows)), "CORE", "o", 25)
    return loaded.select("sheet_name", "row_index", "task_number", "global_domain", "task_id")


# --- edited tables ----------------------------------------------------------------------------------------


def _edited(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    updates = o.filter("o_orderkey % 7 = 0").select("o_orderkey", F.create_map(F.lit("o_orderpriority"), F.lit("edited"), F.lit("o_orderstatus"), F.when(F.col("o_orderkey") % 14 == 0, "X")).alias("updates"))
    return o, sinks.merge_updates(o, updates, "o_orderkey", ["o_orderpriority", "o_orderstatus"])


_EDITED = "e AS (SELECT o_orderkey, o_orderstatus AS s0, o_orderpriority AS p0, CASE WHEN o_orderkey % 14 = 0 THEN 'X' ELSE o_orderstatus END AS s1, CASE WHEN o_orderkey % 7 = 0 THEN 'edited' ELSE o_orderpriority END AS p1 FROM orders)"


@query(f"WITH {_EDITED} SELECT o_orderkey, s1 AS o_orderstatus, p1 AS o_orderpriority FROM e")
def merge_cell_updates(spark, d):
    return _edited(spark, d)[1]


@query(f"""WITH {_EDITED} SELECT o_orderkey, 'o_orderstatus' AS column_name, s0 AS old, s1 AS new FROM e WHERE s0 <> s1 AND o_orderkey % 11 <> 0 UNION ALL SELECT o_orderkey, 'o_orderpriority', p0, p1 FROM e WHERE p0 <> p1 AND o_orderkey % 11 <> 0
UNION ALL SELECT o_orderkey, '(row)', 'present', NULL FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT -1 - o_orderkey, '(row)', NULL, 'present' FROM orders WHERE o_orderkey % 11 = 0""")
def workbook_diff(spark, d):
    """Changed cells; rows that only one side has are named."""
    a, b = _edited(spark, d)
    b = b.withColumn("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, -1 - F.col("o_orderkey")).otherwise(F.col("o_orderkey")))
    return runs.diff(a, b, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query(f"WITH {_EDITED} SELECT 'o_orderstatus' AS column_name, count(*) AS n FROM e WHERE s0 <> s1 UNION ALL SELECT 'o_orderpriority', count(*) FROM e WHERE p0 <> p1 UNION ALL SELECT '(changed rows)', count(*) FROM e WHERE s0 <> s1 OR p0 <> p1")
def column_change_counts(spark, d):
    a, b = _edited(spark, d)
    cells = runs.diff(a, b, "o_orderkey", ["o_orderstatus", "o_orderpriority"])
    return cells.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).unionAll(cells.agg(F.lit("(changed rows)"), F.countDistinct("o_orderkey")))


@query("SELECT o_custkey, o_orderkey, lag(o_orderstatus) OVER w IS DISTINCT FROM o_orderstatus AS new_caption, row_number() OVER w AS pos FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def caption_change_headers(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", (~F.lag("o_orderstatus").over(w).eqNullSafe(F.col("o_orderstatus"))).alias("new_caption"), F.row_number().over(w).cast("long").alias("pos"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS pos FROM lineitem")
def ordered_positions(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("pos"))


@query("SELECT page_id, list_sort(list_distinct(list_transform(a, lambda x: lower(x)))) AS sorted_links, len(list_distinct(list_transform(a, lambda x: lower(x))))::INT AS n FROM (SELECT page_id, regexp_extract_all(html, '<a[^>]*>([^<]*)</a>', 1) AS a FROM pages)")
def distinct_first(spark, d):
    """Link texts of a page, the first of each in any case, sorted."""
    found = F.regexp_extract_all("html", F.lit("<a[^>]*>([^<]*)</a>"), F.lit(1))
    once = P.first_by(found, F.lower)
    return table(spark, d, "pages").select("page_id", F.array_sort(F.transform(once, F.lower)).alias("sorted_links"), F.size(once).alias("n"))
