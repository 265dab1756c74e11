"""Queries over scores and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import runs, scoring, tasks
from ..sources.tables import spread, table
from .base import local, query, splitlines, strip, values

# --- scores ---------------------------------------------------------------------------------------


def _label_scores(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("domain"))
    return scoring.scored(rows.join(table(spark, d, "labels"), "doc_id", "left"), ["quality", "toxic"], 2)


def _line_scores(spark, d):
    dims = {f"d{k}": F.pmod(F.col("l_partkey") + k, F.lit(3)).cast("int") for k in range(5)}
    dims["d4"] = F.when(F.col("l_returnflag") != "N", dims["d4"])  # a dimension that no row of some domains has
    rows = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("domain"), *[c.alias(k) for k, c in dims.items()])
    return scoring.scored(rows, list(dims), 10)


_LABELS = "s AS (SELECT lang AS domain, quality, toxic, coalesce(quality, 0) + coalesce(toxic, 0) AS t FROM documents LEFT JOIN labels USING (doc_id))"
_LINES = (
    "s AS (SELECT *, d0 + d1 + d2 + d3 + coalesce(d4, 0) AS t FROM (SELECT l_returnflag || l_linestatus AS domain, "
    + ", ".join(f"(l_partkey + {k}) % 3 AS d{k}" for k in range(4))
    + ", CASE WHEN l_returnflag <> 'N' THEN (l_partkey + 4) % 3 END AS d4 FROM lineitem))"
)
_DIMENSIONS = [f"d{k}" for k in range(5)]


@query(f"WITH {_LABELS} SELECT domain, count(t) AS n, avg(t) AS mean, stddev_pop(t) AS std, min(t) AS lo, max(t) AS hi FROM s GROUP BY domain")
def score_by_domain(spark, d):
    return scoring.by_domain(_label_scores(spark, d))


@query(f"WITH {_LABELS} SELECT count(t) AS n, avg(t) AS mean, quantile_cont(t, 0.5)::DOUBLE AS median, min(t) AS lo, max(t) AS hi FROM s")
def score_overall(spark, d):
    return scoring.overall(_label_scores(spark, d))


@query(f"WITH {_LABELS}, u AS (SELECT 'quality' AS dimension, quality AS v FROM s UNION ALL SELECT 'toxic', toxic FROM s) SELECT dimension, count(v) AS n, avg(v) AS mean, count(*) - count(v) AS missing FROM u GROUP BY dimension")
def score_by_dimension(spark, d):
    return scoring.by_dimension(_label_scores(spark, d), ["quality", "toxic"])


@query(f"WITH {_LINES} SELECT domain, " + ", ".join(f"coalesce(avg({c}), 0) AS {c}" for c in _DIMENSIONS) + " FROM s GROUP BY domain")
def domain_dimension_matrix(spark, d):
    return scoring.matrix(_line_scores(spark, d), _DIMENSIONS)


@query(f"WITH {_LINES} SELECT b.bin, count(s.t) AS n FROM (SELECT unnest(range(0, 11))::INT AS bin) b LEFT JOIN s ON s.t = b.bin GROUP BY b.bin")
def score_histogram_zero_filled(spark, d):
    return scoring.histogram(_line_scores(spark, d), 10)


@query(f"WITH {_LABELS} SELECT domain, round(stddev_pop(t) / greatest(sqrt(count(t)), 1.0), 9) AS stderr, count(t) AS n FROM s GROUP BY domain")
def domain_standard_error(spark, d):
    return scoring.standard_error(_label_scores(spark, d)).withColumn("stderr", F.round("stderr", 9))


@query(f"WITH {_LINES} SELECT t::INT AS score_total, round(t / 10.0 * 100, 1)::DOUBLE AS score_pct, count(*) AS n FROM s GROUP BY ALL")
def score_totals(spark, d):
    """Rows by total and percentage."""
    return _line_scores(spark, d).groupBy("score_total", "score_pct").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LINES}, b AS (SELECT domain, avg(t) AS mean, stddev_pop(t) / greatest(sqrt(count(t)), 1.0) AS stderr, max(t)::INT AS most, count(t) AS n FROM s GROUP BY domain) SELECT domain, mean, round(stderr, 9) AS stderr, most, n, (row_number() OVER (ORDER BY mean, domain))::INT AS pos FROM b")
def plot_domain_bars(spark, d):
    return scoring.domain_bars(_line_scores(spark, d)).withColumn("stderr", F.round("stderr", 9))


@query(f"WITH {_LINES}, b AS (" + " UNION ALL ".join(f"SELECT '{c}' AS dimension, avg({c}) AS mean FROM s" for c in _DIMENSIONS) + ") SELECT dimension, mean, mean * 100 / 2 AS pct, (row_number() OVER (ORDER BY mean, dimension))::INT AS pos FROM b")
def plot_dimension_bars(spark, d):
    return scoring.dimension_bars(_line_scores(spark, d), _DIMENSIONS)


@query("SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS mean, quantile_cont(l_quantity, 0.5) AS median, round(stddev_pop(l_quantity), 9) AS std, min(l_quantity) AS lo, max(l_quantity) AS hi, round(100.0 * avg(l_quantity) / max(l_quantity), 9) AS pct, greatest(sqrt(count(*)), 1) AS root FROM lineitem GROUP BY l_returnflag")
def stats_math(spark, d):
    q = F.col("l_quantity")
    out = [F.count(F.lit(1)).alias("n"), F.avg(q).alias("mean"), F.percentile(q, 0.5).alias("median"), F.round(F.stddev_pop(q), 9).alias("std"), F.min(q).alias("lo"), F.max(q).alias("hi"), F.round(F.avg(q) * 100 / F.max(q), 9).alias("pct"), F.greatest(F.sqrt(F.count(F.lit(1))), F.lit(1.0)).alias("root")]
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(*out)


_TOKENS = "try_cast(json_extract_string(props, '$.k') AS BIGINT)"
_ZEROED = f"CASE WHEN event_id % 9 = 0 THEN 0 ELSE {_TOKENS} END"


@query(f"SELECT count(*) AS rows, sum(nullif(k, 0))::BIGINT AS total, avg(nullif(k, 0)) AS mean, max(nullif(k, 0)) AS most, count(*) FILTER (coalesce(k, 0) = 0) AS missing FROM (SELECT {_ZEROED} AS k FROM events)")
def token_usage_stats(spark, d):
    """Token counts; every ninth is 0, which counts as missing."""
    k = F.when(F.col("event_id") % 9 == 0, F.lit(0).cast("long")).otherwise(F.expr("try_cast(get_json_object(props, '$.k') as bigint)"))
    return scoring.usage(table(spark, d, "events").select(k.alias("k")), "k")


@query("SELECT substring(props, 1, 80) AS message, count(*) AS n, min(event_id) AS first_seen FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 10")
def error_summary_topk(spark, d):
    return scoring.top_errors(table(spark, d, "events").filter("event_type = 'error'"), "props", "event_id", 10)


@query("SELECT event_type AS status, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS ok FROM events GROUP BY 1")
def status_counts(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("ok"))


@query(f"""WITH e AS (SELECT event_id, 'model' || (user_id % 30) AS model, event_type, {_TOKENS} AS t FROM events), p AS (SELECT 'model' || n_nationkey AS model, CASE WHEN n_regionkey < 4 THEN n_regionkey + 1.0 END AS a FROM nation),
u AS (SELECT event_id, model, CASE WHEN event_type <> 'view' THEN t END AS i, CASE WHEN event_type NOT IN ('view', 'click') THEN t END AS o FROM e)
SELECT event_id, CASE WHEN p.model IS NULL THEN 'unknown_model' WHEN i IS NULL AND o IS NULL THEN 'unknown_no_usage' WHEN i IS NULL OR o IS NULL THEN 'unknown_missing_token_fields' WHEN a IS NULL THEN 'estimated_missing_price_table' ELSE 'estimated_from_usage' END AS cost_status,
CASE WHEN p.model IS NOT NULL AND i IS NOT NULL AND o IS NOT NULL THEN i / 1e6 * a + o / 1e6 * (a * 2) END AS estimated_cost FROM u LEFT JOIN p USING (model)""")
def cost_estimate(spark, d):
    """All five outcomes: models without prices or unknown, rows without usage or with a part of it."""
    price = F.when(F.col("n_regionkey") < 4, F.col("n_regionkey") + 1.0)
    prices = table(spark, d, "nation").select(F.concat(F.lit("model"), "n_nationkey").alias("model"), price.alias("price_in"), (price * 2).alias("price_out"))
    t = F.expr("try_cast(get_json_object(props, '$.k') as bigint)")
    rows = table(spark, d, "events").select("event_id", "event_type", F.concat(F.lit("model"), F.col("user_id") % 30).alias("model"), t.alias("t"))
    put = F.when(F.col("event_type") != "view", F.col("t"))
    return scoring.cost(rows, put, F.when(~F.col("event_type").isin("view", "click"), F.col("t")), prices, "model").select("event_id", "cost_status", "estimated_cost")


@query("SELECT DISTINCT 'model' || (user_id % 30) AS model FROM events WHERE 'model' || (user_id % 30) NOT IN (SELECT 'model' || n_nationkey FROM nation)")
def unknown_models(spark, d):
    rows = table(spark, d, "events").select(F.concat(F.lit("model"), F.col("user_id") % 30).alias("model"))
    return tasks.unknown_models(rows, table(spark, d, "nation").select(F.concat(F.lit("model"), "n_nationkey").alias("model")))


# --- runs -----------------------------------------------------------------------------------------

_PAIRS = f"""c AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 11 = 0 AND turn % 4 = 1 THEN ' ' || chr(10) WHEN conv_id % 13 = 0 AND role = 'user' THEN chr(160) ELSE text END AS text FROM conversations),
p AS (SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS response, CASE WHEN coalesce({strip('u.text')}, '') = '' THEN 'error_prompt' WHEN a.text IS NULL THEN 'error' WHEN {strip('a.text')} = '' THEN 'error_empty' ELSE 'ok' END AS status
FROM c u LEFT JOIN (SELECT conv_id, turn - 1 AS turn, text FROM c WHERE role = 'assistant') a ON u.conv_id = a.conv_id AND u.turn = a.turn WHERE u.role = 'user')"""


def _turns(spark, d):
    blank = F.when((F.col("conv_id") % 11 == 0) & (F.col("turn") % 4 == 1), " \n").when((F.col("conv_id") % 13 == 0) & (F.col("role") == "user"), " ").otherwise(F.col("text"))
    return table(spark, d, "conversations").withColumn("text", blank)


@query(f"WITH {_PAIRS} SELECT * FROM p")
def prompt_response_pairs(spark, d):
    """Prompts with their responses; some of either are made blank."""
    return runs.pairs(_turns(spark, d)).select("conv_id", "turn", "prompt", "response", "status")


@query(f"WITH {_PAIRS} SELECT status, count(*) AS n, count(*) FILTER (status = 'ok' AND coalesce(response, '') <> '') AS scorable FROM p GROUP BY status")
def prompt_response_validity(spark, d):
    rows = runs.pairs(_turns(spark, d)).withColumnRenamed("response", "response_text")
    good = runs.scorable(rows).groupBy("status").agg(F.count(F.lit(1)).alias("scorable"))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n")).join(good, "status", "left").select("status", "n", F.coalesce("scorable", F.lit(0)).alias("scorable"))


_REPLIES = [(1, "text", None, 200, "stop", None), (2, "", None, 200, "length", None), (3, "  ", None, 200, "stop", None), (4, "a\x00b", None, 200, "stop", None), (5, None, None, 429, None, "busy"), (6, None, None, None, None, "no route"), (7, "fine", '{"total_tokens": 5}', 200, "stop", None)]


def _records(spark, d):
    asked = table(spark, d, "benchmark").select(F.concat(F.lit("Core-1-task"), F.col("item_id").cast("string"), F.lit("-A-B-"), F.col("item_id").cast("string")).alias("task_id"), "item_id", F.when(F.col("item_id") % 8 == 0, "").otherwise(F.col("text")).alias("final_prompt_text"), F.lit("Core").alias("sheet_name"), F.col("item_id").cast("string").alias("task_number"), F.concat(F.lit("A-B-"), "item_id").alias("task_name"), F.lit("dom").alias("global_domain"))
    replies = local(spark, _REPLIES, "item_id long, response_text string, token_usage string, http_status int, finish_reason string, error string")
    return runs.results(runs.replay(asked, replies, "item_id"), "final_prompt_text")


@query(f"""WITH r(item_id, response_text, token_usage, http_status, finish_reason, error) AS ({values([(a, b and b.replace(chr(0), '?'), *c) for a, b, *c in _REPLIES])}), j AS (SELECT b.item_id, CASE WHEN b.item_id % 8 = 0 THEN '' ELSE b.text END AS prompt, r.* EXCLUDE (item_id) FROM benchmark b LEFT JOIN r USING (item_id)),
s AS (SELECT *, CASE WHEN prompt = '' THEN 'error_prompt' WHEN error IS NOT NULL OR response_text IS NULL THEN 'error' WHEN trim(response_text) = '' AND finish_reason = 'length' THEN 'error_truncated' WHEN trim(response_text) = '' THEN 'error_empty' WHEN item_id = 4 THEN 'error_truncated' ELSE 'ok' END AS status FROM j)
SELECT item_id, status, CASE status WHEN 'error_prompt' THEN 'Task ''Core-1-task' || item_id || '-A-B-' || item_id || ''' has an empty ''final_prompt_text'' prompt.' WHEN 'error' THEN 'HTTPError(status=' || coalesce(http_status::VARCHAR, 'None') || '): ' || coalesce(error, 'no reply')
WHEN 'error_empty' THEN 'Model response is empty.' WHEN 'error_truncated' THEN CASE WHEN item_id = 4 THEN 'Model response contains non-storable null byte.' ELSE 'Response truncated: model hit max_tokens before producing output (finish_reason=length). Increase --max-tokens or reduce prompt size.' END END AS error_message,
CASE WHEN status = 'ok' THEN 'final_prompt_text' ELSE '' END AS prompt_field_used, CASE WHEN status = 'ok' THEN length({strip('prompt')}) ELSE 0 END::INT AS n_prompt, CASE WHEN status = 'ok' THEN response_text ELSE '' END AS response_text, CASE WHEN status = 'ok' THEN token_usage END AS token_usage,
'some/model' AS model, '20260101T000000Z' AS run_id, 'A-B' AS task_family FROM s""")
def run_projection(spark, d):
    """Run records from a table of replies, every outcome, with the columns that a run log adds."""
    rows = tasks.enriched(_records(spark, d), "some/model", "20260101T000000Z")
    return rows.select("item_id", "status", "error_message", "prompt_field_used", F.length("prompt").alias("n_prompt"), "response_text", "token_usage", "model", "run_id", "task_family")


@query("SELECT doc_id, CASE WHEN length(text) > 1500 THEN text[1:1000] || chr(10) || chr(10) || '[... ' || format('{:,}', length(text) - 1500) || ' chars omitted ...]' || chr(10) || chr(10) || right(text, 500) ELSE text END AS text, text[1:2000] AS prompt FROM documents")
def head_tail_truncate(spark, d):
    """Long texts cut to 1,000 and 500 characters (an evaluation run keeps 10,000 and 5,000), and the first 2,000 of a prompt."""
    return table(spark, d, "documents").select("doc_id", T.head_tail(F.col("text"), 1000, 500).alias("text"), F.left("text", F.lit(2000)).alias("prompt"))


@query("SELECT doc_id, n_chars FROM documents WHERE length(text) > 6000")
def long_response_filter(spark, d):
    return table(spark, d, "documents").filter(F.length("text") > 6000).select("doc_id", "n_chars")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
def rescore_null_set(spark, d):
    return runs.missing(table(spark, d, "documents"), table(spark, d, "labels").filter("quality is not null"), "doc_id")


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 0 ELSE quality END AS quality, toxic, doc_id * 2 AS place FROM labels")
def upsert_replacements(spark, d):
    """Rows replaced by key; new keys (negative here) are left out, and the base's order column stays."""
    labels = table(spark, d, "labels")
    new = labels.filter("toxic = 1").withColumn("quality", F.lit(0)).unionByName(labels.select((-F.col("doc_id")).alias("doc_id"), "quality", "toxic"))
    return runs.upsert(labels.withColumn("place", F.col("doc_id") * 2), new, "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def requested_ids_missing(spark, d):
    return runs.missing(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def requested_ids_present(spark, d):
    return runs.present(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END, ''), nullif(c_mktsegment, ''), '') AS rubric FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def rubric_backfill(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderpriority")).alias("own"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return o.join(c, "o_custkey", "left").select("o_orderkey", T.truthy(F.col("own"), F.col("c_mktsegment")).alias("rubric"))


_HTTP = "CASE WHEN event_id % 6 = 0 THEN NULL ELSE [200, 400, 429, 503, 404, 500, 504][1 + event_id % 7] END"


@query(f"SELECT event_type, count(*) FILTER (http IS NULL OR http IN (429, 500, 502, 503, 504)) AS to_retry, count(*) FILTER (event_type = 'purchase') AS ok, count(*) FILTER (event_type <> 'purchase') AS err FROM (SELECT event_type, {_HTTP} AS http FROM events) GROUP BY event_type")
def retry_tally(spark, d):
    http = F.when(F.col("event_id") % 6 != 0, F.get(F.array(*map(F.lit, [200, 400, 429, 503, 404, 500, 504])), (F.col("event_id") % 7).cast("int")))
    ok = F.col("event_type") == "purchase"
    return table(spark, d, "events").withColumn("http", http).groupBy("event_type").agg(F.count_if(runs.retryable(F.col("http"))).alias("to_retry"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("err"))


_EDIT_STATUS = "['ok', 'flag', 'reject', 'declined', 'error', 'ok'][1 + event_id % 6]"


@query(f"SELECT event_id FROM (SELECT event_id, {_EDIT_STATUS} AS status FROM events) WHERE status IN ('reject', 'error')")
def retry_candidates(spark, d):
    return tasks.to_retry(_edits(spark, d)).select("event_id")


def _edits(spark, d):
    status = F.get(F.array(*map(F.lit, ["ok", "flag", "reject", "declined", "error", "ok"])), (F.col("event_id") % 6).cast("int"))
    updates = F.when(F.col("event_id") % 4 == 0, F.create_map(F.lit("boundary_notes"), "props")).when(F.col("event_id") % 4 == 1, F.create_map().cast("map<string,string>"))
    return table(spark, d, "events").select("event_id", status.alias("status"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("cost"), updates.alias("updates"))


@query(f"SELECT event_id, status FROM (SELECT event_id, {_EDIT_STATUS} AS status FROM events) WHERE status IN ('ok', 'flag') AND event_id % 4 = 0")
def publishable_edits(spark, d):
    return tasks.publishable(_edits(spark, d)).select("event_id", "status")


@query(f"SELECT status, count(*) AS n, round(sum(coalesce(CASE WHEN event_id % 3 <> 0 THEN value END, 0)), 6) AS cost FROM (SELECT *, {_EDIT_STATUS} AS status FROM events) GROUP BY status")
def edit_outcomes(spark, d):
    return tasks.outcome_counts(_edits(spark, d)).withColumn("cost", F.round("cost", 6))


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'error' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase'")
def failed_minus_ok(spark, d):
    e = table(spark, d, "events")
    return e.filter("event_type = 'error'").select("user_id").distinct().join(e.filter("event_type = 'purchase'").select("user_id"), "user_id", "left_anti")


@query("""SELECT doc_id, CASE WHEN quality IS NULL AND doc_id % 3 <> 0 THEN 'nulls' WHEN length(text) > 3000 THEN 'long' ELSE 'kept' END AS mode,
CASE WHEN quality IS NULL AND doc_id % 3 <> 0 THEN 1 WHEN length(text) > 3000 THEN 2 ELSE quality END AS quality FROM documents LEFT JOIN labels USING (doc_id)""")
def rescore_modes(spark, d):
    """Scores with those that are null, or of long responses, done again and merged by key; every third null one cannot be done."""
    rows = table(spark, d, "documents").select("doc_id", F.length("text").alias("n")).join(table(spark, d, "labels"), "doc_id", "left").withColumn("mode", F.lit("kept"))
    null = rows.filter("quality is null and doc_id % 3 <> 0")
    long = rows.filter("n > 3000").join(null.select("doc_id"), "doc_id", "left_anti")
    again = null.withColumns({"quality": F.lit(1), "mode": F.lit("nulls")}).unionByName(long.withColumns({"quality": F.lit(2), "mode": F.lit("long")}))
    return runs.upsert(rows, again, "doc_id").select("doc_id", "mode", "quality")


# --- judge replies ------------------------------------------------------------------------------------

_JUDGED = [(-k, x) for k, x in enumerate(["Coverage: 2\nAccuracy: 1", "coverage 0\nCoverage (0-2): 2", "Accuracy: 5", "", "Coverage: 1\nCoverage: 2\nCoverage: none", "  Coverage: 2\n  Accuracy: 1", "Clarity and Structure: 2\nUse of Evidence: 1\nReasoning: 0", "Coverage: 12\nAccuracy: 1.5", None], 1)]
_DIMS = {"coverage": "Coverage", "accuracy": "Accuracy", "reasoning": "Reasoning", "use_of_evidence": "Use of Evidence", "clarity_and_structure": "Clarity and Structure"}


@query(f"""WITH r(id, reply) AS ({values(_JUDGED)} UNION ALL SELECT event_id, 'Coverage: ' || (event_id % 4) || chr(10) || 'accuracy = ' || (user_id % 3) || chr(13) || chr(10) || 'Accuracy: none' || chr(10) || ' Reasoning: 2' FROM events),
l AS (SELECT id, unnest({splitlines(strip('reply'))}) AS line, unnest(range(len({splitlines(strip('reply'))}))) AS pos FROM r)
SELECT r.id, """ + ", ".join(f"try_cast(max_by(regexp_extract(line, '\\b([012])\\b', 1), pos) FILTER (starts_with(lower(line), '{v.lower()}') AND regexp_matches(line, '\\b[012]\\b')) AS INT) AS {k}" for k, v in _DIMS.items()) + " FROM r LEFT JOIN l USING (id) GROUP BY r.id")
def parse_judge_output(spark, d):
    made = F.concat(F.lit("Coverage: "), F.col("event_id") % 4, F.lit("\naccuracy = "), F.col("user_id") % 3, F.lit("\r\nAccuracy: none\n Reasoning: 2"))
    rows = spread(table(spark, d, "events")).select(F.col("event_id").alias("id"), made.alias("reply")).unionByName(local(spark, _JUDGED, "id long, reply string"))
    return rows.select("id", T.judge_scores(F.col("reply"), _DIMS).alias("s")).select("id", "s.*")


@query(f"SELECT event_id, {_TOKENS} AS k, try_cast(json_extract_string(props, '$.none') AS BIGINT) AS none FROM events")
def json_unwrap_usage(spark, d):
    return table(spark, d, "events").select("event_id", F.expr("try_cast(get_json_object(props, '$.k') as bigint)").alias("k"), F.expr("try_cast(get_json_object(props, '$.none') as bigint)").alias("none"))


_BODIES = [(1, '{"choices": [{"message": {"content": "plain"}}]}', "plain"), (2, '{"choices": [{"message": {"content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]}}]}', "ab"), (3, '{"choices": []}', ""), (4, "no json", ""), (5, '{"choices": [{"message": {"content": "[1, 2]"}}]}', "[1, 2]"), (6, '{"choices": [{"message": {"content": null}}]}', ""), (7, None, "")]


@query(f"WITH b(event_id, body, said) AS ({values(_BODIES)}) SELECT -event_id AS event_id, said FROM b UNION ALL SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE event_type || event_type END FROM events")
def message_text_parts(spark, d):
    """Texts of replies: strings, and lists of parts."""
    one = lambda c: F.concat(F.lit('{"type":"text","text":"'), c, F.lit('"}'))
    content = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise(F.concat(F.lit("["), one("event_type"), F.lit(',{"type":"x"},'), one("event_type"), F.lit("]")))
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit('{"choices":[{"message":{"content":'), content, F.lit("}}]}")).alias("body"))
    more = local(spark, [(-a, b) for a, b, _ in _BODIES], "event_id long, body string")
    return rows.unionByName(more).select("event_id", tasks.reply_text(F.col("body")).alias("said"))


_WRAPPED = [(1, '{".json": "{\\"row_id\\": 1, \\"b\\": 2}"}', '{"b": 2, "row_id": 1}'), (2, '{"a": {"b": {"c": {"d": 1}}}}', '{"d":1}'), (3, '{"a": "no json"}', '{"a": "no json"}'), (4, '{"a": 1}', '{"a": 1}'), (5, '{"a": [1]}', '{"a": [1]}'), (6, '{"a": 1, "b": 2}', '{"a": 1, "b": 2}'), (7, "[1]", "[1]"), (8, '{"x": {"a": 1, "b": {"c": 1}}}', '{"a":1,"b":{"c":1}}'), (9, '{"a": {"b": {"c": {"d": {"e": 1}}}}}', '{"d":{"e":1}}')]


@query(f"WITH w(id, raw, inner_) AS ({values([(-a, b, c) for a, b, c in _WRAPPED])}) SELECT id, json(inner_)::VARCHAR AS payload FROM w UNION ALL SELECT event_id, json('{{\"id\":' || event_id || ',\"k\":' || {_TOKENS} || '}}')::VARCHAR FROM events")
def json_unwrap(spark, d):
    """Objects taken out of up to three wrappers of one key."""
    inner = F.concat(F.lit('{"id":'), "event_id", F.lit(',"k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    text = F.concat(F.lit('{"reply":"'), F.replace(inner, F.lit('"'), F.lit('\\"')), F.lit('"}'))
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"a":{"b":'), inner, F.lit("}}"))).otherwise(text).alias("raw"))
    rows = rows.unionByName(local(spark, [(-a, b) for a, b, _ in _WRAPPED], "id long, raw string"))
    return rows.select("id", F.to_json(F.parse_json(tasks.unwrap(F.col("raw")))).alias("payload"))
