"""Queries over terms, numbers, boundary sentences, rubrics and edits of tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import edits as E
from ..functions import text as T
from ..operators import tasks, updates, validation
from ..sources.tables import spread, table
from .base import SPACE, WORD, flatten, local, query, quoted, splitlines, strip, values

# --- words and numbers ----------------------------------------------------------------------------------


def _distinctions(x: str) -> str:
    lead = rf"regexp_replace(regexp_replace({x}, '(?i)^\s*distinguish(?:\s+between)?\s*', ''), '(?i)^\s*различ{WORD}*\s*', '')"
    return rf"len(list_filter(string_split_regex(regexp_replace({lead}, '[ .]+$', ''), ';|,|\band\b|\bи\b'), lambda p: length({strip('p')}) > 2))::INT"


def _numbers(x: str) -> str:
    return rf"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({x}, '(\d+(?:[.,]\d+)?)', 1), lambda t: replace(t, ',', '.')), lambda t: length(replace(t, '.', '')) >= 2)))"


def _terms(x: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(lower({x}), '([a-z]{{4,}})', 1)))"


@query(f"WITH l AS (SELECT doc_id, unnest({splitlines('text')}) AS line, unnest(range(len({splitlines('text')})))::INT AS pos FROM documents) SELECT doc_id, pos, {_distinctions('line')} AS parts FROM l")
def count_distinctions(spark, d):
    """Parts of each line of all documents, read as a boundary sentence."""
    rows = spread(table(spark, d, "documents")).select("doc_id", F.posexplode(T.splitlines(F.col("text"))).alias("pos", "line"))
    return rows.select("doc_id", "pos", T.distinctions(F.col("line")).alias("parts"))


@query(f"WITH l AS (SELECT unnest({splitlines('text')}) AS line FROM documents) SELECT {_distinctions('line')} AS parts, count(*) AS n FROM l GROUP BY 1")
def distinction_frequency(spark, d):
    return count_distinctions(spark, d).groupBy("parts").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, {_numbers('text')} AS numbers FROM documents")
def numeric_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", T.numbers(F.col("text")).alias("numbers"))


@query(f"SELECT item_id, {_terms('text')} AS terms FROM benchmark")
def term_sets(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.terms(F.col("text")).alias("terms"))


_TWO = f"(SELECT d.doc_id, b.item_id, {_terms('d.text')} AS t, {_terms('b.text')} AS u, {_numbers('d.text')} AS x, {_numbers('b.text || d.doc_id')} AS y FROM documents d JOIN benchmark b ON b.item_id = (SELECT min(item_id) FROM benchmark) + d.doc_id % 40)"


def _two(spark, d):
    """Each document with one benchmark item."""
    b = table(spark, d, "benchmark")
    least = b.agg(F.min("item_id").alias("least"))
    items = b.join(F.broadcast(least), F.lit(True)).select((F.col("item_id") - F.col("least")).alias("at"), "item_id", F.col("text").alias("item"))
    docs = spread(table(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 40).alias("at"))).join(items, "at")
    return docs.select("doc_id", "item_id", T.terms(F.col("text")).alias("t"), T.terms(F.col("item")).alias("u"), T.numbers(F.col("text")).alias("x"), T.numbers(F.concat("item", F.col("doc_id").cast("string"))).alias("y"))


_FILLED = ", ".join(map(quoted, validation.FILLER))


@query(f"SELECT doc_id, item_id, list_sort(list_filter(u, lambda w: NOT list_contains(t, w) AND w NOT IN ({_FILLED}))) AS dropped, len(list_filter(u, lambda w: NOT list_contains(t, w) AND w NOT IN ({_FILLED}))) > greatest(3, len(u) // 3) AS flagged FROM {_TWO}")
def term_sets_diff(spark, d):
    """Terms of an item that a document lacks, but for filler words."""
    gone = F.array_sort(F.array_except(F.array_except("u", "t"), F.array(*map(F.lit, validation.FILLER))))
    return _two(spark, d).select("doc_id", "item_id", gone.alias("dropped"), (F.size(gone) > F.greatest(F.lit(3), F.floor(F.size("u") / 3))).alias("flagged"))


@query(f"SELECT doc_id, item_id, len(u) > 0 AND len(list_filter(u, lambda w: NOT list_contains(t, w))) = 0 AS subset FROM {_TWO}")
def subset_rule(spark, d):
    return _two(spark, d).select("doc_id", "item_id", ((F.size("u") > 0) & (F.size(F.array_except("u", "t")) == 0)).alias("subset"))


@query(f"SELECT doc_id, item_id, list_sort(list_intersect(x, y)) AS shared FROM {_TWO}")
def numeric_tokens_overlap(spark, d):
    return _two(spark, d).select("doc_id", "item_id", F.array_sort(F.array_intersect("x", "y")).alias("shared"))


@query(f"""WITH c AS (SELECT doc_id, item_id, len(list_intersect(t, u)) AS b, len(t) AS n, len(u) AS m FROM {_TWO})
SELECT doc_id, item_id, CASE WHEN n > 0 THEN b / n ELSE 0.0 END AS precision, CASE WHEN m > 0 THEN b / m ELSE 0.0 END AS recall, CASE WHEN n + m > 0 THEN 2.0 * b / (n + m) ELSE 0.0 END AS f1 FROM c""")
def set_prf1(spark, d):
    """An extension: precision, recall and F1 of a document's terms against an item's."""
    both, n, m = F.size(F.array_intersect("t", "u")), F.size("t"), F.size("u")
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    return _two(spark, d).select("doc_id", "item_id", ratio(both, n).alias("precision"), ratio(both, m).alias("recall"), ratio(2.0 * both, n + m).alias("f1"))


_SAID = [(-1, "It is a Trap."), (-2, "trapped tricks"), (-3, "Осторожно, ловушки"), (-4, "ЛОВУШКА"), (-5, "be careful"), (-6, "")]


@query(rf"WITH t AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM ({values(_SAID)})) SELECT doc_id, regexp_matches(text, '(?i)\b(trap|trick|pitfall|beware|careful|caution|gotcha)\b') AS en, regexp_matches(lower(text), 'ловушк|подвох|ошибочн|осторожн') AS ru FROM t")
def giveaway_scan(spark, d):
    rows = spread(table(spark, d, "documents").select("doc_id", "text")).unionByName(local(spark, _SAID, "doc_id long, text string"))
    return rows.select("doc_id", F.col("text").rlike(T.GIVEAWAY_EN).alias("en"), F.col("text").rlike("(?iU)" + T.GIVEAWAY_RU.removeprefix("(?i)")).alias("ru"))


_EDGE = rf"(^|[^\p{{L}}\p{{N}}_])"


@query(rf"""WITH g AS (SELECT item_id, list_filter(string_split(text, ' '), lambda w: regexp_matches(w, '^[a-z]{{4,}}$'))[1:3] AS ws, {_numbers('text')} AS ns FROM benchmark), c AS (SELECT d.doc_id, g.item_id, lower({flatten('d.text')}) AS said, array_to_string(ws, ' ') AS phrase, ws[1] AS word FROM documents d JOIN g ON g.item_id = (SELECT min(item_id) FROM benchmark) + d.doc_id % 40)
SELECT doc_id, item_id, regexp_matches(said, '{_EDGE}' || regexp_escape(phrase) || '($|[^\p{{L}}\p{{N}}_])') AND len(string_split(phrase, ' ')) >= 3 AS phrase_leaks,
CASE WHEN said = word THEN 'same' WHEN regexp_matches(said, '{_EDGE}' || regexp_escape(word) || '($|[^\p{{L}}\p{{N}}_])') THEN 'mention' END AS word_kind FROM c""")
def gold_leak_check(spark, d):
    """A phrase and a word of an item against a document: how a text gives a value away."""
    b = table(spark, d, "benchmark")
    words = F.slice(F.filter(F.split("text", " "), lambda w: w.rlike("^[a-z]{4,}$")), 1, 3)
    least = b.agg(F.min("item_id").alias("least"))
    golds = b.join(F.broadcast(least), F.lit(True)).select((F.col("item_id") - F.col("least")).alias("at"), "item_id", F.array_join(words, " ").alias("phrase"), F.get(words, F.lit(0)).alias("word"))
    rows = spread(table(spark, d, "documents")).select("doc_id", F.lower(T.flatten(F.col("text"))).alias("said"), (F.col("doc_id") % 40).alias("at")).join(golds, "at")
    return rows.select("doc_id", "item_id", F.coalesce(validation.leak(F.col("phrase"), F.col("said")) == "inside", F.lit(False)).alias("phrase_leaks"), validation.leak(F.col("word"), F.col("said")).alias("word_kind"))


# --- sentences ------------------------------------------------------------------------------------------


@query(rf"SELECT doc_id, CASE WHEN regexp_matches(text, '[^.\s][^.]*licen[^.]*\.') THEN {strip(rf"regexp_replace(text, '[^.{SPACE}][^.]*licen[^.]*\.[{SPACE}]*', '')")} ELSE text END AS text FROM documents")
def strip_sentence(spark, d):
    """Documents without their first sentence about licences."""
    return spread(table(spark, d, "documents")).select("doc_id", T.drop_first_sentence(F.col("text"), "licen").alias("text"))


@query("SELECT doc_id, CASE WHEN position(w IN text) > 0 THEN text[1:position(w IN text) - 1] || '<new>' || text[position(w IN text) + length(w):] ELSE text END AS text FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'no such part' ELSE text[5:9] END AS w FROM documents) WHERE w <> ''")
def splice_first(spark, d):
    """The first place of a part of each document replaced; documents without it stay."""
    old = F.when(F.col("doc_id") % 3 == 0, "no such part").otherwise(F.substring("text", 5, 5))
    return table(spark, d, "documents").filter(old != "").select("doc_id", T.splice_first(F.col("text"), old, F.lit("<new>")).alias("text"))


_CLEAN = "regexp_replace(text, '[^a-z ]', ' ', 'g')"


@query(rf"""WITH p AS (SELECT item_id, item_id % 4 AS k, trim(regexp_replace({_CLEAN}, ' +', ' ', 'g')) AS body FROM benchmark)
SELECT item_id, CASE WHEN k = 3 THEN NULL ELSE CASE k WHEN 0 THEN 'Methodological trap: distinguish ' WHEN 1 THEN 'Boundary trap : Distinguish ' ELSE 'Distinguish ' END || body || '.' END AS sentence,
CASE k WHEN 3 THEN NULL WHEN 0 THEN 'distinguish ' || body || '.' ELSE 'Distinguish ' || body || '.' END AS body,
'Find it. ' || CASE WHEN k = 3 THEN 'Consider ' ELSE 'Distinguish ' END || body || '.' || CASE WHEN item_id % 2 = 0 THEN ' Return: list' ELSE '' END AS neutral,
CASE k WHEN 3 THEN NULL WHEN 2 THEN 'Различайте ' || body || '.' ELSE 'Ловушка: различайте ' || body || '.' END AS sentence_ru,
CASE WHEN k = 3 THEN 'Найдите. Прочее ' ELSE 'Найдите. Различайте ' END || body || '.' || CASE WHEN item_id % 2 = 0 THEN ' Результат: список' ELSE '' END AS neutral_ru FROM p""")
def neutralise_prompt(spark, d):
    """Boundary sentences of prompts in both languages, in all spellings, and prompts without labels."""
    b = table(spark, d, "benchmark")
    k = F.col("item_id") % 4
    body = F.trim(F.regexp_replace(F.regexp_replace("text", "[^a-z ]", " "), " +", " "))
    pick = lambda *words: F.when(k == 0, words[0]).when(k == 1, words[1]).when(k == 2, words[2]).otherwise(words[3])
    tail = lambda word: F.when(F.col("item_id") % 2 == 0, word).otherwise("")
    en = F.concat(F.lit("Find it. "), pick("Methodological trap: distinguish ", "Boundary trap : Distinguish ", "Distinguish ", "Consider "), body, F.lit("."), tail(" Return: list"))
    ru = F.concat(F.lit("Найдите. "), pick("Ловушка: различайте ", "Ловушка: различайте ", "Различайте ", "Прочее "), body, F.lit("."), tail(" Результат: список"))
    rows = b.select("item_id", en.alias("en"), ru.alias("ru"))
    e, r = E.sentence_en(F.col("en")), E.sentence_ru(F.col("ru"))
    return rows.select("item_id", e["sentence"].alias("sentence"), e["body"].alias("body"), E.neutral_en(F.col("en")).alias("neutral"), r["sentence"].alias("sentence_ru"), E.neutral_ru(F.col("ru")).alias("neutral_ru"))


@query(r"""WITH p AS (SELECT item_id, item_id % 4 AS k, item_id % 2 AS h, trim(regexp_replace(regexp_replace(text, '[^a-z ]', ' ', 'g'), ' +', ' ', 'g')) AS body FROM benchmark)
SELECT item_id, CASE WHEN k = 3 THEN 'unparsed' WHEN k = 2 THEN 'neutral' ELSE 'changed' END AS state, k < 2 AND regexp_matches(body, 'trap|trick|pitfall|beware') AS residual,
'Use the table. ' || CASE WHEN k = 1 THEN 'See source_scope' ELSE '' END AS stripped, k <> 2 AS changed, k = 1 AS left_over FROM p""")
def gates(spark, d):
    """Both gates over prompts made of items: labels taken out and giveaway words left, scope sentences taken out and names left."""
    b = table(spark, d, "benchmark")
    k = F.col("item_id") % 4
    body = F.trim(F.regexp_replace(F.regexp_replace("text", "[^a-z ]", " "), " +", " "))
    en = F.concat(F.lit("Find it. "), F.when(k < 2, "Boundary trap: distinguish ").when(k == 2, "Distinguish ").otherwise("Consider "), body, F.lit("."))
    ru = F.concat(F.lit("Найдите. "), F.when(k < 2, "Ловушка: различайте ").when(k == 2, "Различайте ").otherwise("Прочее "), body, F.lit("."))
    scope = F.when(k == 2, "Use the table. ").when(k == 1, "Use the table. Use `source_scope` only. See source_scope").otherwise("Use the table. Use `source_scope` only. ")
    rows = validation.neutralise(b.select("item_id", en.alias("en"), ru.alias("ru"), scope.alias("scope")), "en", "ru").withColumnRenamed("residual", "first")
    rows = validation.strip_scope(rows, "scope")
    return rows.select("item_id", "state", F.col("first").alias("residual"), F.when(k == 1, F.col("scope")).otherwise(F.concat(T.strip(F.col("scope")), F.lit(" "))).alias("stripped"), "changed", F.col("residual").alias("left_over"))


@query("""SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 'absent' WHEN item_id % 3 = 0 AND length(text) > 60 THEN 'mismatched' ELSE 'matched' END AS state FROM benchmark""")
def prompt_reconcile(spark, d):
    """Stored prompts against rebuilt ones, by the key that both spellings share; some are missing, some cut."""
    now = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("Core-1-task"), "item_id").alias("task_id"), "text")
    cut = F.when(F.col("item_id") % 3 == 0, F.left("text", F.lit(60))).otherwise(F.concat(F.lit(" "), "text", F.lit("\n")))
    then = now.filter("item_id % 5 <> 0").select(F.concat(F.lit("Core-batch1-task"), "item_id").alias("task_id"), cut.alias("prompt"))
    return validation.reconcile(now, then, "task_id", "text", "prompt").select("item_id", "state")


# --- rubrics ----------------------------------------------------------------------------------------------

_BARE = "replace(text, '*', '')"


@query(rf"""WITH c AS (SELECT item_id, {strip(_BARE)} AS body, item_id % 5 + 1 AS blocks FROM benchmark)
SELECT item_id, blocks::INT AS blocks, CASE WHEN blocks = 5 THEN true END AS same, CASE WHEN blocks = 5 THEN '- 2: ' || body || chr(10) || '- 1: **b** ' || chr(10) || '- 0: c' END AS accuracy,
CASE WHEN blocks = 5 THEN ['2', '1', '0'] END AS levels, [body[1:3], 'b'] AS bold, CASE WHEN blocks = 5 THEN '**Part 0**' || chr(10) || 'new **x** body' END AS start FROM c""")
def rubric_parse_roundtrip(spark, d):
    """Cells of one to five blocks made of benchmark texts: parsed, put together again, one body replaced."""
    body = T.strip(F.replace(F.col("text"), F.lit("*"), F.lit("")))
    blocks = F.col("item_id") % 5 + 1
    part = lambda k: F.when(blocks > k, F.concat(F.lit(f"**Part {k}**\n- 2: "), body, F.lit("\n- 1: **b** \n- 0: c\n\n"))).otherwise("")
    rows = table(spark, d, "benchmark").select("item_id", F.concat(*[part(k) for k in range(5)]).alias("cell"), body.alias("body"))
    cell, none = F.col("cell"), F.create_map().cast("map<string,string>")
    bodies = E.rubric_bodies(cell)
    new = E.compose(cell, F.create_map(F.lit("coverage"), F.lit(" new **x** body\n")))
    return rows.select("item_id", F.size(E.rubric(cell)["blocks"]).alias("blocks"), (E.compose(cell, none) == cell).alias("same"), bodies["accuracy"].alias("accuracy"), E.levels(bodies["coverage"]).alias("levels"),
                       F.concat(F.array(F.left("body", F.lit(3))), F.slice(E.bold(F.lit("**b** x **B**"), F.lit("** b** y")), 1, 9)).alias("bold"), F.substring_index(new, "\n\n", 1).alias("start"))


@query("""SELECT item_id, item_id % 4 = 0 AS multiset, CASE item_id % 4 WHEN 0 THEN ['accuracy', 'coverage'] WHEN 1 THEN ['coverage'] WHEN 2 THEN ['accuracy'] ELSE [] END AS shared, CASE item_id % 4 WHEN 1 THEN ['reasoning'] WHEN 2 THEN [] WHEN 3 THEN ['reasoning'] ELSE [] END AS more, CASE item_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['accuracy'] WHEN 2 THEN ['coverage'] ELSE ['accuracy', 'coverage'] END AS less FROM benchmark""")
def dimension_key_sets(spark, d):
    """Keys of two languages' rubric updates: shared, more, less; and equal values in another order."""
    k = F.col("item_id") % 4
    en = F.create_map(F.lit("coverage"), "text", F.lit("accuracy"), "text")
    ru = F.when(k == 0, en).when(k == 1, F.create_map(F.lit("coverage"), "text", F.lit("reasoning"), "text")).when(k == 2, F.create_map(F.lit("accuracy"), "text")).otherwise(F.create_map(F.lit("reasoning"), "text"))
    a, b = F.map_keys(en), F.map_keys(ru)
    equal = F.array_sort(F.array(F.lit("x"), F.lit("y"), F.lit("x"))) == F.array_sort(F.when(k == 0, F.array(F.lit("y"), F.lit("x"), F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("y"))))
    return table(spark, d, "benchmark").select("item_id", equal.alias("multiset"), F.array_sort(F.array_intersect(a, b)).alias("shared"), F.array_sort(F.array_except(b, a)).alias("more"), F.array_sort(F.array_except(a, b)).alias("less"))


@query("SELECT item_id, CASE WHEN item_id % 3 = 1 THEN ['changed'] WHEN item_id % 3 = 2 THEN ['changed', 'new'] ELSE [] END AS kept FROM benchmark")
def changed_updates(spark, d):
    """Rubric updates without those that only differ in white space."""
    k = F.col("item_id") % 3
    blocks = F.create_map(F.lit("same"), "text", F.lit("changed"), "text")
    one = F.create_map(F.lit("same"), F.concat(F.lit(" "), F.replace(F.col("text"), F.lit(" "), F.lit(" \n")), F.lit(" ")))
    new = F.when(k == 0, one).when(k == 1, F.map_concat(one, F.create_map(F.lit("changed"), F.concat("text", F.lit("!"))))).otherwise(F.map_concat(one, F.create_map(F.lit("changed"), F.lit("x"), F.lit("new"), F.lit("y"))))
    return table(spark, d, "benchmark").select("item_id", F.array_sort(F.map_keys(tasks.changed_only(new, blocks))).alias("kept"))


# --- edits ------------------------------------------------------------------------------------------------

_GOOD = {
    "new_trap_sentence": "Distinguish stocks from flows, gross from net and nominal figures.", "new_trap_dimension": "nominal figures", "internal_source_boundary_rule": "rule",
    "boundary_notes": "Exclude answers that mix.", "optional_distractors": ["flow 7", "other"], "updates": [["accuracy", "- 2: new **gold 1**\n- 1: b\n- 0: c"]], "needs_human_review": False,
    "existing_trap_body": "distinguish stocks from flows", "existing_distinctions": 1, "gold_values": ["gold 1"], "blocks": [["accuracy", "- 2: **Gold  1**"], ["coverage", "x"]],
}
_CASES = [
    {}, {"needs_human_review": True}, {"boundary_notes": " ", "new_trap_dimension": None}, {"new_trap_sentence": "Distinguish stocks from flows."}, {"new_trap_sentence": "Beware: a trap of stocks, flows and net"},
    {"new_trap_sentence": "Distinguish stocks\nfrom flows, gross and net."}, {"existing_distinctions": 5}, {"existing_trap_body": "distinguish alpha, beta, gamma, delta, epsilon and zeta from those"}, {"new_trap_dimension": "Stocks and flows"},
    {"gold_values": []}, {"optional_distractors": ["the gold 1 bar", "b"]}, {"optional_distractors": ["gold 12", "12 pieces of gold"], "gold_values": ["12 units", "gold"]}, {"optional_distractors": ["Direct", "indirect"], "gold_values": ["direct"]},
    {"optional_distractors": ["it is direct here", "the one two three x", "b"], "gold_values": ["direct", "one two three", " "]}, {"optional_distractors": ["x"]}, {"optional_distractors": ["a", "b", "c", "d", "e"]}, {"boundary_notes": "exclude  Answers that x"},
    {"boundary_notes": "Leave out."}, {"updates": []}, {"updates": [["style", "- 2: a - 1: b - 0: c"], ["coverage", "- 2: a - 0: b"]]}, {"updates": [["accuracy", "- 2: **gold 2** - 1: b - 0: c"]]}, {"optional_distractors": None, "updates": None, "gold_values": None},
    {"optional_distractors": ["0,293 of it", "b"], "gold_values": ["about 0.293 and 17"]},
]
_FIELDS = list(_GOOD)
_EDITS = [(k, *[(_GOOD | c)[f] for f in _FIELDS]) for k, c in enumerate(_CASES)]
_listed = lambda x: f"(CASE WHEN len({x}) = 0 THEN '[]' ELSE '[''' || array_to_string({x}, ''', ''') || ''']' END)"
_norm = lambda x: f"lower({flatten(x)})"
_levels = lambda x: rf"regexp_extract_all({x}, '(?:^|\s)-\s*([012])\s*:', 1)"
_bold = lambda x: rf"list_sort(list_transform(regexp_extract_all({x}, '\*\*([^*]+)\*\*', 1), lambda b: {_norm('b')}))"
_inside = lambda d, g: rf"regexp_matches({d}, '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape({g}) || '($|[^\p{{L}}\p{{N}}_])')"
_special = lambda g: rf"(regexp_matches({g}, '\d') OR len(list_filter(string_split({g}, ' '), lambda w: w <> '')) >= 3)"
_kind = lambda d, g: f"(CASE WHEN {g} = '' THEN NULL WHEN {_special(g)} THEN CASE WHEN {_inside(d, g)} THEN 'inside' END WHEN {d} = {g} THEN 'same' WHEN {_inside(d, g)} THEN 'mention' END)"
_bad = lambda d: f"coalesce(list_position(list_transform(golds, lambda g: coalesce({_kind(_norm(d), _norm('g'))} IN ('inside', 'same'), false)), true), 0)"
_MESSAGES = f"""list_filter(list_transform(CASE WHEN {_bad('d')} > 0 THEN golds[1:{_bad('d')}] ELSE golds END, lambda g: CASE {_kind(_norm('d'), _norm('g'))} WHEN 'inside' THEN '[reject] distractor leaks the gold value ''' || g || ''': ''' || d[1:90] || '''' WHEN 'same' THEN '[reject] distractor is the gold value ''' || g || '''' WHEN 'mention' THEN '[flag] distractor mentions the categorical gold ''' || g || ''': ''' || d[1:90] || '''' END), lambda m: m IS NOT NULL)"""
_shared = lambda d, g: f"list_sort(list_intersect({_numbers(g)}, {_numbers(d)}))"
_NEAR = f"(CASE WHEN {_bad('d')} = 0 THEN list_transform(list_filter(golds, lambda g: len({_shared('d', 'g')}) > 0)[1:1], lambda g: '[flag] distractor shares numeric parts ' || {_listed(_shared('d', 'g'))} || ' with gold ''' || g || '''; may earn partial credit') ELSE [] END)"


def _when(*rules: tuple[str, str]) -> str:
    return " || ".join(f"CASE WHEN {c} THEN [{m}] ELSE [] END" if not c.startswith("=") else f"({c[1:]})" for c, m in rules)


_RULES = _when(
    ("NOT starts_with(s, 'Distinguish ')", "'[reject] boundary sentence must start with ''Distinguish '''"), ("right(s, 1) <> '.'", "'[flag] boundary sentence does not end with a period'"),
    ("len(given) > 0", f"'[reject] boundary sentence announces the trick to the model: ' || {_listed('given')}"), ("contains(s, chr(10))", "'[reject] boundary sentence spans multiple lines'"),
    ("n < existing_distinctions", "'[reject] difficulty regression: ' || n || ' distinctions vs ' || existing_distinctions || ' before'"), ("n = existing_distinctions", "'[flag] distinction count unchanged (' || n || '); existing distinction may have been merged'"),
    ("len(gone) > greatest(3, len(old) // 3)", f"'[flag] ' || len(gone) || ' terms from the original trap are absent: ' || {_listed('gone[1:8]')}"), ("len(words) > 0 AND len(list_filter(words, lambda w: NOT list_contains(old, w))) = 0", "'[reject] new_trap_dimension ''' || dim || ''' adds nothing not already in the original trap'"),
    ("len(golds) = 0", "'[flag] no bolded gold value on this row; distractors are not machine-verifiable'"), (f"=flatten(list_transform(ds, lambda d: {_MESSAGES} || {_NEAR}))", ""),
    ("len(ds) = 1", "'[flag] only 1 distractor(s); rule asks for 2-3'"), ("len(ds) > 4", "'[flag] ' || len(ds) || ' distractors; rule asks for 2-3'"),
    (f"NOT starts_with({_norm('boundary_notes')}, 'exclude answers that')", "'[reject] boundary_notes must start with ''Exclude answers that'''"), ("len(us) = 0", "'[flag] no rubric update; the new distinction will not be scored'"),
    (f"=flatten(list_transform(us, lambda u: CASE WHEN NOT list_contains(list_transform(blocks, lambda b: b[1]), u[1]) THEN ['[reject] rubric_updates references unknown dimension ''' || u[1] || ''''] ELSE (CASE WHEN {_levels('u[2]')} <> ['2', '1', '0'] THEN ['[reject] rubric ''' || u[1] || ''' levels are ' || {_listed(_levels('u[2]'))} || ', expected [''2'',''1'',''0'']'] ELSE [] END) || (CASE WHEN u[1] = 'accuracy' AND {_bold('blocks[1][2]')} <> {_bold('u[2]')} THEN ['[reject] accuracy rubric changed the bolded gold value: ' || {_listed(_bold('blocks[1][2]'))} || ' -> ' || {_listed(_bold('u[2]'))}] ELSE [] END) END))", ""),
)


@query(rf"""WITH e(id, {', '.join(_FIELDS)}) AS ({values(_EDITS)}), a AS (SELECT *, {strip("coalesce(new_trap_sentence, '')")} AS s, coalesce(optional_distractors, []) AS ds, coalesce(updates, []) AS us, coalesce(gold_values, []) AS golds, {_norm("coalesce(new_trap_dimension, '')")} AS dim, {_terms("existing_trap_body")} AS old FROM e),
b AS (SELECT *, {_distinctions("regexp_replace(s, '^Distinguish ', '')")} AS n, list_sort(list_filter(old, lambda w: NOT list_contains({_terms('s')}, w) AND w NOT IN ({_FILLED}))) AS gone, {_terms('dim')} AS words, list_sort(list_distinct(regexp_extract_all(s, '(?i)\b(trap|trick|pitfall|beware|careful|caution|gotcha)\b', 1))) AS given,
list_filter([{', '.join(f"CASE WHEN {strip(f'coalesce({k}, {chr(39)*2})')} = '' THEN '[reject] missing required field: {k}' END" for k in validation.REQUIRED)}], lambda m: m IS NOT NULL) AS missing FROM a),
c AS (SELECT id, CASE WHEN len(missing) > 0 THEN missing ELSE {_RULES} END AS issues, needs_human_review FROM b), v AS (SELECT id, issues, needs_human_review, CASE WHEN len(list_filter(issues, lambda m: starts_with(m, '[reject]'))) > 0 THEN 'reject' WHEN len(issues) > 0 THEN 'flag' ELSE 'ok' END AS severity FROM c)
SELECT id, CASE WHEN severity = 'ok' AND needs_human_review THEN 'flag' ELSE severity END AS severity, CASE WHEN severity = 'ok' AND needs_human_review THEN ['[flag] model self-reported needs_human_review'] ELSE issues END AS issues FROM v""")
def validate_edit(spark, d):
    """Edits that break each rule, and some that break none."""
    kinds = {"optional_distractors": "array<string>", "gold_values": "array<string>", "updates": "array<array<string>>", "blocks": "array<array<string>>", "needs_human_review": "boolean", "existing_distinctions": "int"}
    rows = local(spark, _EDITS, "id int, " + ", ".join(f"{f} {kinds.get(f, 'string')}" for f in _FIELDS))
    as_map = lambda c: F.map_from_entries(F.transform(c, lambda p: F.struct(F.get(p, F.lit(0)), F.get(p, F.lit(1)))))
    return validation.check_edits(rows.withColumns({"rubric_updates": as_map("updates"), "rubric_blocks": as_map("blocks")})).select("id", "severity", "issues")


_PAIRS = [
    (0, "Distinguish 10 stocks from flows, gross and net.", "Exclude 2.", ["0.293", "b"], ["a"], None, [["accuracy", "x"]], "Различайте 10 запасов, потоки; валовые.", "Исключайте.", ["0,293", "б"], ["а"], None, [["accuracy", "- 2: а - 1: б - 0: в"]]),
    (1, "Distinguish a.", "x", [], [], [], [], " ", "x", [], [], [], []),
    (2, "Distinguish stocks, flows and 45 figures.", "Exclude 77.", ["1", "2"], ["a", "b"], ["c"], [["accuracy", "x"], ["coverage", "y"]], "Осторожно: запасы", "", ["1"], [], [], [["reasoning", "- 2: а"]]),
    (3, "Distinguish a.", "x", [], [], [], [["accuracy", "x"], ["coverage", "y"]], "различай это и то", "x", None, None, None, [["coverage", "- 2: а\n- 1: б\n- 0: в"]]),
]
_PAIR_FIELDS = ["new_trap_sentence", "boundary_notes", "optional_distractors", "new_common_failure_modes", "new_borderline_cases", "rubric_updates", "new_trap_sentence_ru", "boundary_notes_ru", "optional_distractors_ru", "new_common_failure_modes_ru", "new_borderline_cases_ru", "rubric_updates_ru"]
_all = lambda s, e: _numbers(f"{s} || ' ' || coalesce(boundary_notes{e}, '') || ' ' || array_to_string(coalesce(optional_distractors{e}, []), ' ')")
_size = lambda c: f"len(coalesce({c}, []))"
_TRANSLATED = _when(
    ("NOT starts_with(lower(s), 'различа')", "'[reject] Russian boundary sentence must start with ''Различайте'''"), ("len(given) > 0", f"'[reject] Russian boundary sentence announces the trick: ' || {_listed('given')}"),
    ("trim(coalesce(boundary_notes_ru, '')) = ''", "'[reject] missing boundary_notes_ru'"), ("ru < en", "'[flag] Russian trap has fewer distinctions: EN ' || en || ' vs RU ' || ru"),
    *[(f"{_size(k)} <> {_size(k + '_ru')}", f"'[reject] {k}_ru has ' || {_size(k + '_ru')} || ' items, EN has ' || {_size(k)}") for k in validation.LISTS],
    ("len(lost) > 0", f"'[flag] numbers present in EN but not RU: ' || {_listed('lost[1:6]')}"), ("len(more) > 0", f"'[reject] rubric_updates_ru has dimensions absent from EN: ' || {_listed('more')}"),
    ("len(more) = 0 AND len(less) > 0", f"'[flag] no Russian rubric for ' || {_listed('less')} || '; those dimensions will be left unchanged in both languages'"),
    (f"=flatten(list_transform(coalesce(rubric_updates_ru, []), lambda u: CASE WHEN {_levels('u[2]')} <> ['2', '1', '0'] THEN ['[reject] RU rubric ''' || u[1] || ''' levels are ' || {_listed(_levels('u[2]'))} || ', expected [''2'',''1'',''0'']'] ELSE [] END))", ""),
)
_keys = lambda c: f"list_transform(coalesce({c}, []), lambda u: u[1])"


@query(f"""WITH e(id, {', '.join(_PAIR_FIELDS)}) AS ({values(_PAIRS)}), a AS (SELECT *, {strip('new_trap_sentence_ru')} AS s, {_distinctions('new_trap_sentence')} AS en FROM e),
b AS (SELECT *, {_distinctions('s')} AS ru, list_sort(list_distinct(regexp_extract_all(lower(s), 'ловушк|подвох|ошибочн|осторожн'))) AS given0, list_filter({_all('new_trap_sentence', '')}, lambda x: NOT list_contains({_all('s', '_ru')}, x)) AS lost, list_sort(list_filter({_keys('rubric_updates_ru')}, lambda k: NOT list_contains({_keys('rubric_updates')}, k))) AS more, list_sort(list_filter({_keys('rubric_updates')}, lambda k: NOT list_contains({_keys('rubric_updates_ru')}, k))) AS less FROM a),
c AS (SELECT *, CASE WHEN id = 2 THEN ['Осторожн'] ELSE given0 END AS given FROM b), i AS (SELECT id, CASE WHEN s = '' THEN ['[reject] missing new_trap_sentence_ru'] ELSE {_TRANSLATED} END AS issues FROM c)
SELECT id, CASE WHEN len(list_filter(issues, lambda m: starts_with(m, '[reject]'))) > 0 THEN 'reject' WHEN len(issues) > 0 THEN 'flag' ELSE 'ok' END AS severity, issues FROM i""")
def validate_translation(spark, d):
    """Translations that break each rule, and one that breaks none."""
    kind = lambda f: "array<array<string>>" if "rubric" in f else "string" if "sentence" in f or "notes" in f else "array<string>"
    rows = local(spark, _PAIRS, "id int, " + ", ".join(f"{f} {kind(f)}" for f in _PAIR_FIELDS))
    as_map = lambda c: F.map_from_entries(F.transform(c, lambda p: F.struct(F.get(p, F.lit(0)), F.get(p, F.lit(1)))))
    return validation.check_translations(rows.withColumns({c: as_map(c) for c in ("rubric_updates", "rubric_updates_ru")})).select("id", "severity", "issues")


# --- cell updates, audits, payloads ------------------------------------------------------------------------


def _task_rows(spark, d):
    """Task rows made of benchmark items, with an edit and its translation."""
    b = table(spark, d, "benchmark")
    k = F.col("item_id")
    word = F.concat(F.lit("item"), k.cast("string"))
    cell = F.concat(*[F.concat(F.lit(f"**Part {i}**\n- 2: "), word, F.lit(f" **gold {i}**\n- 1: b\n- 0: c\n\n")) for i in range(5)])
    body = "- 2: new\n- 1: b\n- 0: c"
    columns = {
        "final_prompt_text": F.when(k % 6 == 5, "no sentence").otherwise(F.concat(F.lit("Find "), word, F.lit(". Boundary trap: distinguish a from b. Return: list"))),
        "final_prompt_text_ru": F.concat(F.lit("Найдите "), word, F.lit(". Ловушка: различайте а и б. Результат: список")),
        "internal_source_boundary": F.when(k % 2 == 0, F.concat(F.lit("- old "), word)).otherwise(""), "internal_source_boundary_ru": F.lit(""),
        "common_failure_modes": F.lit(""), "common_failure_modes_ru": F.lit("- был\n"), "borderline_cases": word, "borderline_cases_ru": word,
        "fixed_criteria_0_2_each": F.when(k % 7 == 3, "**Part**\n- 2: alone").otherwise(cell), "fixed_criteria_0_2_each_ru": F.regexp_replace(cell, "\n+", " "),
        "accuracy": F.lit("**gold 1** and **Gold  1**"), "key_facts_from_source_bundle": F.when(k % 2 == 0, F.concat(F.lit("**"), word, F.lit("**"))).otherwise(""),
    }
    text = F.array().cast("array<string>")
    edit = F.struct(
        F.concat(F.lit(" Distinguish a from b and "), word, F.lit(". ")).alias("new_trap_sentence"), F.lit(" rule ").alias("internal_source_boundary_rule"), F.lit("Exclude answers that x. ").alias("boundary_notes"),
        F.array(F.concat(F.lit("- mode "), word), F.lit(" ")).alias("new_common_failure_modes"), text.alias("new_borderline_cases"), F.when(k % 3 == 0, F.array(F.lit("d1"), F.lit("d2"))).alias("optional_distractors"),
        F.create_map(F.lit("accuracy"), F.lit(body), F.lit("coverage"), F.lit(body)).alias("rubric_updates"))
    twin = F.struct(
        F.lit("Различайте\nа, б.").alias("new_trap_sentence_ru"), F.lit("правило").alias("internal_source_boundary_rule_ru"), F.lit("Исключайте\nэто.").alias("boundary_notes_ru"), F.array(F.lit("вид")).alias("new_common_failure_modes_ru"),
        F.lit(None).cast("array<string>").alias("new_borderline_cases_ru"), F.array(F.lit("д1"), F.lit("д2")).alias("optional_distractors_ru"), F.create_map(F.lit("accuracy"), F.lit(body)).alias("rubric_updates_ru"))
    return b.select("item_id", *[c.alias(n) for n, c in columns.items()], edit.alias("edit"), twin.alias("translation"))


_FLAT = "'- 2: new - 1: b - 0: c'"
_LINED = "'- 2: new' || chr(10) || '- 1: b' || chr(10) || '- 0: c'"
_PART = "'**Part ' || i || '**' || chr(10) || CASE WHEN i = 1 THEN " + _LINED + " ELSE '- 2: ' || w || ' **gold ' || i || '**' || chr(10) || '- 1: b' || chr(10) || '- 0: c' END || chr(10) || chr(10)"


@query(f"""WITH t AS (SELECT item_id, 'item' || item_id AS w FROM benchmark WHERE item_id % 6 <> 5)
SELECT item_id, 'Find ' || w || '. Distinguish a from b and ' || w || '. Return: list' AS final_prompt_text, 'Найдите ' || w || '. Различайте а, б. Результат: список' AS final_prompt_text_ru,
CASE WHEN item_id % 2 = 0 THEN '- old ' || w || chr(10) ELSE '' END || '- boundary rule: rule' AS internal_source_boundary, '- mode ' || w AS common_failure_modes, '- был' || chr(10) || '- вид' AS common_failure_modes_ru, w AS borderline_cases,
CASE WHEN item_id % 3 = 0 THEN '- d1' || chr(10) || '- d2' END AS optional_distractors, CASE WHEN item_id % 3 = 0 THEN '- д1' || chr(10) || '- д2' END AS optional_distractors_ru, 'Исключайте это.' AS boundary_notes_ru, {_LINED} AS accuracy, {_FLAT} AS accuracy_ru, NULL::VARCHAR AS coverage,
CASE WHEN item_id % 7 = 3 THEN NULL ELSE array_to_string(list_transform(range(5), lambda i: {_PART}), '') END AS fixed_criteria_0_2_each FROM t""")
def build_updates(spark, d):
    """Cells that accepted edits change; a row whose prompt has no boundary sentence has none."""
    rows = updates.build(_task_rows(spark, d)).filter("updates is not null")
    names = ["final_prompt_text", "final_prompt_text_ru", "internal_source_boundary", "common_failure_modes", "common_failure_modes_ru", "borderline_cases", "optional_distractors", "optional_distractors_ru", "boundary_notes_ru", "accuracy", "accuracy_ru", "coverage", "fixed_criteria_0_2_each"]
    return rows.select("item_id", *[F.col("updates")[n].alias(n) for n in names])


@query("""SELECT item_id, CASE WHEN item_id % 6 = 5 THEN ['EN trap unparseable'] ELSE [] END || CASE WHEN item_id % 7 = 3 THEN ['rubric unparseable: fixed_criteria_0_2_each'] ELSE [] END AS issues, CASE WHEN item_id % 6 <> 5 THEN 1 END AS distinctions, ['gold 1'] || CASE WHEN item_id % 2 = 0 THEN ['item' || item_id] ELSE [] END AS gold FROM benchmark""")
def structural_audit(spark, d):
    """What a dry run finds in task rows, and their gold values from two columns."""
    rows = validation.audit(_task_rows(spark, d), "final_prompt_text", "final_prompt_text_ru", "fixed_criteria_0_2_each", "fixed_criteria_0_2_each_ru", ("accuracy",))
    return rows.select("item_id", "issues", "distinctions", tasks.gold_spans(F.col("accuracy"), F.col("key_facts_from_source_bundle")).alias("gold"))


@query("""WITH t AS (SELECT item_id, item_id % 6 AS k FROM benchmark), p AS (SELECT item_id, unnest(CASE k WHEN 0 THEN ['column outside the allowed set: task_name'] WHEN 1 THEN CASE WHEN item_id % 7 = 3 THEN [] ELSE ['accuracy disagrees with fixed_criteria'] END WHEN 2 THEN ['EN trap no longer parses'] WHEN 3 THEN ['row identity changed a -> b'] WHEN 5 THEN [] ELSE ['row count changed'] END
|| CASE WHEN k = 5 OR k IN (3, 4) OR item_id % 7 <> 3 THEN [] ELSE ['rubric unparseable'] END) AS problem FROM t) SELECT item_id, problem FROM p""")
def verify_output(spark, d):
    """An edited table against the original: each kind of problem on some rows."""
    k = F.col("item_id") % 6
    before = _task_rows(spark, d).withColumns({"task_name": F.lit("n"), "row_id": F.lit("a"), "final_prompt_text": F.regexp_replace("final_prompt_text", "^no sentence$", "Distinguish a and b.")}).drop("edit", "translation")
    after = before.filter(k != 4).withColumns({
        "task_name": F.when(k == 0, "changed").otherwise(F.col("task_name")), "accuracy": F.when(k == 1, "- 2: other").otherwise(F.col("accuracy")),
        "final_prompt_text": F.when(k == 2, "gone").otherwise(F.col("final_prompt_text")), "row_id": F.when(k == 3, "b").otherwise(F.col("row_id")),
    })
    columns = ["task_name", "final_prompt_text", "final_prompt_text_ru", "accuracy", "fixed_criteria_0_2_each"]
    return validation.verify(before, after, "item_id", "row_id", columns)


@query("""SELECT item_id, 'item' || item_id AS row_id, 'distinguish a from b.' AS existing_trap_body, 1 AS n, 2 AS wanted, ['gold 1'] AS gold, 'T' || item_id AS task_name, '' AS source_scope, CASE WHEN item_id % 6 = 5 THEN NULL ELSE '[reject] x' END AS reason, CASE WHEN item_id % 6 = 5 THEN NULL ELSE 'dim' END AS dimension FROM benchmark""")
def payload_json(spark, d):
    """Payloads for an editor, read again: context fields, counts, what must not leak, and the previous attempt."""
    k = F.col("item_id")
    rows = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("item"), k).alias("row_id"), F.concat(F.lit("T"), k).alias("task name"), "text")
    fields = {c: F.col(f"`{c}`") if c == "task name" else F.lit(None).cast("string") for c in tasks.CONTEXT_FIELDS}
    edit = F.when(k % 6 != 5, F.struct(F.lit("dim").alias("new_trap_dimension"), F.lit(None).cast("string").alias("new_trap_sentence"), F.lit(None).cast("array<string>").alias("optional_distractors")))
    issues = F.when(k % 6 != 5, F.array(F.lit("[flag] y"), F.lit("[reject] x")))
    made = tasks.payload(F.col("row_id"), fields, F.lit("s"), F.lit("distinguish a from b."), F.create_map(F.lit("accuracy"), "text"), F.array(F.lit("gold 1")), tasks.previous_attempt(edit, issues))
    get = lambda path: F.get_json_object("payload", path)
    out = rows.withColumn("payload", made)
    return out.select("item_id", get("$.row_id").alias("row_id"), get("$.existing_trap_body").alias("existing_trap_body"), get("$.existing_distinction_count").cast("int").alias("n"), get("$.required_distinction_count").cast("int").alias("wanted"), F.from_json(get("$.gold_values_that_must_never_appear_in_distractors"), "array<string>").alias("gold"),
                      get("$.row_fields['task name']").alias("task_name"), get("$.row_fields.source_scope").alias("source_scope"), get("$.previous_attempt.rejection_reasons[0]").alias("reason"), get("$.previous_attempt.rejected_dimension").alias("dimension"))
