"""Rules over proposed edits and their translations, gates over whole tables, and the check of an edited table.

A verdict is ``severity`` (reject before flag before ok) and ``issues``, an array of ``[severity] message`` in the order of the
rules. Every rule is a column, so a table is judged in one pass without a shuffle. Missing values count as empty texts,
arrays and maps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import edits as E
from ..functions import text as T

# Fixed values of the data model.
REQUIRED = ["new_trap_sentence", "new_trap_dimension", "internal_source_boundary_rule", "boundary_notes"]
FILLER = ["distinguish", "between", "from", "versus", "that", "with", "this", "than", "when", "which", "were", "have", "been", "into", "each", "only", "such", "also", "other"]
LISTS = ["new_common_failure_modes", "new_borderline_cases", "optional_distractors"]
EDITABLE = ["final_prompt_text", "internal_source_boundary", "common_failure_modes", "borderline_cases", "optional_distractors", "boundary_notes", "fixed_criteria_0_2_each", *E.DIMENSIONS]
GATE_EN, GATE_RU = ["trap", "trick", "pitfall", "beware"], ["ловушк", "подвох"]
PREFIX = "Distinguish "

_strings, _texts = "array<string>", "map<string,string>"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(_strings))


def _map(name: str) -> Column:
    return F.coalesce(F.col(name), F.create_map().cast(_texts))


def _norm(c: Column) -> Column:
    return F.lower(T.flatten(c))


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def rule(severity: str, condition: Column, *message: Column | str) -> Column:
    """One issue, or none: an array."""
    return F.when(F.coalesce(condition, F.lit(False)), F.array(_say(f"[{severity}] ", *message))).otherwise(F.array().cast(_strings))


def verdict(rules: list[Column], stop: Column) -> Column:
    """(severity, issues) of rules; where ``stop`` (issues) is not empty, it alone counts."""
    def of(first: Column) -> Column:
        return T.bind(F.when(F.size(first) > 0, first).otherwise(F.concat(*rules)), lambda issues: F.struct(severity(issues).alias("severity"), issues.alias("issues")))

    return T.bind(stop, of)


def severity(issues: Column) -> Column:
    return F.when(F.exists(issues, lambda x: x.startswith("[reject]")), "reject").when(F.size(issues) > 0, "flag").otherwise("ok")


# --- gold values --------------------------------------------------------------------------------------


def is_specific(gold: Column) -> Column:
    """Whether a value can be looked for inside other texts: it has a digit, or three words."""
    g = _norm(gold)
    return g.rlike(r"(?U)\d") | (T.n_words(g) >= 3)


def leak(gold: Column, said: Column) -> Column:
    """How a normal text gives a value away: "inside" (a specific one), "same", "mention" (another, inside), or null."""
    g = _norm(gold)
    inside = E.has_word(said, g)
    return F.when(g == "", None).when(is_specific(gold), F.when(inside, "inside")).otherwise(F.when(said == g, "same").when(inside, "mention"))


def leak_issues(distractors: Column, golds: Column) -> Column:
    """Issues of each distractor in order: values that it mentions up to the first that it gives away, that one, else one of its numbers."""
    def of(d: Column) -> Column:
        said = _norm(d)
        short = E.quoted(F.left(d, F.lit(90)))

        def judged(kinds: Column) -> Column:
            bad = F.array_position(F.transform(kinds, lambda k: F.coalesce(k.isin("inside", "same"), F.lit(False))), True).cast("int")
            upto = F.when(bad > 0, F.slice(kinds, F.lit(1), bad)).otherwise(kinds)
            message = lambda k, g: F.when(k == "inside", _say("[reject] distractor leaks the gold value ", E.quoted(g), ": ", short)).when(k == "same", _say("[reject] distractor is the gold value ", E.quoted(g))).when(k == "mention", _say("[flag] distractor mentions the categorical gold ", E.quoted(g), ": ", short))
            said_so = F.array_compact(F.transform(upto, lambda k, i: message(k, F.get(golds, i))))
            shared = lambda g: F.array_sort(F.array_intersect(T.numbers(g), T.numbers(said)))
            near = F.get(F.filter(golds, lambda g: F.size(shared(g)) > 0), F.lit(0))
            also = F.when((bad == 0) & near.isNotNull(), F.array(_say("[flag] distractor shares numeric parts ", E.listed(shared(near)), " with gold ", E.quoted(near), "; may earn partial credit")))
            return F.concat(said_so, F.coalesce(also, F.array().cast(_strings)))

        return T.bind(F.transform(golds, lambda g: leak(g, said)), judged)

    return F.flatten(F.transform(distractors, of))


# --- edits and translations -----------------------------------------------------------------------------


def check_edits(rows: DataFrame, old_body: str = "existing_trap_body", old_count: str = "existing_distinctions", gold: str = "gold_values", blocks: str = "rubric_blocks") -> DataFrame:
    """``rows`` with ``severity`` and ``issues`` of proposed edits (``REQUIRED`` columns, ``optional_distractors``, ``rubric_updates`` map, ``needs_human_review``)."""
    sentence = T.strip(_text("new_trap_sentence"))
    count = T.distinctions(F.regexp_replace(sentence, f"^{PREFIX}", ""))
    old_terms, new_terms = T.terms(_norm(_text(old_body))), T.terms(_norm(sentence))
    gone = F.array_except(F.array_except(old_terms, new_terms), F.array(*map(F.lit, FILLER)))
    dimension = _norm(_text("new_trap_dimension"))
    words = T.terms(dimension)
    golds, said = _list(gold), _list("optional_distractors")
    n, updates, known = F.size(said), _map("rubric_updates"), F.coalesce(F.col(blocks), F.create_map().cast(_texts))
    given = F.array_sort(F.array_distinct(F.regexp_extract_all(sentence, F.lit(T.GIVEAWAY_EN), F.lit(1))))
    golden = lambda c: F.array_sort(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(E.BOLD), F.lit(1)), _norm))
    right = F.array(F.lit("2"), F.lit("1"), F.lit("0"))

    def rubric(e: Column) -> Column:
        levels = E.levels(F.coalesce(e["value"], F.lit("")))
        before, after = golden(F.try_element_at(known, F.lit("accuracy"))), golden(e["value"])
        there = F.map_contains_key(known, e["key"])
        return F.when(~there, F.array(_say("[reject] rubric_updates references unknown dimension ", E.quoted(e["key"])))).otherwise(F.concat(
            rule("reject", levels != right, "rubric '", e["key"], "' levels are ", E.listed(levels), ", expected ['2','1','0']"),
            rule("reject", (e["key"] == "accuracy") & (before != after), "accuracy rubric changed the bolded gold value: ", E.listed(before), " -> ", E.listed(after)),
        ))

    stop = F.concat(*[rule("reject", T.strip(_text(k)) == "", f"missing required field: {k}") for k in REQUIRED])
    rules = [
        rule("reject", ~sentence.startswith(PREFIX), f"boundary sentence must start with '{PREFIX}'"),
        rule("flag", ~sentence.endswith("."), "boundary sentence does not end with a period"),
        rule("reject", F.size(given) > 0, "boundary sentence announces the trick to the model: ", E.listed(given)),
        rule("reject", sentence.contains("\n"), "boundary sentence spans multiple lines"),
        rule("reject", count < F.col(old_count), "difficulty regression: ", count, " distinctions vs ", F.col(old_count), " before"),
        rule("flag", count == F.col(old_count), "distinction count unchanged (", count, "); existing distinction may have been merged"),
        rule("flag", F.size(gone) > F.greatest(F.lit(3), F.floor(F.size(old_terms) / 3)), F.size(gone), " terms from the original trap are absent: ", E.listed(F.slice(F.array_sort(gone), 1, 8))),
        rule("reject", (F.size(words) > 0) & (F.size(F.array_except(words, old_terms)) == 0), "new_trap_dimension ", E.quoted(dimension), " adds nothing not already in the original trap"),
        rule("flag", F.size(golds) == 0, "no bolded gold value on this row; distractors are not machine-verifiable"),
        leak_issues(said, golds),
        rule("flag", n == 1, "only ", n, " distractor(s); rule asks for 2-3"),
        rule("flag", n > 4, n, " distractors; rule asks for 2-3"),
        rule("reject", ~_norm(_text("boundary_notes")).startswith("exclude answers that"), "boundary_notes must start with 'Exclude answers that'"),
        rule("flag", F.size(updates) == 0, "no rubric update; the new distinction will not be scored"),
        F.flatten(F.transform(F.map_entries(updates), rubric)),
    ]
    judged = verdict(rules, stop)
    out = rows.withColumn("_judged", judged).withColumn("_review", (F.col("_judged.severity") == "ok") & F.coalesce(F.col("needs_human_review"), F.lit(False)))
    issues = F.when(F.col("_review"), F.array(F.lit("[flag] model self-reported needs_human_review"))).otherwise(F.col("_judged.issues"))
    return out.withColumns({"severity": F.when(F.col("_review"), "flag").otherwise(F.col("_judged.severity")), "issues": issues}).drop("_judged", "_review")


def check_translations(rows: DataFrame) -> DataFrame:
    """``rows`` with ``severity`` and ``issues`` of translated edits: the columns of ``check_edits`` beside their ``_ru`` twins."""
    sentence = T.strip(_text("new_trap_sentence_ru"))
    en_count, ru_count = T.distinctions(_text("new_trap_sentence")), T.distinctions(sentence)
    numbers = lambda end, first: T.numbers(F.concat_ws(" ", first, _text("boundary_notes" + end), _list("optional_distractors" + end)))
    lost = F.array_sort(F.array_except(numbers("", _text("new_trap_sentence")), numbers("_ru", sentence)))
    en, ru = _map("rubric_updates"), _map("rubric_updates_ru")
    more, less = (F.array_sort(F.array_except(F.map_keys(a), F.map_keys(b))) for a, b in ((ru, en), (en, ru)))
    given = F.array_sort(F.array_distinct(F.regexp_extract_all(sentence, F.lit("(?iU)(" + T.GIVEAWAY_RU.removeprefix("(?i)") + ")"), F.lit(1))))
    right = F.array(F.lit("2"), F.lit("1"), F.lit("0"))
    rules = [
        rule("reject", ~F.lower(sentence).startswith("различа"), "Russian boundary sentence must start with 'Различайте'"),
        rule("reject", F.size(given) > 0, "Russian boundary sentence announces the trick: ", E.listed(given)),
        rule("reject", T.strip(_text("boundary_notes_ru")) == "", "missing boundary_notes_ru"),
        rule("flag", ru_count < en_count, "Russian trap has fewer distinctions: EN ", en_count, " vs RU ", ru_count),
        *[rule("reject", F.size(_list(k)) != F.size(_list(k + "_ru")), f"{k}_ru has ", F.size(_list(k + "_ru")), " items, EN has ", F.size(_list(k))) for k in LISTS],
        rule("flag", F.size(lost) > 0, "numbers present in EN but not RU: ", E.listed(F.slice(lost, 1, 6))),
        rule("reject", F.size(more) > 0, "rubric_updates_ru has dimensions absent from EN: ", E.listed(more)),
        rule("flag", (F.size(more) == 0) & (F.size(less) > 0), "no Russian rubric for ", E.listed(less), "; those dimensions will be left unchanged in both languages"),
        F.flatten(F.transform(F.map_entries(ru), lambda e: rule("reject", E.levels(F.coalesce(e["value"], F.lit(""))) != right, "RU rubric '", e["key"], "' levels are ", E.listed(E.levels(F.coalesce(e["value"], F.lit("")))), ", expected ['2','1','0']"))),
    ]
    judged = verdict(rules, rule("reject", sentence == "", "missing new_trap_sentence_ru"))
    return rows.withColumn("_judged", judged).withColumns({"severity": F.col("_judged.severity"), "issues": F.col("_judged.issues")}).drop("_judged")


# --- audits and gates -----------------------------------------------------------------------------------


def audit(rows: DataFrame, prompt: str, prompt_ru: str, cell: str, cell_ru: str, gold: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``issues`` (boundary sentences and rubrics that cannot be parsed, or not be put together again), ``distinctions`` and ``has_gold``."""
    none = F.create_map().cast(_texts)
    en = E.sentence_en(F.col(prompt))
    found = [(en.isNull(), "EN trap unparseable"), (E.sentence_ru(F.col(prompt_ru)).isNull(), "RU trap unparseable")]
    for c in (cell, cell_ru):
        bodies = E.rubric_bodies(F.col(c))
        found += [(bodies.isNull(), f"rubric unparseable: {c}"), (bodies.isNotNull() & (E.compose(F.col(c), none) != F.col(c)), f"rubric round-trip mismatch: {c}")]
    issues = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), m) for c, m in found]))
    has_gold = F.size(E.bold(*[F.col(c) for c in gold])) > 0 if gold else F.lit(False)
    return rows.withColumns({"issues": issues, "distinctions": F.when(en.isNotNull(), T.distinctions(en["body"])), "has_gold": has_gold})


def audit_counts(audited: DataFrame) -> DataFrame:
    """One row: rows, problems, rows with a gold value."""
    return audited.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("issues")), F.lit(0)).alias("problems"), F.count_if("has_gold").alias("with_gold"))


def neutralise(rows: DataFrame, prompt: str, prompt_ru: str) -> DataFrame:
    """Prompts without labels, ``state`` (unparsed, neutral, changed) and ``residual``: whether a changed prompt still has a giveaway word.

    A row is changed only where both languages have a boundary sentence. Write only where no row has a residual.
    """
    parsed = E.sentence_en(F.col(prompt)).isNotNull() & E.sentence_ru(F.col(prompt_ru)).isNotNull()
    new = {c: F.when(parsed, f(F.col(c))).otherwise(F.col(c)) for c, f in ((prompt, E.neutral_en), (prompt_ru, E.neutral_ru))}
    out = rows.withColumns({"_" + c: n for c, n in new.items()})
    changed = {c: ~F.col("_" + c).eqNullSafe(F.col(c)) for c in new}
    left = lambda c, words: changed[c] & E.any_of(*[F.lower("_" + c).contains(w) for w in words])
    state = F.when(~parsed, "unparsed").when(changed[prompt] | changed[prompt_ru], "changed").otherwise("neutral")
    out = out.withColumns({"state": state, "residual": F.coalesce(left(prompt, GATE_EN) | left(prompt_ru, GATE_RU), F.lit(False))})
    return out.withColumns({c: F.col("_" + c) for c in new}).drop(*["_" + c for c in new])


def strip_scope(rows: DataFrame, *columns: str) -> DataFrame:
    """The columns without the first sentence that names the scope, ``changed``, and ``residual``: whether the name is left anywhere."""
    new = {c: E.drop_scope(_text(c)) for c in columns}
    out = rows.withColumns({"_" + c: n for c, n in new.items()})
    out = out.withColumns({"changed": E.any_of(*[F.col("_" + c) != _text(c) for c in columns]), "residual": E.any_of(*[F.col("_" + c).contains("source_scope") for c in columns])})
    return out.withColumns({c: F.col("_" + c) for c in columns}).drop(*["_" + c for c in columns])


def gate(rows: DataFrame, flag: str = "residual") -> DataFrame:
    """``rows``, or an error where any row has the flag."""
    if not rows.filter(flag).isEmpty():
        raise ValueError(f"{flag} rows are left: nothing may be written")
    return rows


def reconcile(rebuilt: DataFrame, stored: DataFrame, key: str, text: str, sent: str) -> DataFrame:
    """``rebuilt`` rows with ``state``: matched (stripped texts are equal), mismatched, or absent from the stored ones. Keys compare without "batch"."""
    other = stored.select(F.replace(F.col(key), F.lit("batch"), F.lit("")).alias("_key"), T.strip(_text(sent)).alias("_sent"))
    joined = rebuilt.join(other, F.replace(rebuilt[key], F.lit("batch"), F.lit("")) == F.col("_key"), "left")
    state = F.when(F.col("_key").isNull(), "absent").when(F.col("_sent") == T.strip(F.coalesce(rebuilt[text], F.lit(""))), "matched").otherwise("mismatched")
    return joined.withColumn("state", state).drop("_key", "_sent")


# --- edited tables --------------------------------------------------------------------------------------


def verify(before: DataFrame, after: DataFrame, key: str, identity: str, columns: list[str]) -> DataFrame:
    """Problems of an edited table, one a row: ``key``, ``problem``. An edited table without any may be published.

    Rows that only one side has; rows of another identity; changes outside ``EDITABLE`` and their twins; changed rows whose boundary
    sentences or rubrics no longer parse, and changed dimensions that disagree with the rubric cell.
    """
    allowed = {*EDITABLE, *[c + "_ru" for c in EDITABLE]}
    side = lambda df, p: df.select(F.col(key).alias(p + "key"), F.col(identity).alias(p + "id"), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(p + c) for c in columns])
    both = side(before, "b_").join(side(after, "a_"), F.col("b_key") == F.col("a_key"), "full_outer")
    changed = lambda c: F.col(f"`b_{c}`") != F.col(f"`a_{c}`")
    any_changed = E.any_of(*[changed(c) for c in columns])
    found = [F.when(F.col("b_key").isNull() | F.col("a_key").isNull(), "row count changed"), F.when(F.col("b_id") != F.col("a_id"), _say("row identity changed ", F.col("b_id"), " -> ", F.col("a_id")))]
    found += [F.when(changed(c), f"column outside the allowed set: {c}") for c in columns if c not in allowed]
    for end, sentence, name in (("", E.sentence_en, "EN"), ("_ru", E.sentence_ru, "RU")):
        if "final_prompt_text" + end in columns:
            found.append(F.when(any_changed & sentence(F.col("a_final_prompt_text" + end)).isNull(), f"{name} trap no longer parses"))
        cell = "fixed_criteria_0_2_each" + end
        if cell in columns:
            bodies = E.rubric_bodies(F.col("a_" + cell))
            found.append(F.when(any_changed & bodies.isNull(), f"rubric{end} unparseable"))
            for d in E.DIMENSIONS:
                if d + end in columns:
                    new = T.flatten(F.col("a_" + d + end))
                    found.append(F.when(changed(d + end) & bodies.isNotNull() & (new != "") & (new != T.flatten(F.try_element_at(bodies, F.lit(d)))), f"{d}{end} disagrees with fixed_criteria"))
    return both.select(F.coalesce("b_key", "a_key").alias(key), F.explode(F.array_compact(F.array(*found))).alias("problem"))
