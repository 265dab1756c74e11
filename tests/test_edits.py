import pytest
from pyspark.sql import functions as F

from granary.functions import edits as E
from granary.functions import text as T
from granary.operators import updates, validation

CELL = "".join(f"**Head {k}**\n- 2: x **gold {k}** y\n- 1: z\n- 0: w\n\n" for k in range(5))
FLAT = "pre " + " ".join(f"**Заголовок {k}** - 2: x **0,29** - 1: z - 0: w" for k in range(5))
BODY = "- 2: new **gold 1**\n- 1: b\n- 0: c"
PROMPT = "Find x. Methodological trap: distinguish stocks from flows. Return: list"
PROMPT_RU = "Найдите. Методологическая ловушка: различайте запасы и потоки. Результат: список"


def test_rubric_round_trip(spark):
    df = spark.createDataFrame([(CELL,), (FLAT,), ("none",), ("",), (None,)], "c string")
    none = F.create_map().cast("map<string,string>")
    rows = df.select("c", E.compose(F.col("c"), none).alias("again"), E.rubric(F.col("c")).alias("r")).collect()
    assert [r.again == r.c for r in rows[:2]] == [True, True] and [r.again for r in rows[2:]] == [None] * 3
    assert [b.header for b in rows[1].r.blocks] == [f"Заголовок {k}" for k in range(5)] and rows[1].r.prefix == "pre "
    assert rows[2].r.prefix == "none" and rows[2].r.blocks == []
    new = F.create_map(F.lit("accuracy"), F.lit(BODY))
    out = [r.o for r in df.limit(2).select(E.compose(F.col("c"), new).alias("o")).collect()]
    assert BODY in out[0] and out[0].count("- 2:") == 5 and BODY.replace("\n", " ") in out[1] and "\n" not in out[1]


def test_sentences(spark):
    rows = spark.createDataFrame([(PROMPT, PROMPT_RU), ("A. Distinguish a and b.", "А. Различайте а и б. Ещё."), ("no", "нет"), (None, None)], "p string, r string")
    out = rows.select(E.sentence_en(F.col("p")).alias("e"), E.sentence_ru(F.col("r")).alias("r"), E.neutral_en(F.col("p")).alias("n"), E.neutral_ru(F.col("r")).alias("m")).collect()
    assert out[0].e.sentence == "Methodological trap: distinguish stocks from flows." and out[0].e.body == "distinguish stocks from flows."
    assert out[0].r.sentence == "Методологическая ловушка: различайте запасы и потоки." and out[0].r.body == "различайте запасы и потоки."
    assert out[0].n == "Find x. Distinguish stocks from flows. Return: list" and out[0].m == "Найдите. Различайте запасы и потоки. Результат: список"
    assert out[1].e.sentence == "Distinguish a and b." and out[1].r.sentence == "Различайте а и б."
    assert out[2].e is None and out[2].r is None and (out[2].n, out[2].m) == ("no", "нет") and out[3].n is None


def test_gates(spark):
    rows = spark.createDataFrame([(PROMPT, PROMPT_RU), (PROMPT.replace("Find x", "A trick"), PROMPT_RU), ("Find a trick. Distinguish a and b.", "Различайте а и б."), ("It is a trick.", "нет")], "p string, r string")
    once = validation.neutralise(rows, "p", "r")
    assert [(r.state, r.residual) for r in once.collect()] == [("changed", False), ("changed", True), ("neutral", False), ("unparsed", False)]
    again = validation.neutralise(once.drop("residual", "state"), "p", "r")
    assert [(r.p, r.r) for r in again.collect()] == [(r.p, r.r) for r in once.collect()]
    with pytest.raises(ValueError):
        validation.gate(once)
    assert validation.gate(once.filter("not residual")).count() == 3
    texts = ["A. Use `source_scope` only. B.", "x source_scope a. y source_scope b.", "plain", "source_scope at the start. Then use source_scope here.\n\nEnd", "  kept\n\n see source_scope.  tail ", "no stop source_scope", "x.source_scope y source_scope z.w"]
    rows = spark.createDataFrame([(t,) for t in texts], "p string")
    import re

    def by_pattern(t):
        m = re.search(T.SCOPE, t)
        return t if not m else (t[: m.start()] + t[m.end() :]).strip()

    got = validation.strip_scope(rows, "p").collect()
    assert [r.p for r in got] == [by_pattern(t) for t in texts]
    assert [(r.changed, r.residual) for r in got] == [(by_pattern(t) != t, "source_scope" in by_pattern(t)) for t in texts]


def test_quoting(spark):
    texts = ["plain", "it's", 'both \' and "', "a\\b\nc\td", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.q for r in rows.select(E.quoted(F.col("t")).alias("q")).collect()] == [repr(t) for t in texts]
    assert rows.agg(E.listed(F.array(F.lit("a"), F.lit("b"))).alias("l")).first().l == "['a', 'b']"


def test_must_have(spark):
    rows = spark.createDataFrame([("a b", "b", "x")], "t string, o string, n string")
    assert rows.select(T.must_splice(F.col("t"), F.col("o"), F.col("n")).alias("x")).first().x == "a x"
    with pytest.raises(Exception, match="not found in prompt"):
        rows.select(T.must_splice(F.col("t"), F.lit("z"), F.col("n"))).collect()
    assert spark.createDataFrame([(CELL,)], "c string").select(E.must_have_bodies(F.col("c"))["coverage"]).first()[0].startswith("- 2: x **gold 0**")
    with pytest.raises(Exception, match="expected 5 rubric blocks, found 0"):
        rows.select(E.must_have_bodies(F.col("t"))).collect()


def test_updates(spark):
    fields = ["new_trap_sentence", "internal_source_boundary_rule", "boundary_notes"]
    lists = ["new_common_failure_modes", "new_borderline_cases", "optional_distractors"]
    struct = lambda e: "struct<" + ",".join([f"{n}{e}:string" for n in fields] + [f"{n}{e}:array<string>" for n in lists] + [f"rubric_updates{e}:map<string,string>"]) + ">"
    columns = ["final_prompt_text", "internal_source_boundary", "common_failure_modes", "borderline_cases", "fixed_criteria_0_2_each"]
    schema = ", ".join(f"{c}{e} string" for e in ("", "_ru") for c in columns) + f", edit {struct('')}, translation {struct('_ru')}"
    edit = ("Distinguish a from b. ", " rule ", "Exclude answers that x. ", ["m"], None, ["d"], {"accuracy": BODY, "coverage": BODY})
    twin = ("Различайте\nа и б.", "правило", "Исключайте\nэто.", ["м"], None, ["д"], {"accuracy": BODY})
    row = (PROMPT, "- old", "", "kept", CELL, PROMPT_RU, "", "", "", FLAT, edit, twin)
    got, bare = [r.updates for r in updates.build(spark.createDataFrame([row, ("no", *row[1:])], schema)).collect()]
    assert bare is None
    assert got["final_prompt_text"] == "Find x. Distinguish a from b. Return: list" and got["final_prompt_text_ru"] == "Найдите. Различайте а и б. Результат: список".replace("потоки. ", "")
    assert got["internal_source_boundary"] == "- old\n- boundary rule: rule" and got["common_failure_modes"] == "- m" and got["borderline_cases"] == "kept"
    assert got["optional_distractors_ru"] == "- д" and got["boundary_notes_ru"] == "Исключайте это."
    assert got["accuracy"] == BODY and got["accuracy_ru"] == BODY.replace("\n", " ") and "coverage" not in got
    assert BODY in got["fixed_criteria_0_2_each"] and got["fixed_criteria_0_2_each_ru"].startswith("pre **Заголовок 0** - 2: x")
