import pytest
from pyspark.sql import functions as F

from granary.functions import pages as P
from granary.functions import structure as S
from granary.functions import text as T


def _all(spark, values, f, kind="string"):
    return [r.x for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}").select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


ODD = ["", " a ", "\t a\u00a0b \u2003", "a\n", "\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i\u2028j\u2029k", "\x1f x \x1c", "a  b\u3000\u3000c", "x\n\n"]


def test_white_space_is_pythons(spark):
    import re

    assert _all(spark, ODD, T.strip) == [x.strip() for x in ODD]
    assert _all(spark, ODD, T.splitlines) == [x.splitlines() for x in ODD]
    assert _all(spark, ODD, T.flatten) == [re.sub(r"\s+", " ", x).strip() for x in ODD]
    assert _all(spark, ODD, T.n_words) == [len(x.split()) for x in ODD]
    assert _all(spark, ODD, T.wide_gaps) == [len(re.findall(r"\s{2,}", x)) for x in ODD]
    assert _all(spark, ["\ufeffa\u00adb \t\u00a0 c ", "\u2003x"], T.squeeze) == ["ab c", "x"]
    assert _all(spark, [None], T.strip) == [None] and _all(spark, [None], T.splitlines) == [None]


def test_upper_is_pythons(spark):
    words = ["ABC", "A1", "1", "", "AbC", "ÀÉ", "ß", "Ж", "日本", "A\u00aa"]
    assert _all(spark, words[:-1], T.is_upper) == [x.isupper() for x in words[:-1]]


def test_heading_levels(spark):
    cases = {"1. Intro": 2, "2.3. x": 3, "1.2.3. x": 4, "1.2.3.4.5. x": 4, "1.Intro": 0, "ABC": 2, "AB": 0, "A": 0, "ABCDe fg": 0, "ABCDEFGHi": 2, "Plain:": 3, "x" * 100 + ":": 0, "A " * 13: 0, "É" * 3: 2, "12": 0, "": 0, "- A": 2}
    assert _all(spark, cases, T.heading_level) == list(cases.values())
    assert _all(spark, ["AbCD", "ABCDe", "x:", "1", "A" * 121], T.looks_like_heading) == [False, True, True, False, False]


def test_page_noise(spark):
    cases = {"Page 3 of 10": True, " - 12 - ": True, "-- 4 of 20 --": True, "[ page 7 ]": True, "12 | Title": True, "Title | 9": True, "12345": False, "x 12": False, "": False, "  ": False, "| 1 | x": True, "page": False, "12 | " + "x" * 180: False, "١٢": True}
    assert _all(spark, cases, T.is_page_noise) == list(cases.values())


def test_truncation_and_names(spark):
    long = "a" * 10_000 + "b" * 1_234 + "c" * 5_000
    assert _all(spark, [long, "a" * 15_000], T.head_tail) == ["a" * 10_000 + "\n\n[... 1,234 chars omitted ...]\n\n" + "c" * 5_000, "a" * 15_000]
    assert _all(spark, ["SET009_foo bar.htm", ".hidden", "a.b.c"], T.stem) == ["SET009_foo_bar", "hidden", "a_b"]
    assert _all(spark, ["Foo Bar!", "!!", "x" * 90], T.slug) == ["Foo_Bar", "untitled", "x" * 80]
    assert _all(spark, ["coverage: 2\nCoverage (0-2): 1", " Coverage: 1", "x\n Coverage: 1", "Coverage: 21", "Coverage: none\ncoverage 0"], lambda c: T.judge_score(c, "Coverage")) == [0, 1, None, None, 0]


def test_strip_sentence_equals_the_pattern(spark):
    import random
    import re

    rng = random.Random(4)
    texts = ["".join(rng.choice(["licen", ".", " ", "a", "\n", "b c"]) for _ in range(rng.randint(0, 14))) for _ in range(400)]

    def by_pattern(t):
        m = re.search(r"[^.\s][^.]*licen[^.]*\.\s*", t)
        return t if not m else (t[: m.start()] + t[m.end() :]).strip()

    assert _all(spark, texts, lambda c: T.drop_first_sentence(c, "licen")) == [by_pattern(t) for t in texts]


def test_tables(spark):
    one = lambda f, lines: spark.createDataFrame([(lines,)], "l array<string>").select(f(F.col("l"))).first()[0]
    assert one(S.lines_table, ["a\tb", "c|d\te\tf"]) == "| a | b |  |\n| --- | --- | --- |\n| c\\|d | e | f |"
    assert one(S.lines_table, ["x | y | z", "no cells"]) == "| x | y | z |\n| --- | --- | --- |\n| no cells |  |  |"
    assert one(S.lines_table, ["only | one | row"]) == "only | one | row"
    for lines, want in ((["a|b|c", "d|e|f"], True), (["a|b|c"], False), (["a  b  c", "d  e  f", "g", "h"], True), (["a  b  c", "d", "e", "f", "g  h  i", "j"], False), (["a\tb", "c"], False)):
        assert one(S.is_table, lines) is want, lines
    rows = spark.createDataFrame([([["a", "b|"], [], ["c"]],), ([["x", "y"]],), ([],)], "r array<array<string>>")
    assert [r[0] for r in rows.select(S.cells_table(F.col("r"))).collect()] == ["| a | b\\| |\n| --- | --- |\n| c |  |", "x | y", ""]


def test_markdown_and_cleaning_are_stable(spark):
    text = "INTRODUCTION TO IT\n\nfirst line of a long paragraph that goes on for more than eighty characters in all\nsecond line\n\na | b | c\nd | e | f\n\nPage 3 of 9\n"
    md = "# T\n\n## INTRODUCTION TO IT\n\nfirst line of a long paragraph that goes on for more than eighty characters in all second line\n\n| a | b | c |\n| --- | --- | --- |\n| d | e | f |"
    rows = spark.createDataFrame([(text,)], "t string")
    cleaned = S.clean_ns(F.col("t"), F.lit(False))
    assert rows.select(S.markdown(cleaned["lines"], F.lit("T"))).first()[0] == md
    assert rows.select(cleaned["notes"]).first()[0] == ["Removed 1 page-number or footer markers."]
    once = rows.select(S.clean_bc(F.col("t")).alias("t"))
    assert once.select(S.clean_bc(F.col("t"))).first()[0] == once.first().t
    assert rows.select(S.clean_ns(F.lit(None).cast("string"), F.lit(True))["lines"], S.clean_bc(F.lit(None).cast("string")), S.markdown(F.array().cast("array<string>"), F.lit(None))).first()[2] == "# Untitled Source"


def test_pages(spark):
    html = """<html><head><title>T</title></head><body><header>no</header><h1>One</h1><div class="hatnote">no</div><p>First <b>para</b><sup class="reference">[1]</sup>graph<p>x</p>
    <table class="wikitable"><tr><th>A<th>B<tr><td>1<td>2</table><ul><li>item one<li>item two</ul><div id="toc"><p>contents</p></div><footer><p>end of it</p></footer></body></html>"""
    assert P._visible(html) == "\nOne\nFirst para graph\n\nA | B\n1 | 2\nitem one\nitem two"
    assert P._visible("<p>" * 3000 + "deep") == "deep" and P._visible(None) == "" and P._visible("no tags") == "no tags"
    rows = spark.createDataFrame([(html, "a.htm"), (None, "SET1_b.htm")], "h string, f string")
    got = [r.p for r in rows.select(P.structured(F.col("h"), F.col("f")).alias("p")).collect()]
    assert got[0].page_title == "One" and got[0].table_rows == [] and got[1].page_title == "SET1_b" and got[1].links == []


def test_only_closed_references_are_read(spark, same, tmp_path):
    from granary.plans import catalogue
    from granary.sources import formats

    odd = ["a &amp", "b&&am", "c &quot &lt;x&gt; &amp;amp;", "d &ampx; &notit; &;", "e &#39;x&#39; &#39 f", "g &copy=1 & h &amp;lt i", "&amp", "&"]
    rows = [(k, f"<html><head><title>{x}</title><style>p&amp{{}}</style></head><body><nav>n&amp</nav><h1>{x}</h1><p>{x}<b>{x}</b></p><ul><li>{x}</li></ul></body></html>") for k, x in enumerate(odd)]
    at = f"{tmp_path}/pages.parquet"
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(at)
    for name in ("html_visible_blocks", "html_visible_text"):
        same(catalogue.QUERIES[name](spark, str(tmp_path)), catalogue.ORACLE_SQL[name].replace("FROM pages", f"FROM '{at}/*.parquet'"))
    assert P._visible("<h1>a &amp</h1><p>&eacute;t&#xe9;&eacute &#65") == "\na &amp\nété&eacute &#65"
    link = P.tree('<a href="?x=1&amp;y=2&copy=3" title>l</a>').children[0]
    assert link.attributes == {"href": "?x=1&y=2&copy=3", "title": None}
    assert formats.html_text(b"<p>a &amp</p><script>&amp</script>&amp; b &#39;c") == "a &amp\n& b 'c"


def test_entities_by_caption(spark):
    row = lambda label, caption, cells: (label, cells, 0, 0, caption, "wikitable_row", None, None, None)
    link = lambda label, url: (label, None, None, None, None, "wiki_link", url, False, None)
    entities = [row("a", "", ["a", "1"]), row("b", "C", ["b", "2"]), row("c", None, ["c"]), row("d", "C", ["d"]), row("e", "D", ["e", "5"]), link("x|y", "u"), link("z", ""), link("", "v")]
    df = spark.createDataFrame([(entities,), ([],), (None,)], f"e array<{P.ENTITY}>")
    md, lines = zip(*df.select(S.entities_markdown(F.col("e")), S.entities_lines(F.col("e"))).collect())
    assert md[0] == "a | 1\n\n### C\n\n| b | 2 |\n| --- | --- |\n| c |  |\n| d |  |\n\n### D\n\ne | 5\n\n### Linked items\n\n- x\\|y (u)"
    assert lines[0] == "a | 1\n\nTable: C\nb | 2\nc\nd\n\nTable: D\ne | 5\nx\\|y | wiki_link | u\nz | wiki_link\n | wiki_link | v"
    assert md[1:] == ("", "") and lines[1:] == ("", "")


def test_unknown_prompt_field():
    from granary.operators import tasks

    with pytest.raises(ValueError):
        tasks.prompt_for("other")
    with pytest.raises(ValueError, match="boundary_notes"):
        tasks.require([c for c in tasks.REQUIRED_COLUMNS if c != "boundary_notes"])
    tasks.require([*tasks.REQUIRED_COLUMNS, "more"])
