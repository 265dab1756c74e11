"""Queries over lines and blocks of all documents, with texts of the shapes that the tables lack added on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import structure as S
from ..functions import text as T
from ..operators import lines
from ..sources.tables import spread, table
from .base import SPACE, WORD, flatten, heading, isupper, local, page_noise, query, quoted, splitlines, squeeze, strip, values

_PAGE = "Page 3 of 10\n-- 4 of 20 --\n[ page 7 ]\n12 | Title\n1234\nplain line\nTitle | 9\n\n12345\n – 17 – \nPAGE 9/10\n12 | " + "x" * 190
_REPEATS = "© 2020 Owner\nFirst.\n" * 5 + "RUNNING HEAD\nmore text\n" * 10 + "ISBN 1\n" * 4 + "Upper Lower\n" * 12 + "www.example.org x\n" * 5 + "BC HEAD\n" * 8
_HEADS = "1. Intro\n\n2.3. Deep part\nwith a text that goes on\nfor two lines\n\n1.2.3.4. Deepest\n\nALL CAPITALS HERE\n\nA\n\nOK\n\nAbc Def:\n\nPlain text\n\nTHIRTEEN WORDS IN CAPITALS ARE TOO MANY FOR A HEADING OF THIS SHORT RULE AND MORE\n\n12 345\n\n" + "X" * 101
_TABLES = "a | b | c\nd | e\nf | g | h\n\n| one |\n\n- item one\n- item two\n* three\n\n• bullet\n\n" + ("long " * 30 + "\n") * 2 + "\nshort one\nshort two\n\nHEADING OF IT\nrest of it\nand more"
_WIDE = "h1\th2\th3\n1\t2\n\nname   value   unit\nx   1   kg\ny   2   m\n\nonly   one   row"
_FRONT = "Some book\nAll Rights Reserved by us\nand more\n\nForeword\nThe text.\n\n1. First\nx"
_CHAPTER = "Creative Commons\nx\nChapter 1 is here\ny"
_LATE = "x" * 4100 + "\nunless otherwise noted\nIntroduction\ny"
_WIKI = "Jump to content\nMain menu\nToggle the table of contents\nedit\nBody of it\nRetrieved from \"x\"\nsee the rest\nSee also\nlinks\nCategory: y"
_FILES = "before\n===== FILE: a.txt =====\nline 1\nline 2\n===== FILE:  b c.pdf  =====\n===== FILE: d =====\n\nlast\n"
_ODD = "﻿soft­hyphen and no-break\t tabs  \r\nword-\nbreak and co-\r\noperate\r\r\n\n\n  \n wide \x0bnext\x0cform sep\x1dgroup\n done\n and\n pipe"
_FRAGMENTS = "===== FRAGMENT: one.txt =====\n===== FRAGMENT: two =====\ntext of two\n\n===== fragment: alone =====\n\nend\n===== FRAGMENT: inside ====="
EXTRA = [(-k, x) for k, x in enumerate([_PAGE, _REPEATS, _HEADS, _TABLES, _WIDE, _FRONT, _CHAPTER, _LATE, _WIKI, _FILES, _ODD, _FRAGMENTS, "", " \n\t\n", "one line", "===== FILE: only =====", "x\n" * 40 + "OECD report of it - Wikipedia\nSurvey on Drivers"], 1)]
_EXTRA = f"({values(EXTRA)})"
_DOCS = f"docs AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM {_EXTRA} AS e(doc_id, text))"


def _docs(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).unionAll(local(spark, EXTRA, "doc_id long, text string"))


def _numbered(ls: str, of: str = "docs") -> str:
    return f"SELECT doc_id, unnest({ls}) AS line, unnest(range(len({ls}))) AS pos FROM {of}"


# --- single lines -----------------------------------------------------------------------------------


@query(f"WITH {_DOCS} SELECT doc_id, {flatten('text')} AS text, lower({flatten('text')}) AS norm FROM docs")
def flatten_norm(spark, d):
    flat = T.flatten(F.col("text"))
    return _docs(spark, d).select("doc_id", flat.alias("text"), F.lower(flat).alias("norm"))


@query(rf"""WITH {_DOCS}, a AS (SELECT doc_id, replace(replace(replace(text, chr(61692), '-'), chr(61623), '-'), chr(61564), '|') AS text FROM docs), l AS ({_numbered(splitlines('text'), 'a')}), n AS ({_numbered(splitlines('text'))})
SELECT d.doc_id, coalesce(b.text, '') AS spaced, coalesce(c.text, '') AS squeezed FROM docs d
LEFT JOIN (SELECT doc_id, string_agg({strip(rf"regexp_replace(line, '[ \t\x{{a0}}]+', ' ', 'g')")}, chr(10) ORDER BY pos) AS text FROM l GROUP BY doc_id) b USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg({squeeze('line')}, chr(10) ORDER BY pos) AS text FROM n GROUP BY doc_id) c USING (doc_id)""")
def line_clean(spark, d):
    """Both ways of cleaning a line, over all lines."""
    squeezed = F.array_join(F.transform(T.splitlines(F.col("text")), T.squeeze), "\n")
    return _docs(spark, d).select("doc_id", T.spaces(F.col("text")).alias("spaced"), squeezed.alias("squeezed"))


_JOINED = rf"regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '({WORD})-\n({WORD})', '\1\2', 'g')"


@query(f"WITH {_DOCS} SELECT doc_id, {_JOINED} AS text FROM docs")
def hyphen_repair(spark, d):
    return _docs(spark, d).select("doc_id", T.join_hyphens(F.col("text")).alias("text"))


@query(f"WITH {_DOCS}, l AS ({_numbered(splitlines('text'))}) SELECT doc_id, pos::INT AS pos, line FROM l WHERE {page_noise(strip('line'))}")
def page_noise_filter(spark, d):
    """Page numbers and footers among all lines of all documents."""
    return lines.numbered(_docs(spark, d), "doc_id", T.splitlines(F.col("text"))).filter(T.is_page_noise(F.col("line")))


_NAV = ", ".join(map(quoted, S.NAVIGATION))


@query(f"""WITH {_DOCS}, l AS ({_numbered(splitlines('text'))} UNION ALL SELECT page_id + 1000000, unnest(a), unnest(range(len(a))) FROM (SELECT page_id, regexp_extract_all(html, '<a[^>]*>([^<]*)</a>', 1) AS a FROM pages)), s AS (SELECT doc_id, pos, {strip('line')} AS line FROM l)
SELECT doc_id, pos::INT AS pos, line FROM s WHERE line <> '' AND length(line) <= 80 AND (lower(line) IN ({_NAV}) OR (starts_with(lower(line), 'toggle ') AND contains(lower(line), 'contents')) OR regexp_matches(lower(line), '^(edit|talk|read|view|hide|show)$'))""")
def nav_line_filter(spark, d):
    """Lines of a wiki page's frame among the lines of documents and the link texts of pages."""
    links = table(spark, d, "pages").select((F.col("page_id") + 1_000_000).alias("doc_id"), F.posexplode(F.regexp_extract_all("html", F.lit("<a[^>]*>([^<]*)</a>"), F.lit(1))).alias("pos", "line"))
    rows = lines.numbered(_docs(spark, d), "doc_id", T.splitlines(F.col("text"))).unionByName(links)
    return rows.withColumn("line", T.strip(F.col("line"))).filter(S.is_navigation(F.col("line")))


@query(f"WITH {_DOCS}, l AS ({_numbered(splitlines('text'))}) SELECT doc_id, level, count(*) AS n, count(*) FILTER (length(line) <= 120 AND (right(line, 1) = ':' OR coalesce(length(regexp_replace(line, '\\P{{Lu}}', '', 'g')) / nullif(length(regexp_replace(line, '\\P{{L}}', '', 'g')), 0) > 0.75, false))) AS headings FROM (SELECT doc_id, line, {heading('line')} AS level FROM l) GROUP BY ALL")
def heading_level(spark, d):
    """Lines of all documents by the level of heading that they look like, and how many look like one to the corpus profile."""
    rows = lines.numbered(_docs(spark, d), "doc_id", T.splitlines(F.col("text"))).withColumn("level", T.heading_level(F.col("line")))
    return rows.groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("n"), F.count_if(T.looks_like_heading(F.col("line"))).alias("headings"))


@query(f"WITH {_DOCS} SELECT doc_id, len(list_filter({splitlines('text')}, lambda x: {isupper('x')})) AS n FROM docs")
def upper_lines(spark, d):
    return _docs(spark, d).select("doc_id", F.size(F.filter(T.splitlines(F.col("text")), T.is_upper)).cast("long").alias("n"))


# --- repeated lines and blank runs --------------------------------------------------------------------


def _noise(p: S.Profile) -> str:
    marked = " OR ".join(f"contains(lower(line), {quoted(m)})" for m in p.markers)
    return f"(n >= {p.marked} AND length(line) <= {p.marked_length} AND ({marked})) OR (n >= {p.capital} AND length(line) <= {p.capital_length} AND {isupper('line')})"


_COUNTED = f"c AS (SELECT doc_id, {strip('line')} AS line, count(*) AS n FROM ({_numbered(splitlines('text'))}) WHERE {strip('line')} <> '' GROUP BY 1, 2)"


@query(f"WITH {_DOCS}, {_COUNTED} SELECT doc_id, line, 'ns' AS profile FROM c WHERE {_noise(S.NS)} UNION ALL SELECT doc_id, line, 'bc' FROM c WHERE {_noise(S.BC)} UNION ALL SELECT doc_id, line, 'plain' FROM c WHERE n >= 5")
def repeated_noise_lines(spark, d):
    """Lines that a document repeats: by both profiles, and (as no table has markers) any five times or more."""
    plain = S.Profile(("",), 5, 1 << 30, 1 << 30, 0)
    own = lambda p: F.explode(S.repeated_noise(T.splitlines(F.col("text")), p)).alias("line")
    parts = [_docs(spark, d).select("doc_id", own(p), F.lit(name).alias("profile")) for name, p in (("ns", S.NS), ("bc", S.BC), ("plain", plain))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


_SHORT = 20


def _runs(first: str) -> str:
    return f"""l AS ({_numbered(splitlines('text'))}), g AS (SELECT *, length(line) < {_SHORT} AS blank, coalesce(lag(length(line) < {_SHORT}) OVER (PARTITION BY doc_id ORDER BY pos), {first}) AS was FROM l)"""


@query(f"WITH {_DOCS}, {_runs('false')} SELECT d.doc_id, coalesce(t, '') AS text FROM docs d LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT (blank AND was)) AS t FROM g GROUP BY doc_id) USING (doc_id)")
def collapse_blank_runs(spark, d):
    """Runs of blank lines as one; lines of under 20 characters stand for blank ones, which the tables lack."""
    kept = T.bind(T.splitlines(F.col("text")), lambda x: S.collapse(x, lambda y: F.length(y) < _SHORT))
    return _docs(spark, d).select("doc_id", F.array_join(kept, "\n").alias("text"))


@query(f"WITH {_DOCS}, {_runs('true')} SELECT d.doc_id, coalesce(n, 0)::INT AS blocks FROM docs d LEFT JOIN (SELECT doc_id, count(*) FILTER (NOT blank AND was) AS n FROM g GROUP BY doc_id) USING (doc_id)")
def block_segmentation(spark, d):
    short = F.transform(T.splitlines(F.col("text")), lambda x: F.when(F.length(x) < _SHORT, "").otherwise(x))
    return _docs(spark, d).select("doc_id", F.size(T.bind(short, S.blocks)).alias("blocks"))


def _cut_at(test: str, keep: str) -> str:
    return f"""WITH {_DOCS}, l AS (SELECT doc_id, {splitlines('text')} AS ls FROM docs), s AS (SELECT doc_id, ls, coalesce(list_position(list_transform(ls, lambda x: {test}), true), 0) AS cut FROM l) SELECT doc_id, array_to_string({keep}, chr(10)) AS text FROM s"""


@query(_cut_at(f"lower({squeeze('x')}) IN ({', '.join(map(quoted, S.STOP_HEADINGS))}) OR starts_with(lower({squeeze('x')}), 'category:') OR regexp_matches(lower(x), 'licen[cs]e')", "CASE WHEN cut = 0 THEN ls ELSE ls[1:cut - 1] END"))
def trim_at_stop_heading(spark, d):
    """Lines before the first closing section, or (the tables have none) before the first line about a licence."""
    kept = S.until(S.trim_tail(T.splitlines(F.col("text"))), lambda x: F.lower(x).rlike("licen[cs]e"))
    return _docs(spark, d).select("doc_id", F.array_join(kept, "\n").alias("text"))


_MARKED = " OR ".join(f"contains(lower(array_to_string(ls, chr(10)))[1:4000], {quoted(m)})" for m in S.LICENSE_MARKERS)


@query(_cut_at(f"lower({squeeze('x')}) IN ({', '.join(map(quoted, S.LICENSE_ENDS))}) OR regexp_matches({squeeze('x')}, '^\\d+(\\.\\d+)*\\.\\s+.+$') OR regexp_matches(lower({squeeze('x')}), '^chapter\\s+\\d')", f"CASE WHEN cut > 0 AND ({_MARKED}) THEN ls[cut:] ELSE ls END"))
def strip_license_prefix(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(S.strip_license(T.splitlines(F.col("text"))), "\n").alias("text"))


# --- profiles -----------------------------------------------------------------------------------------

_NS = rf"""l AS (SELECT doc_id, {squeeze('line')} AS line, pos FROM ({_numbered(splitlines(_JOINED))})),
n AS (SELECT doc_id, line FROM (SELECT doc_id, line, count(*) AS n FROM l WHERE line <> '' GROUP BY 1, 2) WHERE {_noise(S.NS)}),
f AS (SELECT l.*, doc_id % 2 = 0 AS is_set, n.line IS NOT NULL AS again, {page_noise('l.line')} AS page, l.line <> '' AND length(l.line) <= 80 AND (lower(l.line) IN ({_NAV}) OR (starts_with(lower(l.line), 'toggle ') AND contains(lower(l.line), 'contents'))) AS nav FROM l LEFT JOIN n USING (doc_id, line)),
k AS (SELECT doc_id, line, pos FROM f WHERE line = '' OR NOT (again OR page OR (is_set AND (nav OR starts_with(lower(line), 'retrieved from '))))),
g AS (SELECT *, coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY pos), 'x') AS was FROM k),
kept AS (SELECT doc_id, line, pos FROM g WHERE line <> '' OR was <> ''),
counts AS (SELECT doc_id, count(DISTINCT line) FILTER (again) AS repeats, count(*) FILTER (page AND NOT again) AS pages, count(*) FILTER (nav AND is_set AND NOT page AND NOT again) AS navs FROM f GROUP BY doc_id)"""


@query(rf"""WITH {_DOCS}, {_NS}
SELECT d.doc_id, coalesce(t.text, '') AS text, list_filter([CASE WHEN regexp_matches(d.text, '{WORD}-\n{WORD}') THEN 'Merged hyphenation line-break artifacts.' END,
CASE WHEN repeats > 0 THEN 'Removed ' || repeats || ' repeated footer/copyright/header lines.' END, CASE WHEN pages > 0 THEN 'Removed ' || pages || ' page-number or footer markers.' END,
CASE WHEN navs > 0 THEN 'Removed ' || navs || ' navigation/UI lines (Set/HTML sources).' END], lambda x: x IS NOT NULL) AS notes
FROM docs d LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM kept GROUP BY doc_id) t USING (doc_id) LEFT JOIN counts USING (doc_id)""")
def clean_document_ns(spark, d):
    """The packet profile; documents of an even id as sets."""
    made = S.clean_ns(F.col("text"), F.col("doc_id") % 2 == 0)
    return _docs(spark, d).select("doc_id", made.alias("c")).select("doc_id", F.array_join("c.lines", "\n").alias("text"), "c.notes")


_SPACED = "replace(replace(replace(text, chr(61692), '-'), chr(61623), '-'), chr(61564), '|')"
_LOOKS = rf"length(x) <= 120 AND (right(x, 1) = ':' OR coalesce(length(regexp_replace(x, '\P{{Lu}}', '', 'g')) / nullif(length(regexp_replace(x, '\P{{L}}', '', 'g')), 0) > 0.75, false))"
_GAPS = lambda x: f"len(regexp_extract_all({x}, '[{SPACE}]{{{{2,}}}}'))".replace("{{", "{").replace("}}", "}")
_ISLANDS = """i AS (SELECT doc_id, line, pos, sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM kept),
b AS (SELECT doc_id, k, list(line ORDER BY pos) AS ls FROM i WHERE line <> '' GROUP BY doc_id, k)"""




def corpus_profile(docs: str) -> str:
    """SQL of ``doc_id`` and ``text`` in the corpus profile, for a WITH clause that defines ``docs``."""
    return rf"""WITH {docs}, s AS (SELECT doc_id, {_SPACED} AS text FROM docs), l AS (SELECT doc_id, {strip(rf"regexp_replace(line, '[ \t\x{{a0}}]+', ' ', 'g')")} AS line, pos FROM ({_numbered(splitlines('text'), 's')})),
n AS (SELECT doc_id, line FROM (SELECT doc_id, line, count(*) AS n FROM l WHERE line <> '' GROUP BY 1, 2) WHERE {_noise(S.BC)}),
kept AS (SELECT l.* FROM l LEFT JOIN n USING (doc_id, line) WHERE n.line IS NULL AND NOT {page_noise('l.line')}), {_ISLANDS},
r AS (SELECT doc_id, k, CASE WHEN len(list_filter(ls, lambda x: contains(x, chr(9)) OR contains(x, '|') OR {_GAPS('x')} >= 2)) > 0 OR (len(ls) <= 3 AND len(list_filter(ls[1:2], lambda x: {_LOOKS})) = len(ls[1:2])) THEN array_to_string(ls, chr(10)) ELSE array_to_string(ls, ' ') END AS text FROM b)
SELECT d.doc_id, coalesce({strip('t.text')}, '') AS text FROM docs d LEFT JOIN (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY k) AS text FROM r GROUP BY doc_id) t USING (doc_id)"""


@query(corpus_profile(_DOCS))
def clean_document_bc(spark, d):
    """The corpus profile: paragraphs."""
    return _docs(spark, d).select("doc_id", S.clean_bc(F.col("text")).alias("text"))


# --- Markdown -----------------------------------------------------------------------------------------

_CELLS = f"(CASE WHEN contains(x, chr(9)) THEN list_transform(string_split(x, chr(9)), lambda c: {strip('c')}) WHEN length(x) - length(replace(x, '|', '')) >= 2 THEN list_transform(string_split(x, '|'), lambda c: {strip('c')}) ELSE list_filter(list_transform(string_split_regex(x, '[{SPACE}]{{2,}}'), lambda c: {strip('c')}), lambda c: c <> '') END)"
_TABLE = f"""rows AS (SELECT doc_id, k, ls, list_filter(list_transform(ls, lambda x: {_CELLS}), lambda r: len(r) > 0) AS rs FROM b WHERE len(ls) >= 2),
wide AS (SELECT *, list_max(list_transform(rs, lambda r: len(r))) AS w FROM rows),
shown AS (SELECT doc_id, k, ls, rs, list_transform(rs, lambda r: '| ' || array_to_string(list_concat(list_transform(r, lambda c: replace(replace(c, '|', '\\|'), chr(10), ' ')), list_transform(range(w - len(r)), lambda i: '')), ' | ') || ' |') AS ms, '| ' || array_to_string(list_transform(range(w), lambda i: '---'), ' | ') || ' |' AS sep FROM wide),
tables AS (SELECT doc_id, k, CASE WHEN len(rs) < 2 THEN array_to_string(ls, chr(10)) ELSE array_to_string(list_concat(ms[1:1], [sep], ms[2:]), chr(10)) END AS md,
len(list_filter(ls, lambda x: contains(x, chr(9)))) >= 2 OR len(list_filter(ls, lambda x: {_GAPS('x')} >= 2)) >= greatest(2, len(ls) // 2) OR len(list_filter(ls, lambda x: length(x) - length(replace(x, '|', '')) >= 2)) >= 2 AS is_table FROM shown)"""
_PLAIN = f"kept AS (SELECT doc_id, CASE WHEN {strip('line')} = '' THEN '' ELSE line END AS line, pos FROM ({_numbered(splitlines('text'))}))"


@query(f"WITH {_DOCS}, {_PLAIN}, {_ISLANDS}, {_TABLE} SELECT doc_id, k::INT AS island, md FROM tables WHERE is_table")
def pipe_rows_to_cells(spark, d):
    """Blocks that are tables, as Markdown. ``island``: the blank lines before the block."""
    tidy = F.transform(T.splitlines(F.col("text")), lambda y: F.when(T.strip(y) == "", "").otherwise(y))
    starts = lambda x: F.filter(F.transform(x, lambda y, i: F.when((y != "") & ((i == 0) | (F.get(x, i - 1) == "")), F.size(F.filter(F.slice(x, F.lit(1), i), lambda z: z == "")))), lambda i: i.isNotNull())
    both = T.bind(tidy, lambda x: F.arrays_zip(S.blocks(x).alias("b"), starts(x).alias("k")))
    return _docs(spark, d).select("doc_id", F.explode(both).alias("z")).select("doc_id", F.col("z.k").alias("island"), F.col("z.b").alias("b")).filter(S.is_table(F.col("b"))).select("doc_id", "island", S.lines_table(F.col("b")).alias("md"))


_BODY = f"""m AS (SELECT doc_id, k, ls, coalesce(list_position(list_transform(ls, lambda x: NOT regexp_matches(x, '(?i)^===== FRAGMENT:')), true), 0) AS cut FROM b0),
marks AS (SELECT doc_id, k, CASE WHEN cut = 0 THEN ls ELSE ls[1:cut - 1] END AS marks, CASE WHEN cut = 0 THEN [] ELSE ls[cut:] END AS ls FROM m),
b AS (SELECT doc_id, k, ls FROM marks)"""


@query(f"""WITH {_DOCS}, {_PLAIN}, {_ISLANDS.replace('b AS (', 'b0 AS (')}, {_BODY}, {_TABLE},
h AS (SELECT doc_id, k, {heading("coalesce(ls[1], '')")} AS level FROM b),
o AS (SELECT doc_id, k, list_concat(list_transform(marks, lambda x: chr(10) || '## ' || {strip("replace(x, '=', '')")} || chr(10)), CASE
  WHEN len(ls) = 0 THEN [] WHEN coalesce(is_table, false) THEN ['', md, '']
  WHEN len(ls) = 1 THEN CASE WHEN level > 0 THEN ['', repeat('#', level) || ' ' || ls[1], ''] ELSE ls END
  WHEN level > 0 AND length(ls[1]) < 120 THEN list_concat(['', repeat('#', level) || ' ' || ls[1], ''], CASE WHEN array_to_string(ls[2:], ' ') <> '' THEN [array_to_string(ls[2:], ' ')] ELSE [] END)
  WHEN len(list_filter(ls, lambda x: length(x) < 80 OR starts_with(x, '- ') OR starts_with(x, '* ') OR starts_with(x, '• '))) = len(ls) THEN ls
  ELSE [array_to_string(ls, ' ')] END) AS out FROM marks LEFT JOIN tables USING (doc_id, k) JOIN h USING (doc_id, k))
SELECT d.doc_id, {strip("concat_ws(chr(10), '# ' || CASE WHEN d.doc_id % 3 = 0 THEN 'Untitled Source' ELSE 'Title ' || d.doc_id END, t.text)")} AS text FROM docs d
LEFT JOIN (SELECT doc_id, string_agg(array_to_string(out, chr(10)), chr(10) ORDER BY k) AS text FROM o GROUP BY doc_id) t USING (doc_id)""")
def structure_markdown(spark, d):
    title = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("Title "), "doc_id"))
    return _docs(spark, d).select("doc_id", S.markdown(T.splitlines(F.col("text")), title).alias("text"))


@query(rf"""WITH {_DOCS}, l AS ({_numbered(splitlines('text'))}), h AS (SELECT *, regexp_extract({strip('line')}, '^===== FILE:\s*(.+?)\s*=====\s*$', 1) AS head FROM l),
s AS (SELECT *, sum(CASE WHEN head <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM h),
p AS (SELECT doc_id, k, coalesce(max(head) FILTER (head <> ''), 'main') AS label, string_agg(line, chr(10) ORDER BY pos) FILTER (head = '') AS body FROM s GROUP BY doc_id, k HAVING count(*) FILTER (head = '') > 0)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS pos, label, body FROM p UNION ALL SELECT doc_id, 0, 'main', text FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM p)""")
def fragment_split(spark, d):
    """Parts of combined texts, from their header lines."""
    return _docs(spark, d).select("doc_id", F.posexplode(S.fragments(F.col("text"))).alias("pos", "f")).select("doc_id", "pos", "f.label", "f.body")


_TITLE = "CASE doc_id % 5 WHEN 0 THEN 'Report ' || doc_id || ' — of the office' WHEN 1 THEN ' ' WHEN 2 THEN 'It is a sentence.' WHEN 3 THEN NULL ELSE 'Plain' END"


@query(rf"""WITH {_DOCS}, t AS (SELECT doc_id, {strip(f"split_part({strip(f'coalesce({_TITLE}, {chr(39)*2})')}, ' — ', 1)")} AS own, {splitlines('text')} AS ls FROM docs),
c AS (SELECT doc_id, own, list_filter(list_transform(ls[1:80], lambda x: {squeeze('x')}), lambda x: contains(x, 'Survey on Drivers') OR (contains(x, 'OECD') AND length(x) < 120) OR (length(x) > 20 AND length(x) < 120 AND NOT contains(x, '©') AND ({isupper('x')} OR regexp_matches(x, '^\p{{Lu}}'))))[1] AS core,
{strip("replace(list_filter(list_transform(ls[1:40], lambda x: " + squeeze('x') + "), lambda x: contains(x, ' - Wikipedia'))[1], ' - Wikipedia', '')")} AS wiki FROM t)
SELECT doc_id, CASE WHEN own <> '' AND length(own) < 200 AND right(own, 1) <> '.' THEN own ELSE coalesce(CASE WHEN doc_id % 2 = 0 THEN wiki ELSE core END, nullif(own, ''), doc_id::VARCHAR) END AS title FROM c""")
def infer_title(spark, d):
    return _docs(spark, d).select("doc_id", S.infer_title(F.expr(_TITLE), F.col("text"), F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("title"))


@query(f"WITH l AS (SELECT doc_id, {splitlines('text')} AS ls FROM documents) SELECT doc_id, array_to_string(ls[1:20], chr(10)) AS text, greatest(len(ls) - 20, 0)::INT AS overflow FROM l")
def line_caps_overflow(spark, d):
    ls = T.splitlines(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.slice(ls, 1, 20), "\n").alias("text"), F.greatest(F.size(ls) - 20, F.lit(0)).alias("overflow"))


@query(f"""WITH {_DOCS}, l AS (SELECT doc_id, (list_filter(list_transform({splitlines('text')}, lambda x: {strip('x')}), lambda x: length(x) > 3 AND length(x) < 200))[1:200] AS ls FROM docs), e AS (SELECT doc_id, unnest(ls) AS label, unnest(range(len(ls)))::INT AS line_index FROM l)
SELECT * FROM e WHERE NOT regexp_matches(label, '^\\d+$')""")
def pdf_lines(spark, d):
    """Entities of a page text: its first 200 lines of 4 to 199 characters, without numbers, under their old index."""
    from ..functions import pages

    return _docs(spark, d).select("doc_id", F.explode(pages.pdf_entities(F.col("text"))).alias("e")).select("doc_id", "e.label", "e.line_index")
