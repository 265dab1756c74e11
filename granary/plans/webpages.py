"""Queries over web pages. Wiki pages, which the tables lack, are made of regions and nations on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions import structure as S
from ..functions import text as T
from ..sources.tables import spread, table
from .base import flatten, local, query, quoted, strip, values
from .cleaning import corpus_profile

# --- plain pages --------------------------------------------------------------------------------------

_UNESCAPED = lambda x: f"replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&')"


@query(f"""WITH a AS (SELECT page_id, {_UNESCAPED("regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>', '', 'g'), '(?s)<!--.*?-->|<[^>]*>', chr(10), 'g')")} AS t FROM pages)
SELECT page_id, array_to_string(list_filter(list_transform(string_split_regex(t, '[\\n\\r]+'), lambda x: {strip('x')}), lambda x: x <> ''), chr(10)) AS text FROM a""")
def html_visible_text(spark, d):
    """The text of pages, each piece between tags on lines of its own, without blank lines."""
    return spread(table(spark, d, "pages")).select("page_id", P.text_lines(F.col("html")).alias("text"))


@query("""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g') AS h FROM pages), p AS (SELECT page_id, regexp_extract(h, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS title, list_transform(string_split_regex(h, '<p(\\s[^>]*)?>')[2:], lambda x: split_part(x, '</p>', 1)) AS ps FROM a),
t AS (SELECT page_id, title, list_transform(ps, lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS ps FROM p)
SELECT page_id, trim(regexp_replace(regexp_replace(title, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS title, (list_filter(ps, lambda x: length(x) > 40))[1:2] AS lead FROM t""")
def html_title_lead(spark, d):
    """First heading, and the first two paragraphs of over 40 characters (entities as they stand)."""
    bare = F.regexp_replace("html", "(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "")
    plain = lambda x: T.flatten(F.regexp_replace(x, "<[^>]*>", " "))
    parts = F.transform(F.split(bare, r"<p(?:\s[^>]*)?>"), lambda x: plain(F.substring_index(x, "</p>", 1)))
    lead = F.slice(F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.length(x) > 40), 1, 2)
    return spread(table(spark, d, "pages")).select("page_id", plain(F.regexp_extract(bare, "(?is)<h1[^>]*>(.*?)</h1>", 1)).alias("title"), lead.alias("lead"))


@query("SELECT link, count(*) AS n FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages) GROUP BY link")
def html_links_distinct(spark, d):
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))
    return table(spark, d, "pages").select(F.explode(links).alias("link")).groupBy("link").agg(F.count(F.lit(1)).alias("n"))


_URLS = [(-1, "//a.example/x#y"), (-2, "/wiki/Some_Page#top"), (-3, "  https://b.example/#a#b "), (-4, None), (-5, "#only"), (-6, "/other"), (-7, "//en.wikipedia.org/wiki/List_of_airports_in_X"), (-8, "https://en.wikipedia.org/wiki/File:a.png"), (-9, "https://en.wikipedia.org/wiki/A/wiki/Special:b"), (-10, "https://fr.wikipedia.org/wiki/Talk_show"), (-11, "https://en.wikipedia.org/wiki/Talk:show"), (-12, "/wiki/")]
_URL = f"(CASE WHEN starts_with(u, '//') THEN 'https:' || u WHEN starts_with(u, '/wiki/') THEN 'https://en.wikipedia.org' || u ELSE u END)"


@query(f"WITH a AS (SELECT page_id, {strip('coalesce(url, chr(32))')} AS u FROM (SELECT page_id, url FROM pages UNION ALL SELECT * FROM ({values(_URLS)}))) SELECT page_id, split_part({_URL}, '#', 1) AS url FROM a")
def url_normalize(spark, d):
    rows = table(spark, d, "pages").select("page_id", "url").unionByName(local(spark, _URLS, "page_id long, url string"))
    return rows.select("page_id", T.url_key(F.col("url")).alias("url"))


_SKIP = " OR ".join(f"starts_with(p, {quoted(x)})" for x in P.SKIPPED_LINKS)


@query(f"""WITH a AS (SELECT page_id, {strip('coalesce(url, chr(32))')} AS u FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS url FROM pages UNION ALL SELECT * FROM ({values(_URLS)}))),
n AS (SELECT page_id, split_part({_URL}, '#', 1) AS url FROM a), q AS (SELECT page_id, url, string_split(url, '/wiki/')[-1] AS p FROM n)
SELECT page_id, url, contains(url, 'wikipedia.org/wiki/') AND NOT ({_SKIP}) AS article FROM q""")
def link_filter(spark, d):
    """Links of pages, with those of articles of a wiki marked."""
    links = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("url"))
    rows = links.unionByName(local(spark, _URLS, "page_id long, url string")).select("page_id", T.url_key(F.col("url")).alias("url"))
    return rows.withColumn("article", P.is_article_link(F.col("url")))


_LABELS = [(-k, x) for k, x in enumerate([None, "", " x ", "xy", "Edit", " See  Also", "[12]", "[note]", "[open", "Main\nPage", "edit it", "é", "日本"], 1)]
_NOISY = ", ".join(map(quoted, P.NOISE_LABELS))


@query(f"""WITH a AS (SELECT page_id, label, {flatten("coalesce(label, '')")} AS f FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*>([^<]*)</a>', 1)) AS label FROM pages UNION ALL SELECT * FROM ({values(_LABELS)})))
SELECT page_id, label, length(f) < 2 OR lower(f) IN ({_NOISY}) OR (starts_with(f, '[') AND right(f, 1) = ']') AS noise FROM a""")
def noise_label_filter(spark, d):
    links = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<a[^>]*>([^<]*)</a>"), F.lit(1))).alias("label"))
    rows = links.unionByName(local(spark, _LABELS, "page_id long, label string"))
    return rows.withColumn("noise", P.is_noise_label(F.col("label")))


_TITLES = [(-k, t, f) for k, (t, f) in enumerate([
    ("List of World Heritage Sites in Peru", "SET001_a.htm"), ("Lists of World Heritage Sites", "b.html"), ("List of UNESCO World Heritage Sites by year", "c.html"), ("List of airports in Peru", "d.html"),
    ("List of airports by IATA code", "e.html"), ("List of countries by area", "f.htm"), ("National capitals", "g.html"), ("The largest cities", "h"), ("List of sovereign states", "i"), ("List of castles by height", "j.htm"),
    ("Comparison of web frameworks", "k.html"), ("Peru", "Peru - Wikipedia.html"), ("Peru", "l.HTM"), ("Register", "m.PDF"), ("Peru", "n.html"), ("", ""), ("List of x", "y by z.html")], 1)]
_CLASS = """CASE WHEN contains(t, 'list of world heritage sites in ') THEN 'country_wh_site_list' WHEN contains(t, 'lists of world heritage') OR contains(t, 'list of unesco world heritage') THEN 'wh_index'
WHEN contains(t, 'list of airports in ') THEN 'country_airport_list' WHEN contains(t, 'list of airports by iata') THEN 'airport_iata_index' WHEN regexp_matches(t, 'list of countries|list of sovereign|national capitals|largest cities') THEN 'country_data_table'
WHEN regexp_matches(t, 'list of .* by ') THEN 'generic_list_table' WHEN contains(t, 'comparison of') AND contains(t, 'framework') THEN 'comparison_table' WHEN contains(f, ' - wikipedia') OR f LIKE '%.htm' THEN 'wikipedia_article' WHEN f LIKE '%.pdf' THEN 'pdf_document' ELSE 'unknown' END"""


@query(f"""WITH a AS (SELECT page_id, lower(title || ' ' || file_name) AS t, lower(file_name) AS f FROM (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, url || CASE page_id % 3 WHEN 0 THEN '.htm' WHEN 1 THEN '.pdf' ELSE '' END AS file_name FROM pages UNION ALL SELECT * FROM ({values(_TITLES)}))) SELECT page_id, {_CLASS} AS page_class FROM a""")
def page_classify(spark, d):
    """The class of pages by title and address (with an ending added), and of titles of every class."""
    end = F.when(F.col("page_id") % 3 == 0, ".htm").when(F.col("page_id") % 3 == 1, ".pdf").otherwise("")
    rows = table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.concat("url", end).alias("file_name"))
    rows = rows.unionByName(local(spark, _TITLES, "page_id long, title string, file_name string"))
    return rows.select("page_id", P.page_class(F.col("title"), F.col("file_name")).alias("page_class"))


_CLASSES = ["country_wh_site_list", "wh_index", "country_airport_list", "airport_iata_index", "country_data_table", "generic_list_table", "comparison_table", "wikipedia_article", "pdf_document", "unknown"]


@query(f"""WITH a AS (SELECT unnest({quoted(_CLASSES)}) AS page_class, (n_nationkey * 5 // 2)::BIGINT AS n, (n_nationkey % 5)::BIGINT AS rows, (n_nationkey % 3)::BIGINT AS links FROM nation)
SELECT page_class, n, rows, links, CASE page_class WHEN 'wh_index' THEN 'linked_country_or_region_world_heritage_list_pages' WHEN 'country_wh_site_list' THEN 'individual_world_heritage_sites_in_country' WHEN 'country_airport_list' THEN 'airports_in_country' WHEN 'country_data_table' THEN 'wikitable_entities' WHEN 'generic_list_table' THEN 'wikitable_entities' ELSE 'unknown' END AS candidate_answer_set_type,
CASE WHEN page_class = 'wh_index' THEN CASE WHEN n >= 50 THEN 'bounded' ELSE 'partial' END WHEN page_class IN ('country_wh_site_list', 'country_airport_list') THEN CASE WHEN n >= 1 THEN 'bounded' ELSE 'empty' END WHEN page_class IN ('country_data_table', 'generic_list_table') THEN CASE WHEN n >= 10 THEN 'bounded' ELSE 'partial' END ELSE 'unknown' END AS boundedness,
CASE WHEN page_class = 'wh_index' THEN CASE WHEN n >= 50 THEN 'pass_as_index_source' ELSE 'needs_review' END WHEN page_class IN ('country_wh_site_list', 'country_airport_list') THEN CASE WHEN n >= 1 THEN 'pass' ELSE 'needs_review' END WHEN page_class IN ('country_data_table', 'generic_list_table') THEN CASE WHEN n >= 10 THEN 'pass' ELSE 'needs_review' END WHEN n < 3 THEN 'needs_review' ELSE 'pass' END AS qa_status,
CASE WHEN page_class IN ('wh_index', 'airport_iata_index') AND links > 0 THEN 'wiki_links' WHEN page_class = 'country_wh_site_list' AND rows > 0 THEN 'wikitable_sites' WHEN page_class = 'country_airport_list' AND rows > 0 THEN 'wikitable_airports' WHEN page_class IN ('country_data_table', 'generic_list_table', 'comparison_table') AND rows > 0 THEN 'wikitable' WHEN rows < 3 AND links > 0 THEN 'wiki_links_fallback' WHEN page_class = 'wikipedia_article' THEN 'single_article' ELSE 'wikitable' END AS mode FROM a""")
def set_annotation(spark, d):
    """Every class with many numbers of entities, table rows and links."""
    kinds = F.explode(F.array(*map(F.lit, _CLASSES))).alias("page_class")
    key = F.col("n_nationkey").cast("long")
    rows = table(spark, d, "nation").select(kinds, F.floor(key * 5 / 2).alias("n"), (key % 5).alias("rows"), (key % 3).alias("links"))
    mode = P.extraction_mode(F.col("page_class"), F.col("rows"), F.col("links"), F.lit("a title"))["mode"]
    return rows.select("*", P.annotation(F.col("page_class"), F.col("n")).alias("a"), mode.alias("mode")).select("page_class", "n", "rows", "links", "a.*", "mode")


# --- wiki pages ---------------------------------------------------------------------------------------

_WIKI_TITLES = ["List of countries in X", "List of airports by IATA code", "List of World Heritage Sites in X", "X", "List of castles by area"]
_TAIL = '<p><a href="/wiki/File:x.png">pic</a> and <a href="//en.wikipedia.org/wiki/List_of_airports_in_X#a">Air&amp;ports</a> <a href="https://example.org">out</a><a href="/wiki/Edit">edit</a> <a href="/wiki/Y"> [1] </a></p>'


def _wiki(spark, d):
    """A page a region: a heading, two leads, a table of its nations (one of them twice), links."""
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    row = lambda x: F.concat(F.lit('<tr><td><a href="/wiki/'), x["n_name"], F.lit('#top">'), x["n_name"], F.lit("</a><td> <b>"), x["n_nationkey"].cast("string"), F.lit("</b> | x\n"))
    rows = F.array_join(F.transform(F.col("n"), row), "")
    title = F.get(F.array(*map(F.lit, _WIKI_TITLES)), F.col("r_regionkey") % 5)
    html = F.concat(
        F.lit('<html><body><h1 id="firstHeading"> '), title, F.lit('</h1><p>'), F.repeat(F.lit("outside "), F.lit(9)), F.lit('</p><div id="mw-content-text"><div class="a mw-parser-output"><p>short<p>'),
        F.repeat(F.concat("r_name", F.lit(" is <i>a</i> region. ")), F.lit(6)), F.lit('<div><p>'), F.repeat(F.lit("inside of a part "), F.lit(6)), F.lit('</p></div><table class="wikitable sortable"><caption>Nations of it</caption><tr><th>Name</th><th>Key</th></tr>'), rows, row(F.get("n", F.lit(0))),
        F.lit("</table>"), F.lit(_TAIL), F.lit("</div></div></body></html>"))
    return table(spark, d, "region").join(n, "r_regionkey").select("r_regionkey", title.alias("title"), html.alias("html"), F.concat(F.lit("SET00"), "r_regionkey", F.lit("_a.htm")).alias("file_name"))


_WIKI_SQL = f"""n AS (SELECT n_regionkey AS r_regionkey, list(n_name ORDER BY n_nationkey) AS names, list(n_nationkey ORDER BY n_nationkey) AS keys FROM nation GROUP BY 1),
w AS (SELECT r_regionkey, r_name, names, keys, {quoted(_WIKI_TITLES)}[r_regionkey % 5 + 1] AS title FROM region JOIN n USING (r_regionkey)),
k AS (SELECT *, ['country_data_table', 'airport_iata_index', 'country_wh_site_list', 'wikipedia_article', 'generic_list_table'][r_regionkey % 5 + 1] AS page_class, ['wikitable', 'wiki_links', 'wikitable_sites', 'single_article', 'wikitable'][r_regionkey % 5 + 1] AS mode FROM w)"""


@query(f"""WITH {_WIKI_SQL}
SELECT r_regionkey, title AS page_title, page_class, mode AS extraction_mode, [trim(repeat(r_name || ' is a region. ', 6))] AS lead,
CASE mode WHEN 'wiki_links' THEN list_append(names, 'Air&ports') WHEN 'single_article' THEN [title] ELSE names END AS labels,
CASE mode WHEN 'wiki_links' THEN list_append(list_transform(names, lambda x: 'https://en.wikipedia.org/wiki/' || x), 'https://en.wikipedia.org/wiki/List_of_airports_in_X') WHEN 'single_article' THEN [''] ELSE list_transform(names, lambda x: NULL::VARCHAR) END AS urls,
len(names)::INT AS wikitable_rows, len(names)::INT + 1 AS wiki_links FROM k""")
def html_structured(spark, d):
    """Title, class, leads and entities of wiki pages."""
    page = _wiki(spark, d).withColumn("page", P.structured(F.col("html"), F.col("file_name")))
    kind = P.page_class(F.col("page.page_title"), F.col("file_name"))
    made = page.withColumn("page_class", kind).withColumn("e", P.entities(F.col("page_class"), F.col("page")))
    return made.select("r_regionkey", "page.page_title", "page_class", "e.extraction_mode", F.col("page.lead_paragraphs").alias("lead"), F.transform("e.entities", lambda x: x["label"]).alias("labels"), F.transform("e.entities", lambda x: x["url"]).alias("urls"), "e.counts.wikitable_rows", "e.counts.wiki_links")


_ROWS = r"list_transform(list_zip(names, keys), lambda x: '| ' || x[1] || ' | ' || x[2] || ' \| x |')"
_LINKS = "list_append(list_transform(names, lambda x: '- ' || x || ' (https://en.wikipedia.org/wiki/' || x || ')'), '- Air&ports (https://en.wikipedia.org/wiki/List_of_airports_in_X)')"


@query(f"""WITH {_WIKI_SQL}
SELECT r_regionkey, CASE mode WHEN 'single_article' THEN '' WHEN 'wiki_links' THEN array_to_string(list_concat(['### Linked items'], ({_LINKS})[1:3], CASE WHEN len(names) > 2 THEN ['- … and ' || (len(names) - 2) || ' more linked items'] ELSE [] END), chr(10) || chr(10))
ELSE '### Nations of it' || chr(10) || chr(10) || CASE WHEN len(names) < 2 THEN names[1] || ' | ' || keys[1] || ' \\| x' ELSE array_to_string(list_concat(({_ROWS})[1:1], ['| --- | --- |'], ({_ROWS})[2:]), chr(10)) END END AS markdown,
CASE mode WHEN 'single_article' THEN title || ' | single_article' WHEN 'wiki_links' THEN array_to_string(list_append(list_transform(names, lambda x: x || ' | wiki_link | https://en.wikipedia.org/wiki/' || x), 'Air&ports | country_airport_list_page | https://en.wikipedia.org/wiki/List_of_airports_in_X'), chr(10))
ELSE 'Table: Nations of it' || chr(10) || array_to_string(list_transform(list_zip(names, keys), lambda x: x[1] || ' | ' || x[2] || ' \\| x'), chr(10)) END AS lines FROM k""")
def entities_markdown(spark, d):
    """Entities of wiki pages as Markdown (at most 3 links) and as lines."""
    page = _wiki(spark, d).withColumn("page", P.structured(F.col("html"), F.col("file_name")))
    e = P.entities(P.page_class(F.col("page.page_title"), F.col("file_name")), F.col("page"))["entities"]
    return page.withColumn("e", e).select("r_regionkey", S.entities_markdown(F.col("e"), 3).alias("markdown"), S.entities_lines(F.col("e")).alias("lines"))


_BLOCKS = rf"""a AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<head>.*?</head>|<nav[^>]*>.*?</nav>|<header[^>]*>.*?</header>|<footer[^>]*>.*?</footer>', '', 'g') AS h FROM pages),
m AS (SELECT page_id, regexp_replace(regexp_replace(h, '<(h[1-4]|p|li)(\s[^>]*)?>', chr(1) || '\1' || chr(2), 'g'), '</?(h[1-4]|p|li|ul|ol|article|body|div|html)(\s[^>]*)?>', chr(3), 'g') AS h FROM a),
segs AS (SELECT page_id, unnest(string_split(h, chr(1))) AS seg, unnest(range(len(string_split(h, chr(1))))) AS pos FROM m),
parts AS (SELECT page_id, pos, split_part(seg, chr(2), 1) AS tag, array_to_string(list_filter(list_transform(string_split(regexp_replace(split_part(split_part(seg, chr(2), 2), chr(3), 1), '<[^>]*>', chr(4), 'g'), chr(4)), lambda x: {strip(_UNESCAPED('x'))}), lambda x: x <> ''), ' ') AS said FROM segs WHERE pos > 0),
docs AS (SELECT page_id AS doc_id, coalesce(string_agg(CASE WHEN starts_with(tag, 'h') THEN chr(10) || said ELSE said END, chr(10) ORDER BY pos) FILTER (CASE WHEN starts_with(tag, 'h') THEN said <> '' ELSE length(said) >= 3 END), '') AS text FROM parts GROUP BY page_id)"""


@query(f"SELECT doc_id AS page_id, text FROM ({corpus_profile(_BLOCKS)})")
def html_visible_blocks(spark, d):
    """Headings, paragraphs and list items of pages without frames, in the corpus profile."""
    return spread(table(spark, d, "pages")).select("page_id", P.visible_blocks(F.col("html")).alias("text"))
