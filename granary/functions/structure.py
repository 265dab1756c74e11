"""A text's lines: cleaning profiles, blocks, Markdown, fragments, and the rendering of tables and entities.

A text is one row and its lines are an array inside it, so nothing here shuffles, and order is never lost. Arrays are
sorted where lines are counted, so long texts cost n log n. Two profiles exist, "ns" for packets and "bc" for the
corpus; they differ in markers and thresholds, which are fixed values of the data model.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Fixed values of the data model.
STOP_HEADINGS = ["see also", "references", "explanatory notes", "notes", "further reading", "external links", "navigation menu", "categories", "hidden categories", "bibliography"]
LICENSE_MARKERS = ["creative commons", "attribution 4.0", "all rights reserved", "unless otherwise noted"]
LICENSE_ENDS = ["foreword", "executive summary", "introduction", "abstract"]
NAVIGATION = [
    "jump to content", "main menu", "navigation", "search", "appearance", "tools", "personal tools", "create account", "log in", "move to sidebar",
    "hide", "show", "edit", "talk", "read", "view source", "view history", "main page", "contents", "current events", "random article",
    "about wikipedia", "contact us", "help", "learn to edit", "community portal", "recent changes", "upload file", "special pages", "donate",
    "contribute", "wikimedia commons", "wikimedia foundation", "mediawiki", "meta-wiki", "wikimedia outreach", "wikispecies", "wikidata",
    "wikifunctions", "wikivoyage", "wikinews", "wikiquote", "wikisource", "wikiversity", "wikibooks", "wiktionary", "print/export",
    "download as pdf", "printable version", "in other projects", "languages",
]
FILE_HEADER = r"^===== FILE:\s*(.+?)\s*=====\s*$"
FRAGMENT = r"(?i)^===== FRAGMENT:"


@dataclass(frozen=True)
class Profile:
    """When a repeated line is noise: with a marker, or in capitals."""

    markers: tuple[str, ...]
    marked: int
    marked_length: int
    capital: int
    capital_length: int


NS = Profile(("©", "copyright", "all rights reserved", "isbn", "doi:", "shutterstock"), 5, 200, 10, 120)
BC = Profile(("©", "copyright", "all rights reserved", "isbn", "doi:", "www.", "http://", "https://"), 5, 180, 8, 140)

_bind, _strings = T.bind, "array<string>"


def _none() -> Column:
    return F.array().cast(_strings)


# --- lines ------------------------------------------------------------------------------------------


def repeated_noise(lines: Column, profile: Profile) -> Column:
    """Distinct lines (stripped) that the text repeats and that are short and marked, or short and in capitals."""
    def of(s: Column) -> Column:
        def noisy(x: Column, i: Column) -> Column:
            low = F.lower(x)
            marked = F.lit(False)
            for m in profile.markers:
                marked = marked | low.contains(m)
            often = lambda k: F.coalesce(F.get(s, i + k - 1) == x, F.lit(False))
            return (often(profile.marked) & (F.length(x) <= profile.marked_length) & marked) | (often(profile.capital) & (F.length(x) <= profile.capital_length) & T.is_upper(x))

        return F.array_distinct(F.filter(s, noisy))

    return _bind(F.array_sort(F.filter(F.transform(lines, T.strip), lambda x: x != "")), of)


def is_navigation(line: Column) -> Column:
    """A line of a wiki page's frame."""
    def of(low: Column) -> Column:
        return low.isin(NAVIGATION) | (low.startswith("toggle ") & low.contains("contents")) | low.rlike("^(edit|talk|read|view|hide|show)$")

    return _bind(T.strip(line), lambda s: F.when(F.length(s).between(1, 80), _bind(F.lower(s), of)).otherwise(False))


def collapse(lines: Column, blank=lambda x: x == "") -> Column:
    """Lines with each run of blank ones (``blank``: line -> condition) as one."""
    return F.filter(lines, lambda x, i: ~blank(x) | (i == 0) | ~blank(F.get(lines, i - 1)))


def until(lines: Column, stop) -> Column:
    """Lines before the first that meets ``stop``."""
    at = F.array_position(F.transform(lines, lambda x: F.coalesce(stop(x), F.lit(False))), True)
    return F.when(at == 0, lines).otherwise(F.slice(lines, F.lit(1), F.greatest(at.cast("int") - 1, F.lit(0))))


def trim_tail(lines: Column) -> Column:
    """Lines before the first closing section of a wiki page. Of a long line only the start can matter."""
    def stop(line: Column) -> Column:
        start = lambda x: F.lower(T.squeeze(F.left(T.strip(x), F.lit(64))))
        return _bind(start(line), lambda n: n.startswith("category:") | ((F.length(line) <= 64) & n.isin(STOP_HEADINGS)))

    return until(lines, stop)


def strip_license(lines: Column) -> Column:
    """Where a licence marker is in the first 4,000 characters: lines from the first opening section on; else all."""
    head = F.lower(F.left(F.array_join(lines, "\n"), F.lit(8000)))  # lower case may lengthen a text, never to more than twice
    marked = F.lit(False)
    for m in LICENSE_MARKERS:
        marked = marked | F.left(head, F.lit(4000)).contains(m)
    opens = lambda x: _bind(T.squeeze(x), lambda n: F.lower(n).isin(LICENSE_ENDS) | n.rlike(T.SECTION) | F.lower(n).rlike(T.CHAPTER))
    at = F.array_position(F.transform(lines, opens), True).cast("int")
    return F.when(marked & (at > 0), F.slice(lines, F.greatest(at, F.lit(1)), F.size(lines))).otherwise(lines)


# --- cleaning profiles --------------------------------------------------------------------------------


def clean_ns(raw: Column, is_set: Column) -> Column:
    """(lines, notes): hyphens joined, lines squeezed, repeated lines, page marks and (sets) navigation taken out, blank runs as one."""
    def of_lines(lines: Column) -> Column:
        def of_noise(noise: Column) -> Column:
            # each line is judged once: 0 stays, 1 repeated, 2 page mark, 3 navigation, 4 a page's address
            kind = lambda x: F.when(x == "", 0).when(F.array_contains(noise, x), 1).when(T.is_page_noise(x), 2).when(is_set & is_navigation(x), 3).when(is_set & F.lower(x).startswith("retrieved from "), 4).otherwise(0)

            def of_kinds(kinds: Column) -> Column:
                kept = F.filter(lines, lambda x, i: F.get(kinds, i) == 0)
                count = lambda k: F.size(F.filter(kinds, lambda x: x == k))
                said = lambda n, before, after: F.when(n > 0, F.concat(F.lit(before), n.cast("string"), F.lit(after)))
                notes = F.array(
                    F.when(F.contains(raw, F.lit("-\n")) & raw.rlike(r"(?U)\w-\n\w"), F.lit("Merged hyphenation line-break artifacts.")),
                    said(F.size(noise), "Removed ", " repeated footer/copyright/header lines."),
                    said(count(2), "Removed ", " page-number or footer markers."),
                    said(count(3), "Removed ", " navigation/UI lines (Set/HTML sources)."),
                )
                return F.struct(_bind(kept, lambda k: collapse(k)).alias("lines"), F.array_compact(notes).alias("notes"))

            return _bind(F.transform(lines, kind), of_kinds)

        return _bind(repeated_noise(lines, NS), of_noise)

    return _bind(F.transform(T.splitlines(T.join_hyphens(raw)), T.squeeze), of_lines)


def clean_bc(raw: Column) -> Column:
    """A text in paragraphs: repeated lines and page marks taken out, blocks joined."""
    def of_lines(lines: Column) -> Column:
        kept = _bind(repeated_noise(lines, BC), lambda noise: F.filter(lines, lambda x: ~(F.array_contains(noise, x) | T.is_page_noise(x))))
        return T.strip(paragraphs(kept))

    return _bind(T.splitlines(T.spaces(raw)), of_lines)


# --- blocks -------------------------------------------------------------------------------------------


def blocks(lines: Column) -> Column:
    """Runs of lines that are not empty, each an array."""
    def of(full: Column) -> Column:
        starts = F.filter(F.transform(full, lambda x, i: F.when(x & ((i == 0) | ~F.get(full, i - 1)), i)), lambda i: i.isNotNull())
        ends = F.filter(F.transform(full, lambda x, i: F.when(x & ((i == F.size(full) - 1) | ~F.get(full, i + 1)), i)), lambda i: i.isNotNull())
        return F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a + 1))

    return _bind(F.transform(lines, lambda x: x != ""), of)


def paragraphs(lines: Column) -> Column:
    """Blocks apart by a blank line: tables and headings keep their lines, others become one line."""
    def render(b: Column) -> Column:
        heads = (F.size(b) <= 3) & F.forall(F.slice(b, 1, 2), T.looks_like_heading)
        return F.when((F.size(b) == 1) | heads | F.exists(b, T.looks_like_table_line), F.array_join(b, "\n")).otherwise(F.array_join(b, " "))

    return F.array_join(F.transform(_bind(lines, blocks), render), "\n\n")


def is_table(block: Column) -> Column:
    n = F.size(block)
    count = lambda f: F.size(F.filter(block, f))
    tabs, pipes = count(lambda x: x.contains("\t")), count(lambda x: x.contains("|") & (T.n_pipes(x) >= 2))
    gaps = count(lambda x: T.wide_gaps(x) >= 2)
    return (n >= 2) & ((tabs >= 2) | (pipes >= 2) | (gaps >= F.greatest(F.lit(2), F.floor(n / 2))))


def escape(cell: Column) -> Column:
    """A cell of a Markdown table."""
    return F.replace(F.replace(cell, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def fence(body: Column) -> Column:
    """A text between fences that it does not hold itself."""
    def of(b: Column) -> Column:
        mark = F.when(b.contains("```"), "````").otherwise("```")
        return F.concat(mark, F.lit("text\n"), b, F.lit("\n"), mark)

    return _bind(body, of)


def _rows_as_table(rows: Column) -> Column:
    width = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    pad = lambda r: F.concat(F.transform(r, escape), F.array_repeat(F.lit(""), width - F.size(r)))
    made = F.transform(rows, lambda r: line(pad(r)))
    return F.array_join(F.concat(F.slice(made, 1, 1), F.array(line(F.array_repeat(F.lit("---"), width))), F.slice(made, F.lit(2), F.size(made) - 1)), "\n")


def lines_table(block: Column) -> Column:
    """A block as a Markdown table: cells by tabs, else by pipes, else by wide gaps; the lines themselves where fewer than two have cells."""
    def cells(x: Column) -> Column:
        tidy = lambda parts: F.transform(parts, T.strip)
        return F.when(x.contains("\t"), tidy(F.split(x, "\t"))).when(T.n_pipes(x) >= 2, tidy(F.split(x, r"\|"))).otherwise(F.filter(tidy(F.split(x, f"[{T.SPACE}]{{2,}}")), lambda c: c != ""))

    rows = F.filter(F.transform(block, cells), lambda r: F.size(r) > 0)
    return _bind(rows, lambda r: F.when(F.size(r) < 2, F.array_join(block, "\n")).otherwise(_rows_as_table(r)))


def cells_table(rows: Column) -> Column:
    """Rows of cells as a Markdown table; one row or none as a plain line."""
    full = F.filter(rows, lambda r: F.size(r) > 0)
    return _bind(full, lambda r: F.when(F.size(r) < 2, F.array_join(F.transform(r, lambda x: F.array_join(F.transform(x, escape), " | ")), "\n")).otherwise(_rows_as_table(r)))


def markdown(lines: Column, title: Column) -> Column:
    """Cleaned lines with headings, lists and tables marked: each block by its shape."""
    head = lambda level, x: F.array(F.lit(""), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), x), F.lit(""))
    listed = lambda x: x.startswith("- ") | x.startswith("* ") | x.startswith("• ")

    def body(b: Column) -> Column:
        first = F.get(b, F.lit(0))
        rest = F.array_join(F.slice(b, F.lit(2), F.greatest(F.size(b) - 1, F.lit(0))), " ")
        def by_level(level: Column) -> Column:
            many = F.when((level > 0) & (F.length(first) < 120), F.concat(head(level, first), F.when(rest != "", F.array(rest)).otherwise(_none())))
            many = many.when(F.forall(b, lambda x: listed(x) | (F.length(x) < 80)), b).otherwise(F.array(F.array_join(b, " ")))
            return F.when(F.size(b) == 1, F.when(level > 0, head(level, first)).otherwise(b)).otherwise(many)

        return F.when(F.size(b) == 0, _none()).when(is_table(b), F.array(F.lit(""), lines_table(b), F.lit(""))).otherwise(_bind(T.heading_level(first), by_level))

    def whole(b: Column) -> Column:
        # fragment marks at a block's start are headings of their own
        marks = F.size(b) - F.size(F.filter(b, lambda x, i: F.exists(F.slice(b, F.lit(1), i + 1), lambda y: ~y.rlike(FRAGMENT))))
        shown = F.transform(F.slice(b, F.lit(1), marks), lambda x: F.concat(F.lit("\n## "), T.strip(F.translate(x, "=", "")), F.lit("\n")))
        some = F.when(F.get(b, F.lit(0)).rlike(FRAGMENT), F.concat(shown, body(F.slice(b, marks + 1, F.size(b)))))
        return some.otherwise(body(b))

    first = F.array(F.concat(F.lit("# "), F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled Source"))))
    return T.strip(F.array_join(F.concat(first, F.flatten(F.transform(_bind(F.transform(lines, lambda x: F.when(T.strip(x) == "", "").otherwise(x)), blocks), whole))), "\n"))


# --- fragments and titles -------------------------------------------------------------------------------


def fragments(text: Column) -> Column:
    """(label, body) of the parts of a combined text, each under a ``===== FILE: label =====`` line; what is before the first is "main"."""
    def of(lines: Column) -> Column:
        label = lambda x: F.when(x.contains("===== FILE:"), F.regexp_extract(T.strip(x), FILE_HEADER, 1)).otherwise("")
        heads = F.filter(F.transform(lines, lambda x, i: F.when(label(x) != "", i)), lambda i: i.isNotNull())
        starts = F.concat(F.array(F.lit(-1)), heads)
        ends = F.concat(heads, F.array(F.size(lines)))
        parts = F.zip_with(starts, ends, lambda a, b: F.struct(F.when(a < 0, "main").otherwise(T.strip(label(F.get(lines, F.greatest(a, F.lit(0)))))).alias("label"), F.slice(lines, a + 2, F.greatest(b - a - 1, F.lit(0))).alias("body")))
        made = F.transform(F.filter(parts, lambda p: F.size(p["body"]) > 0), lambda p: F.struct(p["label"].alias("label"), F.array_join(p["body"], "\n").alias("body")))
        return F.when(F.size(made) > 0, made).otherwise(F.array(F.struct(F.lit("main").alias("label"), text.alias("body"))))

    return _bind(T.splitlines(text), of)


def infer_title(title: Column, raw: Column, is_set: Column, fallback: Column) -> Column:
    """The inventory's title where it is short and no sentence; else a line of the text that looks like one; else the title or the id."""
    own = T.strip(F.substring_index(T.strip(F.coalesce(title, F.lit(""))), " — ", 1))
    heads = F.transform(T.splitlines(raw), T.squeeze)
    n = F.length
    named = lambda x: x.contains("Survey on Drivers") | (x.contains("OECD") & (n(x) < 120))
    first_upper = lambda x: F.left(x, F.lit(1)).rlike(r"^\p{Lu}")
    core = F.filter(F.slice(heads, 1, 80), lambda x: named(x) | ((n(x) > 20) & (n(x) < 120) & ~x.contains("©") & (T.is_upper(x) | first_upper(x))))
    wiki = F.filter(F.slice(heads, 1, 40), lambda x: x.contains(" - Wikipedia"))
    found = F.when(is_set, T.strip(F.replace(F.get(wiki, F.lit(0)), F.lit(" - Wikipedia"), F.lit("")))).otherwise(F.get(core, F.lit(0)))
    return F.when((own != "") & (n(own) < 200) & ~own.endswith("."), own).otherwise(F.coalesce(found, F.nullif(own, F.lit("")), fallback.cast("string")))


# --- entities -------------------------------------------------------------------------------------------


def captioned(rows: Column) -> Column:
    """(caption, rows) of table entities in order: a new part where an entity has a caption other than the last one seen."""
    def of(known: Column) -> Column:
        # known: the last caption seen up to each entity
        own = lambda i: F.coalesce(F.get(rows, i)["caption"], F.lit(""))
        fresh = lambda i: (own(i) != "") & ((i == 0) | (own(i) != F.get(known, i - 1)))
        starts = F.filter(F.transform(rows, lambda x, i: F.when((i == 0) | fresh(i), i)), lambda i: i.isNotNull())
        ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(rows)))
        return F.zip_with(starts, ends, lambda a, b: F.struct(F.when(fresh(a), own(a)).otherwise("").alias("caption"), F.slice(rows, a + 1, b - a).alias("rows")))

    seen = F.transform(rows, lambda x, i: F.coalesce(F.try_element_at(F.filter(F.slice(rows, F.lit(1), i + 1), lambda y: F.coalesce(y["caption"], F.lit("")) != ""), F.lit(-1))["caption"], F.lit("")))
    return F.when(F.size(rows) > 0, _bind(seen, of))


def entities_markdown(entities: Column, most: int = 500) -> Column:
    """Tables by caption, then a list of at most ``most`` links with a count of the others."""
    tables = F.filter(entities, lambda e: F.coalesce(F.size(e["cells"]), F.lit(0)) > 0)
    links = F.filter(entities, lambda e: (F.coalesce(F.size(e["cells"]), F.lit(0)) <= 0) & (F.coalesce(e["url"], F.lit("")) != ""))

    def shown(parts: Column) -> Column:
        one = lambda p: F.array_compact(F.array(F.when(p["caption"] != "", F.concat(F.lit("### "), p["caption"])), cells_table(F.transform(p["rows"], lambda e: e["cells"]))))
        return F.flatten(F.transform(parts, one))

    def listed(rows: Column) -> Column:
        def one(e: Column) -> Column:
            label, url = escape(F.coalesce(e["label"], F.lit(""))), T.strip(e["url"])
            return F.when((label != "") & (url != ""), F.concat(F.lit("- "), label, F.lit(" ("), url, F.lit(")"))).when(label != "", F.concat(F.lit("- "), label))

        more = F.when(F.size(rows) > most, F.concat(F.lit("- … and "), (F.size(rows) - most).cast("string"), F.lit(" more linked items")))
        return F.when(F.size(rows) > 0, F.array_compact(F.concat(F.array(F.lit("### Linked items")), F.transform(F.slice(rows, 1, most), one), F.array(more)))).otherwise(_none())

    made = F.concat(_bind(tables, lambda t: F.coalesce(_bind(captioned(t), shown), _none())), _bind(links, listed))
    return F.coalesce(T.strip(F.array_join(made, "\n\n")), F.lit(""))


def entities_lines(entities: Column) -> Column:
    """Entities one a line, cells and fields apart by pipes, captions before their rows."""
    cell = lambda c: T.strip(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|")))

    def of(known: Column) -> Column:
        def one(e: Column, i: Column) -> Column:
            caption = F.coalesce(e["caption"], F.lit(""))
            fresh = (caption != "") & ((i == 0) | (caption != F.get(known, i - 1)))
            row = F.array_join(F.transform(e["cells"], cell), " | ")
            plain = F.array_join(F.array_compact(F.array(cell(e["label"]), cell(e["entity_type"]), F.when(cell(e["url"]) != "", cell(e["url"])))), " | ")
            return F.when(F.coalesce(F.size(e["cells"]), F.lit(0)) > 0, F.concat(F.when(fresh, F.array(F.lit(""), F.concat(F.lit("Table: "), caption))).otherwise(_none()), F.array(row))).otherwise(F.array(plain))

        return F.array_join(F.flatten(F.transform(entities, one)), "\n")

    has_cells = lambda y: (F.coalesce(F.size(y["cells"]), F.lit(0)) > 0) & (F.coalesce(y["caption"], F.lit("")) != "")
    seen = F.transform(entities, lambda x, i: F.coalesce(F.try_element_at(F.filter(F.slice(entities, F.lit(1), i + 1), has_cells), F.lit(-1))["caption"], F.lit("")))
    return F.coalesce(T.strip(_bind(seen, of)), F.lit(""))


def bullets_of(fields: list[tuple[str, Column]]) -> Column:
    """``- **name:** value`` lines of the fields that are neither null nor empty."""
    said = [F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f"- **{k}:** "), v.cast("string"))) for k, v in fields]
    return F.array_join(F.array_compact(F.array(*said)), "\n")
