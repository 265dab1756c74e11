"""Column functions over text: cleaning, noise, headings, names and numbers. All run in the JVM.

White space is the set that Python strips (``SPACE``), lines end where Python's ``splitlines`` ends them. Null texts give
null results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
PAGE_MARKER = r"(?iU)^(?:[-–—\s]*)?(?:page\s*)?\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?(?:[-–—\s]*)?$"
PAGE_DASHES = r"(?iU)^--\s*\d{1,4}\s+of\s+\d{1,4}\s*--$"
PAGE_BRACKETS = r"(?iU)^\[\s*page\s+\d{1,4}\s*\]$"
PDF_FOOTER = r"(?U)^[\W_]*\d{1,4}\s*[|]\s*.*$|^.*[|]\s*\d{1,4}[\W_]*$"
SECTION = r"(?U)^(\d+(?:\.\d+)*)\.\s+(.+)$"
CHAPTER = r"(?U)^chapter\s+\d"
GIVEAWAY_EN = r"(?i)\b(trap|trick|pitfall|beware|careful|caution|gotcha)\b"
GIVEAWAY_RU = r"(?i)ловушк|подвох|ошибочн|осторожн"
SCOPE = r"[^.\s][^.]*`?source_scope`?[^.]*\.\s*"

#: Inside of a character class: what Python's ``str.strip`` and ``\s`` take for white space. Latin-1 ones stand alone and the others
#: behind one range, as the matcher tests a bit for those and a range for these.
SPACE = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
#: The same characters.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: A run of white space that is not one plain space.
_WIDE = rf"(?:[{SPACE.replace(' ', '', 1)}]| (?=[{SPACE}]))[{SPACE}]*"
#: A run of blanks (spaces, tabs, no-break spaces) that is not one plain space.
_BLANKS = r"(?:[\t\u00a0]| (?=[ \t\u00a0]))[ \t\u00a0]*"
OTHER_END = r"[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def bind(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def flatten(c: Column) -> Column:
    """Runs of white space as one space, ends stripped."""
    return F.trim(F.regexp_replace(c, _WIDE, " "))


def squeeze(c: Column) -> Column:
    """A line without byte-order marks and soft hyphens, runs of spaces, tabs and no-break spaces as one space, ends stripped."""
    return strip(F.regexp_replace(F.replace(F.replace(c, F.lit("\ufeff"), F.lit("")), F.lit("\u00ad"), F.lit("")), _BLANKS, " "))


def spaces(c: Column) -> Column:
    """A text with private-use bullets as signs, line ends as \\n, runs of blanks in a line as one, lines stripped."""
    signs = c
    for bullet, sign in (("\uf0fc", "-"), ("\uf0b7", "-"), ("\uf07c", "|")):
        signs = F.replace(signs, F.lit(bullet), F.lit(sign))
    return F.array_join(F.transform(splitlines(signs), lambda x: strip(F.regexp_replace(x, _BLANKS, " "))), "\n")


def line_ends(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("\r")), F.regexp_replace(c, "\r\n?", "\n")).otherwise(c)


def join_hyphens(c: Column) -> Column:
    """Line ends as \\n, then words cut by a hyphen at a line end joined."""
    return bind(line_ends(c), lambda x: F.when(F.contains(x, F.lit("-\n")), F.regexp_replace(x, r"(?U)(\w)-\n(\w)", "$1$2")).otherwise(x))


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def splitlines(c: Column) -> Column:
    """Lines without their ends; a last end makes no further line, an empty text has none."""
    parts = F.when(F.rlike(c, F.lit(OTHER_END)), F.split(c, LINE_END)).otherwise(F.split(c, "\n"))
    return bind(parts, lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, F.lit(1), F.size(x) - 1)).otherwise(x))


def is_page_noise(line: Column) -> Column:
    """Page numbers and footers; never a blank line. All have a digit, which most lines have not."""
    def of(s: Column) -> Column:
        n = F.length(s)
        return ((n <= 20) & s.rlike(PAGE_MARKER)) | s.rlike(PAGE_DASHES) | s.rlike(PAGE_BRACKETS) | ((n <= 180) & s.rlike(PDF_FOOTER))

    return F.when(line.rlike(r"\p{Nd}"), bind(strip(line), of)).otherwise(False)


def is_upper(line: Column) -> Column:
    """At least one letter with a case, and no lower-case letter."""
    return (F.upper(line) == line) & (F.lower(line) != line)


def upper_share(line: Column) -> Column:
    """Capitals among letters; null without a letter."""
    return F.try_divide(F.regexp_count(line, F.lit(r"\p{Lu}")), F.regexp_count(line, F.lit(r"\p{L}")))


def n_words(line: Column) -> Column:
    flat = flatten(line)
    return F.when(flat == "", 0).otherwise(F.size(F.split(flat, " ")))


def heading_level(line: Column) -> Column:
    """Depth of a numbered section plus one, at most 4; 2 for a short line of capitals; 3 for one that ends in a colon; else 0."""
    number = F.regexp_extract(line, SECTION, 1)
    capitals = F.length(line).between(3, 100) & (upper_share(line) > 0.8) & (n_words(line) <= 12)
    return (
        F.when(number != "", F.least(F.size(F.split(number, r"\.")) + 1, F.lit(4)))
        .when(F.coalesce(capitals, F.lit(False)), 2)
        .when(line.endswith(":") & (F.length(line) <= 100), 3)
        .otherwise(0)
    )


def looks_like_heading(line: Column) -> Column:
    """At most 120 characters and a colon at the end, or over three quarters capitals."""
    return (F.length(line) <= 120) & (line.endswith(":") | F.coalesce(upper_share(line) > 0.75, F.lit(False)))


def looks_like_table_line(line: Column) -> Column:
    return line.contains("\t") | line.contains("|") | (wide_gaps(line) >= 2)


def wide_gaps(line: Column) -> Column:
    """Runs of two or more white spaces."""
    return F.regexp_count(line, F.lit(f"[{SPACE}]{{2,}}"))


def n_pipes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))


def stem(file_name: Column) -> Column:
    """A file name without extension, runs of other characters than ASCII letters and digits as one underscore, ends stripped."""
    return F.trim(F.regexp_replace(F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", ""), "[^A-Za-z0-9]+", "_"), F.lit("_"))


def slug(c: Column, most: int = 80) -> Column:
    """As ``stem`` of any text, cut at ``most`` characters; "untitled" where nothing is left."""
    cut = F.left(F.trim(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), F.lit("_")), F.lit(most))
    return F.when(cut == "", "untitled").otherwise(cut)


def head_tail(c: Column, head: int = 10_000, tail: int = 5_000) -> Column:
    """A text longer than both together as its head, a mark with the number of characters left out, and its tail."""
    mark = F.concat(F.lit("\n\n[... "), F.format_number(F.length(c) - head - tail, 0), F.lit(" chars omitted ...]\n\n"))
    return F.when(F.length(c) > head + tail, F.concat(F.substring(c, 1, head), mark, F.right(c, F.lit(tail)))).otherwise(c)


def truthy(*options: Column) -> Column:
    """The first that is neither null nor empty; else an empty text."""
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options], F.lit(""))


def numbers(c: Column) -> Column:
    """Numbers of at least two digits, with a decimal point."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"(\d+(?:[.,]\d+)?)"), 1), lambda x: F.translate(x, ",", "."))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: F.length(F.regexp_replace(x, r"[^0-9]", "")) >= 2)))


def terms(c: Column) -> Column:
    """Distinct lower-case words of four letters or more."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{4,})"), 1)))


def distinctions(c: Column) -> Column:
    """Parts of a "distinguish a, b and c" clause that are longer than two characters."""
    body = F.regexp_replace(F.regexp_replace(c, r"(?i)^\s*distinguish(?:\s+between)?\s*", ""), r"(?iU)^\s*различ\w*\s*", "")
    body = F.regexp_replace(body, r"[ .]+$", "")
    return F.size(F.filter(F.split(body, r"(?U);|,|\band\b|\bи\b"), lambda x: F.length(strip(x)) > 2))


def judge_scores(reply: Column, dimensions: dict[str, str]) -> Column:
    """For each dimension (field: name) the first 0, 1 or 2 that stands alone on the last line that begins with its name and has one; else null."""
    def one(ls: Column, name: str) -> Column:
        found = F.filter(ls, lambda x: F.lower(x).startswith(name.lower()) & x.rlike(r"(?U)\b[012]\b"))
        return F.regexp_extract(F.try_element_at(found, F.lit(-1)), r"(?U)\b([012])\b", 1).cast("int")

    return bind(splitlines(strip(reply)), lambda ls: F.struct(*[one(ls, name).alias(field) for field, name in dimensions.items()]))


def judge_score(reply: Column, dimension: str) -> Column:
    return judge_scores(reply, {"score": dimension})["score"]


def url_key(url: Column) -> Column:
    """A URL without fragment; a scheme where it begins with two slashes, the wiki's host where it begins with its path. Null is empty."""
    s = strip(F.coalesce(url, F.lit("")))
    whole = F.when(s.startswith("//"), F.concat(F.lit("https:"), s)).when(s.startswith("/wiki/"), F.concat(F.lit("https://en.wikipedia.org"), s)).otherwise(s)
    return F.substring_index(whole, "#", 1)


def splice_first(text: Column, old: Column, new: Column) -> Column:
    """``text`` with the first place of ``old`` replaced; as it is where ``old`` is nowhere (``must_splice`` raises)."""
    at = F.instr(text, old)
    return F.when((at > 0) & (F.length(old) > 0), F.concat(F.left(text, at - 1), new, F.right(text, F.length(text) - at - F.length(old) + 1))).otherwise(text)


def must_splice(text: Column, old: Column, new: Column) -> Column:
    """As ``splice_first``; an error where ``old`` is nowhere."""
    return F.when(F.instr(text, old) > 0, splice_first(text, old, new)).otherwise(F.raise_error(F.lit("old sentence not found in prompt")).cast("string"))


def drop_first_sentence(text: Column, token: str) -> Column:
    """``text`` without the first sentence (up to a full stop and the white space after it) that holds ``token``, stripped.

    Found by search, not by a pattern over the whole text: the token, the full stop before it and the one after it. A
    sentence that has no character before the token, or no full stop after it, stays; then the next token's counts.
    """
    def without(pieces: Column) -> Column:
        # pieces: the text between full stops; one with a token, a character before it and a full stop after it goes
        last = F.size(pieces) - 1
        holds = lambda x: F.locate(token, F.regexp_replace(x, f"^[{SPACE}]+", ""), 2) > 0
        at = F.array_position(F.transform(pieces, lambda x, i: holds(x) & (i < last)), True).cast("int")
        lead = F.regexp_extract(F.get(pieces, at - 1), f"^[{SPACE}]*", 0)
        before = F.concat(F.slice(pieces, F.lit(1), F.greatest(at - 1, F.lit(0))), F.array(lead))
        after = F.regexp_replace(F.array_join(F.slice(pieces, at + 1, F.greatest(F.size(pieces) - at, F.lit(0))), "."), f"^[{SPACE}]+", "")
        return F.when(at > 0, strip(F.concat(F.array_join(before, "."), after))).otherwise(text)

    return F.when(F.contains(text, F.lit(token)), bind(F.split(text, r"\."), without)).otherwise(text)
