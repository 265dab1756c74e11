"""Column functions over task texts: boundary sentences, rubric cells, bold values, bullets. All run in the JVM.

Null texts give null results; a text without the part asked for gives null (a sentence) or the text itself (a removal).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, bind, drop_first_sentence, flatten, splice_first, strip

# Fixed values of the data model.
DIMENSIONS = ["coverage", "accuracy", "reasoning", "use_of_evidence", "clarity_and_structure"]
LABELLED_EN = r"(?s)(?:Methodological trap|Boundary trap)\s*:\s*([Dd]istinguish\b.*?)(?=\s+Return\s*:|\s*$)"
NEUTRAL_EN = r"(?s)(Distinguish\b.*?)(?=\s+Return\s*:|\s*$)"
RETURN_RU = r"(?:Результат|Итог|Итоги|Возврат|Возвращаемое значение|Вывод|Верните)\s*:"
MARKER_RU = r"(?iU)(?:ловушк\w*|ошибк\w*)\s*:"
NEUTRAL_RU = r"(?U)Различа\w*\b"
RUBRIC_HEADER = r"\*\*([^*]{3,60}?)\*\*(?=\s*-\s*2\s*:)"
RUBRIC_LEVEL = r"(?:^|\s)-\s*([012])\s*:"
BOLD = r"\*\*([^*]+)\*\*"


def _found(c: Column, pattern: str, group: int) -> Column:
    """A group of the first match; null without one (``regexp_extract`` alone gives an empty text)."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2**31 - 1))


# --- boundary sentences ---------------------------------------------------------------------------


def sentence_en(prompt: Column) -> Column:
    """(sentence, body) of the boundary sentence, labelled before neutral; null without one."""
    found = F.struct(*[F.coalesce(_found(prompt, LABELLED_EN, k), _found(prompt, NEUTRAL_EN, k)).alias(n) for k, n in enumerate(("sentence", "body"))])
    return bind(found, lambda f: F.when(f["sentence"].isNotNull(), F.struct(strip(f["sentence"]).alias("sentence"), strip(f["body"]).alias("body"))))


def sentence_ru(prompt: Column) -> Column:
    """As ``sentence_en``: from the sentence's start to the return clause, or else to the next full stop."""
    def marked(x: Column) -> Column:
        return F.struct(x["p"].alias("p"), x["label"].alias("label"), F.coalesce(x["label"], F.regexp_substr(x["p"], F.lit(NEUTRAL_RU))).alias("mark"))

    def cut(m: Column) -> Column:
        at = F.instr(m["p"], m["mark"])
        start = F.substring_index(F.left(m["p"], at - 1), ". ", -1)
        rest = F.right(m["p"], F.length(m["p"]) - at - F.length(m["mark"]) + 1)

        def bounded(r: Column) -> Column:
            back, stop = F.regexp_instr(r["rest"], F.lit(RETURN_RU)), F.instr(r["rest"], F.lit("."))
            end = F.when(back > 0, F.left(r["rest"], back - 1)).when(stop > 0, F.left(r["rest"], stop)).otherwise(r["rest"])
            return bind(F.struct(strip(F.concat(r["start"], m["mark"], end)).alias("whole"), strip(end).alias("end")), lambda x: F.struct(x["whole"].alias("sentence"), F.when(m["label"].isNull(), x["whole"]).otherwise(x["end"]).alias("body")))

        return F.when(m["mark"].isNotNull(), bind(F.struct(start.alias("start"), rest.alias("rest")), bounded))

    return bind(bind(F.struct(prompt.alias("p"), F.regexp_substr(prompt, F.lit(MARKER_RU)).alias("label")), marked), cut)


def _neutral(prompt: Column, found: Column, labelled: Column) -> Column:
    """The prompt with a labelled sentence replaced by its body, first letter upper; any other prompt unchanged."""
    put = lambda x: F.when(x["f"].isNotNull(), splice_first(x["p"], x["f"]["sentence"], _capital(x["f"]["body"]))).otherwise(x["p"])
    return F.when(labelled, bind(F.struct(prompt.alias("p"), found.alias("f")), put)).otherwise(prompt)


def neutral_en(prompt: Column) -> Column:
    return _neutral(prompt, sentence_en(prompt), prompt.rlike(LABELLED_EN))


def neutral_ru(prompt: Column) -> Column:
    return _neutral(prompt, sentence_ru(prompt), prompt.rlike(MARKER_RU))


def drop_scope(c: Column) -> Column:
    """The text without the first sentence that names the scope column."""
    return drop_first_sentence(c, "source_scope")


# --- rubric cells ---------------------------------------------------------------------------------


def rubric(cell: Column) -> Column:
    """(prefix, blocks of header, sep, body, tail): joined in order they are the cell, character for character."""
    n = F.size(F.regexp_extract_all(cell, F.lit(RUBRIC_HEADER), F.lit(1)))
    parts = F.split(cell, rf"(?={RUBRIC_HEADER})")
    first = F.size(parts) - n
    raw = lambda x: F.regexp_replace(x, r"(?s)^\*\*[^*]*\*\*", "")
    block = lambda x: F.struct(F.regexp_extract(x, RUBRIC_HEADER, 1).alias("header"), F.regexp_extract(raw(x), r"^(\s*)", 1).alias("sep"), strip(raw(x)).alias("body"), F.regexp_extract(raw(x), r"(\s*)\z", 1).alias("tail"))
    blocks = F.when(n > 0, F.transform(F.slice(parts, first + 1, F.greatest(n, F.lit(1))), block)).otherwise(F.filter(F.transform(parts, block), lambda x: F.lit(False)))
    return F.struct(F.when((n > 0) & (first == 0), "").otherwise(F.get(parts, F.lit(0))).alias("prefix"), blocks.alias("blocks"))


def rubric_bodies(cell: Column) -> Column:
    """Map of dimension to body, by position; null unless there are as many blocks as dimensions."""
    blocks = rubric(cell)["blocks"]
    return F.when(F.size(blocks) == len(DIMENSIONS), F.map_from_arrays(F.array(*map(F.lit, DIMENSIONS)), F.transform(blocks, lambda x: x["body"])))


def compose(cell: Column, bodies: Column) -> Column:
    """The cell with the bodies of this map put in; null unless there are as many blocks as dimensions.

    New bodies are flattened in a cell of one line and stripped in others.
    """
    parsed = rubric(cell)
    names = F.array(*map(F.lit, DIMENSIONS))

    def render(x: Column, i: Column) -> Column:
        new = F.element_at(bodies, F.get(names, i))
        new = F.when(F.contains(cell, F.lit("\n")), strip(new)).otherwise(flatten(new))
        return F.concat(F.lit("**"), x["header"], F.lit("**"), x["sep"], F.coalesce(new, x["body"]), x["tail"])

    return F.when(F.size(parsed["blocks"]) == len(DIMENSIONS), F.concat(parsed["prefix"], F.array_join(F.transform(parsed["blocks"], render), "")))


def must_have_bodies(cell: Column) -> Column:
    """As ``rubric_bodies``; an error where the number of blocks is another."""
    n = F.size(rubric(cell)["blocks"])
    wrong = F.raise_error(F.concat(F.lit(f"expected {len(DIMENSIONS)} rubric blocks, found "), n.cast("string"))).cast("map<string,string>")
    return F.when(n == len(DIMENSIONS), rubric_bodies(cell)).otherwise(wrong)


def levels(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(RUBRIC_LEVEL), F.lit(1))


# --- values and lists -----------------------------------------------------------------------------


def bold(*cells: Column) -> Column:
    """Bold values of the cells in order, the first of those that differ in case or white space only."""
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(BOLD), F.lit(1)), strip) for c in cells]))
    same = lambda x: F.lower(flatten(x))
    keys = F.transform(found, same)
    return F.filter(found, lambda x, i: (same(x) != "") & (F.array_position(keys, same(x)) == i + 1))


def bullets(items: Column) -> Column:
    """Lines ``- item`` of the items that are not blank."""
    clean = F.transform(F.filter(items, lambda x: strip(x) != ""), lambda x: F.concat(F.lit("- "), strip(F.regexp_replace(strip(x), "^-+", ""))))
    return F.array_join(F.coalesce(clean, F.array().cast("array<string>")), "\n")


def append_bullets(cell: Column, items: Column) -> Column:
    new = bullets(items)
    return F.when(new == "", cell).when(strip(cell) == "", new).otherwise(F.concat(F.regexp_replace(cell, f"[{SPACE}]+\\z", ""), F.lit("\n"), new))


def has_word(text: Column, word: Column) -> Column:
    """Whether ``word`` is in ``text`` between characters that no word has."""
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
    return F.regexp_like(text, quoted)


def quoted(c: Column) -> Column:
    """A text as Python shows it: in single quotes, or in double ones where it holds single ones alone."""
    plain = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    double = plain.contains("'") & ~plain.contains('"')
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def listed(items: Column) -> Column:
    """Texts as Python shows a list of them."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
