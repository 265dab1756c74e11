"""Quality rules: an ordered list of threshold rules learned by sequential covering, applied as Spark conditions.

Rules say which texts to drop. Each is a conjunction of thresholds on a text's statistics; it is grown
condition by condition for the highest FOIL gain on one part of the labelled rows and pruned from its end on
the other part (RIPPER's grow and prune; Cohen, 1995). Texts that a rule covers are set aside and the next rule is
learned from the rest, until a rule's precision on the pruning part is too low. The list becomes one ordered CASE
expression: the first rule that holds decides, and no rule means keep.

Statistics: the contract's counts of words, code points, symbols, duplicate lines and repeated words, and a few
counts of characters and short forms; all are built-in functions over one row, so a table is one scan without a
shuffle. Learning runs on the driver over a bounded sample of labelled rows (``SAMPLE``).

``n_repeat_words`` counts words inside a 3-word window that the text holds twice or more. A window is known by
the upper bits of its 64-bit hash, its place by the lower ones, so one sort of longs in the row brings equal windows
together; how many bits a place takes follows from the text's length.

Defined cases: null texts have no words and fail the base rule; ``kept`` is never null; repeated rows get a row
each; an empty table gives an empty result; without labelled rows of both kinds the list is empty.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .quality import sampled_labels

SAMPLE, MIN_PRECISION, MIN_COVER, MAX_RULES, MAX_CONDITIONS = 3000, 0.8, 5, 16, 4
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_bangs", "n_pipes", "n_lines")
FEATURES = ("symbols_per_word", "word_length", "dup_lines_per_line", "repeat_share", "upper_share", "digit_share", "bangs_per_word", "pipes_per_word", "words_per_line", "n_words")


# --- statistics -----------------------------------------------------------------------------------


def _chars(text: str, keep: str) -> str:
    """SQL of the number of characters of ``text`` that are in ``keep``."""
    return f"(char_length({text}) - char_length(translate({text}, '{keep}', '')))"


def repeat_words(words: str) -> str:
    """SQL of the words inside 3-word windows that occur twice or more, for an array column of words."""
    n = f"size({words})"
    bits = f"greatest(8, cast(ceil(log2({n} + 1)) as int))"
    # Upper bits: the window; lower bits: its place.
    tagged = f"transform(sequence(0, {n} - 3), i -> (shiftleft(shiftright(xxhash64({words}[i], {words}[i + 1], {words}[i + 2]), {bits}), {bits}) | cast(i as bigint)))"
    places = (
        f"transform(array(sort_array({tagged})), s -> transform(filter(s, (x, k) -> (k > 0 and shiftright(s[k - 1], {bits}) = shiftright(x, {bits}))"
        f" or (k < size(s) - 1 and shiftright(s[k + 1], {bits}) = shiftright(x, {bits}))), x -> x & (shiftleft(1L, {bits}) - 1)))[0]"
    )
    covered = f"size(array_distinct(flatten(transform({places}, p -> array(p, p + 1, p + 2)))))"
    return f"case when {n} < 4 then 0L else cast({covered} as bigint) end"


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``STATS`` of each row."""
    d = common.ids_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    d = d.withColumn("words", F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"))
    d = d.withColumn("full", F.expr(r"filter(split(text, '\n'), l -> rlike(l, '[^\\x20\\x09-\\x0D]'))"))
    return d.select(
        "doc_id",
        F.expr("cast(size(words) as bigint)").alias("n_words"),
        F.expr("cast(char_length(array_join(words, '')) as bigint)").alias("word_chars"),
        F.expr(f"cast({_chars('text', '#*$%&|<>')} as bigint)").alias("n_symbols"),
        F.expr("cast(size(full) - size(array_distinct(full)) as bigint)").alias("n_dup_lines"),
        F.expr(repeat_words("words")).alias("n_repeat_words"),
        F.expr(f"cast({_chars('text', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')} as bigint)").alias("n_upper"),
        F.expr(f"cast({_chars('text', '0123456789')} as bigint)").alias("n_digits"),
        F.expr(f"cast({_chars('text', '!')} as bigint)").alias("n_bangs"),
        F.expr(f"cast({_chars('text', '|')} as bigint)").alias("n_pipes"),
        F.expr("cast(size(full) as bigint)").alias("n_lines"),
    )


def features() -> dict[str, Column]:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    made = (per("n_symbols", "n_words"), per("word_chars", "n_words"), per("n_dup_lines", "n_lines"), per("n_repeat_words", "n_words"), per("n_upper", "word_chars"), per("n_digits", "word_chars"), per("n_bangs", "n_words"), per("n_pipes", "n_words"), per("n_words", "n_lines"), F.col("n_words").cast("double"))
    return dict(zip(FEATURES, made, strict=True))


# --- learning -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self, columns: dict[str, Column]) -> Column:
        c = columns[self.feature]
        return c > self.threshold if self.above else c <= self.threshold


Rule = tuple[Condition, ...]


def _covers(rule: Rule, row: dict) -> bool:
    return all(c.holds(row) for c in rule)


def _cuts(values: list[float], most: int = 32) -> list[float]:
    """Thresholds between distinct values, at most ``most`` of them, spread over the values' ranks."""
    v = sorted(values)
    step = max(1, len(v) // most)
    return sorted({(v[k] + v[k - 1]) / 2 for k in range(1, len(v)) if v[k] != v[k - 1] and (k % step == 0 or v[k] - v[k - 1] > 0.02 * (v[-1] - v[0]))})


def _grow(rows: list[tuple[dict, bool]]) -> Rule:
    rule: list[Condition] = []
    inside = rows
    while len(rule) < MAX_CONDITIONS:
        p, n = sum(bad for _, bad in inside), len(inside)
        if p == n or p == 0:
            break
        base = math.log2(p / n)
        best, best_gain, best_rows = None, 1e-9, inside
        for f in FEATURES:
            for cut in _cuts([r[f] for r, _ in inside]):
                for above in (True, False):
                    c = Condition(f, above, cut)
                    left = [x for x in inside if c.holds(x[0])]
                    q = sum(bad for _, bad in left)
                    if q and (gain := q * (math.log2(q / len(left)) - base)) > best_gain:
                        best, best_gain, best_rows = c, gain, left
        if best is None:
            break
        rule.append(best)
        inside = best_rows
    return tuple(rule)


def _prune(rule: Rule, rows: list[tuple[dict, bool]]) -> Rule:
    """The front part of the rule with the best (p - n) / (p + n); ties: the shorter one."""
    def value(r: Rule) -> float:
        got = [bad for x, bad in rows if _covers(r, x)]
        return (2 * sum(got) - len(got)) / len(got) if got else -1.0
    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (round(value(r), 9), -len(r)), default=())


def learn(rows: list[tuple[dict, bool]]) -> list[Rule]:
    """Rules for the rows marked True, by sequential covering; every third row prunes."""
    rules: list[Rule] = []
    left = list(rows)
    while len(rules) < MAX_RULES and any(bad for _, bad in left):
        grow, prune = [x for i, x in enumerate(left) if i % 3], left[::3]
        rule = _grow(grow)
        rule = _prune(rule, prune) or rule
        if not rule:
            break
        covered = [bad for x, bad in left if _covers(rule, x)]
        checked = [bad for x, bad in prune if _covers(rule, x)]
        if len(covered) < MIN_COVER or sum(covered) < MIN_PRECISION * len(covered) or (checked and sum(checked) < MIN_PRECISION * len(checked)):
            break
        rules.append(rule)
        left = [x for x in left if not _covers(rule, x[0])]
    return rules


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """Rules from a bounded sample of labelled rows, one an id (the least statistics of several); rows whose crc32(id) mod 4 is 2 stay out."""
    few = F.broadcast(sampled_labels(labels, id_col, label_col, sample))
    some = common.ids_and_text(docs, id_col, text_col).join(few, "doc_id", "left_semi")
    one = statistics(some).groupBy("doc_id").agg(F.min(F.struct(*STATS)).alias("s")).select("doc_id", "s.*")
    rows = one.join(few, "doc_id").select("doc_id", (F.col("label") == 0).alias("bad"), *[c.alias(k) for k, c in features().items()]).collect()
    return learn([(r.asDict(), r.bad) for r in sorted(rows, key=lambda r: r.doc_id)])


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """Keep or not, and the number (from 1) of the rule that dropped the text, 0 without one."""
    columns = features()
    number = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        together = F.lit(True)
        for c in rule:
            together = together & c.column(columns)
        number = F.when(together, k).otherwise(number)
    return number == 0, number.cast("int")


def apply(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    kept, number = verdict(rules)
    out = statistics(docs, id_col, text_col).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & kept).alias("kept"), number.alias("rule"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", spread=True)
    return apply(docs, fit(docs, common.table(spark, sf_dir, "labels")))
