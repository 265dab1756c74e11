"""Benchmark decontamination by the q-gram lemma: filter by counts in diagonal bands, verify by banded alignment.

Texts and benchmark items are normalised alike: lower case, runs of ASCII white space become one
space, ends trimmed. An item P occurs in a text if some substring of it is within e(P) = ``edits`` * |P|
edits of P, rounded down. Such an occurrence keeps at least |P| + 1 - q (e + 1) of P's q-grams (Jokinen and
Ukkonen, 1991), and they lie on diagonals (place in the text minus place in P) that differ by e at most.
An item too short for that bound to say anything at ``q`` is looked for by the longest q-grams at which
it does, |P| / (e + 1); an item under ``q`` characters so is its own only q-gram, and has to stand there as
whole words, as a few letters are part of many words. Diagonals are cut into bands 2 (e + 1) wide that begin
every e + 1, so some band holds them all; bands with fewer shared q-grams are dropped without a look at
the text, the rest is verified by an alignment inside the band, so no occurrence within the budget is missed.

How: the items are the query set. They are read in blocks of at most ``block_chars`` characters; each
block's q-gram index (its size is so bounded) goes to the tasks and every text passes it once, whole, in
one scan without a shuffle. With several blocks rows are written once with a row number; each block writes
the few rows it finds, and they come together by that number: the driver holds one block at a time.

Result: a row per row of the table: ``doc_id``, ``contaminated``, ``n_items``, ``item_ids`` (ascending).
Defined cases: null and empty texts are clean; null items and items of white space alone are no items;
equal items are each reported; an empty benchmark or table gives all clean or an empty result; repeated
rows give a row each.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

Q, EDITS, BLOCK_CHARS = 10, 0.08, 8_000_000
_BITS = 20
_C = 0x9E3779B97F4A7C15
_ITEMS = "item_ids array<long>"
_SCHEMA = f"doc_id long, {_ITEMS}"


def normal(text: str) -> str:
    return " ".join(x for x in text.lower().translate(dict.fromkeys(range(9, 14), " ")).split(" ") if x)


def budget(length: int, edits: float) -> int:
    return int(edits * length)


def gram(length: int, q: int, edits: float) -> int:
    """Length of the q-grams by which an item is looked for."""
    return min(q, length // (budget(length, edits) + 1))


def _qgrams(points: np.ndarray, q: int) -> np.ndarray:
    """Hash of each window of q code points, by doubling."""
    if len(points) < q:
        return np.zeros(0, np.uint64)
    have, width = points.astype(np.uint64) + np.uint64(1), 1
    out, size = None, 0
    while width <= q:
        if q & width:
            if out is None:
                out, size = have, width
            else:  # the window so far, then the next ``width`` points
                n = len(points) - (size + width) + 1
                out = out[:n] * np.uint64(pow(_C, width, 1 << 64)) + have[size : size + n]
                size += width
        n = len(points) - 2 * width + 1
        if n > 0 and 2 * width <= q:
            have = have[:n] * np.uint64(pow(_C, width, 1 << 64)) + have[width : width + n]
        width *= 2
    return common.mix(out)


class Index:
    """q-grams of a block of items: an ``OneLength`` for each length of q-grams (one, but for short items)."""

    def __init__(self, items: list[tuple[int, str]], q: int, edits: float):
        kept = [(i, n) for i, t in items if (n := normal(t))]
        self.parts = [OneLength([x for x in kept if gram(len(x[1]), q, edits) == k], k, edits, q) for k in sorted({gram(len(n), q, edits) for _, n in kept})]

    def search_all(self, texts: list[str], small: int = 1 << 20) -> list[list[int]]:
        """The ids of the items that occur in each text (lower case, not null), ascending; in parts of bounded size."""
        out, part, size = [], [], 0

        def search():
            each = [p.search(part) for p in self.parts]
            return [sorted(itertools.chain(*found)) for found in zip(*each, strict=True)] if each else [[] for _ in part]

        for t in texts:
            part.append(t.replace("\0", " "))
            size += len(t)
            if size >= small:
                out += search()
                part, size = [], 0
        out += search() if part else []
        common.trim()
        return out


class OneLength:
    """Items, in normal form, by q-grams of one length; those of under ``words`` characters occur as whole words."""

    def __init__(self, items: list[tuple[int, str]], q: int, edits: float, words: int):
        self.q, self.words, self.ids, self.texts = q, words, [i for i, _ in items], [n for _, n in items]
        self.points = [np.frombuffer(n.encode("utf-32-le"), np.uint32) for n in self.texts]
        self.e = np.array([budget(len(n), edits) for n in self.texts], np.int64)
        self.need = np.array([len(n) + 1 - q * (e + 1) for n, e in zip(self.texts, self.e, strict=True)], np.int64)
        grams = [_qgrams(p, q) for p in self.points]
        keys = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        at = np.argsort(keys, kind="stable")
        self.keys, self.item, self.place = keys[at], item[at], place[at]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def search(self, texts: list[str]) -> list[list[int]]:
        """For each text (lower case, not null), the ids of the items that occur in it."""
        points = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le"), np.uint32)
        white = (points == 32) | ((points >= 9) & (points <= 13))
        points = np.where(white, np.uint32(32), points)
        keep = ~white
        keep[:-1] |= white[:-1] & ~white[1:] & (points[1:] != 0)  # the last of a run stays ...
        if len(points) > 1:  # ... but not at a text's start
            run_start = np.flatnonzero(~white)
            before = np.concatenate(([0], points[run_start][:-1]))  # what stands before each non-space, spaces left out
            lead = run_start[(before == 0) & (run_start > 0)]
            lead = lead[white[lead - 1]]
            keep[lead - 1] = False
        points = points[keep]
        edges = np.concatenate(([0], np.flatnonzero(points == 0) + 1))
        found: list[list[int]] = [[] for _ in texts]
        grams = _qgrams(points, self.q)
        at = np.flatnonzero(self.seen[(grams >> np.uint64(64 - _BITS)).astype(np.int64)])
        lo = np.searchsorted(self.keys, grams[at], side="left")
        many = np.searchsorted(self.keys, grams[at], side="right") - lo
        at, lo, many = at[many > 0], lo[many > 0], many[many > 0]
        if not len(at):
            return found
        hit = np.repeat(lo, many) + (np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many))
        where = np.repeat(at, many)
        item, doc = self.item[hit], np.searchsorted(edges, where, side="right") - 1
        step = self.e[item] + 1
        band = (where - self.place[hit] - edges[doc] + 2 * len(points)) // step  # never negative
        who = doc.astype(np.int64) * len(self.ids) + item
        who, band = np.concatenate((who, who)), np.concatenate((band, band - 1))
        order = np.lexsort((band, who))
        who, band = who[order], band[order]
        new = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (band[1:] != band[:-1]))))
        count = np.diff(np.append(new, len(who)))
        done = set()
        for k in new[count >= self.need[who[new] % len(self.ids)]]:
            pair = int(who[k])
            if pair in done:
                continue
            d, i = divmod(pair, len(self.ids))
            e = int(self.e[i])
            first = int(band[k]) * (e + 1) - 2 * len(points)
            text = points[edges[d] : edges[d + 1] - 1]
            if len(self.texts[i]) < self.words:
                hit = _as_words(self.texts[i], text.tobytes().decode("utf-32-le"))
            else:
                hit = within(self.points[i], text, first, first + 2 * (e + 1) - 1, e)
            if hit:
                done.add(pair)
                found[d].append(self.ids[i])
        return found


def _as_words(item: str, text: str) -> bool:
    """Whether ``item`` is in ``text`` with no letter or digit right before or after it."""
    at = text.find(item)
    while at >= 0:
        end = at + len(item)
        if not (text[at - 1 : at] if at else "").isalnum() and not text[end : end + 1].isalnum():
            return True
        at = text.find(item, at + 1)
    return False


def within(item: np.ndarray, text: np.ndarray, low: int, high: int, e: int) -> bool:
    """Whether a substring of ``text`` is within ``e`` edits of ``item`` by an alignment on diagonals ``low - e`` to ``high + e``."""
    low, high = low - e, high + e
    width = high - low + 1
    padded = np.concatenate((np.zeros(max(0, -low), np.uint32), text[max(0, low) : max(0, high + len(item) + 1)]))
    padded = np.concatenate((padded, np.zeros(max(0, len(item) + width - len(padded)), np.uint32)))
    steps = np.arange(width)
    row = np.zeros(width, np.int64)  # row i, column j: i characters of the item against a text that ends at low + i + j
    for i, c in enumerate(item):
        across = row + (padded[i : i + width] != c)
        down = np.append(row[1:] + 1, e + 1 + len(item))
        best = np.minimum(across, down)
        row = np.minimum.accumulate(best - steps) + steps
        if row.min() > e:
            return False
    return bool(row.min() <= e)


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in benchmark.select(benchmark[item_id].alias("i"), benchmark[item_text].alias("t")).filter("t is not null and i is not null").toLocalIterator():
        if block and size + len(r.t) > block_chars:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += len(r.t)
    yield block


def _pass(index: Index):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            found = index.search_all([t or "" for t in batch.column("text").to_pylist()])
            kept = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(found, pa.list_(pa.int64()))], [*[batch.schema.names[i] for i in kept], "item_ids"])

    return run


def _hits(rows: DataFrame, blocks: Iterator[list[tuple[int, str]]], q: int, edits: float) -> DataFrame:
    """``row``, ``item_ids`` of the rows (``row``, ``text``) in which an item of some block occurs; a written table."""
    found = [common.cut(rows.mapInArrow(_pass(Index(block, q, edits)), f"row long, {_ITEMS}").filter(F.size("item_ids") > 0)) for block in blocks]
    return functools.reduce(DataFrame.unionAll, found).groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("item_ids"))).alias("item_ids"))


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = Q, edits: float = EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    texts = common.ids_and_text(docs, id_col, text_col).select("doc_id", F.lower("text").alias("text"))
    blocks = _blocks(benchmark, item_id, item_text, block_chars)
    items, after = next(blocks), next(blocks, None)
    if after is None:
        found = texts.mapInArrow(_pass(Index(items, q, edits)), _SCHEMA)
    else:
        keyed = common.cut(texts.withColumn("row", F.monotonically_increasing_id()))
        hits = _hits(keyed.select("row", "text"), itertools.chain((items, after), blocks), q, edits)
        found = keyed.select("row", "doc_id").join(hits, "row", "left").select("doc_id", F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"))
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = Q, edits: float = EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no item occurs, with all columns."""
    common.small_batches(docs.sparkSession)
    blocks = _blocks(benchmark, item_id, item_text, block_chars)
    items, after = next(blocks), next(blocks, None)
    if after is None:
        index = Index(items, q, edits)

        @F.pandas_udf("boolean")
        def clean(texts: pd.Series) -> pd.Series:
            return pd.Series([not f for f in index.search_all([t or "" for t in texts])], dtype=bool)

        return docs.filter(clean(F.lower(docs[text_col])))
    row = common.free_name("row", docs.columns)
    keyed = common.cut(docs.withColumn(row, F.monotonically_increasing_id()))
    hits = _hits(keyed.select(F.col(row).alias("row"), F.lower(text_col).alias("text")), itertools.chain((items, after), blocks), q, edits)
    return keyed.join(hits.select(F.col("row").alias(row)), row, "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents", spread=True), common.table(spark, sf_dir, "benchmark"))
