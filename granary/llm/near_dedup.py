"""Near-duplicate classes by ProbMinHash, banding and verification.

Shingles are windows of five words (lower case); a text of fewer words is one shingle. A shingle's
weight is its number of occurrences. The similarity is the probability Jaccard of the weighted sets
(Moulton and Jiang, 2018), J_P(x, y) = sum over d in both of 1 / sum over e of max(x_e / x_d, y_e / y_d);
for texts that repeat no shingle it is the Jaccard index.

Signature (Ertl, 2020): the occurrences of a shingle arrive as a Poisson process whose rate is its weight;
each arrival falls into one of the registers, which keep the earliest arrival and its shingle;
a process ends early, once its next arrival is later than every register's. Registers of two texts agree
with probability J_P. Each band of ``ROWS`` registers is a bucket key. Texts that are hard to tell apart get a second,
finer signature for estimates: ``FINE`` registers, a bit of each (Li and Koenig, 2010).

Whole classes without all pairs of a bucket:

1. Equal texts are one node (a partial aggregate), so copies never meet each other. A node is a 64-bit hash; a second hash of
   each text shows nodes that two texts share (n * n / 2 ** 65 of them for n texts), and those texts get nodes of their own.
2. In each bucket every node is paired with the bucket's least node (the least comes from a partial
   aggregate). Pairs are verified by the exact J_P of the whole texts; links make classes.
3. Nodes in buckets that still hold several classes count their shingles among each other (``counts``). J_P(x, y) is at
   most the part of x's weight that y shares, so a node whose own shingles nobody else has to over a fifth of its
   weight has no link there and leaves.
4. Nodes of one bucket that are in different classes still are paired with the next few of them; here and in the next
   step pairs whose finer signatures put them under ``ALIKE`` are dropped before any text moves.
5. What is in one bucket but not in one class after that is compared outright: the members of all but the bucket's
   largest class with all members of other classes, each pair in the first band that it shares, without those whose bound
   is too low. A bucket is cut into blocks of about ``BLOCK`` nodes and each two blocks are one piece of work, so a hot bucket is
   spread over tasks; pairs are formed inside the task, a block at a time, and only those leave it whose finer signatures
   pass.

So two texts that share a bucket are compared unless they already are in one class: no link between
classes is lost behind a cap. At J_P 0.8 two texts share no bucket with probability under 4e-4.

Result: a row per row of the table with ``class_id``, the least ``doc_id`` of the class. Defined cases:
null and wordless texts are singletons (also beside each other) - except that equal ones are equal texts:
they share a class; repeated rows share a class; an empty table gives an empty result. A class without any id has a null
``class_id``, and two classes whose least ids are one reused id have one ``class_id``; ``class_node`` tells them apart.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, counts
from .graph import components

SHINGLE, BANDS, ROWS, THRESHOLD = 5, 20, 5, 0.8
#: Registers of the finer signature, and the estimate under which a pair is not looked at; at J_P 0.8 a pair has less with probability 1e-4.
FINE, ALIKE = 2048, 0.75
NEXT, SPREAD = 3, 500
#: Nodes of a block in step 5; rows a task of that step holds, and pairs a task verifies, about.
BLOCK, TASK_ROWS, TASK_PAIRS = 500, 5_000, 1_500
#: Text handled at once, and bytes of weighed texts kept for the next pairs.
_SLICE, _KEPT = 2 << 20, 64 << 20


# --- weighted shingles and signatures -------------------------------------------------------------


def _shingles(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts and, for each text, where they start; a text of few words has one."""
    n = np.diff(offsets)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    starts = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros(int(starts[-1]), np.uint64)
    place = np.repeat(offsets[:-1] - starts[:-1], count) + np.arange(len(out))
    whole = np.repeat(n >= size, count)
    out[whole] = common.roll(words, size)[place[whole]]
    for d in np.flatnonzero((n > 0) & (n < size)):
        out[starts[d]] = common.roll(words[offsets[d] : offsets[d + 1]], int(n[d]))[0]
    return out, starts


def _weigh(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle), in the order of the texts: text, hash, weight."""
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))) if len(h) else np.zeros(0, np.int64)
    return d[new], h[new], np.diff(np.append(new, len(h))).astype(float)


def signatures(words: np.ndarray, offsets: np.ndarray, registers: int, size: int = SHINGLE) -> np.ndarray:
    """ProbMinHash registers, one row a text: the hash of the shingle that came first; 0 for a wordless text."""
    doc, shingle, weight = _weigh(*_shingles(words, offsets, size))
    assert registers <= 1024 or registers == 2048, "a slot is dealt from 11 bits"
    texts = len(offsets) - 1
    first = np.full(texts * registers, np.inf)
    who = np.zeros(texts * registers, np.uint64)
    time = np.zeros(len(doc))
    state = common.mix(shingle)
    round_ = 0
    while len(doc):
        round_ += 1
        state = common.mix(state + np.uint64(round_ * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        time = time - np.log(((state >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight
        slot = doc * registers + ((state & np.uint64(0x7FF)) * np.uint64(registers) >> np.uint64(11)).astype(np.int64)
        better = time < first[slot]
        s, t, x = slot[better], time[better], shingle[better]
        np.minimum.at(first, s, t)
        won = first[s] == t
        who[s[won]] = x[won]
        last = first.reshape(texts, registers).max(axis=1)
        alive = time < last[doc]
        doc, shingle, weight, time, state = doc[alive], shingle[alive], weight[alive], time[alive], state[alive]
    return who.reshape(texts, registers)


def _sign(bands: int, rows: int, size: int):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                words, offsets = common.hash_words(*common.text_bytes(part.column(1)))
                sig = signatures(words, offsets, bands * rows, size)
                keys = np.zeros((len(sig), bands), np.uint64)
                for b in range(bands):
                    for r in range(rows):
                        keys[:, b] = common.mix(keys[:, b] * np.uint64(3) + sig[:, b * rows + r])
                full = np.diff(offsets) > 0
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(np.where(full, bands, 0)))).astype(np.int32), keys[full].reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["node", "bands"])
                common.trim()

    return run


def fine_bits(words: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The finer signatures, one row a text: a bit of each of ``FINE`` registers, 64 to a number."""
    return np.packbits((common.mix(signatures(words, offsets, FINE, size)) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)


def _refine(size: int):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                for lo in range(0, part.num_rows, 250):
                    some = part.slice(lo, 250)
                    bits = fine_bits(*common.hash_words(*common.text_bytes(some.column(1))), size)
                    at = np.arange(0, bits.size + 1, bits.shape[1], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(at, bits.reshape(-1))], ["node", "sig"])
                common.trim()

    return run


def _slices(batch, column: int = 1):
    """A batch in parts of bounded text, so that memory does not follow the longest batch."""
    import pyarrow.compute as pc

    yield from _cut_by(batch, pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))


def _cut_by(batch, size: np.ndarray):
    at, total = 0, 0
    for i, s in enumerate(size):
        total += int(s)
        if total >= _SLICE:
            yield batch.slice(at, i + 1 - at)
            at, total = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def probability_jaccard(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    """Exact J_P of two weighted sets with sorted hashes."""
    both, i, j = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    a, b = w1[i], w2[j]
    only_a, only_b = w1.sum() - a.sum(), w2.sum() - b.sum()
    ratio, times = np.unique(a / b, return_counts=True)
    # sum over e of max(x_e / x_d, y_e / y_d), scaled by x_d and grouped by x_d / y_d
    if len(ratio) == 1:
        r = ratio[0]
        per = np.array([np.maximum(a, b * r).sum() + only_a + only_b * r])
    else:
        per = np.array([np.maximum(a, b * r).sum() + only_a + only_b * r for r in ratio])
    return float(sum((a[a / b == r]).sum() / p for r, p in zip(ratio, per, strict=True)))


def _verify(size: int, threshold: float):
    import pyarrow as pa
    import pyarrow.compute as pc

    def weighed(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        words, offsets = common.hash_words(*common.text_bytes(pa.array(texts, pa.string())))
        doc, h, w = _weigh(*_shingles(words, offsets, size))
        at = np.searchsorted(doc, np.arange(len(texts) + 1))
        return [(h[i:j].copy(), w[i:j].copy()) for i, j in zip(at[:-1], at[1:], strict=True)]

    def run(batches):
        kept: dict = {}
        held = 0
        for batch in batches:
            length = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("text_a", "text_b"))
            for part in _cut_by(batch, length):
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                new = {key: (c, i) for c, keys in (("text_a", a), ("text_b", b)) for i, key in enumerate(keys) if key not in kept}
                for key, got in zip(new, weighed([part.column(c)[i].as_py() for c, i in new.values()]), strict=True):
                    kept[key] = got
                    held += 16 * len(got[0])
                ok = np.zeros(len(a), bool)
                for i, (x, y) in enumerate(zip(a, b, strict=True)):
                    (h1, w1), (h2, w2) = kept[x], kept[y]
                    if min(len(h1), len(h2)) >= 0.5 * threshold * max(len(h1), len(h2)) or w1.max() > 1 or w2.max() > 1:
                        ok[i] = probability_jaccard(h1, w1, h2, w2) >= threshold - 1e-12
                if held > _KEPT:
                    kept, held = {}, 0
                yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[ok]), pa.array(np.array(b, np.int64)[ok])], ["a", "b"])
        common.trim()

    return run


# --- bounds -----------------------------------------------------------------------------------------


def _shingles_of(texts, size: int):
    """(text number, hash, weight) of an Arrow column, in parts of bounded text."""
    for lo in range(0, len(texts), 500):
        words, offsets = common.hash_words(*common.text_bytes(texts[lo : lo + 500]))
        doc, h, w = _weigh(*_shingles(words, offsets, size))
        yield doc + lo, h, w


def _ask(size: int, buckets: int):
    def run(table):
        got = [counts.tally(counts.key(h)) for _, h, _ in _shingles_of(table["text"], size)]
        return counts.parts(*counts.tally(np.concatenate([k for k, _ in got]), np.concatenate([c for _, c in got])), table["chunk"][0].as_py(), buckets)

    return run


def _bound(size: int):
    import pyarrow as pa

    def run(texts, answers):
        n = texts.num_rows
        total, shared, plain = np.zeros(n), np.zeros(n), np.ones(n, bool)
        if n:
            got = list(_shingles_of(texts["text"], size))
            keys, _ = counts.tally(counts.key(np.concatenate([h for _, h, _ in got])))
            holders = counts.join(answers)
            for doc, h, w in got:
                total += np.bincount(doc, w, n)
                shared += np.bincount(doc, np.where(holders[np.searchsorted(keys, counts.key(h))] > 1, w, 0.0), n)
                plain[doc[w > 1]] = False
        return pa.table({"node": texts["node"], "total": pa.array(total), "shared": pa.array(shared), "plain": pa.array(plain)})

    return run


def shared_weights(texts: DataFrame, size: int) -> DataFrame:
    """For each of these texts (``node``, ``text``): its weight, the weight of its shingles that some other of them has, and whether all weights are 1.

    J_P(x, y) is at most the part of x's weight that y shares, so texts and pairs that cannot reach a threshold show
    without a comparison.
    """
    _, size_ = common.total_bytes(texts)
    chunks = max(1, -(-size_ // (16 << 20)))
    dealt = counts.deal(texts.select("node", "text", F.pmod(F.xxhash64("node"), F.lit(chunks)).cast("int").alias("chunk")), "chunk", chunks)
    told = counts.deal(counts.answer(dealt.groupBy("chunk").applyInArrow(_ask(size, chunks), counts.PARTS), chunks), "chunk", chunks)
    return dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_bound(size), "node long, total double, shared double, plain boolean")


# --- hot buckets ------------------------------------------------------------------------------------


def _compare(threshold: float):
    """Pairs of a task's pieces that pass: two classes, first band shared, bound and finer signatures (see step 5)."""
    import pyarrow as pa

    most = round((1 - ALIKE) / 2 * FINE)

    def matrix(column) -> np.ndarray:
        flat = column.combine_chunks().flatten().to_numpy()
        return flat.reshape(len(column), -1)

    def piece(left, right, minor, node, label, top, band, sig, bands, total, shared, plain):
        """Rows of ``left`` that are outside the bucket's largest class against rows of ``right``."""
        for i in left[minor[left]]:
            j = right[(label[right] != label[i]) & ((label[right] == top[i]) | (node[i] < node[right]))]
            if band[i]:
                j = j[~(bands[j, : band[i]] == bands[i, : band[i]]).any(axis=1)]
            least = np.minimum(shared[i], shared[j])
            j = j[~(plain[i] & plain[j]) | (least >= (threshold - 1e-9) * (total[i] + total[j] - least))]
            j = j[np.bitwise_count(sig[j] ^ sig[i]).sum(axis=1, dtype=np.int64) <= most]
            yield np.full(len(j), node[i]), node[j]

    def run(table: pa.Table) -> pa.Table:
        column = lambda c: table[c].to_numpy()
        node, label, top, band, side = map(column, ("node", "label", "top", "band", "side"))
        sig, bands = matrix(table["sig"]), matrix(table["bands"])
        total, shared, plain = map(column, ("total", "shared", "plain"))
        minor = label != top
        order = np.lexsort((column("hi"), column("lo"), column("key"), band))
        ids = np.stack([band, column("key"), column("lo"), column("hi")], axis=1)[order]
        edges = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]).any(axis=1), [True])))
        out = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            rows = order[lo:hi]
            rest = (minor, node, label, top, band, sig, bands, total, shared, plain)
            if ids[lo][2] == ids[lo][3]:
                out += piece(rows, rows, *rest)
            else:
                first, second = rows[side[rows] == 0], rows[side[rows] == 1]
                out += piece(first, second, *rest)
                out += piece(second, first, *rest)
        a, b = (np.concatenate([np.zeros(0, np.int64), *[x[k] for x in out]]) for k in (0, 1))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return run


def block_pairs(marked: DataFrame, threshold: float, block: int = BLOCK, task_rows: int = TASK_ROWS) -> DataFrame:
    """``a``, ``b`` of the pairs of step 5. ``marked``: a row for each band, key and node of the open buckets, with ``top`` and the bucket's ``size``."""
    blocks = F.greatest(F.ceil(F.col("size") / block), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int")
    dealt = marked.withColumn("blocks", blocks).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("*", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    n = marked.agg(F.coalesce(F.sum(blocks), F.lit(0))).first()[0]
    tasks = max(1, -(-int(n) // task_rows))
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("band", "key", "lo", "hi"), F.lit(tasks)).cast("int"))
    columns = ["task", "band", "key", "lo", "hi", "side", "node", "label", "top", "sig", "bands", "total", "shared", "plain"]
    return dealt.select(*columns).groupBy("task").applyInArrow(_compare(threshold), "a long, b long")


# --- classes ---------------------------------------------------------------------------------------


def _node(text: Column, shared: list[tuple[int, int]] = ()) -> Column:
    """64-bit key of a text. ``shared``: (key, second hash) of texts that would have another text's key."""
    plain = F.xxhash64(text.isNull(), text)
    out = plain
    for node, second in shared:
        other = (node * int(common._M3) + second) & (2**64 - 1)
        out = F.when((plain == node) & (_second(text) == second), F.lit(other - (other >> 63 << 64))).otherwise(out)
    return out


def _second(text: Column) -> Column:
    return F.xxhash64(F.lit(2), text)


def _shared_nodes(heads: DataFrame, keyed: DataFrame) -> list[tuple[int, int]]:
    """(key, second hash) of all texts but one of each key that several texts have: n * n / 2 ** 65 for n texts."""
    twice = heads.filter("lo <> hi").select("node", "lo")
    if twice.isEmpty():
        return []
    return [(r.node, r.second) for r in keyed.join(twice, "node").filter("second <> lo").select("node", "second").distinct().collect()]


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``class_id``, ``node`` (64-bit key of the text), ``class_node`` (the class's least node: it names the class whatever its ids are)."""
    return _classes(docs, id_col, text_col, size, bands, rows, threshold)[0]


def _classes(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int, threshold: float) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``classes``, and the ``shared`` of ``_node``."""
    plain = common.ids_and_text(docs, id_col, text_col)
    hashed = plain.select("doc_id", _node(F.col("text")).alias("node"), F.coalesce(_second(F.col("text")), F.lit(0)).alias("second"))

    def heads_of(members: DataFrame) -> DataFrame:
        return common.cut(members.groupBy("node").agg(F.min("doc_id").alias("head"), F.min("second").alias("lo"), F.max("second").alias("hi")))

    # Equal texts, equal signatures: one head a node. Texts never go through this aggregate.
    heads = heads_of(hashed)
    shared = _shared_nodes(heads, hashed)
    texts = plain.select("doc_id", _node(F.col("text"), shared).alias("node"), "text")
    members = texts.select("doc_id", "node")
    if shared:
        heads = heads_of(members.withColumn("second", F.lit(0)))
    heads = heads.select("node", "head")
    signed = texts.select("node", F.lower("text").alias("text")).mapInArrow(_sign(bands, rows, size), "node long, bands array<long>")
    signed = common.cut(signed)
    buckets = signed.select("node", F.posexplode("bands").alias("band", "key")).distinct()
    least = buckets.groupBy("band", "key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = common.cut(buckets.join(least, ["band", "key"]).select("band", "key", "node", "least", "n"))
    by_node = heads
    whole = texts.select("node", "doc_id", "text")

    def text_of(nodes: DataFrame) -> DataFrame:
        asked = nodes.distinct().join(by_node, "node").select(F.col("node").alias("asked"), "head")
        return asked.join(whole, (F.col("asked") == F.col("node")) & F.col("head").eqNullSafe(F.col("doc_id"))).select("node", F.lower("text").alias("text")).dropDuplicates(["node"])

    # The texts of all candidates move once; every later step reads this table.
    candidates = common.cut(text_of(met.select("node")))

    def some(nodes: DataFrame) -> DataFrame:
        return candidates.join(nodes.distinct(), "node")

    def links(pairs: DataFrame) -> DataFrame:
        pairs = common.cut(pairs)
        have = some(pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))))
        left, right = have.select(F.col("node").alias("a"), F.col("text").alias("text_a")), have.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        # a pair costs more than its bytes tell: tasks by number of pairs
        tasks = min(counts.MOST_PARTITIONS, max(1, pairs.count() // TASK_PAIRS))
        return common.cut(pairs.join(left, "a").repartition(tasks, "b").join(right, "b").mapInArrow(_verify(size, threshold), "a long, b long"))

    # 2. every node with the least of its buckets
    found = links(_distinct_pairs(met.select(F.col("node").alias("a"), F.col("least").alias("b"))))
    label = components(found)
    def open_buckets(rows: DataFrame, label: DataFrame) -> DataFrame:
        own = rows.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = own.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("band", "key")
        return own.join(mixed, ["band", "key"])

    # 3. what shingles no other candidate has bound a text's similarity to all of them
    left = common.cut(open_buckets(met, label))
    if not left.isEmpty():
        bound = shared_weights(common.cut(some(left.select("node"))), size).filter(F.col("shared") >= (threshold - 1e-9) * F.col("total"))
        left = common.cut(open_buckets(left.drop("label").join(bound, "node"), label))
        nodes = left.select("node").distinct()
        fine = some(nodes).mapInArrow(_refine(size), "node long, sig array<long>")
        fine = common.cut(fine.join(signed.dropDuplicates(["node"]), "node"))
        left = left.drop("label")
        many = open_buckets(left, label).join(fine, "node")
        # 4. each node with the next ones of other classes
        alike = F.expr(f"{differing('sig_a', 'sig_b')} <= {round((1 - ALIKE) / 2 * FINE)}")
        part = F.when(F.col("n") <= SPREAD, 0).otherwise(F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / SPREAD)))
        order = Window.partitionBy("band", "key", "part").orderBy(F.xxhash64("node", "band"), "node")
        near = many.filter("node <> least").withColumn("part", part)
        ahead = [F.struct(*[F.lead(c, k).over(order).alias(c) for c in ("node", "label", "sig")]) for k in range(1, NEXT + 1)]
        near = near.select("node", "label", "sig", F.array(*ahead).alias("others"))
        near = near.select("node", F.col("sig").alias("sig_a"), F.explode(F.filter("others", lambda x: x["label"] != F.col("label"))).alias("other")).withColumn("sig_b", F.col("other.sig"))
        tried = common.cut(_distinct_pairs(near.filter(alike).select(F.col("node").alias("a"), F.col("other.node").alias("b"))))
        found = found.unionAll(links(tried))
        label = components(found)
        # 5. the rest outright
        rest = common.cut(open_buckets(left, label).join(fine, "node"))
        if not rest.isEmpty():
            share = rest.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("n_label"))
            big = share.groupBy("band", "key").agg(F.max(F.struct("n_label", "label")).alias("top"), F.sum("n_label").alias("size"))
            marked = rest.join(big.select("band", "key", F.col("top.label").alias("top"), "size"), ["band", "key"])
            pairs = _distinct_pairs(block_pairs(marked, threshold))
            least_pairs = _distinct_pairs(met.select(F.col("node").alias("a"), F.col("least").alias("b")))
            found = found.unionAll(links(pairs.join(tried, ["a", "b"], "left_anti").join(least_pairs, ["a", "b"], "left_anti")))
            label = components(found)
    named = label.join(heads, "node")
    least_id = named.groupBy("label").agg(F.min("head").alias("class_id"))
    of = named.join(least_id, "label").select("node", "label", "class_id")
    of = heads.join(of, "node", "left").select("node", F.coalesce("class_id", "head").alias("class_id"), F.coalesce("label", "node").alias("class_node"))
    return members.join(of, "node").select("doc_id", "class_id", "node", "class_node"), shared


def differing(a: str, b: str) -> str:
    """SQL of how many bits of two finer signatures differ."""
    return f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x)"


def query(spark, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents", spread=True)).select("doc_id", "class_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of the least id (null ids last), of those the least node; classes are told apart by node."""
    id_, node_ = (common.free_name(x, docs.columns) for x in ("kept_id", "kept_node"))
    of, shared = _classes(docs, id_col, text_col, SHINGLE, BANDS, ROWS, THRESHOLD)
    kept = of.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_node").agg(F.min("doc_id").alias("doc_id"), F.min("node").alias("node"), F.count(F.lit(1)).alias("n"))
    kept = common.cut(kept.select(F.col("doc_id").alias(id_), F.col("node").alias(node_), "n"))
    node = _node(docs[text_col], shared)
    same = docs[id_col].eqNullSafe(F.col(id_)) & (node == F.col(node_))
    once = docs.join(kept.filter("n = 1").drop("n"), same, "left_semi")
    twice = kept.filter("n > 1").drop("n")
    if twice.isEmpty():
        return once
    return once.unionAll(docs.join(twice, same, "left_semi").withColumn(node_, node).dropDuplicates([node_]).drop(node_))
