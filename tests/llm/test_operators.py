"""Each operator against SQL or brute force, and on odd inputs: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from granary.llm import common, decontamination, forest, license_scan, line_dedup, lm_scoring, near_dedup, packing, quality, quality_rules, registry, secret_scan, sharding
from tests.conftest import SF

ODD = [(1, None, "a"), (2, "", "a"), (2, "", "a"), (3, "   \n\t ", None), (4, "one", "b"), (5, "one", "b"), (6, "long " * 30000 + "w" * 5000, "b"), (None, "no id here at all", "a")]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("x") for c in ("node", "label", "chunk", "size", "hash", "host_key", "n_dropped", "score", "tie")})


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, same, name):
    same(registry.queries()[name](spark, SF), registry.oracle_sql()[name])


def test_odd_inputs(spark, odd):
    empty = odd.limit(0)
    tokenizer = packing.default_tokenizer()
    model = quality.train(["good words here\nmore of them", "$$$ ### |||"] * 5, [1, 0] * 5)
    scanner = secret_scan.train(secret_scan.Language.of(["a few words"]), secret_scan.labelled_findings(200))
    items = spark.createDataFrame([(1, None), (2, "short"), (3, "no id here at all")], "item_id long, text string")
    runs = [
        lambda d: lm_scoring.score(d), lambda d: license_scan.scan(d), lambda d: line_dedup.drop_boilerplate(d, d["source"])[0], lambda d: secret_scan.scan(d, scanner),
        lambda d: near_dedup.classes(d), lambda d: quality.score(d, model), lambda d: sharding.shard(d), lambda d: quality_rules.apply(d, []), lambda d: decontamination.scan(d, items),
    ]
    for run in runs:
        assert run(odd).count() == len(ODD)
        assert run(empty).count() == 0
    assert packing.pack(odd, tokenizer).select("doc_id").distinct().count() == 7 and packing.pack(empty, tokenizer).count() == 0
    assert {r.doc_id: r.contaminated for r in decontamination.scan(odd, items).collect()} == {1: False, 2: False, 3: False, 4: False, 5: False, 6: False, None: True}
    got = {r.doc_id: r.class_id for r in near_dedup.classes(odd).collect()}
    assert got[5] == 4 and got[1] == 1 and got[2] == 2 and got[3] == 3
    assert near_dedup.keep_one(odd).count() == 6


def test_word_hashes_do_not_depend_on_neighbours():
    words = ["a", "bé", "w" * 700, "x y"]
    alone = [common.hash_words(*common.text_bytes(pa.array([w])))[0].tolist() for w in words]
    data, offsets = common.text_bytes(pa.array(words))
    for block in (1, 16, 1 << 19):
        together, at = common.hash_words(data, offsets, block)
        assert [together[i:j].tolist() for i, j in zip(at, at[1:])] == alone


def test_near_classes_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()]
    rng = random.Random(3)
    base = rows[5][1].split()
    for k in range(40):  # a family of graded copies
        w = list(base)
        for _ in range(k // 2):
            w[rng.randrange(len(w))] = f"z{rng.random()}"
        rows.append((10_000 + k, " ".join(w)))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words, offsets = common.hash_words(*common.text_bytes(pa.array([t.lower() for _, t in rows])))
    doc, h, w = near_dedup._weigh(*near_dedup._shingles(words, offsets, 5))
    at = np.searchsorted(doc, np.arange(len(rows) + 1))
    sets = [(h[a:b], w[a:b]) for a, b in zip(at, at[1:])]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] == rows[j][1] or near_dedup.probability_jaccard(*sets[i], *sets[j]) >= 0.8 - 1e-12:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(lambda: 10**9)
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], d)
    assert got == {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def test_hot_buckets_are_compared_in_blocks(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    sig = rng.integers(-(2**63), 2**63 - 1, (60, 32), dtype=np.int64)
    for k in range(30, 60):  # each of the second half is near one of the first
        sig[k] = sig[k - 30] ^ rng.integers(0, 8, 32)
    rows = [(band, 9, node, node // 3, [int(x) for x in sig[node]], [100 + node if node % 2 else 9, 9], 10.0, 9.9, True, 0, 60) for band in (0, 1) for node in range(60) if band == 1 or node % 2 == 0]
    schema = "band int, key long, node long, label long, sig array<long>, bands array<long>, total double, shared double, plain boolean, top long, size long"
    marked = spark.createDataFrame(rows, schema).withColumn("size", F.when(F.col("band") == 0, 30).otherwise(60))
    most = round((1 - near_dedup.ALIKE) / 2 * near_dedup.FINE)
    near = lambda a, b: int(np.bitwise_count(sig[a] ^ sig[b]).sum()) <= most
    want = sorted((a, b) for a in range(60) for b in range(a + 1, 60) if a // 3 != b // 3 and near(a, b))
    assert len(want) >= 27
    for block in (500, 7):
        got = near_dedup.block_pairs(marked, 0.8, block=block, task_rows=50).collect()
        assert sorted((min(r), max(r)) for r in got) == want  # each pair once, in the first band it shares


def test_texts_that_share_a_hash_get_nodes_of_their_own(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "doc_id long, text string")
    node = near_dedup._node(F.col("text"))
    fake = docs.select(F.when(F.col("text").isNull(), 5).otherwise(7).cast("long").alias("node"), F.coalesce(near_dedup._second(F.col("text")), F.lit(0)).alias("second"))
    shared = near_dedup._shared_nodes(fake.groupBy("node").agg(F.min("second").alias("lo"), F.max("second").alias("hi")), fake)
    assert [n for n, _ in shared] == [7]
    real = {r.text: (r.node, r.second) for r in docs.select("text", node.alias("node"), near_dedup._second(F.col("text")).alias("second")).collect()}
    moved = {r.text: r.n for r in docs.select("text", near_dedup._node(F.col("text"), [real["b"]]).alias("n")).collect()}
    assert moved["a"] == real["a"][0] and moved["b"] != real["b"][0] and len(set(moved.values())) == 3


def test_signature_estimates_probability_jaccard():
    x = [str(i) for i in range(300)]
    y = x[:250] + [f"n{i}" for i in range(50)] + x[:30] * 2
    words, offsets = common.hash_words(*common.text_bytes(pa.array([" ".join(x), " ".join(y)])))
    sig = near_dedup.signatures(words, offsets, 1000)
    doc, h, w = near_dedup._weigh(*near_dedup._shingles(words, offsets, 5))
    a, b = dict(zip(h[doc == 0], w[doc == 0])), dict(zip(h[doc == 1], w[doc == 1]))
    exact = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())
    assert abs(near_dedup.probability_jaccard(h[doc == 0], w[doc == 0], h[doc == 1], w[doc == 1]) - exact) < 1e-9
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.06


def _edits(item, text):
    row = best = None
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    said = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, p) for i, p in enumerate(said(rng.randint(3, 40)) for _ in range(25)) if len(p) >= 10]
    assert len({decontamination.gram(len(p), 10, 0.08) for _, p in items}) > 1
    docs = []
    for d in range(80):
        t = said(rng.randint(0, 40))
        if d % 3:
            p = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, len(p) // 9)):
                p[rng.randrange(len(p))] = rng.choice(["", "x", "yz"])
            t += " \n " + "".join(p).upper() + "\t " + said(10)
        docs.append((d, t))
    n = decontamination.normal
    want = {d: [i for i, p in items if _edits(n(p), n(t)) <= decontamination.budget(len(n(p)), 0.08)] for d, t in docs}
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (8_000_000, 300):
        assert {r.doc_id: r.item_ids for r in decontamination.scan(*tables, block_chars=block).collect()} == want
        clean = {r.doc_id for r in decontamination.keep_clean(*tables, block_chars=block).collect()}
        assert clean == {d for d, w in want.items() if not w} and any(want.values())
    short = decontamination.Index([(1, "A cat"), (2, "ab"), (3, " \t "), (4, "thirteen char")], 10, 0.08)
    assert short.search_all(["see a  cat!", "a cats ab", "", "the thirteen chars", "tirteen charm"]) == [[1], [2], [], [4], [4]]


def test_packing_is_a_partition_of_the_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    encode = packing.encoder(packing.default_tokenizer())
    for x in ["日本語 テスト　x", "é́ naïve  \n\n  \t x", "<|endoftext|> hi", "😀👍🏽 ok", "a\x00b", "١٢٣ Ⅷ ½", "'S it's we're", "  x  y"]:
        assert list(encode(x)) == t.encode(x, add_special_tokens=False).ids
    docs = common.table(spark, SF, "documents")
    ids = {r.doc_id: np.array([*t.encode(r.text, add_special_tokens=False).ids, 0], "<u4") for r in docs.collect()}
    rows = packing.pack(docs, packing.default_tokenizer(), range_bytes=100_000).collect()
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    for key, place in (("doc_id", "start"), ("sequence_id", "offset")):
        at = defaultdict(int)
        for r in sorted(rows, key=lambda r: (r[key], r[place])):
            assert r[place] == at[r[key]]
            at[r[key]] += r.length
        if key == "doc_id":
            assert at == {d: len(i) for d, i in ids.items()}
        else:
            assert all(n <= 1024 and n & (n - 1) == 0 for n in at.values())


def test_packing_ranges_are_even_and_split_copies(spark):
    rng = np.random.default_rng(4)
    places, sizes = np.sort(rng.integers(0, 1 << 60, 20_000)), rng.integers(1, 5000, 20_000)
    part = np.searchsorted(packing.range_ends(places, sizes, 50), places, side="right")
    held = np.bincount(part, sizes, 50)
    assert len(held) == 50 and held.max() < 1.1 * held.min()
    # a third of all rows repeat altogether: they do not stay in one range
    same = spark.range(0, 400, 1, 4).selectExpr("7L as doc_id", "repeat('same words ', 60) as text").unionAll(spark.range(800).selectExpr("id", "concat_ws(' ', id, id * 7, uuid())"))
    rows = packing.pack(same, packing.default_tokenizer(), range_bytes=30_000).collect()
    ranges = Counter(r.sequence_id >> 40 for r in rows if r.doc_id == 7 and r.doc_tokens > 60)
    assert sum(r.start == 0 for r in rows) == 1200 and len(ranges) > 3
    assert len({r.sequence_id >> 40 for r in packing.pack(same, packing.default_tokenizer(), range_bytes=100, most_ranges=6).collect()}) <= 6


def test_scores_equal_a_table_of_ngrams(spark, odd):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(30)]
    rows = [(k % 50, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for k in range(200)] + [(None, None), (7, "W1 w2\tw3"), (7, "W1 w2\tw3")]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string"), odd.select("doc_id", "text")):
        shown = lambda df: sorted(str((r.doc_id, r.n_tokens, round(r.log_score, 6), r.mean_log_score and round(r.mean_log_score, 6), r.n_backed_off)) for r in df.collect())
        want = shown(lm_scoring.score_by_rows(docs))
        for size in (1 << 24, 2_000):
            assert shown(lm_scoring.score(docs, chunk_bytes=size)) == want


def test_hilbert_steps_are_neighbours():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert(cells, 3)
    assert sorted(keys) == list(range(512)) and np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1).max() == 1


def test_shards(spark):
    docs = common.table(spark, SF, "documents").select("doc_id", "text")
    hot = docs.unionAll(spark.range(10_000, 10_100).selectExpr("id", "repeat('hot text ', 50)"))
    rows = sharding.shard(hot).collect()
    sizes, slots = Counter(), defaultdict(list)
    text = {r.doc_id: r.text for r in hot.collect()}
    for r in rows:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        assert r["size"] == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    assert len(rows) == len(text) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(sizes) == 8 and max(sizes.values()) < 1.06 * min(sizes.values())


def test_placing_equals_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    v = rng.random((200, 3)) / 300
    residual = [[0.25] * 3 for _ in range(4)]
    want = [0] * 200
    for i in sorted(range(200), key=lambda i: -max(v[i])):
        worth = [sum(w * a * b for w, a, b in zip(sharding._WEIGHT, v[i], r)) for r in residual]
        want[i] = worth.index(max(worth))
        residual[want[i]] = [a - b for a, b in zip(residual[want[i]], v[i])]
    left = np.full((4, 3), 0.25)
    assert sharding.place(v, left).tolist() == want and np.allclose(left, residual)
    # a whole table against the same rule by hand: bins of one text each, since there are more bins than texts
    docs = spark.createDataFrame([(k, f"{k} " * (k % 23 + 1)) for k in range(120)] + [(500, None), (501, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in sharding.shard(docs, shards=3, heavy=1000).collect()}
    total = [sum(r["size"] for r in rows.values()), sum(r.tokens for r in rows.values()), len(rows)]
    assert {d: (r["size"], r.tokens) for d, r in rows.items()} == {d: (len((t or "").encode()) + 1, len((t or "").split())) for d, t in docs.collect()}
    sums = Counter()
    for r in rows.values():
        sums[r.shard] += r["size"]
    assert len(sums) == 3 and max(sums.values()) - min(sums.values()) <= 2 * max(r["size"] for r in rows.values()) and total[2] == 122


def test_shards_over_several_levels(spark):
    docs = spark.range(3000).selectExpr("cast(id % 50 as long) as doc_id", "concat('t', id % 700, ' ', repeat('word ', cast(id % 700 % 37 as int))) as text").unionAll(spark.range(1500).selectExpr("1L", "'the same row'"))
    rows = sharding.shard(docs, rows_a_part=20, fan=32, heavy=8).collect()
    slots, sizes, of = defaultdict(list), Counter(), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
        of[r.text_crc32].add(r.shard)
    assert len(rows) == 4500 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    # equal texts stay together, but for those of over half of a shard; sizes differ by less than two of the largest groups
    assert all(len(s) == 1 for c, s in of.items() if c != zlib.crc32(b"the same row")) and max(sizes.values()) < 1.06 * min(sizes.values())
    # every level against placing by hand
    bins = spark.createDataFrame([(p, b, 10 + p + b, 5, 1) for p in range(40) for b in range(8)], "part int, bin int, bytes long, tokens long, rows long")
    last, of = sharding._pack_bins(bins, 40, 8, [1e4, 1600.0, 320.0], 4)
    sums = Counter()
    for r in bins.join(of, ["part", "bin"]).collect():
        sums[r.top, r.top_bin] += r.bytes
    assert {(r.part, r.bin): r.bytes for r in last.collect()} == dict(sums) and len(sums) <= 64 and of.count() == 320
    counts = [(g, k, (7 * k + g) % 5) for g in range(3) for k in range(0, 950, 2)]
    begin = {(r.g, r.k): r.begin for r in sharding.running(spark.createDataFrame(counts, "g int, k int, n long"), "g", "k", "n").collect()}
    assert begin == {(g, k): sum(n for h, j, n in counts if h == g and j < k) for g, k, _ in counts}


def test_rules_are_grown_and_pruned_as_defined():
    import math

    rng = random.Random(9)
    rows = []
    for _ in range(240):
        r = {f: rng.random() for f in quality_rules.FEATURES}
        rows.append((r, r["symbols_per_word"] > 0.7 and r["digit_share"] <= 0.5))
    p, n = sum(b for _, b in rows), len(rows)

    def gain(c):
        inside = [b for r, b in rows if c.holds(r)]
        return sum(inside) * (math.log2(sum(inside) / len(inside)) - math.log2(p / n)) if any(inside) else 0.0

    first = quality_rules._grow(rows)[0]
    every = [quality_rules.Condition(f, above, cut) for f in quality_rules.FEATURES for cut in quality_rules._cuts([r[f] for r, _ in rows]) for above in (True, False)]
    assert gain(first) == max(map(gain, every))
    rules = quality_rules.learn(rows)
    assert {c.feature for c in rules[0]} >= {"symbols_per_word", "digit_share"}
    caught = [any(quality_rules._covers(rule, r) for rule in rules) for r, _ in rows]
    assert np.mean([c == b for c, (_, b) in zip(caught, rows)]) > 0.95
    front = lambda k: [b for r, b in rows[::3] if quality_rules._covers(rules[0][:k], r)]
    worth = [(2 * sum(f) - len(f)) / len(f) for f in (front(k) for k in range(1, len(rules[0]) + 1))]
    assert worth[-1] == max(worth)


def test_quality_score_of_whole_texts_by_brute_force():
    import itertools
    import math

    model = quality.train(["good words here\nmore of them are\nfine", "$$$ ### |||\n!! 11 22"] * 6, [1, 0] * 6)
    for text in ("good words\n### 12 |\n\nfine again here", "one line", "", None, "a\nb"):
        features, size, offsets = quality.line_features([text])
        n = len(size)
        score = features @ model.weights
        paths = list(itertools.product((0, 1), repeat=n))
        worth = [math.exp(sum(score[t] for t in range(n) if p[t]) + sum(model.pair[p[t], p[t + 1]] for t in range(n - 1))) for p in paths]
        good = [sum(w for w, p in zip(worth, paths) if p[t]) / sum(worth) for t in range(n)]
        raw = sum(g * s for g, s in zip(good, size)) / sum(size)
        want = 1 / (1 + math.exp(-(model.slope * math.log(min(max(raw, 1e-4), 1 - 1e-4) / (1 - min(max(raw, 1e-4), 1 - 1e-4))) + model.shift)))
        assert abs(model.score([text])[0] - want) < 1e-9 and abs(model.score(["x y z\n$", text, "q"])[1] - want) < 1e-9


def test_quality_training_holds_little_besides_its_features():
    import tracemalloc

    rng = random.Random(5)
    lines = lambda n: "\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(n))
    texts = [None, "", "\n\n", lines(1200), *(lines(10) for _ in range(1500))]
    tracemalloc.start()
    try:
        quality.train(texts, [k % 2 for k in range(len(texts))], rounds=2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    features, _, offsets = quality.line_features(texts)
    got, at = quality._features_in_parts(texts)
    assert np.array_equal(got, features) and np.array_equal(at, offsets) and len(quality._parts(texts)) > 10
    assert peak < features.nbytes + (32 << 20)


def test_rules_statistics_and_held_out_accuracy(spark):
    import re

    docs, labels = common.table(spark, SF.replace("0.001", "0.01"), "documents"), common.table(spark, SF.replace("0.001", "0.01"), "labels")
    rows = {r.doc_id: r for r in quality_rules.apply(docs, quality_rules.fit(docs, labels)).collect()}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        seen = Counter(zip(w, w[1:], w[2:]))
        inside = {p for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        full = [x for x in r.text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        got = rows[r.doc_id]
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text), len(full) - len(set(full)), len(inside))
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and rows[r.doc_id].n_words >= 50]
    assert np.mean([rows[r.doc_id].kept == (r.quality == 1) for r in held]) > 0.9


def test_fits_do_not_depend_on_order_or_repeats(spark):
    docs = spark.createDataFrame([(k, f"{'good words here and more of them' if k % 2 else '$$ ## | !!'} {k}", "x") for k in range(40)] * 2 + [(3, "another text of id 3", "y"), (None, None, None)], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] * 2 + [(4, 1), (None, 1), (7, None)], "doc_id long, quality int")
    rows = quality.training_rows(docs, labels, "doc_id", "text", "quality", 3000)
    assert len({r.doc_id for r in rows}) == len(rows) and next(r.label for r in rows if r.doc_id == 4) == 1
    again = quality.training_rows(docs.orderBy(docs["doc_id"].desc()).repartition(7), labels.repartition(5), "doc_id", "text", "quality", 3000)
    assert again == rows and sum(len(r.text) for r in quality.training_rows(docs, labels, "doc_id", "text", "quality", 3000, 100)) <= 100
    assert quality_rules.fit(docs, labels) == quality_rules.fit(docs.repartition(7), labels.repartition(5))
    none = labels.limit(0)
    assert quality_rules.fit(docs, none) == [] and quality.keep(docs, quality.fit(docs, none)).count() == docs.count()
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.filter("quality = 1"))).collect()} == {0.5}


def test_quality_held_out_accuracy_and_marginals(spark):
    d = SF.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in quality.query(spark, d).collect()}
    held = [r for r in common.table(spark, d, "labels").collect() if rows[r.doc_id].held_out]
    assert np.mean([rows[r.doc_id].predicted == r.quality for r in held]) > 0.95
    rng = np.random.default_rng(1)
    unary, pair = rng.normal(size=(1, 4, 2)), rng.normal(size=(2, 2))
    paths = np.array(np.meshgrid(*[[0, 1]] * 4, indexing="ij")).reshape(4, -1).T
    worth = np.exp([sum(unary[0, t, p[t]] for t in range(4)) + sum(pair[p[t], p[t + 1]] for t in range(3)) for p in paths])
    m, both, z = quality.forward_backward(unary, pair, np.array([4]), pairs=True)
    assert np.allclose(m[0, :, 1], [(worth * (paths[:, t] == 1)).sum() / worth.sum() for t in range(4)]) and np.isclose(z[0], np.log(worth.sum()))
    assert np.allclose(both[0], [[sum((worth * (paths[:, t] == a) * (paths[:, t + 1] == b)).sum() for t in range(3)) / worth.sum() for b in (0, 1)] for a in (0, 1)])


def test_secrets_held_out_accuracy():
    language = secret_scan.Language.of(["the nation and the reason of it"])
    scanner = secret_scan.train(language, secret_scan.labelled_findings(2000))
    other = secret_scan.labelled_findings(500, seed=99)
    got = scanner.score([(f.text, f.start, f.run, f.path) for f in other]) >= secret_scan.CUT
    assert np.mean(got == [f.secret for f in other]) > 0.95
    text = 'so token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and commit 24be64439e3e49cf46b2d7c90f3602a3d0b907fe'
    (_, secrets), = scanner.scan([text], ["src1"])
    assert [s["start"] for s in secrets] == [12]


def test_forest_learns_a_box():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.6)).astype(float)
    trees = forest.fit(x[:400], y[:400])
    assert np.mean((trees.predict(x[400:]) > 0.5) == y[400:]) > 0.93


def test_line_dedup_and_licence_literals(spark):
    pages = spark.createDataFrame([(i, "h", f" menu \nbody {i}\n\nmenu") for i in range(6)] + [(9, None, "menu\nx")], "id long, host string, text string")
    out, n = line_dedup.drop_boilerplate(pages, pages["host"])
    rows = {r.id: r for r in out.collect()}
    assert rows[3].text == "body 3\n" and rows[3][n] == 2 and rows[9].text == "menu\nx"
    alone = spark.createDataFrame([(1, "h", "a\nb"), (2, "g", None), (3, "g", None)], "id long, host string, text string")
    assert {r.id: r.text for r in line_dedup.drop_boilerplate(alone, alone["host"], min_pages=1)[0].collect()} == {1: "", 2: None, 3: None}
    docs = spark.createDataFrame([(1, "x\nReleased under the MIT license!"), (2, "nothing"), (3, "Licensed under CC-BY-NC 4.0"), (4, "CC BY-SA 4.0")], "doc_id long, text string")
    assert {r.doc_id: r.license for r in license_scan.scan(docs).collect()} == {1: "MIT", 2: None, 3: "CC-BY-NC-4.0", 4: "CC-BY-SA-4.0"}


def test_licence_notices_inside_longer_texts(spark):
    import textwrap

    from pyspark.sql import functions as F

    code = "\n".join(f"x{k} = compute({k})" for k in range(80))
    def notice(name, start="# ", width=70):
        return "\n".join(start + x for x in textwrap.wrap(license_scan.TEMPLATES[name], width))

    names = ["MIT-full", "Apache-2.0-header-full", "GPL-3.0-header-full", "BSD-2-Clause-full", "ISC-full", "Zlib"]
    rows = [(k, f"import a\n{code}\n{notice(n)}\n{code}") for k, n in enumerate(names)]
    rows += [(10, "Copyright (c) 2020 A B\n\n" + notice("MIT-full", " * ", 40) + "\n" + code), (11, notice("MIT-full").replace("the Software", "this file")[:600] + "\n" + code), (12, code), (13, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert [got[k].license for k in range(6)] == names and all(got[k].dice == 1.0 for k in range(6)) and got[10].license == "MIT-full" and got[12].license is None and got[13].n_units == 0
    assert got[11].license in (None, "MIT-text")
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted((r[0], r[1], r[2] and round(r[2], 9), r[3]) for r in con.execute(license_scan.SQL).fetchall()) == sorted((r.doc_id, r.license, r.dice and round(r.dice, 9), r.n_units) for r in got.values())
    assert license_scan.scan(docs, templates={}).agg(F.sum("n_units")).first()[0] == 0


def test_secret_table_equals_direct_scan_and_learns_from_a_table(spark):
    docs = common.table(spark, SF, "documents")
    known = secret_scan.labelled_findings(1500, seed=5)
    table = spark.createDataFrame([("y" * 90 + "\n" + f.text, 91 + f.start, len(f.run), f.path, f.secret) for f in known] + [(None, 0, 1, None, True), ("ab", 1, 9, None, True)], "text string, start long, length long, path string, secret boolean")
    found = secret_scan.findings_of(table)
    assert {(f.run, f.secret) for f in found} == {(f.run, f.secret) for f in known} and len(secret_scan.findings_of(table, 100)) == 100
    scanner = secret_scan.fit(docs, table)
    other = secret_scan.labelled_findings(500, seed=77)
    assert np.mean((scanner.score([(f.text, f.start, f.run, f.path) for f in other]) >= secret_scan.CUT) == [f.secret for f in other]) > 0.93
    rows = docs.select("doc_id", "text", "source").collect()
    want = {r.doc_id: (n, [(s["start"], s["length"], s["score"]) for s in secrets]) for r, (n, secrets) in zip(rows, scanner.scan([r.text for r in rows], [r.source for r in rows]))}
    assert {r.doc_id: (r.n_candidates, [tuple(s) for s in r.secrets]) for r in secret_scan.scan(docs, scanner).collect()} == want
    # every planted token is found, and nothing in documents without a candidate word
    import re

    for r in rows:
        for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text):
            assert (m.start(1), 40) in [s[:2] for s in want[r.doc_id][1]]


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline
    from pyspark.sql import functions as F

    rng = random.Random(2)
    text = lambda: " ".join(f"w{rng.randrange(4000)}" for _ in range(120))
    same = text()
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, same, "en", "a", 1), (2, same, "en", "a", 1), (None, text(), None, None, None), (None, text(), "en", None, 3), (4, "the item of the benchmark is here " + text(), "en", "b", 9), (5, text() + " x" * 20_000, "en", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in ("row", "kept_id", "kept_node", "host_key", "n_dropped", "item_ids", "place", "node")})
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "the item of the benchmark is here"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, common.table(spark, folder, "documents"), folder)
        assert after.columns == docs.columns and stage(spark, docs.limit(0), folder).count() == 0, name
        kept.append(after.count())
    assert kept == [8, 8, 7, 7]
    out = corpus_pipeline.run(spark, folder).filter("start = 0")
    assert out.count() == 6


def test_pipeline(spark):
    import corpus_pipeline

    docs = common.table(spark, SF, "documents")
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.cut(stage(spark, docs, SF))
        assert docs.columns == columns and 0 < docs.count() <= left, name
        left = docs.count()
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == left


def test_near_dedup_with_null_and_reused_ids(spark):
    rng = random.Random(8)
    said = [[f"{rng.random()}" for _ in range(80)] for _ in range(5)]
    near = lambda w: " ".join([*w[:-1], "other"])
    text = [" ".join(w) for w in said]
    rows = [(None, text[0]), (None, text[1]), (7, text[2]), (7, text[3]), (None, near(said[1])), (8, near(said[3])), (None, text[4]), (None, text[4]), (7, text[3])]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, place long")
    got = near_dedup.classes(docs).collect()
    name = {r.node: r.class_node for r in got}
    assert len(got) == len(rows) and len(name) == 7 and len(set(name.values())) == 5
    kept = sorted(r.place for r in near_dedup.keep_one(docs).collect())
    assert len(kept) == 5 and kept[0] == 0 and {2, 6} & set(kept) and len({1, 4} & set(kept)) == 1 and len({3, 8} & set(kept)) == 1 and len({6, 7} & set(kept)) == 1


def test_decontamination_blocks_do_not_change_rows(spark):
    items = spark.createDataFrame([(1, "the first benchmark item"), (2, "a second benchmark item"), (2, "and a third one of the second's id")], "item_id long, text string")
    rows = [(None, "it holds the first benchmark item here"), (None, "clean and free of any"), (5, "A second benchmark item and a third one of the second's id"), (5, "nothing of it is in here"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, several = (sorted(map(str, decontamination.scan(docs, items, block_chars=n).collect())) for n in (8_000_000, 10))
    assert one == several and len(one) == 5
    assert sorted(r.item_ids for r in decontamination.scan(docs, items, block_chars=10).collect()) == [[], [], [], [1], [2, 2]]


def test_packing_finds_added_tokens(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    encode = packing.encoder(packing.default_tokenizer())
    texts = ["<|endoftext|> hi", "a <|endoftext|>b<|endoftext|><|endoftext|>", "<|endoftext |> <|endoftext", "日本 <|endoftext|>\n\n x", "plain  text"]
    for x in texts:
        assert list(encode(x)) == t.encode(x, add_special_tokens=False).ids
    rows = packing.pack(spark.createDataFrame([(1, texts[0])], "doc_id long, text string"), packing.default_tokenizer()).orderBy("start").collect()
    ids = np.array([*t.encode(texts[0], add_special_tokens=False).ids, 0], "<u4")
    assert rows[0].doc_tokens == 3 and [r.ids_crc32 for r in rows] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in rows]


def test_secret_statistics_cover_all_rows(spark):
    rows = [(k, "plain words of the common language are here") for k in range(600)] + [(None, "žluťoučký kůň pěl")] * 2 + [(9999, "žluťoučký qzqz")]
    got = secret_scan.Language.of_table(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {"žluťoučký", "language"} <= got.words and "kůň" not in got.words
    assert np.allclose(got.transitions, secret_scan.Language.of([t for _, t in rows]).transitions)
    empty = secret_scan.Language.of_table(spark.createDataFrame([], "doc_id long, text string"))
    assert np.allclose(np.exp(empty.transitions), 1 / 37)


def test_secrets_short_or_without_digit():
    language = secret_scan.Language.of(["the nation and the reason of it, note that names are here"] * 3)
    found = secret_scan.labelled_findings(4000)
    assert any(f.secret and len(f.run) < 16 for f in found) and any(f.secret and not any(c.isdigit() for c in f.run) for f in found)
    scanner = secret_scan.train(language, found)
    texts = ['password = "k9$Tz!wQ4x"', "pwd: Xq7#mLp2vR", "API_KEY=QwRtZpLkJhGfDsXcVbNm", 'token = "hQzXvKpWbTnRfJdLgMcY"', "the password is vB3!kq%Z", "https://u.example.org/a?sig=1&api_key=Zk3vQ9xT7bLm2RwP8sYd"]
    for text, (_, secrets) in zip(texts, scanner.scan(texts, ["src1"] * len(texts)), strict=True):
        assert len(secrets) == 1 and text[secrets[0]["start"] :][: secrets[0]["length"]].rstrip(chr(34)) == text.replace(chr(34), "").replace("=", " ").split()[-1], text
    prose = ["Note: the reason of the nation", "the key of the nation is here", "at 12:30, see http://example.org/the/nation"]
    assert all(not s for _, s in scanner.scan(prose, ["src1"] * len(prose)))
    other = secret_scan.labelled_findings(2000, seed=98)
    got = scanner.score([(f.text, f.start, f.run, f.path) for f in other]) >= secret_scan.CUT
    assert np.mean(got == [f.secret for f in other]) > 0.95
