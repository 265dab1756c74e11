"""Packing along a space-filling curve: documents ordered by Hilbert key, then cut into full sequences.

A text's words are hashed into ``BUCKETS`` counts (feature hashing); a fixed Gaussian matrix projects the counts to
``DIMS`` numbers, each divided by the root of the number of words and turned into a cell of ``2 ** BITS`` by the
normal distribution function. The cell's place on a Hilbert curve (Skilling, 2004) is the text's key: texts with like
words get near keys.

The table is read once and written with its keys; everything after that is read from there. A row's place is its key,
then a hash of its id and row number, so that copies of one text, and rows that repeat altogether, spread over ranges too.
Ranges hold about ``RANGE_BYTES`` of text, or the ``MOST_RANGES``-th part of a table that would have more ranges; where they
end is set by a sample of places and sizes that grows with them (``SAMPLE`` rows a range, so the driver holds at most
``SAMPLE`` * ``MOST_RANGES`` pairs of numbers). Each range is sorted by place and packed as one stream in curve order: ids of
a text, then id 0, then the next text; a sequence ends at ``LENGTH`` ids. The last ids of a range, fewer than ``LENGTH``,
become sequences of falling powers of two, so no sequence needs padding. Every text is tokenised once, whole, in the task
that packs its range, which holds one batch and one open sequence.

Defined cases: a null text counts as empty and is one id (0); null ids are packed like others; repeated rows are packed
each; an empty table gives an empty result; ties in the key fall to the hash of id and row number.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH, DIMS, BITS, BUCKETS = 1024, 3, 10, 256
#: Text a range holds, about; the most ranges; rows sampled for the ranges' ends, a range.
RANGE_BYTES, MOST_RANGES, SAMPLE = 24 << 20, 1 << 16, 64
#: Bits of a place below the Hilbert key.
_TIE = 63 - DIMS * BITS
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, hilbert_key long"
_PLANES = np.random.default_rng(1891).standard_normal((BUCKETS, DIMS))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (rows of unsigned coordinates) on the Hilbert curve, by Skilling's transform."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[:, i] & q) > 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(high, p, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[:, i] >> b) & 1
    return key


def curve_keys(column) -> np.ndarray:
    """Hilbert key of each text of an Arrow column."""
    words, offsets = common.hash_words(*common.text_bytes(column))
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    bucket = (words & np.uint64(BUCKETS - 1)).astype(np.int64)
    counts = np.bincount(row * BUCKETS + bucket, minlength=len(n) * BUCKETS).reshape(len(n), BUCKETS)
    unit = counts @ _PLANES / np.sqrt(np.maximum(n, 1))[:, None] / 2
    # 1 / (1 + exp(-1.702 x)) is within 0.01 of the normal distribution function
    cells = np.minimum((1 / (1 + np.exp(-1.702 * unit)) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
    return hilbert(cells, BITS)


def _in_parts(texts, f):
    """``f`` of an Arrow column in parts of bounded text, as one array."""
    from .near_dedup import _slices

    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    return np.concatenate([np.zeros(0, np.int64), *[f(part.column(0)) for part in _slices(pa.RecordBatch.from_arrays([texts], ["text"]), 0)]])


def _key_udf():
    @F.arrow_udf("long")
    def key(texts: pa.Array) -> pa.Array:
        return pa.array(_in_parts(texts, curve_keys), pa.int64())

    return key


def range_ends(places: np.ndarray, sizes: np.ndarray, ranges: int) -> np.ndarray:
    """The first place of each range but the first, so that ranges hold about equal parts of the sampled sizes."""
    order = np.argsort(places, kind="stable")
    places, before = places[order], np.cumsum(sizes[order]) - sizes[order]
    at = np.searchsorted(before, np.arange(1, ranges) * (sizes.sum() / ranges))
    return places[at[at < len(places)]]


def _range_udf(ends: np.ndarray):
    """The number of range ends at or before a place."""

    @F.arrow_udf("int")
    def of(places: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(ends, places.to_numpy(zero_copy_only=False), side="right"), pa.int32())

    return of


_loaded: dict = {}


def encoder(path: str):
    """``text -> uint32 array``: the ids of ``Tokenizer.encode(text, add_special_tokens=False)`` for a byte-level BPE in a tokenizers file.

    The file's vocabulary and merges are run by the byte-pair encoder of tiktoken, in a quarter of the time; the file's added
    tokens are found in the text, as by a tokenizer at its defaults.
    """
    if path not in _loaded:
        import tiktoken

        spec = json.loads(open(path, encoding="utf-8").read())
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has added tokens that are not found literally")
        plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in plain]
        back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if i not in special.values()}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # of byte-level pre-tokenisation: a fixed value
        made = tiktoken.Encoding("byte level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        _loaded[path] = lambda text: np.asarray(made.encode_to_numpy(text, allowed_special="all", disallowed_special=()), "<u4") if text else np.zeros(0, "<u4")
    return _loaded[path]


def powers(n: int) -> list[int]:
    """``n`` as falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """One range's stream: takes texts in order, gives pieces."""

    def __init__(self, base: int, length: int):
        self.sequence, self.length, self.used = base, length, 0
        self.open: list[tuple] = []  # pieces of the sequence that is not full yet: (doc, start, ids, doc tokens, key)

    def add(self, doc, ids: np.ndarray, key: int) -> list[tuple]:
        out, start = [], 0
        while start < len(ids):
            take = min(self.length - self.used, len(ids) - start)
            self.open.append((doc, start, ids[start : start + take], len(ids), key))
            self.used += take
            start += take
            if self.used == self.length:
                out += self._close(self.open, [self.length])
                self.open, self.used = [], 0
        return out

    def end(self) -> list[tuple]:
        out = self._close(self.open, powers(self.used))
        self.open, self.used = [], 0
        return out

    def _close(self, pieces: list[tuple], sizes: list[int]) -> list[tuple]:
        out, sizes = [], list(sizes)
        offset = 0
        for doc, start, ids, total, key in pieces:
            at = 0
            while at < len(ids):
                take = min(sizes[0] - offset, len(ids) - at)
                out.append((doc, start + at, take, zlib.crc32(ids[at : at + take].tobytes()), total, self.sequence, offset, key))
                at += take
                offset += take
                if offset == sizes[0]:
                    sizes.pop(0)
                    self.sequence += 1
                    offset = 0
        return out


def _stream(path: str, length: int):
    from pyspark import TaskContext

    schema = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])

    def emit(rows: list[tuple]):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    def run(batches):
        encode = encoder(path)
        packer = Packer(TaskContext.get().partitionId() << 40, length)
        rows: list[tuple] = []
        for batch in batches:
            for doc, text, key in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                rows += packer.add(doc, np.append(encode(text.as_py() or ""), np.uint32(0)).astype("<u4"), key)
                if len(rows) >= 10_000:
                    yield emit(rows)
                    rows = []
        rows += packer.end()
        if rows:
            yield emit(rows)

    return run


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, range_bytes: int = RANGE_BYTES, most_ranges: int = MOST_RANGES) -> DataFrame:
    """A row per piece: ``SCHEMA``."""
    d = common.ids_and_text(docs, id_col, text_col)
    tie = F.shiftrightunsigned(F.xxhash64("doc_id", F.monotonically_increasing_id()), 64 - _TIE)
    d = d.select("doc_id", "text", _key_udf()("text").alias("hilbert_key"), tie.alias("tie"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"))
    keyed = common.cut(d.select("doc_id", "text", F.shiftleft("hilbert_key", _TIE).bitwiseOR(F.col("tie")).alias("place"), "size"))
    rows, size = keyed.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(1, min(most_ranges, -(-size // range_bytes)))
    ends = np.zeros(0, np.int64)
    if ranges > 1:
        part = F.pmod(F.xxhash64("place"), F.lit(1 << 30)) < max(1, (SAMPLE * ranges << 30) // rows)
        some = keyed.filter(part).select("place", "size").toArrow()
        ends = range_ends(some["place"].to_numpy(), some["size"].to_numpy(), ranges)
    dealt = keyed.withColumn("range", _range_udf(ends)("place")).repartitionById(ranges, F.col("range")).sortWithinPartitions("place")
    return dealt.select("doc_id", "text", F.shiftright("place", _TIE).alias("hilbert_key")).mapInArrow(_stream(path, length), SCHEMA)


def default_tokenizer() -> str:
    """Where the installed public tokenizer files have the 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents", spread=True), default_tokenizer())
