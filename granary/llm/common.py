"""Pieces that several operators share: reading, cutting lineage, and vectorised word hashing.

A *word* here is a maximal run of bytes other than ASCII white space (0x20, 0x09-0x0D) in the
UTF-8 form of a text; word hashes are 64-bit and depend on all of its bytes.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables

#: Java regular expression of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One table of a data folder, read through Spark so that any Hadoop path works. ``spread``: one small file is dealt over the cores."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return tables.spread(rows) if spread else rows


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one on a local master (tests) and an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="granary-checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it from there, so that its lineage ends.

    Unlike ``checkpoint()``, which runs a plan's last stage twice, the rows are made once; and the written size tells
    the optimizer which sides of later joins are small.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that Spark hands to Python at once; texts are long.
BATCH_ROWS = 1000


def free_name(wanted: str, columns: list[str]) -> str:
    """``wanted``, with underscores added until no column has that name in any case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def small_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch than by default, unless the caller chose a number: it bounds memory on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) == 10000:
        spark.conf.set(key, BATCH_ROWS)


def trim() -> None:
    """Give memory that is free inside this process back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if (f := _malloc_trim()) is not None:
        f(0)


@functools.cache
def _malloc_trim():
    import ctypes

    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def ids_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id`` and ``text`` only, whatever the input calls them and whatever else it holds."""
    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))


def total_bytes(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of text, as sizes for partition counts."""
    n, b = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_col))).first()
    return int(n), int(b or 0)


# --- vectorised hashing -------------------------------------------------------------------------

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_VALUE = np.random.default_rng(20240229).integers(0, 2**64, size=256, dtype=np.uint64)
#: Odd, so that it has an inverse; 3 modulo 8, so that its powers differ early.
_BASE = 0x9E3779B97F4A7C1B
_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_S33 = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string array with one space after each row, and where each row starts (rows + 1 offsets)."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    parts = [b"" if s is None else s.encode() for s in column.to_pylist()]
    ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64) if parts else np.zeros(0, np.int64)
    return np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8), np.concatenate(([0], ends)).astype(np.int64)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def hash_words(data: np.ndarray, offsets: np.ndarray, block: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in ``data`` and, for each row, the index of its first word (rows + 1 offsets).

    A word's hash is a polynomial in its bytes' random values, taken from running sums over a block of text.
    """
    space = _SPACES[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]  # data ends with a space, so each word has an end
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + block, side="right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        up, down = _powers(1 << max(19, (hi - lo).bit_length()))
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_VALUE[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _M3)
        at = to
    return out, np.searchsorted(starts, offsets, side="left").astype(np.int64)


def roll(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of ``n`` successive words (len(words) - n + 1 of them); rows are not told apart."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    out = mix(words[: len(words) - n + 1] + np.uint64(n * int(_M3) & (2**64 - 1)))
    for k in range(1, n):
        out = mix(out * np.uint64(3) + words[k : len(words) - n + 1 + k])
    return out
