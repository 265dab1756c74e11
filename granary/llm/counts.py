"""Corpus-wide counts of keys, by buckets of the key.

Keys are the upper 56 bits of 64-bit hashes: a given key is met by chance by one of n others with probability n / 2**56
(1e-7 for ten thousand million), and its count then holds both.

A chunk (some tens of MB of text) counts its own keys first and sends each bucket one row: the sorted keys that fall
into it and their counts, packed. A bucket adds the chunks' counts up and answers every chunk with the sums of the
keys it asked for. A frequent key so moves once a chunk, memory follows the size of a chunk and of a bucket,
and no task sees the whole table. Chunks and buckets are dealt to at most ``MOST_PARTITIONS`` partitions; one of a large
table holds several, one after another, so a shuffle's blocks do not grow with the square of the table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import trim

BITS, MOST_PARTITIONS = 56, 1 << 14
PARTS = "bucket int, chunk int, first long, steps binary, counts binary"


def deal(rows: DataFrame, column: str, values: int) -> DataFrame:
    """``rows`` by a column of that many values."""
    return rows.repartition(min(values, MOST_PARTITIONS), column)


def key(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - BITS)


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as byte planes, the empty high planes left out."""
    values = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def tally(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their (weighted) counts."""
    if weights is not None:
        at = np.argsort(keys, kind="stable")
        keys, weights = keys[at], weights[at]
    else:
        keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys))).astype(np.uint64) if weights is None else np.add.reduceat(weights, first) if len(first) else weights
    return keys[first], counts


def _bounds(buckets: int) -> np.ndarray:
    """First hash of each bucket but the first."""
    return np.array([(b << BITS) // buckets for b in range(1, buckets)], dtype=np.uint64)


def parts(keys: np.ndarray, sums: np.ndarray, chunk: int, buckets: int):
    """A chunk's rows for the buckets, from its sorted distinct keys and their counts."""
    import pyarrow as pa

    edges = np.concatenate(([0], np.searchsorted(keys, _bounds(buckets), side="left"), [len(keys)]))
    full = [b for b in range(buckets) if edges[b + 1] > edges[b]]
    part = [slice(edges[b], edges[b + 1]) for b in full]
    return pa.table({
        "bucket": pa.array(full, pa.int32()),
        "chunk": pa.array([chunk] * len(full), pa.int32()),
        "first": pa.array([int(keys[s.start]) for s in part], pa.int64()),
        "steps": pa.array([pack(np.diff(keys[s])) for s in part], pa.binary()),
        "counts": pa.array([pack(sums[s]) for s in part], pa.binary()),
    })


def _answer():
    import pyarrow as pa

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = []
        for r in rows:
            first, steps = np.uint64(r["first"]), unpack(r["steps"])
            keys.append(np.concatenate(([first], first + np.cumsum(steps, dtype=np.uint64))))
        trim()
        known, total = tally(np.concatenate(keys), np.concatenate([unpack(r["counts"]) for r in rows]))
        return pa.table({
            "chunk": table["chunk"],
            "bucket": table["bucket"],
            "totals": pa.array([pack(total[np.searchsorted(known, k)]) for k in keys], pa.binary()),
        })

    return run


def answer(asked: DataFrame, buckets: int) -> DataFrame:
    """``chunk``, ``bucket``, ``totals`` for each row of ``parts``."""
    return deal(asked, "bucket", buckets).groupBy("bucket").applyInArrow(_answer(), "chunk int, bucket int, totals binary")


def join(answers) -> np.ndarray:
    """A chunk's answers as one array, in the order of its sorted keys."""
    rows = sorted(zip(answers["bucket"].to_pylist(), answers["totals"].to_pylist(), strict=True))
    return np.concatenate([unpack(t) for _, t in rows])
