"""Document quality by a linear-chain conditional random field over the lines of each text.

Every line is labelled good or bad. A line's features are shares of its characters and words (symbols,
capitals, digits, pipes, exclamation marks, repeats inside the text) and the same of the lines before and
after it; two transition weights a pair of labels tie neighbours together (Lafferty et al., 2001). A text's
score is the mean of its lines' forward-backward marginals for "good", weighted by line length, brought
to a probability by a logistic fit on the training texts.

Training: texts with a label, a bounded sample of ``SAMPLE`` of them (those with the least hash of the id) and of
``SAMPLE_BYTES`` of text together, only from rows whose crc32(id) mod 4 is not 2; all lines of a text carry the text's
label. An id with several labels counts with the highest, one with several texts with that of the least hash, so a model
does not change between runs. Neither labels, language, source nor id are inputs of a score. Scoring is one scan of the
table, whole texts, no shuffle.

Defined cases: null and empty texts are one blank line and get that line's score; repeated rows get the
same score; an empty table gives an empty result; without labelled rows of both kinds the score is 0.5, all other
columns are as described, and ``keep`` keeps every row: nothing was learned that could reject one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SAMPLE, SAMPLE_BYTES, CUT = 3000, 64 << 20, 0.7
_SEGMENT = 64
#: Characters of text whose features are found at once in training, and line places whose chains are run at once.
_PART, _CELLS = 1 << 18, 1 << 14
_NAMES = ("bias", "words", "symbols", "capitals", "digits", "pipes", "bangs", "mean_word", "repeated", "blank", "punctuation")


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[[ord(c) for c in chars]] = 1
    return out


_SYMBOL, _PIPE, _BANG = _class("#*$%&<>=~^{}[]\\@+_"), _class("|"), _class("!")
_UPPER, _DIGIT, _DOT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class(".,;:?")
_ASCII_LETTER = _class("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line (a row each), lengths in bytes plus one, and each text's first line (texts + 1 offsets)."""
    parts = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    text_ends = np.cumsum([len(p) + 1 for p in parts])
    offsets = np.concatenate(([0], np.searchsorted(ends, text_ends - 1) + 1))
    length = ends - starts
    # A count over [start, end] holds the line break too, which is in no class but white space.
    count = lambda table: np.add.reduceat(table[data], starts)
    space = common._SPACES[data]
    begins = ~space
    begins[1:] &= space[:-1]
    words = np.add.reduceat(begins.astype(np.int32), starts)
    letters, n = np.maximum(count(_ASCII_LETTER), 1), np.maximum(length, 1)
    body = np.maximum(n - np.add.reduceat(space.astype(np.int32), starts) + 1, 1)
    # The same words in a text before: share of a line's words that some earlier line or place of the text holds.
    hashes, word_at = common.hash_words(data, np.append(starts, len(data)))
    doc_of_line = np.repeat(np.arange(len(parts)), np.diff(offsets))
    line_of = np.repeat(np.arange(len(starts)), np.diff(word_at))
    if len(hashes) > 2:
        triple = common.roll(hashes, 3)
        same_line_doc = doc_of_line[line_of[:-2]] == doc_of_line[line_of[2:]]
        key = common.mix(triple + doc_of_line[line_of[:-2]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        repeats = np.bincount(line_of[:-2][again & same_line_doc], minlength=len(starts))
    else:
        repeats = np.zeros(len(starts))
    own = np.column_stack([
        np.ones(len(starts)),
        np.log1p(words) / 4,
        np.minimum(4 * count(_SYMBOL) / body, 2),
        count(_UPPER) / letters,
        np.minimum(4 * count(_DIGIT) / body, 2),
        np.minimum(8 * count(_PIPE) / np.maximum(words, 1), 2),
        np.minimum(4 * count(_BANG) / np.maximum(words, 1), 2),
        np.minimum(body / np.maximum(words, 1), 20) / 10,
        repeats / np.maximum(words, 1),
        (words == 0).astype(float),
        np.minimum(count(_DOT) / np.maximum(words, 1), 1),
    ])
    none = np.zeros((1, own.shape[1] - 1))
    before, after = np.vstack([none, own[:-1, 1:]]), np.vstack([own[1:, 1:], none])
    before[offsets[:-1]] = 0
    after[offsets[1:] - 1] = 0
    return np.hstack([own, before, after]), length + 1.0, offsets


def forward_backward(unary: np.ndarray, pair: np.ndarray, lengths: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains as (chain, place, label) scores: marginals, a chain's pair marginals summed over its places, log partition."""
    chains, places, _ = unary.shape
    alive = np.arange(places)[None, :] < lengths[:, None]
    up, down = np.zeros_like(unary), np.zeros_like(unary)
    up[:, 0] = unary[:, 0]
    lse = lambda a: np.logaddexp(a[..., 0], a[..., 1])
    for t in range(1, places):
        step = lse(np.moveaxis(up[:, t - 1, :, None] + pair[None], 1, 2)) + unary[:, t]
        up[:, t] = np.where(alive[:, t, None], step, up[:, t - 1])
    z = lse(up[:, -1])
    for t in range(places - 2, -1, -1):
        step = lse(pair[None] + (unary[:, t + 1] + down[:, t + 1])[:, None, :])
        down[:, t] = np.where(alive[:, t + 1, None], step, 0.0)
    marginal = np.where(alive[:, :, None], np.exp(up + down - z[:, None, None]), 0.0)
    both = np.zeros((chains, 2, 2))
    if places > 1 and pairs:
        log = up[:, :-1, :, None] + pair[None, None] + (unary[:, 1:] + down[:, 1:])[:, :, None, :] - z[:, None, None, None]
        both = np.where(alive[:, 1:, None, None], np.exp(np.minimum(log, 0)), 0.0).sum(axis=1)
    return marginal, both, z


@dataclass
class Model:
    weights: np.ndarray
    pair: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    trained: bool = True

    def marginals(self, features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(good) of each line given its whole text."""
        unary = np.column_stack([np.zeros(len(features)), features @ self.weights])
        lines = np.diff(offsets)
        out = np.zeros(len(features))
        order = np.argsort(lines, kind="stable")
        at = 0
        while at < len(order):  # texts of like length together; a batch holds a bounded number of cells
            most = int(lines[order[at]])
            to = at + 1
            while to < len(order) and (to - at) * int(lines[order[to]]) <= 200_000 and lines[order[to]] <= 2 * most + 8:
                to += 1
            chosen = order[at:to]
            size = int(lines[chosen].max())
            place = np.minimum(offsets[chosen][:, None] + np.arange(size)[None], len(features) - 1)
            m, _, _ = forward_backward(unary[place], self.pair, lines[chosen])
            alive = np.arange(size)[None] < lines[chosen][:, None]
            out[place[alive]] = m[:, :, 1][alive]
            at = to
        return out

    def raw(self, texts: list[str | None]) -> np.ndarray:
        features, size, offsets = line_features(texts)
        good = self.marginals(features, offsets)
        return np.add.reduceat(good * size, offsets[:-1]) / np.add.reduceat(size, offsets[:-1]) if len(texts) else np.zeros(0)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.trained:
            return np.full(len(texts), 0.5)
        return self.calibrated(self.raw(texts))

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * _logit(raw) + self.shift)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _adam(loss_and_gradient, x: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, rounds + 1):
        g = loss_and_gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return x


def _parts(texts: list[str | None]) -> list[tuple[int, int]]:
    """Bounds of successive texts of about ``_PART`` characters together."""
    ends = np.cumsum([len(t or "") for t in texts]) // _PART
    at = [0, *(np.flatnonzero(ends[1:] != ends[:-1]) + 1).tolist(), len(texts)]
    return list(zip(at[:-1], at[1:], strict=True))


def _features_in_parts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features and offsets as ``line_features`` has them; what is held besides them grows with the longest text, not with their number."""
    offsets = np.concatenate(([0], np.cumsum([(t or "").count("\n") + 1 for t in texts])))
    out = np.empty((int(offsets[-1]), 3 * len(_NAMES) - 2))
    for lo, hi in _parts(texts):
        out[offsets[lo] : offsets[hi]] = line_features(texts[lo:hi])[0]
    return out, offsets


def train(texts: list[str | None], labels: list[int], ridge: float = 1e-3, rounds: int = 250) -> Model:
    """Maximum likelihood; every text counts alike, however many lines it has."""
    if not texts or len(set(labels)) < 2:
        return Model(np.zeros(0), np.zeros((2, 2)), trained=False)
    features, offsets = _features_in_parts(texts)
    start, size, truth, worth = [], [], [], []
    for d, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        for a in range(lo, hi, _SEGMENT):  # long texts in pieces, all of them
            start.append(a)
            size.append(min(_SEGMENT, hi - a))
            truth.append(labels[d])
            worth.append(1.0 / (hi - lo))
    truth = np.array(truth)
    share = truth.mean()
    worth = np.array(worth)
    size = np.array(size)
    start = np.array(start)
    groups = [np.flatnonzero((size > lo) & (size <= hi)) for lo, hi in ((0, 4), (4, 16), (16, 64))]
    blocks = [g[at : at + _CELLS // width] for g, width in zip(groups, (4, 16, 64), strict=True) for at in range(0, len(g), _CELLS // width)]
    total = len(texts)
    k = features.shape[1]

    def gradient(x: np.ndarray) -> np.ndarray:
        w, pair = x[:k], x[k:].reshape(2, 2)
        score = features @ w
        g = np.zeros_like(x)
        miss = np.zeros(len(features))  # each line is in one piece
        for chosen in blocks:
            place = np.arange(int(size[chosen].max()))
            at = np.minimum(start[chosen][:, None] + place, len(features) - 1)
            alive = place[None] < size[chosen][:, None]
            unary = np.stack([np.zeros(at.shape), score[at]], axis=2)
            m, both, _ = forward_backward(unary, pair, size[chosen], pairs=True)
            miss[at[alive]] = ((m[:, :, 1] - truth[chosen][:, None]) * worth[chosen][:, None])[alive]
            both = (both * worth[chosen][:, None, None]).sum(axis=0)
            edges = np.maximum(size[chosen] - 1, 0) * worth[chosen]
            want = np.diag([edges[truth[chosen] == 0].sum(), edges[truth[chosen] == 1].sum()])
            g[k:] += (both - want).reshape(-1)
        g[:k] = miss @ features
        g /= total
        g[:k] += ridge * x[:k]
        g[k:] += 20 * ridge * x[k:]
        return g

    x = _adam(gradient, np.concatenate([np.zeros(k), np.zeros(4)]), rounds, 0.15)
    model = Model(x[:k], x[k:].reshape(2, 2))
    raw, y = _logit(np.concatenate([model.raw(texts[lo:hi]) for lo, hi in _parts(texts)])), np.array(labels, float)

    def fit(x: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-(x[0] * raw + x[1])))
        return np.array([((p - y) * raw).mean() + 1e-3 * x[0], (p - y).mean()])

    model.slope, model.shift = map(float, _adam(fit, np.array([1.0, float(np.log((share + 0.01) / (1.01 - share)))]), 400, 0.05))
    return model


def sampled_labels(labels: DataFrame, id_col: str, label_col: str, sample: int) -> DataFrame:
    """``doc_id`` and ``label`` of a bounded, repeatable sample of the rows open for training."""
    open_ = labels.select(labels[id_col].alias("doc_id"), labels[label_col].alias("label")).filter("doc_id is not null and label is not null and crc32(cast(doc_id as string)) % 4 <> 2")
    return open_.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, sample_bytes: int = SAMPLE_BYTES) -> list:
    """Those labels with their texts, one an id, in the order of the ids' hashes until their bytes are used up."""
    few = sampled_labels(labels, id_col, label_col, sample)
    with_text = common.ids_and_text(docs, id_col, text_col).join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("t"), F.max("label").alias("label"))
    # At most ``sample`` rows reach this window.
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = with_text.select("doc_id", F.col("t.text").alias("text"), "label").withColumn("bytes", F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(before))
    return rows.filter(F.col("bytes") <= sample_bytes).select("doc_id", "text", "label").orderBy("doc_id").collect()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    rows = training_rows(docs, labels, id_col, text_col, label_col, sample)
    model = train([r.text for r in rows], [int(r.label) for r in rows])
    del rows
    common.trim()  # the driver would keep it for all that runs later
    return model


def _apply(model: Model):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            scores, part, size = [], [], 0
            for i, t in enumerate(texts):
                part.append(t)
                size += len(t or "")
                if size >= 1 << 20 or i == len(texts) - 1:
                    scores.append(model.score(part))
                    part, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["doc_id", "score"])
            common.trim()

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for each row of ``docs``."""
    out = common.ids_and_text(docs, id_col, text_col).mapInArrow(_apply(model), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is predicted good, with all columns; every row where the model is untrained."""
    if not model.trained:
        return docs

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        out, part, size = [], [], 0
        for t in texts:
            part.append(t)
            size += len(t or "")
            if size >= 1 << 20:
                out.append(model.score(part))
                part, size = [], 0
        out.append(model.score(part) if part else np.zeros(0))
        common.trim()
        return pd.Series(np.concatenate(out) >= CUT)

    common.small_batches(docs.sparkSession)
    return docs.filter(good(docs[text_col]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", spread=True)
    return score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
