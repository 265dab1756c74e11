"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a run of at least ``LEAST`` characters of ``A-Z a-z 0-9 _ + / = -``, or one of at least ``LEAST_NAMED``
characters, whatever they are, that an assignment or a word for secrets precedes. The verdict is the forest's, which sees
its length, its characters (digits, capitals, symbols, entropy, switches between letters and digits), how likely its
character transitions are in running text, the part of it that dictionary words cover, words of the path (the
document's source) and the words beside it. It is trained from labelled findings: a table of the caller's, or
``labelled_findings``, which makes them from a seed - keys and tokens as they are assigned in code and settings
against commit ids, checksums, card and phone numbers, identifiers, placeholders and examples.

The transition table and the dictionary come from all rows: occurrences of words (runs of letters alone) are counted per
task and summed, transitions are summed over the words. The dictionary holds the words of three letters and more that
occur at least ``OCCURS`` times and at least once in ``ONE_IN`` words, so its size is bounded by that share. Scanning is
one scan of the table, whole texts, no shuffle.

Result: a row per row of the table: candidates, secrets (score at or over ``CUT``), and the secrets' places (in
characters from 0), lengths and scores, in order. Defined cases: null and empty texts have none; a null path
has no words; repeated rows give a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, forest

LEAST, LEAST_NAMED, CUT, FINDINGS = 16, 4, 0.5, 4000
#: Characters beside a run that features see, at most, and the longest run of a labelled finding in a table.
BESIDE, LONGEST = 60, 1000
#: Dictionary words: so many occurrences at least, and one in so many of all words.
OCCURS, ONE_IN = 3, 1_000_000
_RUN = re.compile(r"[A-Za-z0-9_+/=-]{%d,}" % LEAST)
_NAMES = r"(?:tokens?|keys?|secrets?|passwords?|passwd|passphrase|pwd|pass|auth|credentials?|apikey|access|bearer|private)"
#: What follows an assignment, or a word for secrets: up to the closing quote, or else to white space, a quote or an angle bracket.
_NAMED = re.compile(
    r"(?:(?:=>|:=|[=:])(?!//)[ \t]*|(?<![a-z])%s(?:[\"']?[ \t]*(?:=>|:=|[=:])[ \t]*|>|[ \t]+(?:(?:is|was)[ \t]+)?))"
    r"(?:\"([^\"\s]{%d,})\"|'([^'\s]{%d,})'|[\"']?([^\s\"'`<>]{%d,}))" % (_NAMES, *[LEAST_NAMED] * 3),
    re.IGNORECASE,
)
_FURTHER = re.compile(r"[?&;,](?=\w+=)")
_WORD = re.compile(r"\b[^\W\d_]+\b")
_SYMBOLS = {c: i for i, c in enumerate(string.ascii_lowercase + string.digits)}
SCHEMA = "doc_id long, n_candidates long, n_secrets long, secrets array<struct<start:long,length:long,score:double>>"

#: Words beside a secret, beside other long runs, and in paths of tests and examples.
_FOR = frozenset("token key secret password passwd pwd auth credential credentials api apikey access bearer private".split())
_AGAINST = frozenset("commit sha sha1 sha256 md5 checksum digest hash uuid guid id version build card phone call number order invoice isbn image file rev revision merge".split())
_PLAY = frozenset("test tests example examples sample fixture fixtures mock docs doc demo".split())
_PLACEHOLDERS = ("example", "sample", "dummy", "placeholder", "changeme", "your", "here", "test", "xxxx", "token", "secret", "password", "key", "redacted", "insert", "1234", "abcd", "0000")


def _transitions(counted) -> np.ndarray:
    """Occurrences of each pair of successive symbols in words with counts."""
    table = np.zeros((37, 37))
    for w, n in counted:
        codes = [_SYMBOLS.get(c, 36) for c in w]
        for a, b in zip(codes, codes[1:], strict=False):
            table[a, b] += n
    return table


def _count_words(batches):
    import pyarrow as pa

    def emit(counts: Counter):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    counts: Counter = Counter()
    for batch in batches:
        for t in batch.column(0):
            counts.update(_WORD.findall((t.as_py() or "").lower()))
            if len(counts) >= 100_000:
                yield emit(counts)
                counts = Counter()
    if counts:
        yield emit(counts)


def _count_transitions(batches):
    import pyarrow as pa

    table = np.zeros((37, 37))
    for batch in batches:
        table += _transitions(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    at = np.flatnonzero(table)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(table.reshape(-1)[at].astype(np.int64))], ["cell", "n"])


@dataclass
class Language:
    """Character transitions and words of running text."""

    transitions: np.ndarray
    words: frozenset

    @classmethod
    def of(cls, texts: list[str | None]) -> Language:
        """Of texts at hand."""
        counts = Counter(w for t in texts for w in _WORD.findall((t or "").lower()))
        return cls.made(_transitions(counts.items()), (w for w in counts if len(w) >= 3))

    @classmethod
    def made(cls, counts: np.ndarray, words) -> Language:
        table = counts + 1.0
        return cls(np.log(table / table.sum(axis=1, keepdims=True)), frozenset(words) | frozenset(_PLACEHOLDERS))

    @classmethod
    def of_table(cls, texts: DataFrame) -> Language:
        """Of all rows of ``text``: sums over the table; words are counted per task before they move."""
        words = common.cut(texts.select("text").mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
        cells = words.mapInArrow(_count_transitions, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(37 * 37)
        counts[[r.cell for r in cells]] = [r.n for r in cells]
        total = words.agg(F.sum("n")).first()[0] or 0
        often = words.filter((F.length("word") >= 3) & (F.col("n") >= max(OCCURS, total / ONE_IN))).select("word").toLocalIterator()
        return cls.made(counts.reshape(37, 37), (r.word for r in often))

    def likely(self, run: str) -> float:
        codes = [_SYMBOLS.get(c, 36) for c in run.lower()]
        return float(np.mean(self.transitions[codes[:-1], codes[1:]])) if len(codes) > 1 else 0.0

    def coverage(self, run: str) -> float:
        """Share of the run inside dictionary words, taken from the left, the longest first."""
        run, at, inside = run.lower(), 0, 0
        while at < len(run):
            for n in range(min(12, len(run) - at), 2, -1):
                if run[at : at + n] in self.words:
                    inside += n
                    at += n
                    break
            else:
                at += 1
        return inside / max(1, len(run))


def candidates(text: str | None) -> list[tuple[int, str]]:
    """Places and runs, in order: what is assigned or named, and long runs between those."""
    text, out, at, look = text or "", [], 0, 0
    while m := _NAMED.search(text, look):
        k = m.lastindex
        run, look = m[k], m.start(k)
        if k == 3:  # further assignments of an unquoted run (a query string, say) are looked at in their own right
            run = "" if "://" in run else _FURTHER.split(run, maxsplit=1)[0].rstrip(".,;:)]}")
        if len(run) >= LEAST_NAMED:
            out += [(r.start(), r[0]) for r in _RUN.finditer(text, at, m.start(k))]
            out.append((m.start(k), run))
            at = look = m.start(k) + len(run)
    return out + [(r.start(), r[0]) for r in _RUN.finditer(text, at)]


def features(language: Language, text: str, start: int, run: str, path: str | None) -> list[float]:
    n = len(run)
    before, after = text[max(0, start - BESIDE) : start], text[start + n : start + n + 40]
    near = [w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9]*", before.replace("_", " "))[-3:]]
    next_ = [w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9]*", after.replace("_", " "))[:1]]
    play = {w.lower() for w in re.findall(r"[A-Za-z]+", path or "")}
    digits, upper = sum(c.isdigit() for c in run), sum(c.isupper() for c in run)
    counts = Counter(run)
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(run, run[1:], strict=False))
    return [
        n,
        digits / n,
        upper / n,
        sum(c in "_+/=-" for c in run) / n,
        sum(not c.isalnum() and c not in "_+/=-" for c in run) / n,
        float(any(c.islower() for c in run)) + any(c.isupper() for c in run) + (digits > 0) + any(not c.isalnum() for c in run),
        float(run.isalpha() and (run.islower() or run.istitle())),
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        max(counts.values()) / n,
        switches / n,
        float(all(c in "0123456789abcdefABCDEF-" for c in run)),
        language.likely(run),
        language.coverage(run),
        float(bool(_FOR.intersection(near))),
        float(bool(_AGAINST.intersection(near))),
        float(bool(_AGAINST.intersection(next_))),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))),
        float(before[-1:] in "\"'" and before[-1:] != ""),
        float(bool(_PLAY.intersection(play))),
    ]


@dataclass
class Finding:
    text: str
    start: int
    run: str
    path: str
    secret: bool


def labelled_findings(n: int = FINDINGS, seed: int = 11) -> list[Finding]:
    """Labelled findings, made from a seed: half secrets, half not."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    hexa = lambda k: pick("0123456789abcdef", k)
    alnum = string.ascii_letters + string.digits
    syllables = "the tion an er re in on de la le und ge ver que ment ci as os th st".split()
    prose = lambda k: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(k))
    symbols = alnum + "!#$%*+-.?@^_~"
    def long() -> str:
        return next(w for w in iter(lambda: prose(1), None) if len(w) >= LEAST_NAMED)

    true = (
        lambda: (f'token = "{(k := hexa(rng.choice((32, 40, 40, 64))))}"', k),
        lambda: (f'{rng.choice(("api_key", "secret", "auth_token", "access_key", "private_key"))} = "{(k := hexa(rng.choice((32, 40, 48))))}"', k),
        lambda: (f"{rng.choice(('API_KEY', 'SECRET_KEY', 'TOKEN'))}={(k := pick(alnum, rng.randint(20, 48)))}", k),
        lambda: (f"aws_access_key_id = {(k := 'AKIA' + pick(string.ascii_uppercase + '234567', 16))}", k),
        lambda: (f"Authorization: Bearer {(k := pick(alnum + '_-', rng.randint(24, 60)))}", k),
        lambda: (f'password: "{(k := pick(alnum + "_+", rng.randint(16, 24)))}"', k),
        lambda: (f"{rng.choice(('password', 'DB_PASSWORD', 'passwd', 'pwd'))}{rng.choice((': ', '=', ' = '))}{(q := rng.choice(('', chr(34))))}{(k := pick(symbols, rng.randint(7, 20)) + rng.choice(alnum))}{q}", k),
        lambda: (f"the password is {(k := pick(symbols, rng.randint(7, 15)) + rng.choice(alnum))}", k),
        lambda: (f"{rng.choice(('key', 'secret', 'token'))} = {(q := rng.choice(('', chr(34))))}{(k := pick(rng.choice((alnum, string.ascii_letters, string.ascii_uppercase + '234567')), rng.randint(10, 32)))}{q}", k),
        lambda: (f"use the key {(k := 'ghp_' + pick(alnum, 36))} for it", k),
    )
    def marked(k: str) -> str:
        return (rng.choice(("example", "your", "test", "dummy", "sample")) + rng.choice("_-") + rng.choice(("token", "key", "secret")) + rng.choice("_-") + rng.choice(("here", "1234", "value1", "00")) + k)
    false = (
        lambda: (f"commit {(k := hexa(40))}", k),
        lambda: (f"{rng.choice(('sha256', 'md5', 'checksum', 'digest'))}: {(k := hexa(rng.choice((32, 40, 64))))}", k),
        lambda: (f"{rng.choice(('uuid', 'id', 'order'))} {(k := '-'.join(map(hexa, (8, 4, 4, 4, 12))))}", k),
        lambda: ((k := pick(string.digits, rng.randint(16, 19))), k),
        lambda: (f"card {(k := '4' + pick(string.digits, 15))} paid", k),
        lambda: (f'token = "{(k := marked(""))}"', k),
        lambda: (f'api_key = "{(k := rng.choice("x0X1a") * rng.randint(15, 40) + "0")}"', k),
        lambda: (f"see {(k := prose(1).replace(' ', '') + '-' + prose(1).replace(' ', '') + '-' + prose(1) + '-release-' + str(rng.randint(1, 99)))}", k),
        lambda: (f"file {(k := '/usr/share/' + prose(1) + '/' + prose(1) + '-2.' + str(rng.randint(0, 9)))}", k),
        lambda: (f"{(k := prose(1) + str(rng.randint(1000, 9999)) + prose(1) + prose(1))}", k),
        lambda: ((k := rng.choice("=-_") * rng.randint(16, 60)), k),
        lambda: (f"{rng.choice(('note', 'name', 'title', 'type', 'mode', 'by', 'see'))}{rng.choice((': ', ' = ', '='))}{(k := long())}", k),
        lambda: (f"{rng.choice(('key', 'the token', 'access', 'pass', 'private', 'secret', 'password'))} {(k := long())}", k),
        lambda: (f"{rng.choice(('password', 'token', 'secret', 'api_key'))}{rng.choice((': ', '=', ' = '))}{(k := rng.choice(('changeme', 'required', 'hidden', 'None', 'null', 'true', 'your_password', 'xxxxxxxx', '********', 'password', 'example', 'config.' + long(), 'get_' + long() + '()')))}", k),
        lambda: (f"{rng.choice(('width', 'size', 'port', 'date', 'price', 'version', 'time', 'id', 'at'))}{rng.choice((': ', '=', ' = '))}{(k := rng.choice((str(rng.randint(1000, 10**9)), f'{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}', f'{rng.randint(1, 99)}.{rng.randint(10, 99)}.{rng.randint(0, 9)}', f'{rng.randint(10, 23)}:{rng.randint(10, 59)}')))}", k),
        lambda: ((k := "".join(long() for _ in range(rng.randint(3, 5)))), k),
        lambda: ((k := "_".join(long() for _ in range(rng.randint(3, 5)))), k),
        lambda: ((k := "=" * rng.randint(16, 30) + "1" + "=" * 8), k),
    )
    out = []
    while len(out) < n:
        secret = len(out) % 2 == 0
        said, run = rng.choice(true if secret else false)()
        head = prose(rng.randint(0, 12))
        text = f"{head}{rng.choice((' ', chr(10))) if head else ''}{said} {prose(rng.randint(0, 10))}"
        whole = next(((s, r) for s, r in candidates(text) if run in r), None)
        if whole is None:
            continue
        play = rng.random() < (0.05 if secret else 0.2)
        out.append(Finding(text, whole[0], whole[1], f"tests/{prose(1)}.py" if play else f"src{rng.randint(0, 99)}", secret))
    return out


@dataclass
class Scanner:
    language: Language
    trees: forest.Forest

    def score(self, found: list[tuple[str, int, str, str | None]]) -> np.ndarray:
        return self.trees.predict(np.array([features(self.language, *f) for f in found], float)) if found else np.zeros(0)

    def scan(self, texts: list[str | None], paths: list[str | None]) -> list[tuple[int, list[dict]]]:
        """Of each text: the number of candidates, and the secrets."""
        found = [candidates(t) for t in texts]
        flat = [(t or "", s, r, p) for t, p, f in zip(texts, paths, found, strict=True) for s, r in f]
        scores = iter(self.score(flat))
        out = []
        for f in found:
            each = [(s, len(r), float(next(scores))) for s, r in f]
            out.append((len(f), [{"start": s, "length": n, "score": round(x, 6)} for s, n, x in each if x >= CUT]))
        return out


def train(language: Language, findings: list[Finding]) -> Scanner:
    x = np.array([features(language, f.text, f.start, f.run, f.path) for f in findings], float)
    return Scanner(language, forest.fit(x, np.array([f.secret for f in findings], float)))


def findings_of(rows: DataFrame, most: int = FINDINGS) -> list[Finding]:
    """Labelled findings of a table: ``text``, ``start`` and ``length`` in characters, ``path``, ``secret`` (Boolean).

    At most ``most`` of them, those with the least hash of what the features see: ``BESIDE`` characters before the run, the
    run (no longer than ``LONGEST``) and what follows. Rows with a null or a place outside the text are no findings.
    """
    rows = rows.filter("text is not null and secret is not null and start >= 0 and length > 0 and start + length <= char_length(text)").filter(F.col("length") <= LONGEST)
    begin = F.greatest(F.col("start") - BESIDE, F.lit(0))
    seen = rows.select(F.substring("text", begin + 1, F.col("start") - begin + F.col("length") + BESIDE).alias("text"), (F.col("start") - begin).alias("start"), "length", F.coalesce("path", F.lit("")).alias("path"), "secret").distinct()
    some = seen.orderBy(F.xxhash64(*seen.columns), *seen.columns).limit(most).collect()
    return [Finding(r.text, r.start, r.text[r.start : r.start + r.length], r.path, r.secret) for r in some]


def fit(docs: DataFrame, findings: list[Finding] | DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> Scanner:
    """A scanner from the table's language and labelled findings: a list, a table of them (``findings_of``), or those of ``labelled_findings``."""
    if isinstance(findings, DataFrame):
        findings = findings_of(findings)
    return train(Language.of_table(common.ids_and_text(docs, id_col, text_col)), labelled_findings() if findings is None else findings)


def _apply(scanner: Scanner):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                got = scanner.scan(part.column(1).to_pylist(), part.column(2).to_pylist())
                counts, secrets = pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], kind)
                yield pa.RecordBatch.from_arrays([part.column(0), counts, pa.array([len(s) for _, s in got], pa.int64()), secrets], ["doc_id", "n_candidates", "n_secrets", "secrets"])

    return run


def scan(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    path = docs[path_col].cast("string") if path_col else F.lit(None).cast("string")
    common.small_batches(docs.sparkSession)
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), path.alias("path")).mapInArrow(_apply(scanner), SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", spread=True)
    return scan(docs, fit(docs))
