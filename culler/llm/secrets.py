"""Secret scans: fixed patterns, and a randomness test battery over every long token.

Pass one reads each text once. It finds the pattern kinds (assign, access, hex) and scores all tokens of at least
`least` characters: the encoding is inferred (hexadecimal, base32, base64), then a chi-squared test of alphabet
uniformity, a runs test and a serial-correlation test under that encoding give three p-values, whose sum of
logarithms is the score. Tokens of letters of one case (the first may differ) are ordinary words and aren't tested; all
others are, inside patterns as well. Pass two needs no text: from corpus-wide counts by score and length (a table of
fixed size) it takes the share of ordinary words that score as high as a token as that token's p-value under "ordinary
text" and applies Benjamini and Hochberg's step-up rule with weights in proportion to token length. Tokens that pass are
random; those that meet no pattern become spans of the kind `random`, and each test is reported with its p-values.

Defined cases: a null or empty text has no spans; repeated rows give a row each; without ordinary words nothing is
added to the patterns. Spans are in code points, the end exclusive. A `random` span never overlaps a pattern span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from culler.llm import text as T

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
HEX = T.byte_class(b"0123456789abcdef")
TOKEN = T.byte_class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=")
LEAST = 20  # characters of a token that is tested
ORDINARY = 12  # characters of a word that counts towards the null distribution
BINS, STEP = 128, 0.25  # score bins
LENGTHS = 64  # length classes: characters up to this


def _table(alphabet: bytes) -> np.ndarray:
    t = np.full(256, -1, np.int16)
    t[list(alphabet)] = np.arange(len(alphabet))
    return t


_UPPER, _LOWER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
BASE64 = _table(_UPPER + _LOWER + _DIGITS + b"+/")
BASE64[ord("-")], BASE64[ord("_")], BASE64[ord("=")] = 62, 63, 63
BASE32 = _table(_UPPER + b"234567")
BASE16 = _table(_DIGITS + b"abcdef")
BASE16[list(b"ABCDEF")] = np.arange(10, 16)
LETTER = T.byte_class(_UPPER + _LOWER)


def _normal_tail(z: np.ndarray) -> np.ndarray:
    """P(Z > z) by the rational approximation 26.2.17 of Abramowitz and Stegun."""
    a = np.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    p = np.exp(-a * a / 2) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.clip(np.where(z >= 0, p, 1 - p), 1e-12, 1)


def battery(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each token data[start:end] three p-values under "uniformly random": uniformity, runs, serial correlation. A score is the sum of their logarithms (0: most random)."""
    n = ends - starts
    m = len(n)
    if not m:
        return np.zeros((0, 3))
    owner = np.repeat(np.arange(m), n)
    b = data[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    every = lambda t: np.bincount(owner[t[b] < 0], minlength=m) == 0
    hex_, b32 = every(BASE16), every(BASE32)
    kind = np.where(hex_, 0, np.where(b32, 1, 2))
    x = np.where(kind[owner] == 0, BASE16[b], np.where(kind[owner] == 1, BASE32[b], BASE64[b])).astype(np.int64)
    size = np.array([16, 32, 64])[kind]
    seen = np.bincount(owner * 8 + x * 8 // size[owner], minlength=8 * m).reshape(m, 8)
    stat = ((seen - n[:, None] / 8) ** 2).sum(1) * 8 / n
    uniform = _normal_tail(((stat / 7) ** (1 / 3) - (1 - 2 / 63)) / np.sqrt(2 / 63))
    high = x * 2 >= size[owner]
    inner = np.ones(len(owner), bool)
    inner[np.cumsum(n) - n] = False
    change = inner.copy()
    change[1:] &= high[1:] != high[:-1]
    runs = np.bincount(owner[change], minlength=m) + 1
    n1 = np.bincount(owner[high], minlength=m)
    n0 = n - n1
    mean = 2 * n0 * n1 / n + 1
    var = np.maximum((mean - 1) * (mean - 2) / np.maximum(n - 1, 1), 1e-9)
    runs_p = np.where((n0 == 0) | (n1 == 0), 1e-12, 2 * _normal_tail(np.abs(runs - mean) / np.sqrt(var)))
    y = x - np.bincount(owner, x, minlength=m)[owner] / n[owner]
    product = np.zeros(len(y))
    product[1:] = y[1:] * y[:-1]
    r = np.bincount(owner[inner], product[inner], minlength=m) / np.maximum(np.bincount(owner, y * y, minlength=m), 1e-9)
    serial = 2 * _normal_tail(np.abs(r) * np.sqrt(n))
    return np.clip(np.stack([uniform, runs_p, serial], 1), 1e-12, 1)


def _bins(score: np.ndarray) -> np.ndarray:
    return np.clip((-score / STEP).astype(np.int64), 0, BINS - 1)


def scan(c: T.Chunk, least: int = LEAST) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple]], np.ndarray]:
    """Of each document: spans (start, end, kind) of the patterns and tests (start, end, score bin, length class, whether it
    meets a pattern, three p-values); and counts of ordinary words by score bin."""
    points = None
    spans: list[list[tuple[int, int, int]]] = [[] for _ in range(c.n)]
    more: list[list[tuple]] = [[] for _ in range(c.n)]
    raw = c.data.tobytes()
    low = raw.lower()
    hot = set()
    for hint in (*HINTS, b"akia"):
        at = low.find(hint)
        while at >= 0:
            d = int(np.searchsorted(c.offsets, at, "right")) - 1
            hot.add(d)
            at = low.find(hint, int(c.offsets[d + 1]))
    for d in hot:
        s = raw[c.offsets[d] : c.offsets[d + 1]].decode("utf-8", "replace")
        spans[d] += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(s) if len(m[1]) >= 6]
        spans[d] += [(m.start(), m.end(), 1) for m in ACCESS.finditer(s) if m.end() - m.start() >= 20]
    starts, ends = c.runs(HEX[c.data])
    far = ends - starts >= 24
    starts, ends = starts[far], ends[far]
    if len(starts):
        points = c.code_points()
        for s, e, d in zip(starts, ends, np.searchsorted(c.offsets, starts, "right") - 1, strict=True):
            spans[d].append((int(points[s] - points[c.offsets[d]]), int(points[e] - points[c.offsets[d]]), 2))
    starts, ends = c.runs(TOKEN[c.data])
    far = ends - starts >= min(least, ORDINARY)
    starts, ends = starts[far], ends[far]
    tests = battery(c.data, starts, ends)
    score = _bins(np.log(tests).sum(1))
    others = np.zeros(len(c.data) + 1, np.int64)
    np.cumsum(~LETTER[c.data], out=others[1:])
    ups = np.zeros(len(c.data) + 1, np.int64)
    np.cumsum((c.data >= 65) & (c.data <= 90), out=ups[1:])
    after = ups[ends] - ups[np.minimum(starts + 1, ends)]
    word = (others[ends] == others[starts]) & ((after == 0) | (after == ends - starts - 1))
    ordinary = np.bincount(score[word & (ends - starts >= ORDINARY)], minlength=BINS)
    test = np.flatnonzero(~word & (ends - starts >= least))
    if len(test):
        points = c.code_points() if points is None else points
        for i in test:
            s, e = int(starts[i]), int(ends[i])
            d = int(np.searchsorted(c.offsets, s, "right")) - 1
            p, q = int(points[s] - points[c.offsets[d]]), int(points[e] - points[c.offsets[d]])
            more[d].append((p, q, int(score[i]), min(e - s, LENGTHS), any(q > x and p < y for x, y, _ in spans[d]), *tests[i].tolist()))
    return [sorted(x, key=lambda v: (v[0], v[2])) for x in spans], more, ordinary


def threshold(ordinary: np.ndarray, tests: np.ndarray, alpha: float) -> np.ndarray:
    """For each length class, the bins that pass: weighted step-up at false-discovery rate alpha. tests: counts by (length, bin)."""
    p = (1 + np.cumsum(ordinary)) / (1 + ordinary.sum())  # bin 0 is the most random
    m = tests.sum()
    lengths = np.arange(LENGTHS + 1)
    weight = lengths / max((tests.sum(1) * lengths).sum() / max(m, 1), 1e-9)
    q = np.where(weight[:, None] > 0, p[None, :] / np.maximum(weight[:, None], 1e-9), np.inf)
    if not m or not ordinary.sum():
        return np.zeros((LENGTHS + 1, BINS), bool)
    order = np.argsort(q, axis=None, kind="stable")
    seen = np.cumsum(tests.ravel()[order])
    ok = (q.ravel()[order] <= alpha * seen / m) & (tests.ravel()[order] > 0)
    cut = q.ravel()[order][ok].max() if ok.any() else -1.0
    return q <= cut


def find_secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = LEAST, alpha: float = 0.01) -> DataFrame:
    """One row per document: the columns in `keep`; `found`, an array of (start, kind, end) by start, then kind; and `tests`,
    one of (start, end, uniform, runs, serial, random) for all tokens tested. Underscores follow where `keep` has a name.

    alpha: the share of false ones among random tokens that is tolerated.
    """
    T.ship(docs.sparkSession)
    given, keep = keep, tuple(f"k{i}" for i in range(len(keep)))
    source = docs.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(given, keep, strict=True)], F.col(f"`{text}`").alias("__text"))
    span, cand = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())])), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("bin", pa.int32()), ("size", pa.int32()), ("met", pa.bool_()), ("uniform", pa.float64()), ("runs", pa.float64()), ("serial", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, types, names = np.zeros(BINS, np.int64), None, [*keep, "base", "more", "ordinary"]
        for batch in batches:
            for rows, c in T.chunks(batch, "__text"):
                base, more, ordinary = scan(c, least)
                total += ordinary
                types = [rows.column(i).type for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(keep))), pa.array([[dict(zip(("start", "end", "kind"), x, strict=True)) for x in d] for d in base], span), pa.array([[dict(zip(("start", "end", "bin", "size", "met", "uniform", "runs", "serial"), x, strict=True)) for x in d] for d in more], cand), pa.nulls(c.n, pa.list_(pa.int64()))], names)
        if types is not None:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types), pa.nulls(1, span), pa.nulls(1, cand), pa.array([total.tolist()], pa.list_(pa.int64()))], names)

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    rows = T.cut(source.mapInArrow(run, own + ", base array<struct<start: bigint, end: bigint, kind: int>>, more array<struct<start: bigint, end: bigint, bin: int, size: int, met: boolean, uniform: double, runs: double, serial: double>>, ordinary array<bigint>"))
    ordinary, tests = np.zeros(BINS, np.int64), np.zeros((LENGTHS + 1, BINS), np.int64)
    for r in rows.filter("ordinary IS NOT NULL").select(F.posexplode("ordinary").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():
        ordinary[r["k"]] = r["n"]
    for r in rows.select(F.explode("more").alias("m")).groupBy("m.size", "m.bin").count().collect():
        tests[r["size"], r["bin"]] = r["count"]
    good = [int(size * BINS + k) for size, k in zip(*np.nonzero(threshold(ordinary, tests, alpha)), strict=True) if tests[size, k]]
    passed = f"array_contains(array({', '.join(map(str, good)) or '-1'}), x.size * {BINS} + x.bin)"  # LENGTHS * BINS numbers at most
    added = F.expr(f"transform(filter(more, x -> NOT x.met AND {passed}), x -> named_struct('start', x.start, 'end', x.end, 'kind', 3))")
    tests = F.expr(f"transform(more, x -> named_struct('start', x.start, 'end', x.end, 'uniform', x.uniform, 'runs', x.runs, 'serial', x.serial, 'random', {passed}))")
    found, tested = T.free(given, "found", "tests")
    spans = F.array_sort(F.transform(F.concat("base", added), lambda x: F.struct(x["start"], x["kind"], x["end"])))
    return rows.filter("ordinary IS NULL").select(*[F.col(n).alias(k) for k, n in zip(given, keep, strict=True)], spans.alias(found), tests.alias(tested))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents."""
    rows = find_secrets(T.documents(spark, sf_dir))
    name = "element_at(array('assign', 'access', 'hex', 'random'), x.kind + 1)"
    said = lambda which: F.expr(f"array_join(transform({which}, x -> concat_ws(':', {name}, x.start, x.end)), ',')")
    n = lambda k: F.expr(f"cast(size(filter(found, x -> x.kind = {k})) as bigint)")
    return rows.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(said("filter(found, x -> x.kind < 3)"), 256).alias("base_sha256"), said("found").alias("spans"), F.size("tests").cast("bigint").alias("n_tested"), F.expr("cast(size(filter(tests, x -> x.random)) as bigint)").alias("n_random"))
