"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Document statistics (shares of character classes, repetition, lengths) are standardised and mapped by random Fourier
features, which approximate a Gaussian kernel. Every partition sums its part of the normal equations by fold; sums of
fixed size are added by the executors, and the driver solves. For calibration each row is scored by the solution of the
other folds; those raw scores, counted in bins of fixed number, are pooled where adjacent ones violate the order, and
between the centres of the pooled blocks the score runs straight, so it never falls as the raw score rises.

Training rows are all labelled rows whose crc32(doc_id as text) mod 5 isn't 0; that remainder is also their fold. doc_id serves that choice and the join
with labels only; labels, lang, source and doc_id are no inputs of a score.

Defined cases: a null or empty text has its statistics (zeros) and a score; labels that are null or missing don't train;
a document with several labels trains with each; without any training row every score is 0.5; repeated rows give a row
each. Held out is false for a null doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from culler.llm import quality_rules as Q
from culler.llm import text as T

FEATURES, WIDTH, RIDGE, SEED = 192, 2.0, 1.0, 7
FOLDS, CUT = 5, 0.3
CALIBRATION = 512  # bins of raw scores
PARTS = 16  # of a sum, added by as many tasks
CLASSES = (T.byte_class(range(0x30, 0x3A)), T.byte_class(b".,;:"), T.byte_class(b"!?"), T.byte_class(b"#*$%&"), T.byte_class(b"|<>"), T.byte_class(b"()[]{}\"'/\\_=+@~^`-"), T.byte_class(range(0x80, 0x100)))


def statistics(c: T.Chunk) -> np.ndarray:
    """One row of statistics for each document of a chunk, all within small ranges."""
    m = Q.measure(c)
    n, chars, lines = np.maximum(m["n_words"], 1), np.maximum(m["word_chars"], 1), np.maximum(m["n_lines"], 1)
    w = c.words()
    _, later = T.repeated(w.hash ^ T.mix(np.arange(1, c.n + 1, dtype=T.U))[w.doc])
    distinct = m["n_words"] - np.bincount(w.doc[later], minlength=c.n)
    caps = Q.UPPER[c.data]
    columns = [
        np.log1p(m["n_words"]),
        m["word_chars"] / n / 10,
        m["n_repeat_words"] / n,
        m["n_dup_lines"] / lines,
        np.log1p(n / lines),
        distinct / n,
        m["n_upper"] / chars,
        np.bincount(w.doc, caps[w.starts], minlength=c.n) / n,
        *(np.minimum(c.per_doc(k[c.data]) / n, 3) for k in CLASSES),
    ]
    return np.stack(columns, 1)


N_STATS = 8 + len(CLASSES)


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, features: int, width: float, seed: int) -> np.ndarray:
    """Random Fourier features of standardised statistics, the statistics themselves, and a one."""
    z = np.clip((x - mean) / scale, -5, 5)
    rng = np.random.default_rng(seed)
    w, b = rng.normal(size=(x.shape[1], features)) / (width * np.sqrt(x.shape[1])), rng.uniform(0, 2 * np.pi, features)
    return np.concatenate([np.cos(z @ w + b) * np.sqrt(2 / features), z / np.sqrt(x.shape[1]), np.ones((len(x), 1))], 1)


def pool(n: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Isotonic regression over ordered bins: pools adjacent violators; bins without rows take the value before them."""
    out, blocks = np.full(len(n), 0.5), _blocks(n, positive)
    for i, (a, b, k, _) in enumerate(blocks):
        out[(0 if i == 0 else k) :] = b / a
    return out


def _blocks(n: np.ndarray, positive: np.ndarray) -> list[list[float]]:
    """Pooled blocks: rows, positive rows, first bin, sum of bins over rows."""
    stack: list[list[float]] = []
    for k, (a, b) in enumerate(zip(n.tolist(), positive.tolist(), strict=True)):
        if not a:
            continue
        stack.append([a, b, k, a * k])
        while len(stack) > 1 and stack[-2][1] * stack[-1][0] >= stack[-1][1] * stack[-2][0]:
            a2, b2, _, c2 = stack.pop()
            stack[-1][0] += a2
            stack[-1][1] += b2
            stack[-1][3] += c2
    return stack


def _add(rows: DataFrame, size: int) -> np.ndarray:
    """Sum of vectors of `size` doubles from their parts `k`, added up by the executors; the driver gets one vector. Without rows, zeros."""

    def run(key, table):
        total = sum(np.frombuffer(x) for x in table.column("v").to_pylist())
        return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})

    parts = sorted(rows.groupBy("k").applyInArrow(run, "k int, v binary").collect(), key=lambda r: r["k"])
    return np.concatenate([np.frombuffer(r["v"]) for r in parts]) if parts else np.zeros(size)


class Model:
    """What scoring needs; its size depends on the number of features alone."""

    def __init__(self, mean, scale, weights, curve, features, width, seed):
        self.mean, self.scale, self.weights, self.curve, self.features, self.width, self.seed = mean, scale, weights, curve, features, width, seed

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier(x, self.mean, self.scale, self.features, self.width, self.seed) @ self.weights

    def bins(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(((raw + 0.5) / 2 * CALIBRATION).astype(np.int64), 0, CALIBRATION - 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), *self.curve), 0, 1)


def fit(train: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """train: columns s (array of statistics), y (0 or 1) and fold (1 to FOLDS - 1)."""

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y, fold = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("y", "fold"))
        return np.array(batch.column("s").flatten().to_numpy(zero_copy_only=False)).reshape(-1, N_STATS), y.astype(float), fold.astype(np.int64)

    def summed(size, add):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    total += add(*read(batch))
            parts = np.array_split(total, min(PARTS, size))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([x.tobytes() for x in parts], pa.binary())], ["k", "v"])

        return _add(train.mapInArrow(run, "k int, v binary"), size)

    m = summed(2 * N_STATS + 1, lambda x, y, fold: np.concatenate([x.sum(0), (x * x).sum(0), [len(x)]]))
    n = m[-1]
    if not n:
        return Model(np.zeros(N_STATS), np.ones(N_STATS), np.zeros(features + N_STATS + 1), None, features, width, seed)
    mean = m[:N_STATS] / n
    scale = np.sqrt(np.maximum(m[N_STATS : 2 * N_STATS] / n - mean**2, 1e-4))
    d = features + N_STATS + 1

    def normal(x, y, fold):
        f = fourier(x, mean, scale, features, width, seed)
        return np.concatenate([np.concatenate([(f[k].T @ f[k]).ravel(), f[k].T @ y[k]]) for k in (fold == i for i in range(1, FOLDS))])

    a = summed((FOLDS - 1) * (d * d + d), normal).reshape(FOLDS - 1, d * d + d)
    solve = lambda v: np.linalg.solve(v[: d * d].reshape(d, d) + ridge * np.eye(d), v[d * d :])
    model = Model(mean, scale, solve(a.sum(0)), None, features, width, seed)
    others = [solve(a.sum(0) - own) for own in a]

    def histogram(x, y, fold):
        raw = np.zeros(len(x))
        for i, w in enumerate(others, 1):
            raw[fold == i] = fourier(x[fold == i], mean, scale, features, width, seed) @ w
        k = model.bins(raw)
        return np.concatenate([np.bincount(k, minlength=CALIBRATION), np.bincount(k, y, minlength=CALIBRATION)]).astype(float)

    h = summed(2 * CALIBRATION, histogram)
    blocks = _blocks(h[:CALIBRATION], h[CALIBRATION:])
    model.curve = np.array([(c / a_ + 0.5) / CALIBRATION * 2 - 0.5 for a_, _, _, c in blocks]), np.array([b / a_ for a_, b, _, _ in blocks])
    return model


def _fold():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS, F.lit(1))


def held_out():
    return _fold() == 0


def classify(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; learns from labels of rows that aren't held out."""
    spark = docs.sparkSession
    T.ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, c in T.chunks(batch, "text"):
                s = statistics(c)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, s.size + 1, N_STATS, dtype=np.int32)), pa.array(s.ravel()))
                yield pa.RecordBatch.from_arrays([rows.column(0), flat], ["doc_id", "s"])

    rows = T.cut(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, s array<double>"))
    y = labels.filter("quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("y"))
    train = T.cut(rows.filter(~held_out()).join(y, "doc_id").select("s", "y", _fold().cast("int").alias("fold")))
    sent = spark.sparkContext.broadcast(fit(train, **parameters))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("s").flatten().to_numpy(zero_copy_only=False)).reshape(-1, N_STATS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(sent.value.score(x))], ["doc_id", "held_out", "score"])

    out = rows.withColumn("h", held_out()).mapInArrow(score, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return classify(T.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
