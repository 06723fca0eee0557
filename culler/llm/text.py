"""Vectorised text kernels shared by the operators.

Texts stay UTF-8 bytes in one numpy buffer per chunk; words, lines and windows are index arrays into it.
Every hash is 64 bits of a polynomial in the bytes (or in the word hashes) followed by a finaliser, so a window
of any width costs O(1) once the prefix sums are there.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
CHUNK = 1 << 19  # bytes of text that a kernel looks at together
BATCH = 1 << 22  # bytes of rows that go to a Python worker together; a longer row goes alone
ODD = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on whole arrays."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _byte_values() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=U) * ODD)


VALUES = _byte_values()
FOLDED = VALUES.copy()
FOLDED[65:91] = VALUES[97:123]
_BASE, _powers = 0xD1342543DE82EF95, {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i in 0..n; kept, and made anew where more are wanted."""
    have = _powers.get("p")
    if have is None or len(have) <= n:
        size = ((n >> 18) + 1) << 18
        size += 1 << 18 if size <= n + 1 else 0
        for name, base in (("p", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
            p = np.empty(size, U)
            p[0] = at = 1
            while at < size:
                to = min(2 * at, size)
                p[at:to] = p[: to - at] * U(pow(base, at, 1 << 64))
                at = to
            _powers[name] = p
    return _powers["p"], _powers["i"]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE**i, with a leading zero."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values in [start, end): equal sequences anywhere give equal hashes."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(U) * ODD)


def byte_class(pattern_bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(pattern_bytes)] = True
    return t


SPACE = byte_class([0x20, *range(0x09, 0x0E)])
PLAIN = ~SPACE  # words [^\x20\x09-\x0D]+
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM_FOLDED = ALNUM | byte_class(range(0x41, 0x5B))  # the same before A-Z are lowered


class Chunk:
    """Some whole documents: bytes, and offsets of the documents in them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs where `inside` holds; no run crosses a document."""
        if not len(self.data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        o, before, after = self.offsets, np.empty_like(inside), np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        before[o[:-1][o[:-1] < len(inside)]] = False
        after[o[1:][o[1:] > 0] - 1] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def words(self, kind: np.ndarray = PLAIN, fold: bool = False, hashes: bool = True) -> Words:
        starts, ends = self.runs(kind[self.data])
        sums = prefix((FOLDED if fold else VALUES)[self.data]) if hashes else None
        return Words(self, starts, ends, span_hash(sums, starts, ends) if hashes else None, sums)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of the lines, in order; an empty document has one empty line."""
        cut = np.flatnonzero(self.data == 10)
        starts = np.concatenate([self.offsets[:-1], cut + 1])
        ends = np.concatenate([cut, self.offsets[1:]])
        doc = np.concatenate([np.arange(self.n), np.searchsorted(self.offsets, cut, "right") - 1])
        order = np.lexsort((starts, doc))
        starts, doc = starts[order], doc[order]
        doc_e = np.concatenate([doc_of_cut := np.searchsorted(self.offsets, cut, "right") - 1, np.arange(self.n)])
        ends = ends[np.lexsort((ends, doc_e))]
        del doc_of_cut
        return starts, ends, doc

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each document are flagged."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def code_points(self) -> np.ndarray:
        """Code points before each byte position of the chunk."""
        sums = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=sums[1:])
        return sums


class Words:
    """Words of a chunk, in order; word w of document d has first[d] <= w < first[d + 1]."""

    def __init__(self, chunk: Chunk, starts, ends, hashes, byte_sums):
        self.chunk, self.starts, self.ends, self.hash, self.byte_sums = chunk, starts, ends, hashes, byte_sums
        self.first = np.searchsorted(starts, chunk.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(chunk.n), self.count)
        self._sums = None

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all windows of k words within one document."""
        if self._sums is None:
            self._sums = prefix(self.hash)
        at = np.arange(max(0, len(self.hash) - k + 1))
        at = at[at + k <= self.first[1:][self.doc[at]]] if len(at) else at
        return at, span_hash(self._sums, at, at + k)


def covered(n: int, at: np.ndarray, k) -> np.ndarray:
    """Which of n places lie in a span of k places from one of `at`."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, at, 1)
    np.add.at(d, at + k, -1)
    return np.cumsum(d[:-1]) > 0


def between(cuts: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(start, end) of the parts of n places that begin at `cuts`; none where there are no cuts."""
    return list(zip(cuts.tolist(), [*cuts[1:].tolist(), n], strict=True)) if len(cuts) else []


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs twice or more, and whether it occurred before."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[1:] = keys[order[1:]] == keys[order[:-1]]
    later = np.zeros(len(keys), bool)
    later[order] = same
    twice = same.copy()
    twice[:-1] |= same[1:]
    any_ = np.zeros(len(keys), bool)
    any_[order] = twice
    return any_, later


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without copies; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if at is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch | pa.Table, text: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch | pa.Table, Chunk]]:
    """Slices of a batch of at most `limit` bytes of text (one document at least), each with its chunk."""
    data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, at + 20_000, n)
        yield batch.slice(at, to - at), Chunk(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def longs(batch, name: str, null: int) -> np.ndarray:
    """An integer column as int64, with `null` where it has none."""
    c = batch.column(batch.schema.get_field_index(name))
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return pc.fill_null(c.cast(pa.int64()), null).to_numpy(zero_copy_only=False)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Lets Python workers import the package, from where the driver has it or from a copy that a cluster's executors fetch, and
    give large arrays back when freed. Batches are bounded by bytes too, as thousands of long texts would fill a worker."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_BYTES)) > BATCH:
        spark.conf.set(BATCH_BYTES, str(BATCH))
    spark.sparkContext.environment.update(MALLOC_MMAP_THRESHOLD_="16777216", MALLOC_TRIM_THRESHOLD_="33554432", MALLOC_ARENA_MAX="2", ARROW_DEFAULT_MEMORY_POOL="system")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)
        if not spark.sparkContext.master.startswith("local"):
            serve(spark, root)


def serve(spark: SparkSession, root: str) -> None:
    """Has the driver serve a copy of the package to all executors, of whatever host."""
    folder = tempfile.mkdtemp(prefix="culler-package-")  # the driver alone reads it, as long as the session lives
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/culler", "zip", root, "culler"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; sets one of our own only where none is set and all runs on this host, as in tests."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="culler-checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from files in the shared folder: later steps don't compute them again, lost executors or not."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame) -> DataFrame:
    """As cut(), but as Parquet: compressed, and later readers take only the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a table of store(). Only where all that was made of it is written itself."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


BITS = (1 << 23, 1 << 28)  # least and most bits of a row filter


def maybe_in(rows: DataFrame, key: str, wanted: DataFrame, flag: str) -> DataFrame:
    """Rows with a flag: false where the key (bigint) is surely not among those of `wanted`. A broadcast of 1 to 32 MB before a join.

    There are 64 bits a wanted key, up to the most: beyond 4 million keys more rows pass, and none that should is missed.
    The bits are built by an aggregation and come to the driver as rows of 4 KB.
    """
    bits = min(BITS[1], max(BITS[0], 1 << (64 * wanted.count()).bit_length()))
    at = F.pmod(F.col(key), F.lit(bits))
    made = wanted.select(at.alias("at")).groupBy(F.expr("shiftright(at, 15)").cast("int").alias("k")).agg(F.expr("bitmap_construct_agg(cast(at & 32767 as bigint))").alias("bits"))
    table = rows.sparkSession.createDataFrame([(r["k"], bytes(r["bits"])) for r in made.collect()], "__k int, __bits binary")
    found = rows.withColumn("__at", at).join(F.broadcast(table), F.expr("cast(shiftright(__at, 15) as int) = __k"), "left")
    byte = F.expr("cast(conv(hex(substring(__bits, cast((__at & 32767) div 8 + 1 as int), 1)), 16, 10) as int)")
    return found.withColumn(flag, F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(__at & 7 as int))")) != 0, F.lit(False))).drop("__at", "__k", "__bits")


def probably_in(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key may be among those of `wanted`; a join then decides."""
    return maybe_in(rows, key, wanted, "__maybe").filter("__maybe").drop("__maybe")


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]


def pieces(total: int, each: int, least: int = 1) -> int:
    """How many parts of about `each` bytes hold `total`."""
    return max(least, -(-int(total) // each))


def free(names: list[str] | tuple[str, ...], *wanted: str) -> list[str]:
    """The wanted column names, each with underscores behind it until it differs from all of `names`, in any case."""
    have, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in have:
            w += "_"
        have.add(w.lower())
        out.append(w)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
