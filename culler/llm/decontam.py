"""Benchmark decontamination over training suffix arrays.

Each chunk of training text is a shard with its own suffix array over words. Every test suffix is binary-searched in
every shard; the range of suffixes that begin with a whole window gives all places where the window occurs. For the
longest verbatim match the roles change: the test suffixes have a suffix array, sorted to their ends, and the two
neighbours of a document suffix in it give its longest match. Only places of a document that may give its longest one
are searched: those whose first k words occur in the tests, for the greatest k that any place of it has. Nothing of the corpus is shuffled or collected, and the
benchmark reaches the workers in blocks of a checked size, one in memory at a time, whatever its own size.

Words are lower-cased A-Z and split as [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. A window is `width` words of an item; an item of
fewer words is one window. A document word inside any occurrence of a window is hit; a document is contaminated if
words are hit and 20 * hit >= words.

Defined cases: a null or empty text has no words and is never contaminated; an item without words has no window; a
null item_id isn't listed but its windows count; items with the same id count once; repeated rows give a row each; of equally long matches the first place counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from culler.llm import text as T

WIDTH = 13
SHARE = 20  # contaminated where SHARE * n_hit >= n_words
BLOCK = 8 << 20  # bytes of benchmark text in one block
ADDED = ("n_words", "n_hit", "n_items", "items", "longest", "longest_at")


class Tests:
    """Test suffixes of one block, as word hashes: suffix s is words[at[s]:end[s]]; need[s] words of it are a window, or 0."""

    def __init__(self, items: pa.Table, width: int):
        data, offsets = T.utf8(items.column("text"))
        w = T.Chunk(data, offsets).words(T.ALNUM_FOLDED, fold=True)
        self.words, self.at, self.end = w.hash, np.arange(len(w.hash)), w.first[1:][w.doc]
        left = self.end - self.at
        whole = (w.count[w.doc] < width) & (self.at == w.first[:-1][w.doc])
        self.need = np.where(left >= width, width, np.where(whole, left, 0))
        ids = items.column("item_id").cast(pa.string()).to_pylist()
        self.ids = sorted({x for x in ids if x is not None})
        place = {x: i for i, x in enumerate(self.ids)}
        self.item = np.array([place.get(x, -1) for x in ids], np.int64)[w.doc] if len(w.hash) else np.zeros(0, np.int64)
        self.width = width
        self.sums, self._w, self._grams, self._sorted = T.prefix(w.hash), w, {}, None

    def sorted(self) -> Shard:
        """Suffix array of all suffixes, sorted to the end of their items."""
        if self._sorted is None:
            self._sorted = Shard(self._w, int(self._w.count.max()))
        return self._sorted

    def grams(self, k: int) -> np.ndarray:
        """Sorted hashes of all k words in a row."""
        if k not in self._grams:
            at = self.at[self.at + k <= self.end]
            self._grams[k] = np.unique(T.span_hash(self.sums, at, at + k))
        return self._grams[k]


class Suffixes:
    """All suffixes of the documents of a chunk, to be searched in the suffix array of the tests."""

    def __init__(self, w: T.Words):
        self.words, self.at, self.end = w.hash, np.arange(len(w.hash)), w.first[1:][w.doc]
        self.sums = T.prefix(w.hash)


class Shard:
    """Suffix array over the words of a chunk; suffixes end with their document and are sorted by their first `depth` words."""

    def __init__(self, w: T.Words, depth: int):
        n = len(w.hash)
        self.words, self.n = w.hash, n
        self.end = w.first[1:][w.doc] if n else np.zeros(0, np.int64)
        _, rank = np.unique(w.hash, return_inverse=True)  # ranks order words as their hashes do
        rank, k = rank.astype(np.int64) + 1, 1
        while k < depth and n:
            nxt = np.zeros(n, np.int64)
            at = np.flatnonzero(np.arange(n) + k < self.end)
            nxt[at] = rank[at + k]
            both = rank * (n + 2) + nxt
            order = np.argsort(both, kind="stable")
            new = np.ones(n, np.int64)
            new[1:] = both[order[1:]] != both[order[:-1]]
            rank[order] = np.cumsum(new)
            k *= 2
            if rank[order[-1]] == n:
                break
        self.sa = np.argsort(rank, kind="stable") if n else np.zeros(0, np.int64)

    def compare(self, at: np.ndarray, t: Tests | Suffixes, s: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Common words of shard suffixes and test suffixes, up to `most`; sign of shard minus test after them (0: equal so far)."""
        common, sign = np.zeros(len(at), np.int64), np.zeros(len(at), np.int8)
        live = np.arange(len(at))
        while len(live):
            live = live[common[live] < most[live]]
            p, q = at[live] + common[live], t.at[s[live]] + common[live]
            ends = p >= self.end[at[live]]
            sign[live[ends]] = -1
            live, p, q = live[~ends], p[~ends], q[~ends]
            a, b = self.words[p], t.words[q]
            same = a == b
            sign[live[~same]] = np.where(a[~same] < b[~same], -1, 1)
            live = live[same]
            common[live] += 1
        return common, sign

    def bound(self, t: Tests | Suffixes, s: np.ndarray, most: np.ndarray, after: bool) -> np.ndarray:
        """Binary search: first place whose suffix isn't before (or, with `after`, is after) the first `most` words of each test suffix."""
        lo, hi = np.zeros(len(s), np.int64), np.full(len(s), self.n, np.int64)
        while len(live := np.flatnonzero(lo < hi)):
            mid = (lo[live] + hi[live]) // 2
            _, sign = self.compare(self.sa[mid], t, s[live], most[live])
            right = sign < 0 if not after else sign <= 0
            lo[live[right]] = mid[right] + 1
            hi[live[~right]] = mid[~right]
        return lo


def longest_matches(w: T.Words, t: Tests) -> tuple[np.ndarray, np.ndarray]:
    """Longest verbatim match with any item, in words, and the first word where one begins (-1: none), by document."""
    c, x = w.chunk, Suffixes(w)
    longest, where = np.zeros(c.n, np.int64), np.full(c.n, -1, np.int64)
    level, found, k = np.zeros(c.n, np.int64), [], 1
    at = x.at
    while len(at):
        at = at[at + k <= x.end[at]]
        have, key = t.grams(k), T.span_hash(x.sums, at, at + k)
        place = np.searchsorted(have, key)
        at = at[(place < len(have)) & (have[np.minimum(place, len(have) - 1)] == key)] if len(have) else at[:0]
        level[w.doc[at]] = k
        found.append((at, k))
        k = k + 1 if k < 4 else k + k // 2 if k & (k - 1) == 0 else k // 3 * 4
    s = np.concatenate([p[level[w.doc[p]] == k] for p, k in found]) if found else x.at[:0]
    if not len(s):
        return longest, where
    tests, most = t.sorted(), x.end[s] - s
    lo, common = tests.bound(x, s, most, after=False), np.zeros(len(s), np.int64)
    for near in (lo - 1, lo):
        ok = np.flatnonzero((near >= 0) & (near < tests.n))
        common[ok] = np.maximum(common[ok], tests.compare(tests.sa[near[ok]], x, s[ok], most[ok])[0])
    d = w.doc[s]
    order = np.lexsort((-s, common))  # the longest last, and of those the first place
    longest[d[order]], where[d[order]] = common[order], s[order] - w.first[:-1][d[order]]
    return longest, where


def search(w: T.Words, t: Tests, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For one shard and one block: hit words; documents and items of occurring windows; longest match and its word, by document."""
    n, c = len(w.hash), w.chunk
    none = np.zeros(0, np.int64)
    if not n or not len(t.words):
        return np.zeros(n, bool), none, none, np.zeros(c.n, np.int64), np.full(c.n, -1, np.int64)
    longest, where = longest_matches(w, t)
    shard = Shard(w, depth)
    # windows: the ranges of suffixes that begin with them
    s = np.flatnonzero(t.need > 0)
    lo, hi = shard.bound(t, s, t.need[s], after=False), shard.bound(t, s, t.need[s], after=True)
    size = hi - lo
    owner = np.repeat(s, size)
    at = shard.sa[np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    hit = np.zeros(n + 1, np.int64)
    np.add.at(hit, at, 1)
    np.add.at(hit, at + t.need[owner], -1)
    pairs = np.unique(w.doc[at] * (len(t.ids) + 1) + t.item[owner] + 1)
    return np.cumsum(hit[:-1]) > 0, pairs // (len(t.ids) + 1), pairs % (len(t.ids) + 1) - 1, longest, where


def blocks(spark: SparkSession, benchmark: DataFrame, block: int = BLOCK) -> list:
    """The benchmark as broadcasts of about `block` bytes each; the driver holds one at a time."""
    b = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = T.pieces(T.text_bytes(b) + 16, block)
    if n > 1:
        b = T.cut(b.withColumn("k", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))))
    out = []
    for k in range(n):
        part = (b.filter(F.col("k") == k) if n > 1 else b).select("item_id", "text").toArrow()
        out.append(spark.sparkContext.broadcast(part))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text: str = "text", block: int = BLOCK, only_clean: bool = False, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Columns of `docs` named in `keep` (all by default) and, for each row: n_words, n_hit, n_items, items (sorted ids), longest
    verbatim match in words, and longest_at, the word where it begins (-1: none); underscores follow where `docs` has the name. With only_clean: contaminated rows go
    and no column comes.

    Parameters: width, the words of a window; block, bytes of benchmark text in one broadcast.
    """
    spark = docs.sparkSession
    T.ship(spark)
    sent = blocks(spark, benchmark, block)
    names = list(keep) if keep is not None else docs.columns
    source = docs.select(*[F.col(f"`{k}`") for k in names], F.col(f"`{text}`").alias(T.free(names, "__text")[0]))
    added = T.free(names, *ADDED)
    depth = 1 << (width - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: list = [Tests(sent[0].value, width)] if len(sent) == 1 else []
        for batch in batches:
            batch = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for rows, c in T.chunks(batch, f"c{batch.num_columns - 1}"):
                w = c.words(T.ALNUM_FOLDED, fold=True)
                hit, longest, where = np.zeros(len(w.hash), bool), np.zeros(c.n, np.int64), np.full(c.n, -1, np.int64)
                items: list[set[str]] = [set() for _ in range(c.n)]
                for b in sent:
                    if tests:
                        t = tests[0]
                    else:
                        t = Tests(b.value, width)
                        b._value = None  # one block in memory at a time
                    h, d, i, far, at = search(w, t, depth)
                    hit |= h
                    for x, y in zip(d.tolist(), i.tolist(), strict=True):
                        if y >= 0:
                            items[x].add(t.ids[y])
                    more = (far > longest) | ((far == longest) & (at >= 0) & (at < where))
                    longest[more], where[more] = far[more], at[more]
                n_hit = np.bincount(w.doc[hit], minlength=c.n)
                rows = rows.select(range(len(names)))
                if only_clean:
                    yield rows.filter(pa.array(~((n_hit > 0) & (SHARE * n_hit >= w.count)))).rename_columns(names)
                else:
                    more = [pa.array(w.count.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array([len(x) for x in items], pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(longest), pa.array(where)]
                    yield pa.RecordBatch.from_arrays([*rows.columns, *more], [*names, *added])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    if only_clean:
        return source.mapInArrow(run, own)
    return source.mapInArrow(run, own + ", " + ", ".join(f"{a} {t}" for a, t in zip(added, ("bigint", "bigint", "bigint", "array<string>", "bigint", "bigint"), strict=True)))


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all documents against all benchmark items."""
    rows = decontaminate(T.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("doc_id",))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "longest", "longest_at")
