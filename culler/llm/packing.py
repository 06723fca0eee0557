"""Variable-capacity best-fit packing.

Several sequence lengths are permitted. Pieces are placed by falling length, each into the open bin that it fills best;
if none has room, the bin size of least cost is opened, its price shared among the words that can still fill it, so
large bins are opened while there is material and small ones at the end. At last each bin is downsized to the least
permitted length that holds its contents.

A piece's length is all that matters, so the packing is planned over the histogram of lengths: bins with equal contents
are one class with a multiplicity, and each length is dealt to whole classes. The plan's size depends on the largest
capacity, not on the corpus. Pieces then get their rank among pieces of their length, from counts by (length, salt) and
a row number within each, and the plan gives bin and offset. A length has one salt for every `each` of its pieces, so no
length meets in one task. This is the packing that one-by-one placement would give, and it depends on the rows alone, not
on their order or partitions.

Length is counted in words. Longer documents are cut into pieces of the largest capacity and a rest; nothing is dropped.
Defined cases: a document without words gets one piece of length 0 and no bin (null); a null doc_id is kept; repeated
rows are packed each, and which of them lies where can't be told; an empty table gives no rows; where `keep` has the name
of an added column, that gets underscores.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from culler.llm import text as T

CAPACITIES = (256, 512, 1024, 2048)
OVERHEAD = 64  # price of any bin besides its capacity
EACH = 1 << 16  # pieces of one length behind one salt


def plan_bins(lengths: Mapping[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[tuple[int, int, int, int, int, int]], list[tuple[int, int, int, int]]]:
    """Ranges (length, first rank, ranks, first bin, pieces a bin, offset) and bins (first bin, bins, fill, capacity).

    Ranks count the pieces of a length from 0. The rank r of a range lies in bin first + (r - first rank) // pieces, at
    offset + (r - first rank) % pieces * length.
    """
    caps = sorted(capacities)
    spaces: list[int] = []  # the distinct free spaces of open classes
    open_: dict[int, list[tuple[int, int, int]]] = {}  # free space -> (first bin, bins, fill)
    ranges, next_bin = [], 0
    left_words = sum(k * n for k, n in lengths.items())

    def put(space: int, first: int, bins: int, fill: int) -> None:
        if bins:
            if space not in open_:
                open_[space] = []
                insort(spaces, space)
            open_[space].append((first, bins, fill))

    for size in sorted((k for k, n in lengths.items() if n and k), reverse=True):
        n, rank = lengths[size], 0
        while n:
            i = bisect_left(spaces, size)
            if i == len(spaces):
                fitting = [c for c in caps if c >= size]
                best = min(fitting, key=lambda c: ((c + overhead) / min(c, max(left_words, size)), c))
                bins = max(1, -(-n // (best // size)))
                # one bin more than the words left can fill at this price is never opened at once
                bins = min(bins, max(1, left_words // best))
                put(best, next_bin, bins, 0)
                next_bin += bins
                continue
            space = spaces[i]
            first, bins, fill = open_[space].pop()
            if not open_[space]:
                del open_[space], spaces[i]
            each = space // size
            full = min(bins, n // each)
            if full:
                ranges.append((size, rank, full * each, first, each, fill))
                put(space - each * size, first, full, fill + each * size)
                n, rank, left_words = n - full * each, rank + full * each, left_words - full * each * size
            rest = 0
            if n and full < bins:
                ranges.append((size, rank, n, first + full, n, fill))
                put(space - n * size, first + full, 1, fill + n * size)
                left_words -= n * size
                n, rest = 0, 1
            put(space, first + full + rest, bins - full - rest, fill)
    done = [(first, bins, fill, next(c for c in caps if c >= fill)) for x in open_.values() for first, bins, fill in x if fill]
    return ranges, sorted(done)


PIECE, PLACE = ("piece", "start", "length"), ("bin", "offset", "capacity")


def cut_pieces(docs: DataFrame, largest: int, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns k0, k1, ... for those in `keep`, piece, start (word) and length of every piece of every document."""
    T.ship(docs.sparkSession)
    names = [f"k{i}" for i in range(len(keep))]
    source = docs.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keep, names, strict=True)], F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, c in T.chunks(batch, "__text"):
                n = c.words(hashes=False).count
                k = np.maximum(1, -(-n // largest))
                at = np.repeat(np.arange(c.n), k)
                piece = np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)
                start = piece * largest
                own = [rows.column(i).take(pa.array(at)) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(piece), pa.array(start), pa.array(np.minimum(largest, n[at] - start))], [*names, *PIECE])

    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, own + ", piece bigint, start bigint, length bigint")


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, keep: tuple[str, ...] = ("doc_id",), text: str = "text", each: int = EACH) -> DataFrame:
    """The columns in `keep`, piece, start, length, bin, offset and capacity of every piece of every document."""
    spark = docs.sparkSession
    names = [f"k{i}" for i in range(len(keep))]
    rows = T.cut(cut_pieces(docs, max(capacities), keep, text))
    total = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # largest capacity + 1 at most
    salts = np.array([T.pieces(total.get(k, 0), each) for k in range(max(capacities) + 1)])
    several = F.element_at(F.expr(f"array({', '.join(map(str, salts))})"), (F.col("length") + 1).cast("int"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(*names, "piece"), several).cast("int"))
    first = np.cumsum(salts) - salts
    base = np.zeros(salts.sum(), np.int64)  # pieces of the same length under smaller salts
    for r in rows.filter(several > 1).groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).collect():  # one row for `each` pieces
        base[first[r["length"]] + r["salt"] + 1 : first[r["length"]] + salts[r["length"]]] += r["n"]
    ranges, bins = plan_bins(total, capacities, overhead)
    r = np.array(sorted(ranges), np.int64).reshape(-1, 6)
    b = np.array(bins, np.int64).reshape(-1, 4)
    sent = spark.sparkContext.broadcast((first, base, r, b))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*names, "piece")).cast("bigint") - 1)
    added = T.free(keep, *PIECE, *PLACE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, base, r, b = sent.value
        key = (r[:, 0] << 44) + r[:, 1]
        for batch in batches:
            col = lambda k: batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            size = col("length")
            rank = col("r") + base[first[size] + col("salt")]
            at = np.searchsorted(key, (size << 44) + rank, "right") - 1
            some = size > 0
            x = r[np.where(some, at, 0)] if len(r) else np.zeros((len(size), 6), np.int64)
            x[~some, 4] = 1
            k = rank - x[:, 1]
            bin_, offset = x[:, 3] + k // x[:, 4], x[:, 5] + k % x[:, 4] * size
            cap = b[np.searchsorted(b[:, 0], bin_, "right") - 1, 3] if len(b) else np.zeros(len(size), np.int64)
            own = [batch.column(i) for i in range(len(names) + 3)]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(v, mask=~some) for v in (bin_, offset, cap))], [*keep, *added])

    own = [f"`{k}` {rows.schema[n].dataType.simpleString()}" for k, n in zip(keep, names, strict=True)]
    return ranked.select(*names, *PIECE, "salt", "r").mapInArrow(run, ", ".join([*own, *(f"`{k}` bigint" for k in added)]))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of all documents."""
    return pack(T.documents(spark, sf_dir))
