"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

Every shard owns `nodes` points of the ring; a row belongs to the arc in which its hash lies. A shard takes no more than
its capacity, and rows beyond it go on clockwise to the next shard with room. The capacities are the row count divided
by the shards, rounded down, plus one for the first `count mod shards` shards, so they add up to the count: the law is
`rows`, counts differ by one at most. Which rows overflow is decided by their rank in the arc alone.

Only counts by arc come to the driver (shards * nodes at most, whatever the corpus); there the ring is walked, which
yields a plan of ranges (arc, first rank, last rank, shard, first slot) of bounded size. Rows get their rank within an
arc by two steps, counts by (arc, sub-arc) and a running sum within a sub-arc, so that no arc meets in one task. Rows that
are equal in all columns kept are counted before that and dealt as one range, so the placement depends on the rows alone
and not on their order or partitions.

Defined cases: a null doc_id hashes as such; repeated rows take neighbouring ranks, and which of them goes on can't be
told; a null text has no bytes; an empty table gives no rows. Columns kept must be of types that can be grouped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from culler.llm import text as T

SHARDS, NODES, SUB = 24, 64, 32
RING = 1 << 60


def _unsigned(h):
    return h.bitwiseAND(F.lit(RING - 1))


def points(spark: SparkSession, shards: int, nodes: int) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes in ring order; a shard's places depend on its number alone."""
    rows = spark.range(shards * nodes).select(_unsigned(F.xxhash64(F.lit("node"), F.floor(F.col("id") / nodes), F.col("id") % nodes)).alias("at"), F.floor(F.col("id") / nodes).cast("int").alias("shard"))
    return sorted((r["at"], r["shard"]) for r in rows.collect())


def walk(counts: dict[int, int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Ranges (arc, first rank, last rank exclusive, shard, first slot). Arcs are served in ring order; each first fills its
    owner, then what is left goes on clockwise, in order, to the next shards with room."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    slot, plan, waiting = [0] * shards, [], []
    for arc in range(2 * len(owners)):  # the second round has no new rows, only those that still go on
        s = owners[arc % len(owners)]
        if arc < len(owners) and counts.get(arc):
            waiting.append((arc, 0, counts[arc]))
        left = []
        for a, lo, hi in reversed(waiting) if arc < len(owners) else waiting:  # an arc's own rows before those passing by
            take = min(room[s], hi - lo)
            if take:
                plan.append((a, lo, lo + take, s, slot[s]))
                room[s] -= take
                slot[s] += take
            if take < hi - lo:
                left.append((a, lo + take, hi))
        waiting = left[::-1] if arc < len(owners) else left
    return plan


def ring_shards(docs: DataFrame, shards: int = SHARDS, nodes: int = NODES, key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns in `keep`, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row; underscores follow where `keep` has the name.

    Parameters: shards; nodes, virtual nodes of each shard; key, the column that is hashed.
    """
    spark = docs.sparkSession
    ring = points(spark, shards, nodes)
    places = F.array(*[F.lit(p) for p, _ in ring]).cast("array<bigint>")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        *[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)],
        (F.octet_length(t) + 8).cast("bigint").alias("__size"),
        F.crc32(t).alias("__crc"),
        _unsigned(F.xxhash64(F.lit("key"), F.col(f"`{key}`"))).alias("__h"),
        F.xxhash64(F.col(f"`{key}`"), F.crc32(t)).alias("__sub_h"),
    )
    # the arc is the first node clockwise: a binary search by ten-odd comparisons of array elements, on one row at a time
    steps = (len(ring)).bit_length()
    rows = rows.withColumn("__at", F.lit(0))
    for step in reversed([1 << i for i in range(steps)]):
        nxt = F.col("__at") + step
        rows = rows.withColumn("__at", F.when((nxt <= len(ring)) & (F.element_at(places, F.least(nxt, F.lit(len(ring)))) < F.col("__h")), nxt).otherwise(F.col("__at")))
    rows = rows.withColumn("__arc", F.col("__at") % len(ring)).withColumn("__sub", F.pmod("__sub_h", F.lit(SUB)).cast("int")).drop("__at")
    rows = T.cut(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__m")))
    per_sub = rows.groupBy("__arc", "__sub").agg(F.sum("__m").alias("n"))
    got = {(r["__arc"], r["__sub"]): r["n"] for r in per_sub.collect()}  # shards * nodes * SUB counts at most
    counts: dict[int, int] = {}
    base: dict[tuple[int, int], int] = {}
    for a, s in sorted(got):
        base[a, s] = counts.get(a, 0)
        counts[a] = base[a, s] + got[a, s]
    plan = walk(counts, [s for _, s in ring], shards)
    cuts = spark.createDataFrame(_ranges(got, base, plan), "__arc int, __sub int, __base bigint, __lo bigint, __hi bigint, shard int, __slot bigint")
    order = Window.partitionBy("__arc", "__sub").orderBy("__sub_h", "__h", "__crc", "__size", *[f"k{i}" for i in range(len(keep))])
    ranked = rows.withColumn("__r", F.sum("__m").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__m"))
    first = F.col("__base") + F.col("__r")
    low, high = F.greatest(first, F.col("__lo")), F.least(first + F.col("__m"), F.col("__hi"))
    placed = ranked.join(F.broadcast(cuts), ["__arc", "__sub"]).filter(low < high)
    size, crc = T.free(keep, "size", "text_crc32")
    shard, slot = T.free([*keep, size, crc], "shard", "slot")
    return placed.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], F.col("__size").alias(size), F.col("__crc").alias(crc), F.col("shard").alias(shard), F.explode(F.sequence(F.col("__slot") + low - F.col("__lo"), F.col("__slot") + high - F.col("__lo") - 1)).alias(slot))


def _ranges(got: dict, base: dict, plan: list) -> list[tuple]:
    """The ranges of the plan that meet each sub-arc; at most sub-arcs + ranges rows."""
    by: dict[int, list] = {}
    for a, *rest in plan:
        by.setdefault(a, []).append(rest)
    return [(a, s, base[a, s], lo, hi, shard, slot) for a, s in got for lo, hi, shard, slot in by[a] if lo < base[a, s] + got[a, s] and hi > base[a, s]]


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 under the law `rows`."""
    rows = ring_shards(T.documents(spark, sf_dir))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
