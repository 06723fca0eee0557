"""N-gram Jaccard join over a token-group matrix.

Documents are sets of distinct shingles. Documents with equal sets become one node. Bands of min-hashes name a pivot for
each node; links to pivots are verified exactly and make first components. Nodes are then partitioned into groups of
similar documents, by component or else by the band that most nodes share, and large groups are split into blocks of
bounded size. The token-group matrix holds, for every shingle in a prefix of a member's set, the blocks that have it
(the union of the members' prefixes). A prefix has the first n - ceil(similarity * n) + 1 shingles of a set in one order
for all, frequent shingles last; two sets that qualify share a shingle there. For each two blocks with common entries
the overlap of any two members is bounded by the entries and by what may follow them; blocks are opened only if that
reaches the required overlap, and then all pairs of their members are compared exactly by one matrix product. No link
between components is missed, and links within a component add nothing to it.

At scale: a task sends HELD entries at once, dealt to one bucket for every BUCKET bytes of text; raise both with the
memory of the workers, so that a message holds some hundred entries.

Frequencies come from one sketch of fixed size over all shingles; it decides only the order, never a result.

Defined cases: a null or empty text is an empty set and linked with nothing; fewer words than `words` make one shingle
of the whole sequence; rows with equal sets share a node, so repeated rows and rows with one doc_id are no special case;
a null doc_id counts as the largest, and a component that has no other id gets null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from culler.llm import text as T
from culler.llm.components import components

WORDS, NUM, DEN = 5, 75, 100  # DEN * intersection >= NUM * union
LAST = (1 << 63) - 1
SKETCH, PARTS = 1 << 20, 16
BANDS, ROWS = 8, 2
BLOCK, BLOCK_SHINGLES, STRIPE = 128, 1 << 16, 1 << 13
BUCKET = 8 << 20  # bytes of text whose prefixes make one bucket
BUCKET_SHINGLES, SALTS = 1 << 20, 64
HELD = 1 << 18  # prefix entries that a task holds before it sends them
THIN = 16  # sets of one such part that share a token before most of them skip its meeting
MARK = (1 << 40) - 1  # bits of a node that its prefix entries carry


def shingles(c: T.Chunk, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the documents of a chunk, sorted within each, and where each document's begin."""
    w = c.words(fold=True)
    at, h = w.windows(words)
    d = w.doc[at]
    short = np.flatnonzero((w.count > 0) & (w.count < words))
    if len(short):
        own = T.span_hash(T.prefix(w.hash), w.first[:-1][short], w.first[1:][short])
        h, d = np.concatenate([h, own]), np.concatenate([d, short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(c.n + 1))


def _per_set(h: np.ndarray, first: np.ndarray, ufunc, empty) -> np.ndarray:
    n = np.diff(first)
    out = np.full(len(n), empty, h.dtype)
    if len(h):
        out[n > 0] = ufunc.reduceat(h, first[:-1][n > 0])
    return out


def set_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, from all its members; as int64."""
    n = np.diff(first).astype(T.U)
    total = _per_set(T.mix(h ^ T.U(0x5DEECE66D)), first, np.add, 0)
    return T.mix(total + T.mix(n)).view(np.int64)


def band_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Keys of BANDS bands of ROWS min-hashes each; one row per set."""
    out = np.zeros((len(first) - 1, BANDS), T.U)
    for b in range(BANDS):
        for r in range(ROWS):
            salt = T.U((2 * (b * ROWS + r) + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            x = h * salt
            x ^= x >> T.U(32)
            x *= T.U(0xD6E8FEB86659FD93)
            low = _per_set(x, first, np.minimum, 0)
            out[:, b] = T.mix(out[:, b] + low)
    return out.view(np.int64)


def _meta(docs: DataFrame, words: int) -> DataFrame:
    """tag 0: id, rk, n, node, bands of each document; tag 1: parts of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tag", "id", "rk", "n", "node", "bands", "part"]
        sketch = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for rows, c in T.chunks(batch, "text"):
                h, first = shingles(c, words)
                sketch += np.bincount((h >> T.U(44)).astype(np.int64), minlength=SKETCH)
                bands = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(h, first).ravel()), BANDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(c.n, np.int32)), rows.column("id"), rows.column("rk"), pa.array(np.diff(first)), pa.array(set_keys(h, first)), bands, pa.nulls(c.n, pa.binary())], names)
        if sketch.any():
            blobs = [zlib.compress(x.astype(np.uint32).tobytes(), 1) for x in np.split(np.minimum(sketch, 1 << 31), PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(PARTS, np.int32)), pa.array(range(PARTS), pa.int64()), *(pa.nulls(PARTS, pa.int64()) for _ in range(3)), pa.nulls(PARTS, pa.list_(pa.int64())), pa.array(blobs, pa.binary())], names)

    return docs.mapInArrow(run, "tag int, id bigint, rk bigint, n bigint, node bigint, bands array<bigint>, part binary")


def _levels(meta: DataFrame) -> np.ndarray:
    """Level of each sketch cell: 0, or the powers of two by which its excess over the mean exceeds chance. SKETCH bytes."""

    def run(key, table):
        total = np.zeros(SKETCH // PARTS, np.int64)
        for x in table.column("part").to_pylist():
            total += np.frombuffer(zlib.decompress(x), np.uint32)
        return pa.table({"k": pa.array([key[0].as_py()], pa.int64()), "v": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    total = np.zeros(SKETCH, np.int64)
    for r in meta.filter("tag = 1").select("id", "part").groupBy("id").applyInArrow(run, "k bigint, v binary").collect():
        total[r["k"] * (SKETCH // PARTS) : (r["k"] + 1) * (SKETCH // PARTS)] = np.frombuffer(zlib.decompress(r["v"]), np.int64)
    mean = total.mean()
    noise = 5 * np.sqrt(mean) + 4
    return np.ceil(np.log2(np.maximum((total - mean) / noise, 1))).astype(np.uint8)


def reach(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Length of the prefix of sets of n shingles."""
    return n - -(-n * num // den) + 1


def signature(h: np.ndarray) -> bytes:
    """Bits of the cells that a set's hashes fall into, of a power of two of cells, four a member or more."""
    bits = np.zeros(max(64, 1 << (4 * len(h) - 1).bit_length()), bool)
    bits[(h & T.U(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_qualify(n: np.ndarray, signatures: list[bytes], num: int, den: int) -> np.ndarray:
    """Matrix of the pairs of sets that may be similar enough: a set bit that the other hasn't got is a member that the other hasn't got."""
    size = np.array([8 * len(x) for x in signatures])
    out = np.zeros((len(n), len(n)), bool)
    span = 1 << (-(-den // num) - 1).bit_length()
    for m in np.unique(size).tolist():  # similar sets have at most den / num times as many members, so at most span times as many cells
        who = np.flatnonzero((size >= m) & (size <= span * m))
        bits = np.stack([np.bitwise_or.reduce(np.frombuffer(signatures[i], np.uint8).reshape(-1, m // 8)) for i in who])
        common, own = np.zeros((len(who), len(who)), np.float32), np.bitwise_count(bits).sum(1, dtype=np.int64)
        for low in range(0, m // 8, STRIPE // 8):
            x = np.unpackbits(bits[:, low : low + STRIPE // 8], axis=1).astype(np.float32)
            common += x @ x.T
        most = n[who][:, None] - own[:, None] + common.astype(np.int64)
        most = np.minimum(most, most.T)
        good = (num + den) * most >= num * (n[who][:, None] + n[who][None, :])
        out[np.ix_(who, who)] |= good & ((size[who] == m)[:, None] | (size[who] == m)[None, :])
    return out


def _ordered(h: np.ndarray, first: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of each set in the common order, with their sets and positions."""
    n = np.diff(first)
    d = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, levels[(h >> T.U(44)).astype(np.int64)], d))
    return h[order], d, np.arange(len(h)) - first[:-1][d]


def _postings(docs: DataFrame, levels, buckets: int, words: int, num: int, den: int) -> DataFrame:
    """(token, mark, pos) of the prefix entries whose token sets with two marks or more have; pos is a lower bound in 256ths.

    On the way an entry has 48 bits of its hash (which keep the common order), its place in 256ths of the prefix and 40
    bits of its node. Two shingles of one set with the same 48 bits count once, and two similar sets with the same mark
    (one pair in 10**12) can miss each other here. Buckets are ranges of hashes, so a message is a sorted list of near
    numbers, and an entry takes the same bytes whatever the number of buckets.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def messages() -> pa.RecordBatch:
            h, mark, place = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((mark, h))
            h, mark, place = h[order], mark[order], place[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (mark[1:] != mark[:-1])  # equal sets of a part once
            h, mark, place = h[new], mark[new], place[new]
            bucket = (h >> 16) * buckets >> 32
            # a token that many sets of a part share is known to be shared: two entries tell so, the others go where their marks deal them
            cuts = np.flatnonzero(np.diff(h, prepend=-1))
            nth = np.arange(len(h)) - np.repeat(cuts, np.diff(np.append(cuts, len(h))))
            known = (nth > 1) & np.repeat(np.diff(np.append(cuts, len(h))) > THIN, np.diff(np.append(cuts, len(h))))
            bucket[known] = -1 - (T.mix(mark[known].view(T.U)) % T.U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            h, mark, place, bucket = h[order], mark[order], place[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=buckets))
            out = []
            for a, b in T.between(cuts, len(h)):
                planes = np.diff(h[a:b], prepend=0).view(np.uint8).reshape(-1, 8)[:, :6].T
                out.append(b"".join([planes.tobytes(), np.ascontiguousarray(mark[a:b].view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes(), place[a:b].tobytes()]))
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array(out, pa.binary())], ["bucket", "blob"])

        held = 0
        for batch in batches:
            for _, c in T.chunks(batch, "text"):
                h, first = shingles(c, words)
                mark = set_keys(h, first) & MARK
                h, d, pos = _ordered(h, first, levels.value)
                size = reach(np.diff(first), num, den)
                use = pos < size[d]
                h, d, pos = h[use], d[use], pos[use]
                found.append(((h >> T.U(16)).view(np.int64), mark[d], (pos * 256 // size[d]).astype(np.uint8)))
                held += len(h)
                if held >= HELD:
                    yield messages()
                    found, held = [], 0
        if held:
            yield messages()

    def meet(table):
        parts = []
        for blob in table.column("blob").to_pylist():
            raw = np.frombuffer(blob, np.uint8).reshape(12, -1)
            wide = np.zeros((2, raw.shape[1], 8), np.uint8)
            wide[0, :, :6], wide[1, :, :5] = raw[:6].T, raw[6:11].T
            parts.append((np.cumsum(wide[0].view(np.int64).ravel()), wide[1].view(np.int64).ravel(), raw[11]))
        h, mark, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        known = table.column("bucket")[0].as_py() < 0
        order = np.argsort(h, kind="stable")
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = h[order[1:]] == h[order[:-1]]
        order = order[same[1:] | same[:-1] | known]
        order = order[np.lexsort((mark[order], h[order]))]
        h, mark, place = h[order], mark[order], place[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (mark[1:] != mark[:-1])
        h, mark, place = h[new], mark[new], place[new]
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = h[1:] == h[:-1]
        use = same[1:] | same[:-1] | known
        return pa.table({"token": pa.array(h[use]), "mark": pa.array(mark[use]), "place": pa.array(place[use].astype(np.int32))})

    return docs.mapInArrow(spread, "bucket bigint, blob binary").groupBy("bucket").applyInArrow(meet, "token bigint, mark bigint, place int")


def dealt(rows: DataFrame, key: str, by: str, parts, name: str) -> DataFrame:
    """Rows with a number of their part: rows of one key are dealt by `by` to as many parts as the aggregate `parts` says.

    Keys of several parts come in SALTS copies, so that no key's rows meet in one task.
    """
    many = rows.groupBy(key).agg(parts.cast("bigint").alias("__parts")).filter("__parts > 1").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return salted.join(many, [key, "__salt"], "left").withColumn(name, F.pmod(F.xxhash64(F.lit("part"), by), F.coalesce("__parts", F.lit(1)))).drop("__parts", "__salt")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (rk and others) with the text of one row of each rk."""
    found = T.probably_in(docs.select("rk", "text"), "rk", wanted).join(wanted, "rk")
    return found.dropDuplicates(wanted.columns)


def _per_bucket(rows: DataFrame, key: list[str], load: int, each: int, run, schema: str) -> DataFrame:
    """applyInArrow over buckets of whole keys; `load` of all rows makes buckets of about `each`."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(T.pieces(load, each)))).groupBy("bucket").applyInArrow(run, schema)


def _sets(table, words: int) -> list[np.ndarray]:
    """Shingles of every row's text, sorted."""
    out = []
    for _, c in T.chunks(table.combine_chunks(), "text"):
        h, first = shingles(c, words)
        out += [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def _by_key(table, key: list[str]) -> Iterator[np.ndarray]:
    """Row numbers of each key."""
    columns = [table.column(k).to_numpy() for k in key]
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[order[1:]] != x[order[:-1]]
    for a, b in T.between(np.flatnonzero(new), len(order)):
        yield order[a:b]


def _verified_stars(docs: DataFrame, stars: DataFrame, nodes: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Those stars (a, b) whose sets qualify. A pivot's set meets its candidates in parts of bounded size."""
    name = nodes.select("node", "rk")
    rays = T.cut(dealt(stars, "b", "a", F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)), "part"))
    wanted = T.cut(rays.select("b", "part", F.col("a").alias("node")).unionByName(rays.select("b", "part", F.col("b").alias("node")).distinct()).join(name, "node"))

    def run(table):
        node, b, sets, out = table.column("node").to_numpy(), table.column("b").to_numpy(), _sets(table, words), []
        for rows in _by_key(table, ["b", "part"]):
            pivot = next(sets[i] for i in rows if node[i] == b[i])
            for i in rows:
                common = int(np.isin(sets[i], pivot, assume_unique=True).sum())
                if node[i] != b[i] and den * common >= num * (len(pivot) + len(sets[i]) - common):
                    out.append(i)
        return pa.table({"a": pa.array(node[out]), "b": pa.array(b[out])})

    load = rays.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return _per_bucket(_texts(docs, wanted), ["b", "part"], 2 * load, BUCKET_SHINGLES, run, "a bigint, b bigint")


PAIR = "g_a bigint, g_b bigint, side int, node bigint, c bigint"


def _open(opened: DataFrame, members: DataFrame) -> DataFrame:
    """(g_a, g_b, side) of opened pairs with the columns of the members of both blocks."""
    own = lambda g: members.withColumnRenamed("g", g)
    rest = [k for k in members.columns if k != "g"]
    a = opened.select("g_a", "g_b").join(own("g_a"), "g_a").withColumn("side", F.lit(0))
    b = opened.filter("g_a <> g_b").select("g_a", "g_b").join(own("g_b"), "g_b").withColumn("side", F.lit(1))
    return a.select("g_a", "g_b", "side", *rest).unionByName(b.select("g_a", "g_b", "side", *rest))


def _apart(comp: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Which pairs of members count: of different components, and of the two blocks if there are two."""
    out = comp[:, None] != comp[None, :]
    return out & (side[:, None] != side[None, :]) if side.max() else out


def _promising(docs: DataFrame, opened: DataFrame, members: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(g_a, g_b, side, node, c) of the members that may be similar enough to one of the other block, from signatures of their sets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, c in T.chunks(batch, "text"):
                h, first = shingles(c, words)
                yield pa.RecordBatch.from_arrays([rows.column("rk"), pa.array([signature(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["rk", "sig"])

    def run(table):
        columns = {k: table.column(k).to_numpy() for k in ("g_a", "g_b", "side", "node", "c", "n")}
        sig, out = table.column("sig").to_pylist(), []
        for rows in _by_key(table, ["g_a", "g_b"]):
            some = may_qualify(columns["n"][rows], [sig[i] for i in rows], num, den) & _apart(columns["c"][rows], columns["side"][rows])
            out.append(rows[some.any(1)])
        out = np.concatenate(out) if out else np.zeros(0, np.int64)
        return pa.table({k: pa.array(columns[k][out]) for k in ("g_a", "g_b", "side", "node", "c")})

    signed = T.probably_in(docs.select("rk", "text"), "rk", members).mapInArrow(sign, "rk bigint, sig binary")
    own = T.cut(members.join(signed, "rk").dropDuplicates(["rk", "node"]).select("g", "node", "c", "n", "sig"))
    load = own.groupBy("g").agg(F.sum("n").alias("w")).join(opened.select(F.explode(F.array("g_a", "g_b")).alias("g")), "g").agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n")).first()["n"]
    return _per_bucket(_open(opened, own), ["g_a", "g_b"], load, 8 * BUCKET_SHINGLES, run, PAIR)


def _new_links(docs: DataFrame, alive: DataFrame, nodes: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between members of two opened blocks that qualify: enough to span them, not all."""

    def run(table):
        node, comp, side, sets = *(table.column(k).to_numpy() for k in ("node", "c", "side")), _sets(table, words)
        out = []
        for rows in _by_key(table, ["g_a", "g_b"]):
            n = np.array([len(sets[i]) for i in rows])
            _, t, times = np.unique(np.concatenate([sets[i] for i in rows]), return_inverse=True, return_counts=True)
            who = np.repeat(np.arange(len(rows)), n)
            use = times[t] > 1
            _, t = np.unique(t[use], return_inverse=True)
            common = np.zeros((len(rows), len(rows)), np.float32)
            for low in range(0, int(t.max(initial=-1)) + 1, STRIPE):  # whole numbers below 2**24 add exactly
                m = np.zeros((len(rows), STRIPE), np.float32)
                here = (t >= low) & (t < low + STRIPE)
                m[who[use][here], t[here] - low] = 1
                common += m @ m.T
            good = den * common.astype(np.int64) >= num * (n[:, None] + n[None, :] - common.astype(np.int64))
            i, j = np.nonzero(np.triu(good & _apart(comp[rows], side[rows]), 1))
            top: dict[int, int] = {}

            def root(x: int) -> int:
                while top.setdefault(x, x) != x:  # noqa: B023
                    top[x] = top[top[x]]  # noqa: B023
                    x = top[x]  # noqa: B023
                return x

            for x, y in zip(rows[i].tolist(), rows[j].tolist(), strict=True):
                p, q = root(int(comp[x])), root(int(comp[y]))
                if p != q:
                    top[q] = p
                    out.append((int(node[x]), int(node[y])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    wanted = T.cut(alive.join(nodes.select("node", "rk", "n"), "node"))
    load = wanted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return _per_bucket(_texts(docs, wanted.drop("n")), ["g_a", "g_b"], load, BUCKET_SHINGLES, run, "a bigint, b bigint")


def similar_groups(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per document: doc_id, rk (a hash of doc_id and text), n_shingles, component_id, grp (null for an empty set).

    Parameters: words of a shingle; num / den, the least Jaccard similarity of a link.
    """
    spark = docs.sparkSession
    T.ship(spark)
    docs = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("id"), F.xxhash64("doc_id", "text").alias("rk"), "text").select("id", "rk", "text")
    total = T.text_bytes(docs)
    meta = T.cut(_meta(docs, words))
    levels = spark.sparkContext.broadcast(_levels(meta))
    rows = meta.filter("tag = 0").drop("tag", "part")
    nodes = T.cut(rows.filter("n > 0").groupBy("node").agg(F.min(F.struct("id", "rk")).alias("m"), F.first("n").alias("n"), F.min("bands").alias("bands")).select("node", "m.id", "m.rk", "n", "bands"))
    # groups of similar documents: verified links to the pivots of min-hash bands
    bands = nodes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    pivots = bands.groupBy("band", "key").agg(F.min(F.struct("node", "n")).alias("p"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("band", "key", F.col("p.node").alias("b"), F.col("p.n").alias("n_b"), "m")
    shared_bands = T.store(bands.join(pivots, ["band", "key"]))
    stars = shared_bands.filter("node <> b").filter(F.least("n", "n_b") * den >= F.greatest("n", "n_b") * num).groupBy(F.col("node").alias("a"), "b").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"))
    stars = T.cut(stars.filter("m > 1").select("a", "b", "n"))
    groups = components(_verified_stars(docs, stars, nodes, words, num, den))
    # blocks of similar documents, linked or not: by component, or else by the fullest band
    full = shared_bands.groupBy("node").agg(F.max_by(F.xxhash64("band", "key"), F.struct("m", "key")).alias("k"))
    known = T.cut(full.join(groups, "node", "full").join(nodes.select("node", F.col("n").alias("size")), "node").select("node", F.coalesce("label", "k").alias("k"), F.coalesce("label", "node").alias("c"), "size"))
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES))
    blocks = T.store(dealt(known, "k", "node", parts, "part").select("node", "c", F.xxhash64("k", "part").alias("g")))
    T.discard(shared_bands)
    lone = T.store(nodes.select("node", "rk", "n").join(blocks, "node", "left").select("node", "rk", "n", F.coalesce("g", "node").alias("g"), F.coalesce("c", "node").alias("c")))
    T.discard(blocks)
    # the token-group matrix
    marked = lone.select(F.col("node").bitwiseAND(F.lit(MARK)).alias("mark"), "n", "c", "g")
    pos = F.expr(f"place * (n - (n * {num} + {den - 1}) div {den} + 1) div 256")
    posts = T.store(_postings(docs, levels, T.pieces(total, BUCKET), words, num, den).join(marked, "mark").select("token", "n", pos.alias("pos"), "c", "g"))
    shared = posts.groupBy("token").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).filter("c1 < c2").select("token")
    entries = posts.groupBy("token", "g").agg(F.max(F.col("n") - 1 - F.col("pos")).alias("rest"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("c").alias("c1"), F.max("c").alias("c2"))
    matrix = entries.join(shared, "token")  # dealt by token, as blocks meet
    a, b = (matrix.select("token", *[F.col(k).alias(f"{k}_{s}") for k in ("g", "rest", "lo", "hi", "c1", "c2")]) for s in "ab")
    differ = F.least("c1_a", "c1_b") < F.greatest("c2_a", "c2_b")
    fits = (F.col("g_a") <= F.col("g_b")) & differ & (F.col("hi_a") * den >= F.col("lo_b") * num) & (F.col("hi_b") * den >= F.col("lo_a") * num)
    last = F.least("rest_a", "rest_b")
    bound = a.join(b, "token").filter(fits).groupBy("g_a", "g_b").agg(F.count(F.lit(1)).alias("c"), F.min(last).alias("end"), F.min(F.least("lo_a", "lo_b")).alias("lo"), F.max(F.greatest("hi_a", "hi_b")).alias("hi"), (F.min("lo_a") + F.min("lo_b")).alias("least"))
    # Beyond the entries that two sets share, at most ceil(similarity * n) - 1 of the larger one's can be common: where its or
    # the smaller one's prefix ends, all before is counted. So c must reach num (x + y) / (num + den) - num max(x, y) / den.
    enough = F.col("c") * den * (num + den) >= num * den * (F.col("lo") + F.col("hi")) - num * (num + den) * F.col("hi")
    # and for two single nodes, c and what follows the last common entry must reach the required overlap
    near = (F.col("c") + F.col("end")) * (num + den) >= F.col("least") * num
    opened = bound.filter(enough).select("g_a", "g_b", near.alias("near"))
    sizes = lone.groupBy("g").agg(F.count(F.lit(1)).alias("m"))
    opened = opened.join(sizes.select(F.col("g").alias("g_a"), F.col("m").alias("m_a")), "g_a").join(sizes.select(F.col("g").alias("g_b"), F.col("m").alias("m_b")), "g_b")
    opened = T.store(opened.filter("near OR m_a > 1 OR m_b > 1").select("g_a", "g_b"))
    T.discard(posts)
    # open: signatures leave the members that may qualify, and their exact overlaps decide
    needed = opened.select(F.explode(F.array("g_a", "g_b")).alias("g")).distinct()
    members = T.store(lone.join(needed, "g"))
    T.discard(lone)
    alive = T.store(_promising(docs, opened, members, words, num, den))
    T.discard(members)
    new = _new_links(docs, alive, nodes, words, num, den)
    name = groups.select("node", "label")
    new = T.cut(new.join(name.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(name.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    T.discard(opened)
    T.discard(alive)
    top = components(new)
    final = nodes.select("node", "id").join(groups.withColumnRenamed("label", "g"), "node", "left").select("node", "id", F.coalesce("g", "node").alias("g")).join(top.select(F.col("node").alias("g"), "label"), "g", "left").select("node", "id", F.coalesce("label", "g").alias("g"))
    least = final.groupBy("g").agg(F.min("id").alias("component"))
    named = final.join(least, "g").select("node", "component", "g")
    out = rows.select("id", "rk", "n", "node").join(named, "node", "left")
    real = lambda c: F.when(c < LAST, c)
    return out.select(real(F.col("id")).alias("doc_id"), "rk", F.col("n").alias("n_shingles"), real(F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))).alias("component_id"), F.col("g").alias("grp"))


def one_of_each(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """All columns of one document of each group: that of the least doc_id (then of the least hash of the row). Documents without words stay.

    Only rows that may have to go, or that occur more than once as they are, meet by key; all others pass straight through.
    """
    groups = T.cut(similar_groups(docs, words, num, den).select("rk", "doc_id", "n_shingles", "grp"))
    (rk, maybe) = T.free(docs.columns, "__rk", "__maybe_in")
    rows = groups.filter("grp IS NOT NULL").groupBy("grp", "rk").agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("id"), F.count(F.lit(1)).alias("times"))
    best = rows.groupBy("grp").agg(F.min(F.struct("id", "rk")).alias("m"))
    marked = rows.join(best, "grp").select(F.col("rk").alias(rk), (F.col("rk") != F.col("m.rk")).alias("__goes"), "times").filter("__goes OR times > 1")
    special = T.cut(marked.select(rk, "__goes"))
    flagged = T.maybe_in(docs.withColumn(rk, F.xxhash64("doc_id", "text")), rk, special, maybe)
    names = [F.col(f"`{k}`") for k in docs.columns]
    met = flagged.filter(F.col(maybe)).join(special, rk, "left")
    return flagged.filter(~F.col(maybe)).select(names).unionByName(met.filter("__goes IS NULL").select(names)).unionByName(met.filter("NOT __goes").dropDuplicates([rk]).select(names))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under five-word shingles and a similarity of 0.75."""
    return similar_groups(T.documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM (SELECT DISTINCT doc_id FROM d) d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""
