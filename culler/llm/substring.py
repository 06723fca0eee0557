"""Substring deduplication over compressed FM-indexes, one per shard.

A window of `width` words whose sequence also starts in a document of smaller doc_id marks its words for removal.

Routing. Every window names an anchor, the least hash among its grams of GRAM words, so equal windows name equal anchors.
Documents are read in chunks; each chunk tells its distinct anchors, and the anchors of two documents or more are told
back. Windows with such an anchor are cut into segments (all neighbouring windows with one anchor), each distinct segment
of a chunk goes once, with its least doc_id, to the shard of its anchor. An anchor with very many different segments is
not sent whole: its windows go one by one to shards by their own hash. So a passage that a third of all documents hold
costs each chunk one segment, and no shard depends on one anchor.

Search. A shard indexes distinct segments, but of each anchor none of its greatest doc_id, which can't precede another, and
streams those that aren't of its least. The index is compressed: a wavelet matrix whose blocks of equal bits take no bits,
common prefixes cut at `width`, and least doc_ids of windows; the suffix array is dropped once they are made. Streamed
segments run all in step by backward search. Each word extends the interval; where nothing in the index goes on so, the
match gives up words at its end until more does. That gives matching statistics, exact up to `width`; words where they
reach it begin a window of the index, whose least doc_id is told to the chunks. Chunks unite such windows into intervals
and remove them. `find_repeats` reports the same intervals for documents that aren't in the index at all.

At scale: raise `chunk` and `bucket` with the memory of the workers; a message has some hundred bytes where a chunk's
anchors are dealt to buckets, so their product with the corpus must stay in proportion.

Defined cases: null or empty texts have no words; documents of fewer than `width` words lose nothing; rows with one
doc_id never remove from each other; a null doc_id counts as the largest; an empty table gives no rows. `width` is 5 to 128.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from culler.llm import text as T

WIDTH, GRAM = 13, 5
LAST = (1 << 63) - 1
CHUNK, BUCKET, SHARD = 2 << 20, 32 << 20, 8 << 20  # bytes of text behind one chunk, anchor bucket and shard
PARTITION = 24 << 20
HOT = 4096  # different segments of one anchor from which its windows are dealt one by one
WORDS_AT_ONCE = 1 << 20


class Bits:
    """Hybrid bit vector: blocks of 64 bits with counts before them; a block of equal bits takes no bits of its own."""

    def __init__(self, b: np.ndarray):
        packed = np.packbits(b, bitorder="little")
        words = np.zeros(len(b) // 64 + 1, T.U)
        words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(words)
        self.counts = np.zeros(len(words) + 1, np.uint32)
        np.cumsum(ones, out=self.counts[1:])
        mixed = (ones > 0) & (ones < 64)
        self.kept = np.append(words[mixed], T.U(0))
        flags = np.packbits(mixed, bitorder="little")
        self.flags = np.zeros(len(mixed) // 64 + 1, T.U)
        self.flags.view(np.uint8)[: len(flags)] = flags
        self.before = np.zeros(len(self.flags), np.uint32)
        np.cumsum(np.bitwise_count(self.flags)[:-1], out=self.before[1:])

    @property
    def nbytes(self) -> int:
        return self.counts.nbytes + self.kept.nbytes + self.flags.nbytes + self.before.nbytes

    def _below(self, word: np.ndarray, low: np.ndarray) -> np.ndarray:
        return np.bitwise_count(word & ((T.U(1) << low.astype(T.U)) - T.U(1)))

    def _word(self, k: np.ndarray) -> np.ndarray:
        ones = self.counts[k + 1] - self.counts[k]
        at = self.before[k >> 6] + self._below(self.flags[k >> 6], k & 63)
        return np.where(ones == 64, ~T.U(0), np.where(ones == 0, T.U(0), self.kept[at]))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        k = i >> 6
        return self.counts[k].astype(np.int64) + self._below(self._word(k), i & 63)

    def select(self, r: np.ndarray) -> np.ndarray:
        """Position of the one that has r before it."""
        k = np.searchsorted(self.counts, r.astype(np.uint32), "right") - 1
        word, left, at = self._word(k), r - self.counts[k], k << 6
        for half in (32, 16, 8, 4, 2, 1):
            n = np.bitwise_count(word & ((T.U(1) << T.U(half)) - T.U(1)))
            high = left >= n
            left = left - np.where(high, n, 0)
            at = at + np.where(high, half, 0)
            word = np.where(high, word >> T.U(half), word)
        return at


class Wavelet:
    """Wavelet matrix over integers: rank in log2(alphabet) steps on compressed bits."""

    def __init__(self, x: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.bits, self.zeros = [], []
        for level in reversed(range(self.depth)):
            b = (x >> level & 1).astype(bool)
            self.bits.append(Bits(b))
            self.zeros.append(len(b) - int(b.sum()))
            x = np.concatenate([x[~b], x[b]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Place of position i in the stable order by symbol c: symbols c before i, plus a constant of c."""
        for k, bits in enumerate(self.bits):
            ones = bits.rank(i)
            i = np.where(c >> (self.depth - 1 - k) & 1, self.zeros[k] + ones, i - ones)
        return i


class Index:
    """Compressed FM-index over segments of word codes, each with an owner; serves matches of up to `width` words.

    Suffixes are sorted by their first `width` symbols or more. Kept are the wavelet matrix of the Burrows-Wheeler transform
    (frequent words have small symbols, so its upper levels are mostly equal bits), common prefixes cut at `width` (a byte
    each, and bit vectors of where they are shorter than each depth) and the least owner of every window. The segments, the
    transform and the suffix array are dropped.
    """

    def __init__(self, codes: np.ndarray, first: np.ndarray, owner: np.ndarray, width: int):
        n = self.n = len(codes) + len(first) - 1
        self.width = width
        ends = first[1:] + np.arange(len(first) - 1)  # a 0 behind each segment
        self.words, inverse, times = np.unique(codes, return_inverse=True, return_counts=True)
        self.symbol = np.empty(len(times), np.int64)
        self.symbol[np.argsort(-times, kind="stable")] = np.arange(1, len(times) + 1)
        s = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        s[inside] = self.symbol[inverse]
        rank, k = s, 1
        while k < width:
            nxt = np.full(n, -1, np.int64)
            nxt[: n - k] = rank[k:]
            both = rank * (n + len(times) + 2) + nxt + 1
            order = np.argsort(both, kind="stable")
            new = np.ones(n, np.int64)
            new[1:] = both[order[1:]] != both[order[:-1]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            k *= 2
        sa = np.argsort(rank, kind="stable")
        self.wavelet = Wavelet(s[sa - 1], len(times) + 1)  # before the first symbol comes the last
        every = np.arange(len(times) + 1)
        start = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=len(every)))[:-1]])
        self.shift = start - self.wavelet.rank(every, np.zeros(len(every), np.int64))
        self.common = np.zeros(n + 1, np.uint8)  # of each suffix with the one before it
        same = np.ones(max(n - 1, 0), bool)
        for j in range(width):
            x = s[(sa + j) % n] if n else s
            same &= x[1:] == x[:-1]
            self.common[1:n] += same
        shorter = self.common < np.arange(1, width)[:, None]  # by depth; holds at 0 and at n
        self.shorter = Bits(shorter.ravel())
        segment = np.repeat(np.arange(len(first) - 1), np.diff(first) + 1)  # the 0 behind a segment is its own
        whole = ends[segment[sa]] - sa >= width
        opens = np.flatnonzero((self.common[:n] < width) & whole)
        self.windows = Bits(np.bincount(opens, minlength=n + 1).astype(bool))
        owners = np.where(whole, owner[segment[sa]], LAST)
        group = np.cumsum((self.common[:n] < width) & whole) - 1
        self.least = np.full(len(opens), LAST)
        np.minimum.at(self.least, group[whole], owners[whole])

    @property
    def nbytes(self) -> int:
        parts = [self.words, self.symbol, self.shift, self.common, self.shorter, self.windows, self.least, *self.wavelet.bits]
        return sum(x.nbytes for x in parts)

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: intervals of the sequences with symbol c before them; empty where there are none."""
        both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
        return self.shift[c] + both[: len(c)], self.shift[c] + both[len(c) :]

    def widen(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the first `depth` (less than width) symbols of what the suffixes in the given ones begin with."""
        at = np.maximum(depth - 1, 0) * (self.n + 1)
        left = self.shorter.select(self.shorter.rank(at + lo + 1) - 1) - at
        right = self.shorter.select(self.shorter.rank(at + hi)) - at
        return np.where(depth > 0, left, 0), np.where(depth > 0, right, self.n)

    def stream(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word of streamed segments: its matching statistic, i.e. how many words from there, up to `width` and within
        the segment, occur together in the index; and where that is `width`, the least owner of that window, else LAST."""
        statistic, owner = np.zeros(len(codes), np.int64), np.full(len(codes), LAST)
        n = np.diff(first)
        if not self.n or not len(codes):
            return statistic, owner
        place = np.minimum(np.searchsorted(self.words, codes), len(self.words) - 1)
        symbol = np.where(self.words[place] == codes, self.symbol[place], 0)
        live = np.arange(len(n))
        los, his, lengths = np.zeros(len(n), np.int64), np.full(len(n), self.n), np.zeros(len(n), np.int64)
        for back in range(1, int(n.max()) + 1):
            live = live[n[live] >= back]
            at = first[live + 1] - back
            c, lo, hi, length = symbol[at], los[live], his[live], lengths[live]
            todo = np.flatnonzero(length == self.width)
            lo[todo], hi[todo] = self.widen(lo[todo], hi[todo], np.full(len(todo), self.width - 1))
            length[todo] = self.width - 1
            lost = c == 0  # a word that isn't in the index
            lo[lost], hi[lost], length[lost] = 0, self.n, 0
            todo = np.flatnonzero(~lost)
            while len(todo):
                a, b = self.extend(c[todo], lo[todo], hi[todo])
                ok = b > a
                done = todo[ok]
                lo[done], hi[done] = a[ok], b[ok]
                length[done] += 1
                todo = todo[~ok]  # the match gives up words at its end, until more suffixes begin with it
                depth = np.maximum(self.common[lo[todo]], self.common[hi[todo]]).astype(np.int64)
                lo[todo], hi[todo] = self.widen(lo[todo], hi[todo], depth)
                length[todo] = depth
            los[live], his[live], lengths[live] = lo, hi, length
            statistic[at] = length
            full = length == self.width
            owner[at[full]] = self.least[self.windows.rank(lo[full] + 1) - 1]
        return statistic, owner


def least_owners(codes: np.ndarray, first: np.ndarray, owner: np.ndarray, meet: np.ndarray, width: int) -> np.ndarray:
    """For each window of each segment, in order: the least owner of any segment that holds the window's sequence.

    Equal windows lie in segments of equal `meet` (their anchor), so of each anchor the segments of the greatest owner needn't
    be in the index, and those of the least needn't be streamed.
    """
    n = np.diff(first)
    _, who = np.unique(meet, return_inverse=True)
    low, top = np.full(len(n), LAST), np.full(len(n), -LAST - 1)
    np.minimum.at(low, who, owner)
    np.maximum.at(top, who, owner)

    def some(which):
        size = n[which]
        begin = np.concatenate([[0], np.cumsum(size)])
        return np.repeat(first[which] - begin[:-1], size) + np.arange(begin[-1]), begin

    held = np.flatnonzero(owner < top[who])
    place, begin = some(held)
    index = Index(codes[place], begin, owner[held], width)
    found = np.full(len(codes), LAST)
    place, begin = some(np.flatnonzero(owner > low[who]))
    found[place] = index.stream(codes[place], begin)[1]
    m = n - width + 1
    at = np.repeat(first[:-1] - (np.cumsum(m) - m), m) + np.arange(m.sum())
    return np.minimum(found[at], np.repeat(owner, m))


class Segments:
    """Windows of a chunk of documents, their anchors and segments. Documents come in the order of (id, rk)."""

    def __init__(self, table: pa.Table, width: int):
        ids, rk = T.longs(table, "id", LAST), T.longs(table, "rk", 0)
        self.order = np.lexsort((rk, ids))
        self.ids = ids[self.order]
        self.table = table.take(pa.array(self.order))
        data, offsets = T.utf8(self.table.column("text"))
        self.chunk = T.Chunk(data, offsets)
        w = self.words = self.chunk.words()
        at, self.window = w.windows(width)
        self.at, k = at, width - GRAM + 1
        if len(at):
            grams = np.full(len(w.hash), 0, T.U)
            g, h = w.windows(GRAM)
            grams[g] = h
            place = at + sliding_window_view(grams, k)[at].argmin(1)
            self.anchor = grams[place]
            new = np.ones(len(at), bool)
            new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
            self.begin = np.flatnonzero(new)
        else:
            self.anchor, self.begin = np.zeros(0, T.U), np.zeros(0, np.int64)
        self.size = np.diff(np.concatenate([self.begin, [len(at)]]))  # windows of each segment
        self.start = at[self.begin]
        self.end = self.start + self.size - 1 + width
        self.name = T.span_hash(w._sums, self.start, self.end) if len(at) else np.zeros(0, T.U)
        self.doc = self.ids[w.doc[self.start]] if len(at) else np.zeros(0, np.int64)


def _blob(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *(a.tobytes() for a in arrays)])


def _unblob(blob: bytes, *types) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.int64, len(types))
    out, o = [], 8 * len(types)
    for n, t in zip(sizes, types, strict=True):
        out.append(np.frombuffer(blob, t, n, o))
        o += int(n) * np.dtype(t).itemsize
    return out


def _dealt(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(bucket, kind="stable")
    return order, np.flatnonzero(np.diff(bucket[order], prepend=-1))


def removal(docs: DataFrame, width: int = WIDTH, chunk: int = CHUNK, bucket: int = BUCKET, shard: int = SHARD, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(keyed documents by chunk, messages (chunk, blob) with the least owners of windows). docs: doc_id, text, owner."""
    if not GRAM <= width <= 128:
        raise ValueError(f"width must be from {GRAM} to 128, not {width}")
    T.ship(docs.sparkSession)
    total = T.text_bytes(docs)
    n_chunks, n_buckets, n_shards = T.pieces(total, chunk), T.pieces(total, bucket), T.pieces(total, shard)
    keyed = docs.withColumnRenamed("owner", "id").withColumn("rk", F.xxhash64("doc_id", "text"))
    keyed = keyed.withColumn("chunk", F.pmod("rk", F.lit(n_chunks))).repartition(T.pieces(total, PARTITION), "chunk")

    def tell(table):
        if not table.num_rows:
            return pa.table({"bucket": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
        s = Segments(table, width)
        anchor = s.anchor[s.begin]
        order = np.lexsort((s.name, s.doc, anchor))
        a, d = anchor[order], s.doc[order]
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        cut = np.flatnonzero(new)
        if len(cut):
            distinct = np.ones(len(a), np.int64)
            distinct[1:] = new[1:] | (s.name[order][1:] != s.name[order][:-1])
            count = np.minimum(np.add.reduceat(distinct, cut), 32767)
            many = np.maximum.reduceat(d, cut) > np.minimum.reduceat(d, cut)
            a, flag = a[cut], (count * 2 + many).astype(np.uint16)
        else:
            flag = np.zeros(0, np.uint16)
        order, cuts = _dealt((T.mix(a) % T.U(n_buckets)).astype(np.int64))
        b = (T.mix(a[order][cuts]) % T.U(n_buckets)).astype(np.int64)
        blobs = [_blob(a[order[i:j]], flag[order[i:j]]) for i, j in T.between(cuts, len(a))]
        return pa.table({"bucket": pa.array(b), "chunk": pa.array(np.full(len(b), table.column("chunk")[0].as_py(), np.int64)), "blob": pa.array(blobs, pa.binary())})

    def meet(table):
        parts = [_unblob(x, T.U, np.uint16) for x in table.column("blob").to_pylist()]
        if not parts:
            return pa.table({"chunk": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
        a, flag = (np.concatenate(x) for x in zip(*parts, strict=True))
        who = np.repeat(np.arange(len(parts)), [len(x[0]) for x in parts])
        order = np.argsort(a, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], a[order[1:]] != a[order[:-1]]])) if len(a) else np.zeros(0, np.int64)
        times = np.diff(np.concatenate([cut, [len(a)]]))
        f = flag[order].astype(np.int64)
        shared = (times > 1) | (f[cut] % 2 == 1) if len(a) else np.zeros(0, bool)
        heavy = np.add.reduceat(f // 2, cut) > hot if len(a) else shared
        keep = np.repeat(shared, times)
        who, a, heavy = who[order][keep], a[order][keep], np.repeat(heavy, times)[keep]
        order, cuts = _dealt(who)
        chunks = table.column("chunk").to_numpy()[who[order][cuts]]
        return pa.table({"chunk": pa.array(chunks), "blob": pa.array([_blob(a[order[i:j]], heavy[order[i:j]].astype(np.uint8)) for i, j in T.between(cuts, len(who))], pa.binary())})

    def send(left, right):
        empty = pa.table({"shard": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
        if not left.num_rows or not right.num_rows:
            return empty
        s = Segments(left, width)
        a, heavy = (np.concatenate(x) for x in zip(*[_unblob(x, T.U, np.uint8) for x in right.column("blob").to_pylist()], strict=True))
        order = np.argsort(a)
        a, heavy = a[order], heavy[order] > 0
        anchor = s.anchor[s.begin]
        at = np.minimum(np.searchsorted(a, anchor), len(a) - 1)
        known = a[at] == anchor
        whole = np.flatnonzero(known & ~heavy[at])
        single = np.flatnonzero(np.repeat(known & heavy[at], s.size))  # windows of hot anchors, one by one
        name = np.concatenate([s.name[whole], s.window[single]])
        start = np.concatenate([s.start[whole], s.at[single]])
        end = np.concatenate([s.end[whole], s.at[single] + width])
        to = np.concatenate([anchor[whole], s.window[single]])
        doc = s.ids[s.words.doc[start]] if len(start) else np.zeros(0, np.int64)
        order = np.lexsort((doc, name))
        new = np.ones(len(order), bool)
        new[1:] = name[order[1:]] != name[order[:-1]]
        top = np.maximum.reduceat(doc[order], np.flatnonzero(new)) if len(order) else doc
        pick = order[new]
        several = top > doc[pick]
        shards = (T.mix(to[pick] + T.U(1)) % T.U(n_shards)).astype(np.int64)
        order, cuts = _dealt(shards)
        blobs = []
        for i, j in T.between(cuts, len(pick)):
            p = pick[order[i:j]]
            n = end[p] - start[p]
            words = s.words.hash[np.repeat(start[p] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            short = words.view(np.uint8).reshape(-1, 8)[:, :5]  # 40 bits of each word's hash
            blobs.append(_blob(name[p], doc[p], several[order[i:j]].astype(np.uint8), n.astype(np.uint8), to[p], np.ascontiguousarray(short).ravel()))
        return pa.table({"shard": pa.array(shards[order[cuts]]), "chunk": pa.array(np.full(len(cuts), left.column("chunk")[0].as_py(), np.int64)), "blob": pa.array(blobs, pa.binary())}) if len(cuts) else empty

    def search(table):
        parts = [_unblob(x, T.U, np.int64, np.uint8, np.uint8, T.U, np.uint8) for x in table.column("blob").to_pylist()]
        if not parts:
            return pa.table({"chunk": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
        name, doc, several, size, to, raw = (np.concatenate(x) for x in zip(*parts, strict=True))
        size = size.astype(np.int64)
        who = np.repeat(np.arange(len(parts)), [len(x[0]) for x in parts])
        first = np.concatenate([[0], np.cumsum(size)])
        windows = size - width + 1
        out_first = np.concatenate([[0], np.cumsum(windows)])
        least = np.empty(out_first[-1], np.int64)
        n_parts = T.pieces(len(raw) // 5, WORDS_AT_ONCE)
        part = (T.mix(to + T.U(2)) % T.U(n_parts)).astype(np.int64)
        for k in range(n_parts):
            mine = np.flatnonzero(part == k)
            if not len(mine):
                continue
            order = mine[np.lexsort((doc[mine], name[mine]))]
            new = np.ones(len(order), bool)
            new[1:] = name[order[1:]] != name[order[:-1]]
            pick, group = order[new], np.cumsum(new) - 1  # each distinct segment once, with its least document
            n = size[pick]
            at = np.repeat(first[pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            codes = np.zeros((len(at), 8), np.uint8)
            codes[:, :5] = raw.reshape(-1, 5)[at]
            found = least_owners(codes.view(T.U).ravel(), np.concatenate([[0], np.cumsum(n)]), doc[pick], to[pick], width)
            m = windows[pick]
            f = np.cumsum(m) - m
            mo = windows[order]
            src = np.repeat(f[group] - (np.cumsum(mo) - mo), mo) + np.arange(mo.sum())
            dst = np.repeat(out_first[order] - (np.cumsum(mo) - mo), mo) + np.arange(mo.sum())
            least[dst] = found[src]
        lower = np.minimum.reduceat(least, out_first[:-1]) < doc
        use = np.flatnonzero(lower | (several > 0))
        order, cuts = _dealt(who[use])
        blobs = []
        for i, j in T.between(cuts, len(use)):
            p = use[order[i:j]]
            m = windows[p]
            blobs.append(_blob(name[p], m.astype(np.uint8), least[np.repeat(out_first[p] - (np.cumsum(m) - m), m) + np.arange(m.sum())]))
        return pa.table({"chunk": pa.array(table.column("chunk").to_numpy()[who[use][order][cuts]]), "blob": pa.array(blobs, pa.binary())})

    told = keyed.groupBy("chunk").applyInArrow(tell, "bucket bigint, chunk bigint, blob binary").groupBy("bucket").applyInArrow(meet, "chunk bigint, blob binary")
    sent = keyed.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(send, "shard bigint, chunk bigint, blob binary")
    return keyed, sent.groupBy("shard").applyInArrow(search, "chunk bigint, blob binary")


def remove_repeats(docs: DataFrame, width: int = WIDTH, **sizes) -> DataFrame:
    """doc_id, n_words, n_removed, text (the kept words joined by one space) and repeats (the intervals [start, end) of removed
    words) of every document."""
    return _without(docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("owner")), width, **sizes).drop("owner")


def find_repeats(docs: DataFrame, index: DataFrame, width: int = WIDTH, **sizes) -> DataFrame:
    """doc_id, n_words, n_removed, text and repeats of all `docs` as in remove_repeats, where only windows of texts of `index`
    count as repeats; texts of `docs` aren't compared with each other."""
    kind = docs.schema["doc_id"].dataType
    both = docs.select("doc_id", "text", F.lit(1).cast("bigint").alias("owner")).unionAll(index.select(F.lit(None).cast(kind).alias("doc_id"), "text", F.lit(0).cast("bigint").alias("owner")))
    return _without(both, width, **sizes).filter("owner = 1").drop("owner")


def _without(docs: DataFrame, width: int, **sizes) -> DataFrame:
    """Documents (doc_id, text, owner) without the windows that a text of a smaller owner holds."""
    keyed, found = removal(docs, width, **sizes)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def clean(left, right):
        if not left.num_rows:
            return pa.table({"doc_id": left.column("doc_id").slice(0, 0), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "repeats": pa.array([], span), "owner": pa.array([], pa.int64())})
        s = Segments(left, width)
        w = s.words
        gone = np.zeros(len(w.hash), bool)
        if right.num_rows and len(s.at):
            name, m, least = (np.concatenate(x) for x in zip(*[_unblob(x, T.U, np.uint8, np.int64) for x in right.column("blob").to_pylist()], strict=True))
            m = m.astype(np.int64)
            f = np.cumsum(m) - m
            order = np.argsort(name)
            flagged = []
            for names_, starts, sizes_ in ((s.name, s.start, s.size), (s.window, s.at, np.ones(len(s.at), np.int64))):
                at = np.minimum(np.searchsorted(name, names_, sorter=order), len(name) - 1)
                hit = np.flatnonzero((name[order[at]] == names_) & (m[order[at]] == sizes_))
                k = sizes_[hit]
                inner = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                first = np.repeat(starts[hit], k) + inner
                low = least[np.repeat(f[order[at[hit]]], k) + inner]
                flagged.append(first[low < s.ids[w.doc[first]]])
            gone = T.covered(len(w.hash), np.unique(np.concatenate(flagged)), width)
        removed = np.bincount(w.doc[gone], minlength=s.chunk.n)
        edge = np.concatenate([[0], np.cumsum(w.count)])  # where a document begins, an interval does
        begins, stops = gone.copy(), gone.copy()
        begins[1:] &= ~gone[:-1]
        stops[:-1] &= ~gone[1:]
        heads, tails = edge[:-1][w.count > 0], edge[1:][w.count > 0] - 1
        begins[heads], stops[tails] = gone[heads], gone[tails]
        begins, stops = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        base = edge[w.doc[begins]]
        spans = pa.StructArray.from_arrays([pa.array(begins - base), pa.array(stops - base)], ["start", "end"])
        cuts = np.concatenate([[0], np.cumsum(np.bincount(w.doc[begins], minlength=s.chunk.n))])
        repeats = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), spans)
        raw = s.chunk.data.tobytes()
        texts, starts, ends = [], w.starts.tolist(), w.ends.tolist()
        for d in range(s.chunk.n):
            a, b = int(w.first[d]), int(w.first[d + 1])
            texts.append(b" ".join([raw[starts[i] : ends[i]] for i in (range(a, b) if not removed[d] else (a + np.flatnonzero(~gone[a:b])).tolist())]))
        return pa.table({"doc_id": s.table.column("doc_id"), "n_words": pa.array(w.count.astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64)), "text": pa.array(texts, pa.binary()).cast(pa.string()), "repeats": repeats, "owner": pa.array(s.ids)})

    return keyed.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(clean, f"doc_id {kind}, n_words bigint, n_removed bigint, text string, repeats array<struct<start: bigint, end: bigint>>, owner bigint")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without repeated windows of 13 words."""
    return remove_repeats(T.documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT s, min(doc_id) AS p FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN m USING (s) WHERE p < doc_id),
y AS (SELECT doc_id, list(i) AS gone FROM x GROUP BY doc_id),
k AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN y USING (doc_id)),
t AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
z AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.i) AS kept FROM t LEFT JOIN x ON x.doc_id = t.doc_id AND x.i = t.i WHERE x.i IS NULL GROUP BY t.doc_id)
SELECT k.doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN z ON z.doc_id = k.doc_id
"""
