"""Line deduplication by winnowing over line hashes.

Lines without a word are passed over; the others are hashed without blanks at their ends. A run is `run` consecutive
lines; with `words`, also fewer lines that have so many words together. Of every least window of lines that makes a run
the line of least hash is selected, so equal windows select the same line: each distinct selected position is a
fingerprint, and runs that repeat are sure to share one. Positions whose fingerprint occurs once go. The others are
extended both ways, to the ends of the windows that selected them, by the hash of the lines between; where the extended
match has an earlier place, its lines are deleted, with blank lines inside the run. Windows overlap, so a repeated run
of any length is made up of matches and no part of it stays. Earlier is in a document of smaller doc_id, or before it in
the same one.

All meetings are counts and minima by key, so a line or run that a third of the documents share is summed where it is
read; places come back by (key, salt), so that no run's places meet in one task. Only texts that lose lines are shuffled.

Defined cases: a null or empty text has no lines and stays as it is; documents of fewer than `run` lines and `words`
words lose nothing; rows with one doc_id are one place, so none of them is later than another; a null doc_id comes last; an
empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from culler.llm import text as T

RUN = 3
WORDS = 50
SALTS = 16
LAST = (1 << 63) - 1


class Lines:
    """Lines with a word of the documents of a chunk: trimmed hashes, byte spans of whole lines, first line of each document."""

    def __init__(self, c: T.Chunk):
        w = c.words(hashes=False)
        sums = T.prefix(T.VALUES[c.data])
        starts, ends, doc = c.lines()
        a, b = np.searchsorted(w.starts, starts), np.searchsorted(w.starts, ends)
        full = b > a
        self.starts, self.ends, self.doc = starts[full], ends[full], doc[full]
        self.hash = T.span_hash(sums, w.starts[a[full]], w.ends[b[full] - 1])
        self.before = np.concatenate([[0], np.cumsum((b - a)[full])])  # words before each line
        self.first = np.searchsorted(self.doc, np.arange(c.n + 1))
        self._sums = T.prefix(self.hash)

    def windows(self, run: int, words: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First line, number of lines and content hash of the least windows of one document that are a run."""

        def enough(at: np.ndarray, k: int) -> np.ndarray:
            if k >= run or words is None:
                return np.full(len(at), k >= run)
            return self.before[at + k] - self.before[at] >= words

        found = []
        for k in range(1, min(run, len(self.hash)) + 1):
            at = np.arange(len(self.hash) - k + 1)
            at = at[self.doc[at] == self.doc[at + k - 1]]
            at = at[enough(at, k) & ~(enough(at, k - 1) & enough(at + 1, k - 1))]
            found.append((at, np.full(len(at), k, np.int8), T.span_hash(self._sums, at, at + k)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, T.U)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def fingerprints(x: Lines, run: int, words: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct selected lines, in order, and of each window, by selected line: where its line's windows begin, lines before the selected one, lines, content."""
    at, size, content = x.windows(run, words)
    chosen = at.copy()
    for k in range(1, int(size.max(initial=0))):
        nxt = np.minimum(at + k, len(x.hash) - 1)
        better = (k < size) & (x.hash[nxt] < x.hash[chosen])  # of equal hashes the first
        chosen[better] = nxt[better]
    order = np.argsort(chosen, kind="stable")
    lines, first = np.unique(chosen[order], return_index=True)
    return lines, first, (chosen - at)[order], size[order], content[order]


WINDOW = "array<struct<back: int, n: int, content: bigint>>"


def selected_positions(docs: DataFrame, run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """(fingerprint, id, rk, line, windows) of every distinct selected position. docs: id, rk, text; line counts the lines with a word."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, c in T.chunks(batch, "text"):
                x = Lines(c)
                lines, first, back, size, content = fingerprints(x, run, words)
                d = x.doc[lines]
                take = pa.array(d)
                each = pa.StructArray.from_arrays([pa.array(back.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(content.view(np.int64))], ["back", "n", "content"])
                windows = pa.ListArray.from_arrays(pa.array(np.append(first, len(size)).astype(np.int32)), each)
                yield pa.RecordBatch.from_arrays([pa.array(x.hash[lines].view(np.int64)), rows.column("id").take(take), rows.column("rk").take(take), pa.array((lines - x.first[:-1][d]).astype(np.int32)), windows], ["fingerprint", "id", "rk", "line", "windows"])

    return docs.mapInArrow(read, f"fingerprint bigint, id bigint, rk bigint, line int, windows {WINDOW}")


def repeated_windows(docs: DataFrame, run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """(rk, line, n) of the windows of n lines that occur earlier. docs: id, rk, text; line counts the lines with a word."""
    positions = T.store(selected_positions(docs, run, words))
    twice = positions.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    matched = T.probably_in(positions, "fingerprint", T.cut(twice.select("fingerprint"))).select("id", "rk", "line", F.explode("windows").alias("w"))
    found = T.store(matched.select("w.content", F.pmod(F.xxhash64("rk"), F.lit(SALTS)).cast("int").alias("salt"), "id", "rk", (F.col("line") - F.col("w.back")).alias("line"), "w.n"))
    T.discard(positions)
    places = F.struct("id", "line")
    salted = found.groupBy("content", "salt").agg(F.min(places).alias("p"), F.max(places).alias("q"))
    run_ = Window.partitionBy("content")  # SALTS rows at most
    earliest = salted.select("content", "salt", F.min("p").over(run_).alias("p"), F.max("q").over(run_).alias("q")).filter("p < q").select("content", "salt", "p")
    return found.join(earliest, ["content", "salt"]).filter(places > F.col("p")).select("rk", "line", "n")


def deduplicate_lines(docs: DataFrame, run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """All columns of `docs`, the text without later repeated runs, and n_lines, n_removed (lines with a word).

    A run is `run` lines or more, or lines of `words` words or more together (None: lines alone count).

    Where `docs` has columns of those names, the added ones get underscores behind theirs.
    """
    T.ship(docs.sparkSession)
    names = docs.columns
    added = T.free(names, "n_lines", "n_removed")
    id_, rk, gone, maybe = T.free(names, "__id", "__rk", "__lines", "__maybe")
    keyed = docs.withColumn(id_, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST))).withColumn(rk, F.xxhash64("doc_id", "text"))
    later = repeated_windows(keyed.select(F.col(id_).alias("id"), F.col(rk).alias("rk"), "text"), run, words)
    # copies of a row have the same windows; one list of them serves all
    lists = T.store(later.groupBy(F.col("rk").alias(rk)).agg(F.collect_set(F.col("line").cast("bigint") * (run + 1) + F.col("n")).alias(gone)))
    own = [F.col(f"`{k}`") for k in names]
    flagged = T.maybe_in(keyed, rk, lists, maybe)
    joined = flagged.filter(~F.col(maybe)).select(*own, F.lit(None).cast("array<bigint>").alias(gone)).unionByName(flagged.filter(F.col(maybe)).join(lists, rk, "left").select(*own, gone))
    at, n = names.index("text"), len(names)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.rename_columns([f"c{i}" for i in range(n + 1)])
            for rows, c in T.chunks(batch, f"c{at}"):
                x = Lines(c)
                texts = rows.column(at).to_pylist()
                removed = np.zeros(c.n, np.int64)
                for d, lines in enumerate(rows.column(n).to_pylist()):
                    if not lines:
                        continue
                    a, b = x.first[d], x.first[d + 1]
                    line, size = np.divmod(np.array(lines, np.int64), run + 1)
                    gone = T.covered(b - a, line, size)
                    removed[d] = gone.sum()
                    raw, o = c.data[c.offsets[d] : c.offsets[d + 1]], c.offsets[d]
                    drop = np.zeros(len(raw) + 1, bool)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    for s, e in edge.reshape(-1, 2):
                        drop[x.starts[a + s] - o : x.ends[a + e - 1] - o + 1] = True  # with the line feed that follows
                    texts[d] = raw[~drop[:-1]].tobytes().decode("utf-8", "replace")
                columns = [pa.array(texts, rows.column(i).type) if i == at else rows.column(i) for i in range(n)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(x.first)), pa.array(removed)], [*names, *added])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(rewrite, kinds + f", {added[0]} bigint, {added[1]} bigint")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents: doc_id, n_lines, n_removed, kept_sha256 of the remaining text. Runs are of RUN lines or of WORDS words."""
    return deduplicate_lines(T.documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, ls[i] AS raw FROM (SELECT r, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
k AS (SELECT r, doc_id, i, regexp_replace(regexp_replace(raw, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS line, len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS words,
  row_number() OVER (PARTITION BY r ORDER BY i) - 1 AS n FROM l WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')),
o AS (SELECT *, lead(line, 1) OVER o AS line2, lead(line, 2) OVER o AS line3, lead(words, 1) OVER o AS words2 FROM k WINDOW o AS (PARTITION BY r ORDER BY n)),
w AS (SELECT r, doc_id, n, 1 AS size, line AS win FROM o WHERE words >= {WORDS} UNION ALL SELECT r, doc_id, n, 2, line || chr(10) || line2 FROM o WHERE words + words2 >= {WORDS}
  UNION ALL SELECT r, doc_id, n, 3, line || chr(10) || line2 || chr(10) || line3 FROM o WHERE line3 IS NOT NULL),
m AS (SELECT win, min((doc_id, n)) AS p FROM w GROUP BY win),
g AS (SELECT DISTINCT r, unnest(range(n, n + size)) AS n FROM w JOIN m USING (win) WHERE (doc_id, n) > p),
x AS (SELECT k.r, k.i, k.n, g.n IS NOT NULL AS gone FROM k LEFT JOIN g ON g.r = k.r AND g.n = k.n),
y AS (SELECT l.r, l.i, l.raw, x.n, coalesce(x.gone, false) AS gone,
  coalesce(last_value(x.gone IGNORE NULLS) OVER (PARTITION BY l.r ORDER BY l.i ROWS UNBOUNDED PRECEDING), false) AND coalesce(first_value(x.gone IGNORE NULLS) OVER (PARTITION BY l.r ORDER BY l.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), false) AS inside,
  max(l.i) OVER (PARTITION BY l.r) AS top FROM l LEFT JOIN x ON x.r = l.r AND x.i = l.i),
z AS (SELECT r, count(n) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(CASE WHEN i < top THEN raw || chr(10) ELSE raw END, '' ORDER BY i) FILTER (WHERE NOT inside), '') AS kept FROM y GROUP BY r)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, sha256(kept) AS kept_sha256 FROM d JOIN z USING (r)
"""
