"""Quality rules as a bitmask ledger.

Every rule is evaluated once for every document; the ledger keeps one bit for each failure beside the measurements.
A policy is a versioned set of rules, so applying it, or asking what each of its rules does alone, is bit arithmetic
on the ledger and never reads a text again.

Defined cases: a null text has no words; a null doc_id is kept as it is; repeated rows give a row each; an empty
table gives an empty ledger; further columns of the input are dropped unless named in `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from culler.llm import text as T

SYMBOLS = T.byte_class(b"#*$%&|<>")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper")
MARKS = T.byte_class(b"!?")
UPPER = T.byte_class(range(65, 91))


def measure(c: T.Chunk) -> dict[str, np.ndarray]:
    """All measurements of the documents of a chunk.

    n_words: words. word_chars: code points in words. n_symbols: characters of [#*$%&|<>]. n_lines: lines with a
    word. n_dup_lines: such lines equal to an earlier line. n_repeat_words: words in windows of three words that occur
    twice or more in the document. n_marks: characters of [!?]. n_upper: A-Z.
    """
    w = c.words()
    firsts = (c.data & 0xC0) != 0x80
    word_chars = c.per_doc(firsts & T.PLAIN[c.data])
    starts, ends, doc = c.lines()
    full = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends, doc = starts[full], ends[full], doc[full]
    salt = T.mix(np.arange(1, c.n + 1, dtype=T.U))
    _, later = T.repeated(T.span_hash(w.byte_sums, starts, ends) ^ salt[doc])
    at, keys = w.windows(3)
    twice, _ = T.repeated(keys ^ salt[w.doc[at]])
    repeat = T.covered(len(w.hash), at[twice], 3)
    return {
        "n_words": w.count,
        "word_chars": word_chars,
        "n_symbols": c.per_doc(SYMBOLS[c.data]),
        "n_dup_lines": np.bincount(doc[later], minlength=c.n),
        "n_repeat_words": np.bincount(w.doc[repeat], minlength=c.n),
        "n_lines": np.bincount(doc, minlength=c.n),
        "n_marks": c.per_doc(MARKS[c.data]),
        "n_upper": c.per_doc(UPPER[c.data]),
    }


#: Rules in the order of their bits; each is true where a document fails it. Only whole numbers are compared.
RULES = {
    "too_short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 30 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "same_lines": "100 * n_dup_lines > 50 * n_lines",
    "shouting": "100 * n_upper > 60 * word_chars",
    "marks": "100 * n_marks > 50 * n_words",
}
BASE = ("too_short", "repetitive")
#: Versioned policies: a document is kept if it fails none of the rules named.
POLICIES = {"base-1": BASE, "web-1": (*BASE, "symbols", "long_words", "short_words"), "web-2": tuple(RULES)}
PRODUCTION = "web-2"


def mask(policy: str) -> int:
    return sum(1 << i for i, r in enumerate(RULES) if r in POLICIES[policy])


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row per document: the columns in `keep`, all measurements, and `failures` with one bit per failed rule.

    A column in `keep` that has one of those names comes with underscores behind its own, as policies read the names.
    """
    T.ship(docs.sparkSession)
    shown = T.free([*MEASURES, "failures"], *keep)
    source = docs.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, c in T.chunks(batch, "__text"):
                m = measure(c)
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(keep))), *(pa.array(m[k].astype(np.int64)) for k in MEASURES)], [*shown, *MEASURES])

    schema = ", ".join([*(f"`{k}` {f.dataType.simpleString()}" for k, f in zip(shown, source.schema.fields[:-1], strict=True)), *(f"{k} bigint" for k in MEASURES)])
    return source.mapInArrow(run, schema).withColumn("failures", failures())


def failures() -> Column:
    """The bits of all failed rules, from the measurements."""
    bits = F.lit(0).cast("bigint")
    for i, rule in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return bits


def failure_bits(values: dict[str, np.ndarray]) -> np.ndarray:
    """The same bits as failures(), of the measurements of a chunk."""
    bits = np.zeros(len(values["n_words"]), np.int64)
    for i, rule in enumerate(RULES.values()):
        bits |= eval(rule, {"__builtins__": {}}, values).astype(np.int64) << i  # noqa: S307  the constants above, the same text as in SQL
    return bits


def passes(policy: str) -> Column:
    return F.col("failures").bitwiseAND(F.lit(mask(policy)).cast("bigint")) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that would be kept without it.

    One aggregation by the masked bits; its groups are at most 2 to the number of rules, whatever the corpus.
    """
    m = mask(policy)
    groups = rows.groupBy(F.col("failures").bitwiseAND(F.lit(m).cast("bigint")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << i).cast("bigint").alias("bit")) for i, r in enumerate(RULES) if m >> i & 1])
    each = groups.select("bits", "n", F.explode(rules).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only_this"),
    )


def apply_rules(docs: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Documents that a policy keeps, with all their columns: the bits of the ledger under the policy's mask.

    One pass without a shuffle: a row's text passes through, its bits and measurements aren't stored.
    """
    T.ship(docs.sparkSession)
    m, names = mask(policy), docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, c in T.chunks(batch.rename_columns([f"c{i}" for i in range(len(names))]), f"c{at}"):
                yield rows.filter(pa.array(failure_bits(measure(c)) & m == 0)).rename_columns(names)

    return docs.mapInArrow(run, docs.schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents with the verdict of the production policy."""
    rows = ledger(T.documents(spark, sf_dir))
    base = F.col("failures").bitwiseAND(F.lit(mask("base-1")).cast("bigint")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), passes(PRODUCTION).alias("kept"), "n_lines", "n_marks", "n_upper", "failures")


_CASES = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES.values()))
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, text, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM d),
u AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM u),
p AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY r),
l AS (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(ls) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line),
q AS (SELECT r, sum(n)::BIGINT AS n_lines, sum(n - 1)::BIGINT AS n_dup_lines FROM l GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
  length(regexp_replace(text, '[^!?]', '', 'g'))::BIGINT AS n_marks, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper
  FROM w LEFT JOIN p USING (r) LEFT JOIN q USING (r)),
f AS (SELECT *, ({_CASES})::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & {mask("base-1")}) <> 0 AS base_failed,
  (failures & {mask(PRODUCTION)}) = 0 AS kept, n_lines, n_marks, n_upper, failures FROM f
"""
