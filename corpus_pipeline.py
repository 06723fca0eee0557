"""A corpus pipeline of five of the operators; part of the subpackage llm.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from culler.llm import decontam, jaccard, line_dedup, packing, quality_rules
from culler.llm import text as T


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy keeps."""
    return quality_rules.apply_rules(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines; one that consisted of such runs alone goes. n_chars follows the text."""
    n, gone = T.free(docs.columns, "n_lines", "n_removed")
    rows = line_dedup.deduplicate_lines(docs).filter((F.col(gone) == 0) | (F.col(gone) < F.col(n))).select(*[F.col(f"`{k}`") for k in docs.columns])
    if "n_chars" not in docs.columns:
        return rows
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return jaccard.one_of_each(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), only_clean=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of all pieces of all documents."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard_join", near_copies), ("benchmark_decontamination", benchmarks), ("best_fit_packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again."""
    docs = T.documents(spark, sf_dir)
    top = f"{T.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            out.write.parquet(f"{top}/{k}-{name}")
            docs = spark.read.parquet(f"{top}/{k}-{name}")
    return out
