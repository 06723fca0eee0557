"""Resumable execution of a queue folder by Structured Streaming."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from culler.operators.planner import audit_events, execute, ledger_rows, outcome
from culler.operators.stage import stored
from culler.sources.report import append_ledger, parse_queue, read_ledger

log = logging.getLogger("culler")


def run_queue(spark: SparkSession, queue_dir: str, state: DataFrame, ledger_dir: str, checkpoint_dir: str, key: str, audit_dir: str | None = None, totals_dir: str | None = None) -> None:
    """Executes what is in the queue folder and not in the ledger, then stops; run again after a failure, it goes on.

    Ledger rows are written once per (key, id): a batch that is tried again finds its rows there. Every removal is an
    event in audit_dir and a removed membership (file, removed_parent); totals_dir gets ok, failed, skipped and orphaned of
    each batch, where lines that can't be read count as failed. Both are written by batch, so a batch tried again replaces
    its own. Rows are tried in the order of their line_no; those without one come last, by id and parent.
    """

    def batch(texts: DataFrame, batch_id: int) -> None:
        ledger = read_ledger(spark, ledger_dir)
        queue = stored(parse_queue(texts))
        last = F.lit(1 << 62) + F.pmod(F.xxhash64("id", "parent"), F.lit(1 << 40))
        rows = queue.filter("NOT bad").withColumn("line_no", F.coalesce("line_no", last))
        results = stored(execute(rows, state, ledger.filter(F.col("key") == key)))
        events = audit_events(results)
        if audit_dir:
            events.write.mode("overwrite").parquet(f"{audit_dir}/batch={batch_id}")
        if totals_dir:
            bad = queue.agg(F.count_if("bad").alias("bad"))
            outcome(results).crossJoin(F.broadcast(bad)).select("ok", (F.col("failed") + F.col("bad")).alias("failed"), "skipped", "orphaned").write.mode("overwrite").parquet(f"{totals_dir}/batch={batch_id}")
        append_ledger(ledger_rows(results.filter("status <> 'resumed'"), key), ledger, ledger_dir)
        log.info("batch %s of %s done", batch_id, key)

    stream = spark.readStream.text(queue_dir)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start().awaitTermination()


def run_totals(spark: SparkSession, totals_dir: str) -> DataFrame:
    """ok, failed, skipped and orphaned of all batches."""
    return spark.read.parquet(totals_dir).agg(*[F.sum(k).alias(k) for k in ("ok", "failed", "skipped", "orphaned")])


def keep_audit(spark: SparkSession, header: DataFrame, audit_dir: str, to: str) -> None:
    """Copies a run's header and events to a durable place; a failure to do so is logged and stops nothing."""
    try:
        header.write.mode("overwrite").parquet(f"{to}/header")
        spark.read.parquet(audit_dir).write.mode("overwrite").parquet(f"{to}/events")
    except Exception:  # the run itself is done
        log.warning("the audit could not be copied to %s", to, exc_info=True)
