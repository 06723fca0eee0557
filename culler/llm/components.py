"""Connected components by repeated joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culler.llm import text as T


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) of every node of the edges (a, b): label is the least node of its component.

    Each round takes the least label among neighbours and then the label of that label, so the distance to the least
    node about halves. Rounds write to the shared folder; the loop ends when no label falls.
    """
    edges = T.cut(edges.select("a", "b"))  # once: links that span a block depend on the order of its rows, and both directions must agree
    both = T.cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = T.cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("l")).select(F.col("a").alias("node"), "l")
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "l").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = T.cut(step.join(up, "label", "left").select("node", "was", F.least("label", F.coalesce("above", "label")).alias("label")))
        changed = not new.filter("was <> label").isEmpty()
        labels = new.select("node", "label")
        if not changed:
            break
    else:
        raise RuntimeError("labels still fall; raise `rounds`")
    return labels
