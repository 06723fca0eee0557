"""Chat formatting of reply trees.

Messages form trees by parent. Iterated self-joins double the reach of every message's link to an ancestor, so a tree
of depth d takes log2(d) rounds; they sum scores along the way. Leaves are ranked in their tree by the mean score of
their root-to-leaf path, the paths of the chosen leaves are unrolled over the same links, and each is formatted as one
conversation. Lineage is cut after every round by a checkpoint in the shared folder.

The template writes `### role: text</turn>` and a line feed per turn. Backslash, # and < in texts, and also : and line
feed in roles, get a backslash before them, so control strings inside texts can't be taken for marks and the format
reads back exactly. The loss mask is an array of spans (code points, end exclusive) of the assistant texts.

Defined cases: null text or role is empty; a null tree_id is a tree of its own; a parent that isn't there makes its
child a root; messages on a cycle belong to no path; ties in score go to the smaller node; a null score counts as 0; rows
that repeat a node of a tree are one message, the least by (parent, role, text, score); an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from culler.llm import text as T

TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(s: str, more: str = "") -> str:
    return re.sub(rf"[\\#<{more}]", lambda m: "\\" + m[0], s)


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1", s)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its assistant texts."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"### {escape(role, ':')}: ", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}</turn>\n")
        at += len(out[-1])
    return "".join(out), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; the inverse of format_turns."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def ancestors(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, node, steps, total) of the messages whose chain ends in a root, and the tables (tree, node, up) of 2**k-th ancestors."""
    ids = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.lit(True).alias("there"))
    now = nodes.join(ids, (F.col("parent") == F.col("n")) & F.col("tree").eqNullSafe(F.col("t")), "left").select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.lit(1).cast("bigint").alias("steps"), F.col("score").alias("total"))
    links, ends = [], []
    now, most = T.cut(now), None
    while True:
        ends.append(now.filter("up IS NULL").select("tree", "node", "steps", "total"))
        now = now.filter("up IS NOT NULL")
        n = now.count()
        most = n if most is None else most
        if not n or 1 << len(links) > most + 1:
            break
        links.append(now.select("tree", "node", "up"))
        both = now.alias("a").join(_all(ends, now).alias("b"), (F.col("a.up") == F.col("b.node")) & F.col("a.tree").eqNullSafe(F.col("b.tree")))
        now = T.cut(both.select("a.tree", "a.node", "b.up", (F.col("a.steps") + F.col("b.steps")).alias("steps"), (F.col("a.total") + F.col("b.total")).alias("total")))
    done = ends[0]
    for e in ends[1:]:
        done = done.unionByName(e)
    return done, links


def _all(ends: list[DataFrame], now: DataFrame) -> DataFrame:
    out = now
    for e in ends:
        out = out.unionByName(e.withColumn("up", F.lit(None).cast("bigint")).select(now.columns))
    return out


def paths(nodes: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, height, node) of the chosen root-to-leaf paths; height counts from the leaf.

    nodes: tree, node (unique in its tree), parent (bigint, null at a root), score. per_tree: paths of a tree, by mean score; None: all.
    """
    shared = T.cut(nodes.select("tree", "node", "parent", F.col("score").cast("double").alias("score")))
    done, links = ancestors(shared)
    parents = shared.filter("parent IS NOT NULL").select(F.col("tree").alias("t"), F.col("parent").alias("n")).distinct()
    leaves = done.join(parents, (F.col("node") == F.col("n")) & F.col("tree").eqNullSafe(F.col("t")), "left_anti").select("tree", F.col("node").alias("leaf"), (F.col("total") / F.col("steps")).alias("mean"))
    leaves = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf")))
    if per_tree is not None:
        leaves = leaves.filter(F.col("rank") <= per_tree)
    out = T.cut(leaves.select("tree", "leaf", "rank", F.lit(0).cast("bigint").alias("height"), F.col("leaf").alias("node")))
    for k in reversed(range(len(links))):
        up = links[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        more = out.join(up, (F.col("node") == F.col("n")) & F.col("tree").eqNullSafe(F.col("t"))).select("tree", "leaf", "rank", (F.col("height") + (1 << k)).alias("height"), F.col("up").alias("node"))
        out = T.cut(out.unionByName(more))
    return out


def format_trees(messages: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """tree, leaf, rank, formatted, loss_spans of each chosen path.

    messages: tree, node, parent, role, text, score. A path is one row of the result, so it is put together in one task.
    """
    T.ship(messages.sparkSession)
    each = messages.select("tree", "node", F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).alias("m"))
    nodes = T.cut(each.groupBy("tree", "node").agg(F.min("m").alias("m")).select("tree", "node", "m.*"))
    p = paths(nodes, per_tree)
    full = p.alias("p").join(nodes.alias("n"), (F.col("p.node") == F.col("n.node")) & F.col("p.tree").eqNullSafe(F.col("n.tree"))).select("p.tree", "p.leaf", "p.rank", "p.height", "n.role", "n.text")
    each = full.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct((-F.col("height")).alias("h"), "role", "text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                made = [format_turns([(x["role"], x["text"]) for x in t]) for t in part.column("turns").to_pylist()]
                spans = pa.array([[{"start": s, "end": e} for s, e in x] for _, x in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([part.column("tree"), part.column("leaf"), part.column("rank"), pa.array([x for x, _ in made], pa.string()), spans], ["tree", "leaf", "rank", "formatted", "loss_spans"])

    return each.mapInArrow(run, f"tree {nodes.schema['tree'].dataType.simpleString()}, leaf bigint, rank int, formatted string, loss_spans array<struct<start: bigint, end: bigint>>")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, each a chain of replies in the order of its turns, formatted and read back."""
    T.ship(spark)
    own = spark.createDataFrame([(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")], "conv_id bigint, turn bigint, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("bigint")
    messages = rows.withColumn("node", at).select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexed = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            out = []
            for conv, formatted, spans in zip(*(batch.column(k).to_pylist() for k in ("tree", "formatted", "loss_spans")), strict=True):
                turns = parse_turns(formatted)
                loss = "".join(unescape(formatted[x["start"] : x["end"]]) for x in spans)
                out.append((conv, len(turns), hexed("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), hexed(loss), len(formatted)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    return format_trees(messages).mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(n))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(14 + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
