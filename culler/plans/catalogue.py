"""Named queries over the planner and the detection cascade, each with SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from culler.functions import errors, render
from culler.functions.fields import id_tokens as id_tokens_of
from culler.functions.fields import to_int
from culler.operators import detect, planner
from culler.operators.stage import shared_folder
from culler.plans import fixture as X
from culler.sources import report
from culler.streaming import resume

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def values(rows: list[tuple], names: str, types: list[str]) -> str:
    """SQL of literal rows."""
    lit = lambda v, t: "NULL::" + t if v is None else f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else f"{str(v).lower()}::{t}"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(lit(v, t) for v, t in zip(r, types, strict=True)) + ')' for r in rows)}) AS t({names})"


def _entry(line_no, role, grp, id_, parent=None, match="", b3=None, size=None, w=None, h=None, name=""):
    return (line_no, role, grp, id_, parent, match, b3, size, w, h, name)


TRAPS = [
    "[DUP] group=1 | id=a1 | parent=p1 | match=exact | b3=ff | size=10 | w=4 | h=3 | name=x.jpg", "[ASLI] id=a2 | parent= | size= | name=", "  [DUP]   id=a3|name=we | ird (1).jpg  ", "[dup] id=a4", "x [DUP] id=a5",
    "[DUP] group=9 | name=no id", "[DUP] id= | group=1", "[ASLI] role=dup | id=a6", "[ASLI] role= | id=a7", "[DUP] id=a8 | id=a9", "[DUP] id=b1 | filename=z | parent=p2 | name=n", "[DUP] id=b2 | name = spaced | parent=p3",
    "[DUP] id=b3x | b3=x=y=z | junk | =v", "[DUP]id=b4", " [DUP] id=b5 | parent= p4 | name=q r", "[DUP] ID=b6", "[DUP] id=b7 | size=1_000 | w=+5 | h=5.0", "[DUP]", "[ASLI][DUP] id=b8", "﻿[DUP] id=b9",
]
EXPECTED = [
    _entry(0, "DUP", "1", "a1", "p1", "exact", "ff", "10", "4", "3", "x.jpg"), _entry(1, "ASLI", "", "a2"), _entry(2, "DUP", "", "a3", name="we | ird (1).jpg"), _entry(7, "DUP", "", "a6"), _entry(8, "", "", "a7"), _entry(9, "DUP", "", "a9"),
    _entry(10, "DUP", "", "b1", name="z | parent=p2 | name=n"), _entry(11, "DUP", "", "b2", "p3", name="spaced"), _entry(12, "DUP", "", "b3x", b3="x=y=z"), _entry(13, "DUP", "", "b4"), _entry(14, "DUP", "", "b5", "p4", name="q r"), _entry(16, "DUP", "", "b7", size="1_000", w="+5", h="5.0"),
]
_ENTRY_NAMES, _ENTRY_TYPES = "line_no, role, grp, id, parent, match, b3, size, w, h, name", ["BIGINT", *["VARCHAR"] * 10]


@query(values(EXPECTED, _ENTRY_NAMES, _ENTRY_TYPES))
def parse_traps(spark, d):
    return report.parse_entries(spark.createDataFrame(list(enumerate(TRAPS)), "line_no bigint, line string"))


@query("WITH " + X.sql() + " SELECT k AS line_no, role, grp, id, parent, 'exact' AS match, b3, size::VARCHAR AS size, NULL::VARCHAR AS w, NULL::VARCHAR AS h, name FROM e")
def parse_entries(spark, d):
    return report.parse_entries(report.render_lines(X.entries(spark, d)))


@query(values([("B", "f1", "v2")], "folder, folder_id, format", ["VARCHAR"] * 3))
def parse_header(spark, d):
    lines = ["Folder: A:B", "Folder ID : f1", "FORMAT: v2", "a=b: c", "[x] folder: y", "Folder: B", "[DUP] junk", "Folder: C"]
    return report.parse_header(spark.createDataFrame(list(enumerate(lines)), "line_no bigint, line string"))


@query("WITH " + X.sql() + " SELECT count(*) FILTER (WHERE role = 'ASLI')::BIGINT AS asli, count(*) FILTER (WHERE role <> 'ASLI')::BIGINT AS dup, coalesce(sum(size) FILTER (WHERE role <> 'ASLI'), 0)::BIGINT AS dup_bytes, CASE WHEN count(*) >= 5000 THEN 'batch' ELSE 'interactive' END AS mode, count(*) FILTER (WHERE role <> 'ASLI') > 2000 AS strict_asks FROM e")
def report_summary(spark, d):
    return planner.summary(X.entries(spark, d))


@query("WITH " + X.verify_sql(False) + " SELECT grp, count(*)::BIGINT AS anchors FROM v WHERE role = 'ASLI' AND grp IN (SELECT grp FROM anchor) GROUP BY grp")
def live_anchors(spark, d):
    return planner.live_anchors(planner.with_state(X.entries(spark, d), X.state(spark, d)))


@query("WITH " + X.verify_sql(False) + " SELECT k AS line_no, id, st AS status FROM v")
def verify_status(spark, d):
    return planner.verify(X.entries(spark, d), X.state(spark, d)).select("line_no", "id", "status")


@query("WITH " + X.verify_sql(True) + " SELECT k AS line_no, id, st AS status FROM v")
def verify_status_strict(spark, d):
    return planner.verify(X.entries(spark, d), X.state(spark, d), strict=True).select("line_no", "id", "status")


def _plan(spark, d, strict=False):
    return planner.plan(X.entries(spark, d), X.state(spark, d), strict)


_PLAN_COLUMNS = ("line_no", "role", "grp", "id", "parent", "status", "owned_by_me", "created_time", "aborted")


def _state_only(df):
    known = F.col("status").isin("ready", "skip_group_survivor")
    return df.select(*[F.when(known, F.col(c)).alias(c) if c in ("owned_by_me", "created_time") else F.col(c) for c in _PLAN_COLUMNS])


_PLAN_SQL = " SELECT k AS line_no, role, grp, id, parent, status, CASE WHEN st = 'ready' THEN k % 2 = 0 END AS owned_by_me, CASE WHEN st = 'ready' THEN created END AS created_time, false AS aborted FROM p"


@query("WITH " + X.verify_sql(False) + _PLAN_SQL)
def plan_full(spark, d):
    return _state_only(_plan(spark, d))


@query("WITH " + X.verify_sql(True) + _PLAN_SQL)
def plan_full_strict(spark, d):
    return _state_only(_plan(spark, d, True))


@query("WITH " + X.verify_sql(False) + " SELECT split_part(status, ':', 1) AS kind, count(*)::BIGINT AS n FROM p GROUP BY 1")
def status_histogram(spark, d):
    h = planner.status_histogram(_plan(spark, d))
    return h.groupBy(F.substring_index("status", ":", 1).alias("kind")).agg(F.sum("n").alias("n"))


@query("WITH " + X.verify_sql(False) + " SELECT grp, id, created AS created_time FROM p WHERE status = 'skip_group_survivor'")
def survivors(spark, d):
    return _plan(spark, d).filter("status = 'skip_group_survivor'").select("grp", "id", "created_time")


_TIES = [("g1", "b", "2020"), ("g1", "a", "2020"), ("g2", "0", None), ("g2", "b", "2020"), ("g3", "z", ""), ("g3", "a", None), ("g4", "only", None)]


@query(values([("g1", "a"), ("g2", "b"), ("g3", "a"), ("g4", "only")], "grp, id", ["VARCHAR"] * 2))
def survivor_tiebreak(spark, d):
    e = spark.createDataFrame([(i, "DUP", g, x, "p", "", None, "1", None, None, x) for i, (g, x, _) in enumerate(_TIES)], report.schemas.ENTRY)
    s = spark.createDataFrame([(x, None, x, ["p"], True, None, None, "1", False, "", None, c, None) for x, c in {x: c for g, x, c in _TIES if g == "g4"}.items()], report.schemas.FILE_STATE)
    s = s.unionByName(spark.createDataFrame([(f"{g}/{x}", None, x, ["p"], True, None, None, "1", False, "", None, c, None) for g, x, c in _TIES if g != "g4"], report.schemas.FILE_STATE))
    e = e.withColumn("id", F.when(F.col("grp") == "g4", F.col("id")).otherwise(F.concat_ws("/", "grp", "id")))
    return planner.plan(e, s).filter("status = 'skip_group_survivor'").select("grp", F.substring_index("id", "/", -1).alias("id"))


@query(f"WITH {X.verify_sql(False, 701)} SELECT k AS line_no, st AS status FROM v WHERE k <= 701")
def plan_abort_prefix(spark, d):
    return planner.plan(X.entries(spark, d), X.state(spark, d, fatal_at=701)).select("line_no", "status")


_ERRORS = [(403, "dailyLimitExceeded", "fatal_global"), (403, "storageQuotaExceeded", "fatal_global"), (403, "userRateLimitExceeded", "recoverable"), (403, "rateLimitExceeded; quotaExceeded", "recoverable"), (403, "ratelimit", "recoverable"), (403, "rate limit", "fatal"), (403, "insufficientPermissions", "fatal"), (403, None, "fatal"), (401, "any", "fatal_global"), (404, "any", "fatal"), *((c, "x", "recoverable") for c in errors.AGAIN), *((c, "x", "fatal") for c in (0, 400, 409, 501))]


@query(values([(c, r, e, e == "fatal_global", c == 404) for c, r, e in _ERRORS], "code, reason, kind, all_fail, not_found", ["INTEGER", "VARCHAR", "VARCHAR", "BOOLEAN", "BOOLEAN"]))
def classify_errors(spark, d):
    e = spark.createDataFrame([(c, r) for c, r, _ in _ERRORS], "code int, reason string").withColumn("err", errors.error_text(F.col("code"), F.col("reason")))
    return e.select("code", "reason", errors.classify_error(F.col("code"), F.col("reason")).alias("kind"), errors.is_global(F.col("err")).alias("all_fail"), errors.is_not_found(F.col("err")).alias("not_found"))


@query(values([(a, float(b), b * 1.5) for a, b in enumerate((1, 2, 4, 8, 16, 16))], "attempt, least, most", ["INTEGER", "DOUBLE", "DOUBLE"]))
def backoff_schedule(spark, d):
    low, high = errors.backoff_seconds(F.col("attempt"))
    return spark.createDataFrame([(a,) for a in range(6)], "attempt int").select("attempt", low.alias("least"), high.alias("most"))


def _results(spark, d, batch=True):
    return planner.execute(planner.select_all(_plan(spark, d)), X.state(spark, d, later=True), X.ledger(spark, d) if batch else None)


@query("WITH " + X.execute_sql() + " SELECT k AS line_no, id, parent, result AS status FROM x")
def execute_results(spark, d):
    return _results(spark, d).select("line_no", "id", "parent", "status")


@query("WITH " + X.execute_sql() + " SELECT count(*) FILTER (WHERE result = 'removed')::BIGINT AS ok, count(*) FILTER (WHERE result LIKE 'error%')::BIGINT AS failed, count(*) FILTER (WHERE result LIKE 'skip%' OR result = 'resumed')::BIGINT AS skipped, count(*) FILTER (WHERE result = 'removed')::BIGINT AS orphaned FROM x")
def execute_outcome(spark, d):
    return planner.outcome(_results(spark, d))


@query(values([(0, "removed"), (1, "skip_already_out"), (2, "skip_already_out")], "line_no, status", ["BIGINT", "VARCHAR"]))
def execute_dedup(spark, d):
    e = spark.createDataFrame([(i, "DUP", "g", "x", p, "", None, "1", None, None, "n") for i, p in enumerate(("p", "p", "q"))], report.schemas.ENTRY)
    s = spark.createDataFrame([("x", None, "n", ["p"], True, None, None, "1", False, "", None, None, None)], report.schemas.FILE_STATE)
    return planner.execute(e, s).select("line_no", "status")


@query("WITH " + X.execute_sql() + ", m AS (SELECT id, unnest(CASE parents2 WHEN 0 THEN [] WHEN 2 THEN [home, 'pX'] ELSE [home] END) AS parent FROM e) SELECT m.id, m.parent FROM m WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.result = 'removed' AND x.id = m.id AND x.parent = m.parent)")
def membership_after(spark, d):
    return planner.membership_after(X.membership(spark, d), _results(spark, d)).select("id", "parent")


@query("WITH " + X.execute_sql() + " SELECT id AS file, name, parent AS removed_parent, home AS parents_before, '' AS parents_after, true AS orphan FROM x WHERE result = 'removed'")
def audit_events(spark, d):
    return planner.audit_events(_results(spark, d)).withColumn("parents_before", F.array_join("parents_before", ",")).withColumn("parents_after", F.array_join("parents_after", ","))


@query("WITH " + X.sql() + " SELECT 'me' AS actor, 'r' AS report_name, 'r1' AS report_id, 'h' AS report_hash, 'f1' AS folder_id, false AS strict, count(*) FILTER (WHERE role = 'ASLI')::BIGINT AS asli, count(*) FILTER (WHERE role <> 'ASLI')::BIGINT AS dup, CASE WHEN count(*) >= 5000 THEN 'batch' ELSE 'interactive' END AS mode FROM e")
def audit_header(spark, d):
    return planner.audit_header(spark, X.entries(spark, d), "me", "r", "r1", "h", "f1", False)


@query("WITH " + X.verify_sql(False) + " SELECT id, k % 71 = 0 AS done FROM p WHERE status = 'ready'")
def resume_anti_join(spark, d):
    ready = planner.select_all(_plan(spark, d))
    done = X.ledger(spark, d)
    return ready.join(done, "id", "left_anti").select("id", F.lit(False).alias("done")).unionByName(ready.join(done, "id", "left_semi").select("id", F.lit(True).alias("done")))


@query("WITH " + X.execute_sql() + " SELECT 'k1' AS key, id, result AS status FROM x WHERE result IN ('removed', 'skip_already_out', 'skip_multi_parent')")
def ledger_rows(spark, d):
    return planner.ledger_rows(_results(spark, d), "k1").select("key", "id", "status")


@query("WITH " + X.verify_sql(False) + " SELECT k AS line_no, CASE WHEN status = 'ready' AND k % 10 = 3 THEN 'skip_user_keep' ELSE status END AS status FROM p")
def keep_selection(spark, d):
    p = _plan(spark, d)
    return planner.select_except(p, p.filter("role <> 'ASLI' AND line_no % 10 = 3").select("id")).select("line_no", "status")


@query("WITH " + X.sql() + " SELECT k AS line_no, id, parent FROM e WHERE k % 9 = 4 AND parent IS NOT NULL")
def manual_selection(spark, d):
    e = X.entries(spark, d)
    return planner.select_manual(e, e.filter("line_no % 9 = 4").select("id")).select("line_no", "id", "parent")


@query("SELECT 'f' || o_orderkey AS id, 'known' AS kind FROM orders WHERE o_orderkey % 9 = 4 UNION ALL SELECT 'u' || o_orderkey, 'unknown' FROM orders WHERE o_orderkey % 9 = 5")
def id_set_ops(spark, d):
    e = X.entries(spark, d)
    given = e.filter("line_no % 9 = 4").select("id").unionByName(e.filter("line_no % 9 = 5").select(F.concat(F.lit("u"), "line_no").alias("id")))
    known, unknown = planner.id_sets(e, given)
    return known.withColumn("kind", F.lit("known")).unionByName(unknown.withColumn("kind", F.lit("unknown")))


_LABEL_CASE = "CASE " + " ".join(f"WHEN status = '{k}' THEN '{v}'" for k, v in report.schemas.STATUS_LABEL.items()) + " WHEN status LIKE 'error_meta%' THEN 'Gagal baca metadata: ' || substr(status, length('error_meta:fatal:') + 1, 80) ELSE status END"


@query("WITH " + X.verify_sql(False) + f" SELECT false AS sort_text, grp::BIGINT AS sort_number, grp AS sort_grp, status <> 'ready' AS sort_skip, k AS sort_line, CASE WHEN status = 'ready' THEN '○' WHEN status IN ('skip_asli', 'skip_group_survivor', 'skip_user_keep') THEN '●' ELSE '·' END AS mark, name AS shown, CASE WHEN status = 'ready' THEN '→ dikeluarkan (' || CASE WHEN k % 2 = 0 THEN 'milik Anda' ELSE 'milik orang lain' END || ')' ELSE {_LABEL_CASE} END AS note FROM p")
def plan_table(spark, d):
    return planner.plan_table(_plan(spark, d))


@query("WITH " + X.verify_sql(False) + f" SELECT DISTINCT status, {_LABEL_CASE} AS label FROM p")
def status_labels(spark, d):
    return planner.status_histogram(_plan(spark, d)).select("status", "label")


@query(values([("0", "—"), (None, "—"), ("512", "512.00 B"), ("1536", "1.50 KB"), ("1125899906842624", "1024.00 TB"), (" 5 ", "5.00 B"), ("1_000", "1000.00 B"), ("5.0", "—"), ("abc", "—")], "n, said", ["VARCHAR", "VARCHAR"]))
def human_bytes(spark, d):
    rows = spark.createDataFrame([(x,) for x in ("0", None, "512", "1536", str(1 << 50), " 5 ", "1_000", "5.0", "abc")], "n string")
    return rows.select("n", render.human_bytes(to_int(F.col("n"))).alias("said"))


@query(values([("4", "3", "4 x 3 px"), ("0", "3", "—"), (None, "3", "—"), ("x", "3", "—")], "w, h, said", ["VARCHAR"] * 3))
def resolution_text(spark, d):
    return spark.createDataFrame([("4", "3"), ("0", "3"), (None, "3"), ("x", "3")], "w string, h string").select("w", "h", render.resolution(F.col("w"), F.col("h")).alias("said"))


@query("SELECT 'f' || o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'own' ELSE 'https://drive.google.com/file/d/f' || o_orderkey || '/view' END AS link FROM orders")
def view_links(spark, d):
    return X.entries(spark, d).select("id", render.view_link(F.col("id"), F.when(F.col("line_no") % 2 == 0, "own").when(F.col("line_no") % 3 == 0, "")).alias("link"))


@query("WITH " + X.verify_sql(False) + " SELECT k AS line_no, id, parent, name, grp, k % 2 = 0 AS owned_by_me, NULL::VARCHAR AS view_link, created AS created_time FROM p WHERE status = 'ready'")
def queue_json_roundtrip(spark, d):
    j = report.queue_json(planner.select_all(_plan(spark, d)))
    return j.select(F.from_json("value", report.schemas.QUEUE).alias("j")).select("j.*")


@query("SELECT 'f' || o_orderkey AS id FROM orders WHERE o_custkey = 7 AND o_orderkey % 3 <> 0")
def find_reports(spark, d):
    catalog = X.orders(spark, d).select(F.concat(F.lit("f"), "o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("name"), (F.col("o_orderkey") % 3 == 0).alias("trashed"), F.lit("text/plain").alias("mime_type"))
    return report.find_reports(catalog, "7").select("id")


_GROUPS = "g AS (SELECT md5(text) AS grp, count(*)::BIGINT AS n, min(doc_id) AS first_key FROM documents GROUP BY 1 HAVING count(*) > 1)"


@query(f"WITH {_GROUPS} SELECT grp, CASE WHEN doc_id = first_key THEN 'ASLI' ELSE 'DUP' END AS role, doc_id, n FROM documents JOIN g ON md5(text) = grp")
def exact_duplicates(spark, d):
    return detect.exact_groups(spark.read.parquet(f"{d}/documents.parquet"))


@query(f"WITH {_GROUPS} SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT grp FROM g)")
def not_exact(spark, d):
    return detect.not_exact(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id")


def _sign_sql(bits: int, step: int) -> str:
    return f"list_sum([CASE WHEN v[i + {step}] > v[i] THEN (1::BIGINT << ({bits} - i)::INTEGER) ELSE 0 END for i in range(1, {bits + 1})])::BIGINT"


_HASH = f"{X.VECTORS}, h AS (SELECT vec_id AS k, v, {_sign_sql(63, 1)} AS h FROM e)"
_PAIRS = f"{_HASH}, q AS (SELECT a.k AS a, b.k AS b, a.v AS u, b.v AS v, bit_count(xor(a.h, b.h))::BIGINT AS distance FROM h a JOIN h b ON a.k < b.k WHERE bit_count(xor(a.h, b.h)) <= 5)"


@query(f"WITH {_PAIRS} SELECT a, b, distance FROM q")
def hash_hamming_pairs(spark, d):
    return detect.hash_pairs(X.vectors(spark, d), most=5)


@query("WITH " + X.VECTORS + f" SELECT vec_id, {_sign_sql(63, 1)} AS along, {_sign_sql(56, 8)} AS down, list_sum([CASE WHEN list_sum([v[i] * round(cos(pi() * k * (2 * i - 1) / 128), 12) for i in range(1, 65)]) > 0 THEN (1::BIGINT << (32 - k)::INTEGER) ELSE 0 END for k in range(1, 33)])::BIGINT AS waves FROM e")
def vector_hashes(spark, d):
    v = F.col("embedding")
    return X.vectors(spark, d).select("vec_id", detect.gradient_hash(v).alias("along"), detect.gradient_hash(v, 56, 8).alias("down"), detect.frequency_hash(v).alias("waves"))


def _vector_pairs(spark, d):
    e = X.vectors(spark, d)
    p = detect.hash_pairs(e, most=5)
    return p.join(e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("u")), "a").join(e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("v")), "b")


@query(f"WITH {_PAIRS} SELECT a, b, floor(1000 * list_cosine_similarity(u, v) + 0.5)::BIGINT AS cosine, floor(1000 * list_sum([least(abs(u[i]), abs(v[i])) for i in range(1, len(u) + 1)]) / greatest(list_sum([abs(x) for x in u]), list_sum([abs(x) for x in v])) + 0.5)::BIGINT AS overlap, floor(1000 * list_sum([abs(u[i] - v[i]) for i in range(1, len(u) + 1)]) / len(u) + 0.5)::BIGINT AS grid FROM q")
def vector_similarity_pairs(spark, d):
    u, v = F.col("u"), F.col("v")
    r = lambda c: F.floor(c * 1000 + 0.5).cast("bigint")
    return _vector_pairs(spark, d).select("a", "b", r(detect.cosine(u, v)).alias("cosine"), r(detect.histogram_overlap(u, v)).alias("overlap"), r(detect.grid_distance(u, v)).alias("grid"))


def _blur_sql(v: str) -> str:
    second = f"[{v}[i - 1] - 2 * {v}[i] + {v}[i + 1] for i in range(2, 64)]"
    return f"(list_sum([x * x for x in {second}]) / 62 - (list_sum({second}) / 62) ** 2)"


def _block_sql(v: str) -> str:
    part = lambda test: f"list_avg([abs({v}[i + 1] - {v}[i]) for i in range(1, 64) if {test}])"
    return f"({part('i % 8 = 0')} / {part('i % 8 <> 0')})"


def _edge_sql(v: str) -> str:
    return f"[abs({v}[i + 1] - {v}[i]) * 63 > list_sum([abs({v}[j + 1] - {v}[j]) for j in range(1, 64)]) for i in range(1, 64)]"


_MEASURES = f"""{_PAIRS}, m AS (SELECT *, list_sum(u) / 64 AS mu, list_sum(v) / 64 AS mv, list_sum([x * x for x in u]) / 64 AS uu, list_sum([x * x for x in v]) / 64 AS vv, list_sum([u[i] * v[i] for i in range(1, 65)]) / 64 AS uv,
  list_cosine_similarity(u, v) AS cosine, list_sum([least(abs(u[i]), abs(v[i])) for i in range(1, 65)]) / greatest(list_sum([abs(x) for x in u]), list_sum([abs(x) for x in v])) AS overlap,
  {_blur_sql("u")} AS blur_a, {_blur_sql("v")} AS blur_b, {_block_sql("u")} AS block_a, {_block_sql("v")} AS block_b, {_edge_sql("u")} AS eu, {_edge_sql("v")} AS ev FROM q),
z AS (SELECT *, (2 * mu * mv + 1e-4) * (2 * (uv - mu * mv) + 9e-4) / ((mu * mu + mv * mv + 1e-4) * (uu - mu * mu + vv - mv * mv + 9e-4)) AS ssim, len([i for i in range(1, 64) if eu[i] AND ev[i]]) / greatest(len([i for i in range(1, 64) if eu[i] OR ev[i]]), 1) AS edges FROM m),
verdicts AS (SELECT *, ssim >= 0.9 AND overlap >= 0.8 AND edges >= 0.6 AND (blur_a >= 0.01 AND blur_b >= 0.01 OR cosine >= 0.98 AND abs(block_a - block_b) <= 0.2) AS same FROM z)"""


@query(f"WITH {_MEASURES} SELECT a, b, {', '.join(f'floor(1000 * {k} + 0.5)::BIGINT AS {k}' for k in ('ssim', 'blur_a', 'blur_b', 'block_a', 'block_b', 'edges'))}, same FROM verdicts")
def vector_verdicts(spark, d):
    u, v = F.col("u"), F.col("v")
    r = lambda c, k: F.floor(c * 1000 + 0.5).cast("bigint").alias(k)
    return _vector_pairs(spark, d).select("a", "b", r(detect.structural_similarity(u, v), "ssim"), r(detect.blur(u), "blur_a"), r(detect.blur(v), "blur_b"), r(detect.blockiness(u), "block_a"), r(detect.blockiness(v), "block_b"), r(detect.edge_overlap(u, v), "edges"), detect.vector_verdict(u, v).alias("same"))


@query(values([(1, True), (2, True), (3, False)], "id, near", ["BIGINT", "BOOLEAN"]))
def aspect_ratio_gate(spark, d):
    rows = spark.createDataFrame([(1, 4.0, 3.0, 8.0, 6.0), (2, 100.0, 75.0, 101.0, 75.0), (3, 4.0, 3.0, 3.0, 4.0)], "id bigint, w1 double, h1 double, w2 double, h2 double")
    return rows.select("id", detect.ratio_gate(F.col("w1"), F.col("h1"), F.col("w2"), F.col("h2")).alias("near"))


_CLIPS = f"{X.CLIPS}, c AS (SELECT conv_id, count(*)::BIGINT AS n, md5(min(text) FILTER (WHERE turn = 0)) AS head FROM t GROUP BY conv_id)"
_GATE = f"{_CLIPS}, g AS (SELECT x.conv_id AS a, y.conv_id AS b, abs(x.n - y.n)::BIGINT AS apart FROM c x JOIN c y ON x.head = y.head AND x.conv_id < y.conv_id AND abs(x.n - y.n) <= 2)"
_MATCH = f"{_GATE}, f AS (SELECT * FROM t WHERE turn % 2 = 0), l AS (SELECT conv_id, count(*)::BIGINT AS n FROM f GROUP BY conv_id), s AS (SELECT a, b, count(*) AS m FROM g JOIN f x ON x.conv_id = a JOIN f y ON y.conv_id = b AND y.turn = x.turn AND md5(y.text) = md5(x.text) GROUP BY a, b), r AS (SELECT g.a, g.b, coalesce(m, 0)::BIGINT AS matched, greatest(x.n, y.n) AS total, coalesce(m, 0) >= 0.75 * greatest(x.n, y.n) AS matches FROM g JOIN l x ON x.conv_id = g.a JOIN l y ON y.conv_id = g.b LEFT JOIN s ON s.a = g.a AND s.b = g.b)"


def _gate(spark, d):
    c = X.clips(spark, d)
    heads = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.md5(F.min(F.when(F.col("turn") == 0, F.col("text")))).alias("head"))
    return c, detect.duration_gate(heads, 2, "conv_id", "n", ["head"])


@query(f"WITH {_GATE} SELECT a, b, apart FROM g")
def duration_gate(spark, d):
    return _gate(spark, d)[1]


@query(f"WITH {_MATCH} SELECT * FROM r")
def frame_match_ratio(spark, d):
    c, pairs = _gate(spark, d)
    return detect.frame_match(detect.sample_frames(c, "turn", 2), pairs, "conv_id", "turn", "text", 0.75)


@query(f"WITH RECURSIVE {_MEASURES}, {_MATCH.replace(' q AS', ' q2 AS')}, k AS (SELECT 'v' || a AS a, 'v' || b AS b FROM verdicts WHERE same UNION ALL SELECT 'c' || a, 'c' || b FROM r WHERE matches), uu AS (SELECT a, b FROM k UNION SELECT b, a FROM k), walk(n, x) AS (SELECT a, a FROM uu UNION SELECT uu.b, walk.x FROM walk JOIN uu ON uu.a = walk.n) SELECT n AS node, min(x) AS component FROM walk GROUP BY n")
def verdict_groups(spark, d):
    """Pictures and clips that are alike, in groups."""
    u, v = F.col("u"), F.col("v")
    pictures = _vector_pairs(spark, d).filter(detect.vector_verdict(u, v)).select(F.concat(F.lit("v"), "a").alias("a"), F.concat(F.lit("v"), "b").alias("b"))
    films = frame_match_ratio(spark, d).filter("matches").select(F.concat(F.lit("c"), "a").alias("a"), F.concat(F.lit("c"), "b").alias("b"))
    return detect.verdict_groups(pictures, films)


@query()
def duplicate_components(spark, d):
    """Groups over the links of all orders: long chains. Recursive SQL would take too long, so tests compare with brute force."""
    return detect.duplicate_components(X.orders(spark, d).select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1 + F.col("o_custkey") % 3).alias("b")))


@query(f"WITH {_GROUPS}, m AS (SELECT doc_id, grp, CASE WHEN doc_id = first_key THEN 'ASLI' ELSE 'DUP' END AS role, source, n_chars FROM documents JOIN g ON md5(text) = grp) SELECT doc_id AS line_no, role, grp, 'd' || doc_id AS id, source AS parent, 'exact' AS match, grp AS b3, n_chars::VARCHAR AS size, NULL::VARCHAR AS w, NULL::VARCHAR AS h, 'doc ' || doc_id AS name FROM m")
def detected_report(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return report.parse_entries(report.render_lines(detect.report_entries(detect.exact_groups(docs), docs)))


@query("WITH r AS (SELECT user_id, epoch_us(ts) * 9 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events), w AS (SELECT user_id, greatest(t, max(t - i * 1000000) OVER (PARTITION BY user_id ORDER BY i) + (i - 17) * 1000000) - t AS wait FROM r) SELECT user_id, count(*)::BIGINT AS requests, sum(wait)::BIGINT AS waited FROM w GROUP BY user_id")
def token_bucket_replay(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return detect.token_bucket(e, 9, 18, "user_id", "us")


@query("WITH r AS (SELECT user_id % 7 AS lane, epoch_us(ts) * 9 // 3000 AS t, row_number() OVER (PARTITION BY user_id % 7 ORDER BY epoch_us(ts) // 3000) AS i FROM events), w AS (SELECT lane, greatest(t9, max(t9 - i * 1000000) OVER (PARTITION BY lane ORDER BY i) + (i - 17) * 1000000) - t9 AS wait FROM (SELECT lane, i, (SELECT 0) + t AS t0, t AS t9 FROM r)) SELECT lane, count(*)::BIGINT AS requests, sum(wait)::BIGINT AS waited FROM w GROUP BY lane")
def token_bucket_of_lanes(spark, d):
    """The same where seven lanes share all events and time runs 3,000 times as fast, so most requests wait."""
    e = spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 7).alias("lane"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return detect.token_bucket(e, 9, 18, "lane", "us", 3000)


@query("SELECT k, CASE WHEN k % 7 >= 5 THEN 5 ELSE k % 7 + 1 END::INTEGER AS tries, CASE WHEN k % 7 >= 5 THEN CASE WHEN k % 3 = 0 THEN 'fatal:exc:timeout' ELSE 'recoverable:http_503:busy' END WHEN k % 5 >= 3 THEN 'fatal:http_404:gone' END AS err FROM (SELECT o_orderkey AS k FROM orders)")
def retry_results(spark, d):
    return X.attempts(spark, d).select("k", errors.call_result(F.col("attempts")).alias("r")).select("k", "r.*")


def _refused(spark, d, fatal_at=None):
    return planner.execute(planner.select_all(_plan(spark, d)), X.state(spark, d, later=True), X.ledger(spark, d), X.updates(spark, d, fatal_at))


_REFUSED = "WITH " + X.execute_sql() + ", y AS (SELECT *, CASE WHEN result = 'removed' AND k % 83 = 0 THEN 'error_remove:recoverable:http_503:busy' ELSE result END AS said FROM x)"


@query(_REFUSED + " SELECT k AS line_no, said AS status FROM y")
def execute_refused(spark, d):
    """Removals that the store refuses for a while."""
    return _refused(spark, d).select("line_no", "status")


@query(_REFUSED + ", cut AS (SELECT min(k) AS stop_at FROM y WHERE result = 'removed' AND k > 900) SELECT k AS line_no, CASE WHEN k = stop_at THEN 'error_remove:fatal_global:http_403:quotaExceeded' ELSE said END AS status FROM y, cut WHERE k <= stop_at")
def execute_refused_for_all(spark, d):
    """The first removal behind line 900 that could be made is refused for all; nothing further is tried."""
    at = _results(spark, d).filter("status = 'removed' AND line_no > 900").agg(F.min("line_no").alias("k")).first()["k"]
    return _refused(spark, d, at).select("line_no", "status")


@query("WITH " + X.verify_sql(False) + " SELECT grp, count(*)::BIGINT AS n, count(*) FILTER (WHERE status = 'ready')::BIGINT AS n_remove, count(*) FILTER (WHERE status <> 'ready')::BIGINT AS n_skip, min(k) AS first_line FROM p GROUP BY grp")
def group_summary(spark, d):
    return planner.group_summary(_plan(spark, d))


def _named(spark, d):
    e = X.entries(spark, d)
    return e, e.filter("line_no % 9 = 4").select("id").unionByName(e.filter("line_no % 9 = 5").select(F.concat(F.lit("u"), "line_no").alias("id")))


@query("WITH " + X.sql() + " SELECT count(*) FILTER (WHERE k % 9 = 4 AND parent IS NOT NULL)::BIGINT AS n, count(*) FILTER (WHERE k % 9 = 4 AND parent IS NOT NULL AND role = 'ASLI')::BIGINT AS asli, count(*) FILTER (WHERE k % 9 = 4 AND parent IS NULL)::BIGINT AS no_parent, count(*) FILTER (WHERE k % 9 = 5)::BIGINT AS unknown FROM e")
def manual_summary(spark, d):
    return planner.manual_summary(*_named(spark, d))


@query("SELECT string_agg('u' || o_orderkey, ', ' ORDER BY 'u' || o_orderkey) AS ids FROM orders WHERE o_orderkey % 9 = 5")
def unknown_ids(spark, d):
    return planner.sorted_ids(planner.id_sets(*_named(spark, d))[1])


@query("SELECT o_orderkey AS k, array_to_string(list_distinct_in_order, ',') AS ids FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN ['f' || o_orderkey, 'f7'] ELSE ['f' || o_orderkey] END AS list_distinct_in_order FROM orders WHERE o_orderkey <> 7)")
def id_tokens(spark, d):
    text = F.concat(F.lit(" \u3000f"), "o_orderkey", F.lit("\t\n"), F.when(F.col("o_orderkey") % 2 == 0, "f7\xa0 f").otherwise(" f"), "o_orderkey", F.lit("\r"))
    return X.orders(spark, d).filter("o_orderkey <> 7").select(F.col("o_orderkey").alias("k"), F.array_join(id_tokens_of(text), ",").alias("ids"))


@query("WITH " + X.verify_sql(False) + ", t AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'g' || grp ELSE grp END AS g2 FROM p) SELECT k % 3 = 0 AS sort_text, CASE WHEN k % 3 <> 0 THEN grp::BIGINT ELSE -1 END AS sort_number, g2 AS sort_grp, status <> 'ready' AS sort_skip, k AS sort_line, left(name, 40) AS short FROM t")
def plan_table_of_named_groups(spark, d):
    p = _plan(spark, d).withColumn("grp", F.when(F.col("line_no") % 3 == 0, F.concat(F.lit("g"), "grp")).otherwise(F.col("grp")))
    short = p.select(F.col("line_no").alias("sort_line"), render.short_name(F.col("name"), F.col("id")).alias("short"))
    return planner.plan_table(p).drop("mark", "shown", "note").withColumn("sort_number", F.coalesce("sort_number", F.lit(-1))).join(short, "sort_line")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def text_hashes(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("sha256"))


def _report_files(spark, d, files, md5=False):
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    report.write_report(X.entries(spark, d), path, "Photos", "f1", files)
    return report.read_lines(spark, path, md5)


@query("WITH " + X.sql() + " SELECT role, grp, id, parent, b3, size::VARCHAR AS size, name FROM e")
def report_file_entries(spark, d):
    """Entries of a report of four files, written and read back."""
    return report.require_entries(report.parse_entries(_report_files(spark, d, 4))).select("role", "grp", "id", "parent", "b3", "size", "name")


@query("SELECT 'Photos' AS folder, 'f1' AS folder_id, 'v2' AS format FROM range(4)")
def report_file_headers(spark, d):
    return report.parse_header(_report_files(spark, d, 4), ("path",)).drop("path")


@query("WITH " + X.sql() + " SELECT md5('Folder: Photos' || chr(10) || 'Folder ID: f1' || chr(10) || 'FORMAT: v2' || chr(10) || string_agg('[' || role || '] group=' || grp || ' | id=' || id || ' | parent=' || coalesce(parent, '') || ' | match=exact | b3=' || coalesce(b3, '') || ' | size=' || coalesce(size::VARCHAR, '') || ' | w= | h= | name=' || name || chr(10), '' ORDER BY k)) AS report_md5, count(*)::BIGINT + 4 AS lines FROM e")
def report_md5(spark, d):
    return _report_files(spark, d, 1, md5=True).groupBy("report_md5").agg(F.count(F.lit(1)).alias("lines"))


@query("WITH " + X.execute_sql() + " SELECT count(*) FILTER (WHERE result = 'removed')::BIGINT AS ok, count(*) FILTER (WHERE result LIKE 'error%')::BIGINT + 2 AS failed, count(*) FILTER (WHERE result LIKE 'skip%' OR result = 'resumed')::BIGINT AS skipped, count(*) FILTER (WHERE result = 'removed')::BIGINT AS orphaned FROM x")
def resumed_run(spark, d):
    """A queue in files, two of its lines broken, run as a stream with a ledger; what it counts."""
    top = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    lines = report.queue_json(planner.select_all(_plan(spark, d)))
    lines.unionByName(spark.createDataFrame([("{broken",), ('{"id": "x"}',), ("  ",)], "value string")).write.text(f"{top}/queue")
    X.ledger(spark, d).select(F.lit("k").alias("key"), "id", F.lit("removed").alias("status")).write.json(f"{top}/ledger")
    for _ in range(2):
        resume.run_queue(spark, f"{top}/queue", X.state(spark, d, later=True), f"{top}/ledger", f"{top}/progress", "k", f"{top}/audit", f"{top}/totals")
    return resume.run_totals(spark, f"{top}/totals")


@query("WITH " + X.verify_sql(False) + " SELECT count(*)::BIGINT AS lines, 0::BIGINT AS bad, count(*) FILTER (WHERE k % 71 = 0)::BIGINT AS done FROM p WHERE status = 'ready'")
def queue_counts(spark, d):
    queue = report.parse_queue(report.queue_json(planner.select_all(_plan(spark, d))))
    return report.queue_counts(queue, X.ledger(spark, d))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected exact copies of documents, planned against a state derived from the same table: a histogram of statuses."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    e = detect.report_entries(detect.exact_groups(docs), docs)
    s = docs.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.lit(None).cast("string").alias("err"), F.concat(F.lit("doc "), "doc_id").alias("name"), F.array("source").alias("parents"), F.lit(True).alias("owned_by_me"), F.lit(None).cast("struct<can_remove_children: boolean, can_edit: boolean>").alias("capabilities"), F.md5("text").alias("md5"), F.col("n_chars").cast("string").alias("size"), (F.col("doc_id") % 23 == 0).alias("trashed"), F.lit("text/plain").alias("mime_type"), F.lit(None).cast("string").alias("view_link"), F.lit(None).cast("string").alias("created_time"), F.md5("text").alias("cur_b3"))
    return planner.status_histogram(planner.plan(e, s))


@query("WITH g AS (SELECT md5(text) AS grp, min(doc_id) AS f FROM documents GROUP BY 1 HAVING count(*) > 1), m AS (SELECT doc_id, grp, doc_id = f AS asli, doc_id % 23 = 0 AS trashed FROM documents JOIN g ON md5(text) = grp), a AS (SELECT DISTINCT grp FROM m WHERE asli AND NOT trashed), r AS (SELECT doc_id, row_number() OVER (PARTITION BY grp ORDER BY 'd' || doc_id) AS rn FROM m WHERE NOT asli AND NOT trashed AND grp NOT IN (SELECT grp FROM a)), s AS (SELECT CASE WHEN asli THEN 'skip_asli' WHEN trashed THEN 'skip_trashed' WHEN rn = 1 THEN 'skip_group_survivor' ELSE 'ready' END AS status FROM m LEFT JOIN r USING (doc_id)) SELECT status, count(*)::BIGINT AS n, " + _LABEL_CASE + " AS label FROM s GROUP BY status")
def plan_of_documents(spark, d):
    return flagship(spark, d)
