import random

import pytest
from oracle import SF, same
from pyspark.sql import functions as F

from culler import schemas
from culler.operators import planner
from culler.plans import catalogue
from culler.plans import fixture as X


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, name):
    same(catalogue.QUERIES[name](spark, SF), catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_components_of_all_orders_by_brute_force(spark):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    orders = X.orders(spark, SF).select("o_orderkey", "o_custkey").collect()
    for k, c in orders:
        a, b = root(k), root(k + 1 + c % 3)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in catalogue.QUERIES["duplicate_components"](spark, SF).collect()}
    assert got == {x: root(x) for x in list(up)} and {k for k, _ in orders} <= set(got)


def test_golden_counts(spark):
    got = {r["status"].split(":")[0]: 0 for r in planner.status_histogram(catalogue._plan(spark, SF)).collect()}
    for r in planner.status_histogram(catalogue._plan(spark, SF)).collect():
        got[r["status"].split(":")[0]] += r["n"]
    assert got == {"skip_asli": 150, "skip_no_parent_in_report": 26, "skip_not_found": 69, "error_meta": 14, "skip_trashed": 56, "skip_already_out": 42, "skip_changed_size": 64, "skip_unverifiable_need_strict": 58, "skip_no_permission": 91, "skip_group_survivor": 31, "ready": 899}


def test_keep_list_with_original_is_refused(spark):
    p = catalogue._plan(spark, SF)
    with pytest.raises(ValueError):
        planner.select_except(p, p.filter("role = 'ASLI'").select("id"))


def test_aborted_plan_executes_nothing(spark):
    p = planner.plan(X.entries(spark, SF), X.state(spark, SF, fatal_at=701))
    assert planner.select_all(p).count() == 0 and p.count() == 702


def test_membership_is_split_and_second_run_changes_nothing(spark):
    before = X.membership(spark, SF)
    results = catalogue._results(spark, SF, batch=False)
    after = planner.membership_after(before, results)
    assert before.count() == after.count() + results.filter("status = 'removed'").count()
    assert planner.membership_after(after, results).count() == after.count()


def test_every_group_keeps_a_file(spark):
    rnd = random.Random(5)
    n = 400
    e = spark.createDataFrame([(i, rnd.choice(["ASLI", "DUP", "DUP"]), f"g{rnd.randrange(60)}", f"i{i}", rnd.choice([None, "p", "p", "p"]), "", None, rnd.choice([None, "1", "1", "2"]), None, None, "n") for i in range(n)], schemas.ENTRY)
    s = spark.createDataFrame([(f"i{i}", rnd.choice([None, None, None, "fatal:http_404:"]), "n", rnd.choice([[], ["p"], ["p"], ["p", "q"]]), True, None, None, "1", rnd.random() < 0.1, "", None, rnd.choice([None, "2020", "2021"]), None) for i in range(n)], schemas.FILE_STATE)
    p = planner.plan(e, s).toPandas()
    anchors = {r["grp"] for r in planner.live_anchors(planner.with_state(e, s)).collect()}
    for grp, rows in p.groupby("grp"):
        assert grp in anchors or "ready" not in set(rows.status) or "skip_group_survivor" in set(rows.status)
    assert set(p.line_no) == set(range(n)) and not ((p.role == "ASLI") & (p.status == "ready")).any()


def test_same_line_twice_is_deduplicated(spark):
    e = spark.createDataFrame([(i, "DUP", "g", "x", "p", "", None, "1", None, None, "n") for i in range(3)], schemas.ENTRY)
    assert [r["line_no"] for r in planner.dedup_entries(e).collect()] == [0]


def test_files_and_resume(spark, tmp_path):
    from culler.sources import report
    from culler.streaming.resume import run_queue

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.txt").write_bytes("﻿[DUP] group=1 | id=a | parent=p | name=x\r\n[DUP] id=b\n".encode())
    (tmp_path / "in" / "l.txt").write_bytes(b"[DUP] id=caf\xe9 | parent=p")
    got = {r["id"] for r in report.parse_entries(report.read_lines(spark, str(tmp_path / "in"))).collect()}
    assert got == {"a", "b", "café"}
    ready = planner.select_all(catalogue._plan(spark, SF))
    report.write_queue(ready, str(tmp_path / "queue"))
    assert report.read_queue(spark, str(tmp_path / "queue")).filter("NOT bad").count() == ready.count()
    state = X.state(spark, SF, later=True)
    for _ in range(2):
        (tmp_path / "ledger").mkdir(exist_ok=True)
        run_queue(spark, str(tmp_path / "queue"), state, str(tmp_path / "ledger"), str(tmp_path / "ck"), "k")
        assert report.read_ledger(spark, str(tmp_path / "ledger")).count() == 899 - 16


def test_report_without_entries_and_large_strict_runs_are_refused(spark):
    from culler.sources import report

    lines = spark.createDataFrame([(0, "Folder: x"), (1, "FORMAT: v9"), (2, "[DUP] group=1")], "line_no bigint, line string")
    with pytest.raises(ValueError):
        report.require_entries(report.parse_entries(lines))
    e = spark.createDataFrame([(i, "DUP", "g", f"i{i}", "p", "", None, "1", None, None, "n") for i in range(2001)], schemas.ENTRY)
    with pytest.raises(ValueError):
        planner.guard_strict(e, True)
    assert planner.guard_strict(e, True, True) is e and planner.guard_strict(e, False) is e and planner.guard_strict(e.limit(2000), True).count() == 2000


def test_the_report_refuses_to_guess(spark):
    from culler.sources import report

    c = spark.createDataFrame([("a", "r", False, "text/plain"), ("b", "r", True, "text/plain"), ("c", "r", None, "application/vnd.google-apps.folder"), ("d", "s", False, None), ("e", "s", False, None)], "id string, name string, trashed boolean, mime_type string")
    assert report.the_report(c, "r") == "a"
    for name in ("s", "t"):
        with pytest.raises(ValueError):
            report.the_report(c, name)


def test_audit_of_a_run_is_kept_and_a_second_run_adds_nothing(spark, tmp_path):
    from culler.sources import report
    from culler.streaming import resume

    p = lambda x: str(tmp_path / x)
    e = X.entries(spark, SF)
    report.write_queue(planner.select_all(catalogue._plan(spark, SF)), p("queue"))
    (tmp_path / "ledger").mkdir()
    for _ in range(2):
        resume.run_queue(spark, p("queue"), X.state(spark, SF, later=True), p("ledger"), p("progress"), "k", p("audit"), p("totals"))
    want = planner.audit_events(catalogue._results(spark, SF, batch=False))
    resume.keep_audit(spark, planner.audit_header(spark, e, "me", "r", "r1", "h", "f1", False), p("audit"), p("kept"))
    got = spark.read.parquet(p("kept/events"))
    assert got.count() == want.count() and got.select("file", "removed_parent").exceptAll(want.select("file", "removed_parent")).isEmpty()
    assert spark.read.parquet(p("kept/header")).count() == 1
    resume.keep_audit(spark, e, p("nothing"), p("kept2"))  # logged, not raised
    assert spark.read.parquet(p("ledger").replace("ledger", "audit")).filter("NOT orphan").count() == 0


def test_token_bucket_by_brute_force(spark):
    from culler.operators import detect

    rng = random.Random(3)
    times = {k: sorted(rng.randrange(1_000_000) for _ in range(60)) for k in range(4)}
    rows = spark.createDataFrame([(k, t) for k, ts in times.items() for t in ts], "k bigint, us bigint")
    got = {r["k"]: (r["requests"], r["waited"]) for r in detect.token_bucket(rows, 9, 18, "k", "us").collect()}
    for k, ts in times.items():
        tokens, last, waited = 18 * 1_000_000, ts[0] * 9, 0
        for t in ts:
            start = max(t * 9, last)
            tokens = min(18 * 1_000_000, tokens + start - last)
            wait = max(0, 1_000_000 - tokens)
            tokens, last, waited = tokens + wait - 1_000_000, start + wait, waited + start + wait - t * 9
        assert got[k] == (60, waited) and waited > 0


def test_plans_read_their_inputs_once(spark):
    for name, most in (("plan_full", 4), ("execute_results", 4)):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") <= most, name


def test_queries_give_rows(spark):
    for name in ("duration_gate", "frame_match_ratio", "verdict_groups", "hash_hamming_pairs", "vector_verdicts"):
        assert not catalogue.QUERIES[name](spark, SF).isEmpty()
    same_ = {r["same"] for r in catalogue.vector_verdicts(spark, SF).select("same").collect()}
    matches = {r["matches"] for r in catalogue.frame_match_ratio(spark, SF).select("matches").collect()}
    assert same_ == matches == {True, False}


def test_reports_of_any_line_ends_are_read_in_blocks(spark, tmp_path):
    import hashlib
    import re

    from culler.sources import report

    rnd = random.Random(1)
    line = lambda: "".join(rnd.choice("ab é|=[]") for _ in range(rnd.randrange(30)))
    texts = [end.join(line() for _ in range(60)) + last for end in ("\n", "\r\n", "\r", "\n\r") for last in ("", "\n", "\r", "\r\n")]
    texts += ["".join(line() + rnd.choice(["\n", "\r", "\r\n", "\r\r\n", "\n\n"]) for _ in range(90)), "", "\n", "\r", "x", "x\r\r"]
    contents = [m + t.encode(enc) for t in texts for enc in ("utf-8", "latin-1") for m in (b"", b"\xef\xbb\xbf") if m + t.encode(enc)]
    (tmp_path / "in").mkdir()
    for i, c in enumerate(contents):
        (tmp_path / "in" / f"r {i}.txt").write_bytes(c)
    want = {}
    for i, c in enumerate(contents):
        try:
            t = c.decode("utf-8").removeprefix("﻿")
        except UnicodeDecodeError:
            t = c.decode("latin-1")
        want |= {(f"r {i}.txt", hashlib.md5(c).hexdigest(), k): x for k, x in enumerate(re.split("\r\n|\r|\n", t))}
    confs = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.sources.binaryFile.maxLength": "100"}  # no content longer than that may be held as one value
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        rows = report.read_lines(spark, str(tmp_path / "in")).collect()
    finally:
        for k in confs:
            spark.conf.unset(k)
    assert len(rows) == len(want) and {(r["path"].rsplit("/", 1)[1], r["report_md5"], r["line_no"]): r["line"] for r in rows} == want


def test_md5_of_a_report_is_taken_over_its_blocks(spark):
    confs = {"spark.sql.files.maxPartitionBytes": "9k", "spark.sql.sources.binaryFile.maxLength": "100"}  # about twenty blocks, none of them as one value
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        same(catalogue.QUERIES["report_md5"](spark, SF), catalogue.SQL["report_md5"])
    finally:
        for k in confs:
            spark.conf.unset(k)


def test_reports_are_put_in_order_outside_memory(spark, tmp_path):
    import hashlib

    from culler.sources import report

    sc, n = spark._jsc.sc(), 12_000
    store, doubles = sc.statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = store.stageList(None, False, False, doubles, None)
        return {(found.apply(i).stageId(), found.apply(i).attemptId()) for i in range(found.size())}

    before = stages()
    name = F.concat_ws("", *[F.sha2(F.concat("id", F.lit(f" {k}")), 256) for k in range(200)])  # 150 MB in all
    rows = spark.range(n).select(F.col("id").alias("line_no"), F.lit("DUP").alias("role"), F.lit("g").alias("grp"), F.col("id").cast("string").alias("id"), *[F.lit("").alias(k) for k in ("parent", "match", "b3", "size", "w", "h")], name.alias("name"))
    confs = {"spark.sql.files.maxPartitionBytes": "8m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m"}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        report.write_report(rows.repartition(5), str(tmp_path / "r"), "Photos", "f1")
        (file,) = (tmp_path / "r").glob("part-*")
        ((path, md5, lines),) = report.read_lines(spark, str(tmp_path / "r")).groupBy("path", "report_md5").agg(F.count(F.lit(1))).collect()
    finally:
        for k in confs:
            spark.conf.unset(k)
    want = hashlib.md5(b"Folder: Photos\nFolder ID: f1\nFORMAT: v2\n")
    for i in range(n):
        want.update(f"[DUP] group=g | id={i} | parent= | match= | b3= | size= | w= | h= | name=".encode() + b"".join(hashlib.sha256(f"{i} {k}".encode()).hexdigest().encode() for k in range(200)) + b"\n")
    assert (path.rsplit("/", 1)[1], md5, lines) == (file.name, want.hexdigest(), n + 4)
    tasks = [store.taskList(*x, 1000) for x in stages() - before]
    peaks = [t.apply(i).taskMetrics().get().peakExecutionMemory() for t in tasks for i in range(t.size())]
    assert 0 < max(peaks) < 100 << 20  # a task that sorts the file holds all of it


def test_components_of_chains_loops_and_texts(spark):
    from culler.operators import detect

    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(3000)] + [(5000, 5000), (5001, 5001), (5001, 5002)] + [(6000, 6001 + i) for i in range(200)] + [(rnd.randrange(7000, 7400), rnd.randrange(7000, 7400)) for _ in range(150)]
    rnd.shuffle(edges)
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in sorted((min(e), max(e)) for e in edges):
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    found = detect.duplicate_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert sorted(map(tuple, found.collect())) == [(x, root(x)) for x in sorted(up)]
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 1000  # not the product of all that was joined in all rounds
    texts = detect.duplicate_components(spark.createDataFrame([(f"v{a:05}", f"v{b:05}") for a, b in edges], "a string, b string"))
    assert sorted(map(tuple, texts.collect())) == [(f"v{x:05}", f"v{root(x):05}") for x in sorted(up)]
    assert detect.duplicate_components(found.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)).count() == 0


def test_lanes_that_wait_equal_their_sql(spark, tmp_path):
    import os

    import duckdb
    from oracle import TABLES

    for t in TABLES:
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    os.unlink(tmp_path / "events.parquet")
    # further apart than the 3,000 microseconds within which the SQL leaves the order open
    duckdb.sql(f"COPY (SELECT i AS user_id, make_timestamp(1704067200000000 + i * 7001003 + i * i % 997) AS ts FROM range(3000) t(i)) TO '{tmp_path}/events.parquet'")
    found = catalogue.QUERIES["token_bucket_of_lanes"](spark, str(tmp_path))
    assert found.filter("waited > 0").count() == 7
    same(found, catalogue.SQL["token_bucket_of_lanes"], str(tmp_path))
