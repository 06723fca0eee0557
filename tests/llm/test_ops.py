import re

import numpy as np
import pytest
from oracle import SF, same
from pyspark.sql import functions as F

from culler.llm import chat, classifier, components, decontam, jaccard, line_dedup, packing, quality_rules, registry, secrets, sharding, substring
from culler.llm import text as T

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(registry.queries()[name](spark, SF), registry.oracle_sql()[name])


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None) for i, t in zip(ids, texts, strict=True)], SCHEMA)


LONG = " ".join(f"w{i}" for i in range(3000))
ODD = [None, "", " \t\n", "one", "a b c d e", "é ü 漢字 \U0001f600 " * 20, LONG, LONG, LONG.replace("w7 ", "x ") + "\n\n", "line one here\nline two here\nline three here\nend", "line one here\nline two here\nline three here\nother"]


@pytest.mark.parametrize("ids", [None, [None, 1, 1, 2, None, 5, 6, 6, 8, 9, 10]])
def test_odd_rows_and_clashing_columns(spark, ids):
    d = table(spark, ODD, ids).withColumn("n_lines", F.lit("x")).withColumn("n_hit", F.lit("y")).withColumn("rk", F.lit(1)).withColumn("chunk", F.lit(2))
    n = d.count()
    assert substring.remove_repeats(d).count() == n
    assert jaccard.similar_groups(d).count() == n
    assert line_dedup.deduplicate_lines(d).count() == n
    assert quality_rules.ledger(d).count() == n
    assert decontam.decontaminate(d, spark.createDataFrame([(1, LONG), (None, "one"), (3, None)], "item_id bigint, text string")).count() == n
    assert secrets.find_secrets(d).count() == n
    assert sharding.ring_shards(d).count() == n
    assert packing.pack(d).select("doc_id", "piece", "start", "length").count() >= n
    assert classifier.classify(d, spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int")).count() == n
    quality_rules.apply_rules(d).count(), jaccard.one_of_each(d).count()


def test_empty_tables(spark):
    d = table(spark, [])
    for out in (substring.remove_repeats(d), jaccard.similar_groups(d), line_dedup.deduplicate_lines(d), quality_rules.ledger(d), decontam.decontaminate(d, spark.createDataFrame([], "item_id bigint, text string")), secrets.find_secrets(d), sharding.ring_shards(d), packing.pack(d), classifier.classify(d, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")), jaccard.one_of_each(d)):
        assert out.count() == 0


def test_hot_anchors_give_the_same(spark):
    d = T.documents(spark, SF)
    few = substring.remove_repeats(d, hot=2, chunk=1 << 16, bucket=1 << 16, shard=1 << 16)
    same(few.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")), substring.SQL)


def test_wavelet_rank_counts():
    x = np.random.default_rng(1).integers(0, 37, 1000)
    w = substring.Wavelet(x, 37)
    for c in (0, 5, 36):
        i = np.arange(0, 1001, 17)
        got = w.rank(np.full(len(i), c), i) - w.rank(np.full(len(i), c), np.zeros(len(i), np.int64))
        assert got.tolist() == [int((x[:k] == c).sum()) for k in i]


def test_decontamination_by_brute_force(spark):
    words = lambda s: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]+", lambda m: m[0].lower(), s or ""))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    windows = {}
    for r in bench.collect():
        w = words(r["text"])
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(r["item_id"]))
    for block in (decontam.BLOCK, 500):
        for r in decontam.decontaminate(T.documents(spark, SF), bench, block=block).collect():
            w, hit, items = words(r["text"]), set(), set()
            for size in {len(x) for x in windows}:
                for k in range(len(w) - size + 1):
                    if tuple(w[k : k + size]) in windows:
                        hit |= set(range(k, k + size))
                        items |= windows[tuple(w[k : k + size])]
            assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(items))


def test_repeated_runs_of_few_lines_by_brute_force(spark):
    rng = np.random.default_rng(4)
    pool = [" ".join(f"p{i}x{k}" for k in range(n)) for i, n in enumerate([60, 30, 25, 20, 10, 3, 1, 50, 49])]
    texts = [pool[0], pool[0], pool[1] + "\n\n" + pool[2], "x\n" + pool[1] + "\n" + pool[2] + "\ny", pool[0] + "\n" + pool[4] + "\nz"]
    texts += ["\n".join(rng.choice(pool, rng.integers(1, 7))) for _ in range(150)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate_lines(table(spark, texts)).collect()}
    seen = set()
    for i, t in enumerate(texts):
        ls, gone = [x for x in t.split("\n") if x], set()
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                if b - a >= 3 or len(" ".join(ls[a:b]).split()) >= 50:
                    gone |= set(range(a, b)) if tuple(ls[a:b]) in seen else set()
                    seen.add(tuple(ls[a:b]))
        assert [x for x in got[i].split("\n") if x] == [x for k, x in enumerate(ls) if k not in gone], i


def test_pipeline_drops_copies_of_few_lines(spark):
    import corpus_pipeline as cp

    assert [r["doc_id"] for r in cp.lines(spark, table(spark, [LONG, LONG, "a b c", "a b c"]), SF).collect()] == [0, 2, 3]


def test_longest_match_by_brute_force(spark):
    rng = np.random.default_rng(6)
    item = [f"q{i}" for i in range(60)]
    bench = [item, item[:16] + [f"r{i}" for i in range(30)], list(rng.choice(list("abcd"), 90)), ["a"] * 20, []]
    texts = [["x", *item[5:25], "y"]] * 5 + [[*item[:16], "z"], [*item[:30], "z"], bench[1][:25], ["a"] * 25, ["no", "match"], [], [*item[:20], "x", *item[20:40]]]
    texts += [list(rng.choice(list("abcde"), rng.integers(1, 60))) for _ in range(40)] * 2
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(bench)], "item_id bigint, text string")

    def best(w):
        found = (0, -1)
        for p in range(len(w)):
            for t in bench:
                for q in range(len(t)):
                    k = 0
                    while p + k < len(w) and q + k < len(t) and w[p + k] == t[q + k]:
                        k += 1
                    found = (k, p) if k > found[0] else found
        return found

    for block in (decontam.BLOCK, 100):
        got = {r["doc_id"]: (r["longest"], r["longest_at"]) for r in decontam.decontaminate(table(spark, [" ".join(t) for t in texts]).coalesce(1), rows, block=block).collect()}
        assert [got[i] for i in range(len(texts))] == [best(t) for t in texts]


def test_packing_is_best_fit_one_by_one(spark):
    rng = np.random.default_rng(3)
    lengths = {int(k): int(rng.integers(1, 30)) for k in rng.choice(np.arange(1, 65), 25, replace=False)}
    ranges, bins = packing.plan_bins(lengths, (16, 32, 64), 4)
    fill = {}
    for size, _, count, first, each, offset in ranges:
        for k in range(count):
            b = first + k // each
            assert fill.get(b, 0) == offset + k % each * size
            fill[b] = fill.get(b, 0) + size
    assert sum(c for _, _, c, *_ in ranges) == sum(lengths.values())
    for first, n, f, cap in bins:
        assert all(fill[b] == f for b in range(first, first + n)) and f <= cap and cap == min(c for c in (16, 32, 64) if c >= f)
    p = packing.op2_best_fit_packing(spark, SF).toPandas()
    assert p.groupby("doc_id").length.sum().sum() == quality_rules.ledger(T.documents(spark, SF)).agg(F.sum("n_words")).first()[0]
    b = p.dropna().sort_values(["bin", "offset"])
    assert ((b.groupby("bin").length.cumsum() - b.length) == b.offset).all() and (b.groupby("bin").length.sum() <= b.groupby("bin").capacity.max()).all()


def test_ring_law(spark):
    p = sharding.op6_sharding(spark, SF).toPandas()
    n = p.groupby("shard").slot.agg(["size", "max", "nunique"])
    assert n["size"].max() - n["size"].min() <= 1 and (n["max"] + 1 == n["size"]).all() and (n["nunique"] == n["size"]).all()
    owners = [0, 1, 2, 1, 0]
    counts = {0: 7, 2: 1, 3: 4, 4: 3}
    plan = sharding.walk(counts, owners, 3)
    per = {s: sum(hi - lo for _, lo, hi, x, _ in plan if x == s) for s in range(3)}
    assert per == {0: 5, 1: 5, 2: 5}


def test_chat_round_trip_and_branches(spark):
    turns = [("user", "\\### Assistant: </turn> ok"), ("a:b\n", "### x: y</turn>\n"), ("assistant", "")]
    formatted, spans = chat.format_turns(turns)
    assert chat.parse_turns(formatted) == turns and len(spans) == 1
    m = spark.createDataFrame([(1, 1, None, "user", "root", 0.0), (1, 2, 1, "assistant", "bad", 0.0), (1, 3, 1, "assistant", "good", 5.0), (1, 4, 3, "user", "more", 1.0), (None, 1, 9, "user", "x", 0.0), (2, 1, 2, "u", "cycle", 0.0), (2, 2, 1, "u", "cycle", 0.0)], "tree bigint, node bigint, parent bigint, role string, text string, score double")
    got = {r["tree"]: [t for _, t in chat.parse_turns(r["formatted"])] for r in chat.format_trees(m).collect()}
    assert got == {1: ["root", "good", "more"], None: ["x"]}
    assert chat.format_trees(m, None).filter("tree = 1").count() == 2


def test_classifier_holds_out(spark):
    sf = SF.replace("0.001", "0.1")
    r = classifier.op5_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    good, n = r.filter("predicted = quality").count(), r.count()
    assert n > 300 and good / n > 0.95
    assert classifier.pool(np.array([1, 1, 0, 2]), np.array([1, 0, 0, 2])).tolist() == [0.5, 0.5, 0.5, 1.0]


def test_secrets_base_and_random(spark):
    token = "qZ8vK2nX5rT9wB3mL7pD4hJ6sF1gC0yA"
    noise = "".join(np.random.default_rng(2).choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 48))
    words = " ".join("abcdefghijklmnop"[: 12 + i % 5] + "e" * (i % 3) for i in range(400))
    d = table(spark, [f"é password = '{token}' and", f"AKIA{'Q' * 16} x", "0123456789abcdef01234567", f"see {noise} there", words, None, "token: abc secret=token:abcdefgh"])
    got = {r["doc_id"]: [(x["start"], x["end"], x["kind"]) for x in r["found"]] for r in secrets.find_secrets(d, alpha=0.2).collect()}
    assert [k for *_, k in got[0]] == [0] and got[0][0][0] == 2
    assert got[1] == [(0, 20, 1)] and got[2] == [(0, 24, 2)] and got[5] == [] and got[6] == []
    assert got[3] == [(4, 52, 3)] and got[4] == []


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["label"] for r in components.components(e).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[101] == 100


def test_ablation(spark):
    rows = quality_rules.ledger(T.documents(spark, SF))
    got = {r["rule"]: (r["n_failed"], r["n_only_this"]) for r in quality_rules.ablation(rows, "web-2").collect()}
    assert got["too_short"][0] == rows.filter("n_words < 50").count()
    kept = rows.filter(quality_rules.passes("web-2")).count()
    assert quality_rules.apply_rules(T.documents(spark, SF)).count() == kept


def test_policy_is_arithmetic_on_the_ledgers_bits(spark):
    docs = T.documents(spark, SF)
    want = {r["doc_id"]: r["failures"] for r in quality_rules.ledger(docs).collect()}
    rows = docs.select("doc_id", "text").toArrow().combine_chunks()
    got = {}
    for part, c in T.chunks(rows):
        got.update(zip(part.column("doc_id").to_pylist(), quality_rules.failure_bits(quality_rules.measure(c)).tolist(), strict=True))
    assert got == want and len(set(want.values())) > 3
    for policy in quality_rules.POLICIES:
        assert {r["doc_id"] for r in quality_rules.apply_rules(docs, policy).collect()} == {k for k, v in want.items() if not v & quality_rules.mask(policy)}


def test_pipeline_by_stages(spark):
    import corpus_pipeline as cp

    docs = T.documents(spark, SF)
    for name, stage in cp.STAGES[:4]:
        out = T.store(stage(spark, docs, SF))
        assert out.columns == docs.columns, name
        if name == "ngram_jaccard_join":
            left = jaccard.similar_groups(docs).toPandas()
            assert {r["doc_id"] for r in out.collect()} == set(left.component_id)
        docs = out
    packed = cp.run(spark, SF).toPandas()
    assert set(packed.doc_id) == {r["doc_id"] for r in docs.collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert packed.groupby("doc_id").length.sum().to_dict() == {k: len(re.findall("[^\x20\x09-\x0d]+", t)) for k, t in text.items()}
