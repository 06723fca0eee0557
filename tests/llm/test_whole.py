"""Comparisons with brute force, equal results under other layouts, and odd rows by value."""

import re

import numpy as np
import pyarrow as pa
import pytest
from oracle import SF
from pyspark.sql import functions as F

from culler.llm import chat, classifier, jaccard, line_dedup, packing, quality_rules, secrets, sharding, substring
from culler.llm import text as T

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in zip(range(len(texts)) if ids is None else ids, texts, strict=True)], SCHEMA)


def test_windows_meet_at_selected_positions(spark):
    d = table(spark, ["a b\nc d\ne f\ng h", "x\na b\nc d\ne f\ng h"]).withColumnRenamed("doc_id", "id").withColumn("rk", F.col("id")).select("id", "rk", "text")
    assert sorted(map(tuple, line_dedup.repeated_windows(d).collect())) == [(1, 1, 3), (1, 2, 3)]
    positions, by = line_dedup.selected_positions(d).collect(), {}
    assert len({(r["rk"], r["line"]) for r in positions}) == len(positions) and sum(len(r["windows"]) for r in positions) == 5
    for r in positions:  # equal windows select the same line
        for w in r["windows"]:
            by.setdefault(w["content"], set()).add((r["fingerprint"], w["back"]))
    assert len(by) == 3 and all(len(x) == 1 for x in by.values())


def test_signatures_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(8)
    for num in (75, 40):
        sets = []
        for _ in range(40):
            base = rng.integers(0, 1 << 64, rng.integers(1, 400), np.uint64)
            for share in (1, 0.95, 0.85, 0.7, 0.4):
                other = np.where(rng.random(len(base)) < share, base, rng.integers(0, 1 << 64, len(base), np.uint64))
                sets.append(np.unique(other[: max(1, int(len(base) * rng.uniform(0.7, 1)))]))
        n = np.array([len(x) for x in sets])
        may = jaccard.may_qualify(n, [jaccard.signature(x) for x in sets], num, 100)
        for i in range(0, len(sets), 5):
            for j in range(i, i + 5):
                for k in range(j + 1, i + 5):
                    common = len(np.intersect1d(sets[j], sets[k]))
                    assert may[j, k] == may[k, j] and (may[j, k] or 100 * common < num * (n[j] + n[k] - common))
        assert may.mean() < 0.2


def test_small_parts_and_buckets_give_the_same_groups(spark, monkeypatch):
    for name, value in (("HELD", 2000), ("BUCKET", 1 << 12), ("BUCKET_SHINGLES", 500), ("BLOCK", 2), ("BLOCK_SHINGLES", 300), ("THIN", 2)):
        monkeypatch.setattr(jaccard, name, value)
    words = [f"w{i}" for i in range(60)]
    near = [" ".join(words[:k] + [f"x{k}"] + words[k + 1 :]) for k in range(60)]
    texts = near + near[:5] + [" ".join(f"y{i + k}" for i in range(40)) for k in range(0, 40, 4)] + [None, "a b", "a b"]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t else set() for t in texts]
    top = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                p, q = top[i], top[j]
                top = [min(p, q) if x in (p, q) else x for x in top]
    assert {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(table(spark, texts).repartition(5)).collect()} == dict(enumerate(top))


@pytest.mark.parametrize("f", [sharding.op6_sharding, packing.op2_best_fit_packing])
def test_places_depend_on_rows_alone(spark, f, monkeypatch):
    rows = lambda: sorted(map(str, f(spark, SF).collect()))
    want, plain = rows(), T.documents
    monkeypatch.setattr(T, "documents", lambda s, d: plain(s, d).repartition(7))
    assert rows() == want


def test_equal_rows_are_dealt_as_a_range(spark):
    p = sharding.ring_shards(table(spark, ["same"] * 50 + ["other"] * 3, [7] * 50 + [1, 2, None]), shards=4, nodes=8).toPandas()
    n = p.groupby("shard").slot.agg(["size", "max", "nunique"])
    assert len(p) == 53 and n["size"].max() - n["size"].min() <= 1 and (n["max"] + 1 == n["size"]).all() and (n["nunique"] == n["size"]).all()


def test_one_more_shard_moves_few_rows(spark):
    d = T.documents(spark, SF.replace("0.001", "0.01"))
    a, b = (sharding.ring_shards(d, shards=k).select("doc_id", F.col("shard").alias(f"s{k}")) for k in (24, 25))
    n, moved = a.count(), a.join(b, "doc_id").filter("s24 <> s25").count()
    print("moved from 24 to 25 shards:", moved / n)
    assert 0.03 <= moved / n <= 0.25


def test_every_piece_goes_to_the_bin_it_fills_best():
    rng = np.random.default_rng(5)
    caps, overhead = (8, 16, 32), 4
    for _ in range(100):
        lengths = {int(k): int(rng.integers(1, 9)) for k in rng.choice(np.arange(1, 33), 8, replace=False)}
        ranges, bins = packing.plan_bins(lengths, caps, overhead)
        left, space, sizes = sum(k * n for k, n in lengths.items()), {}, []
        for size, _, count, first, each, _ in ranges:  # in the order of placement, piece by piece
            for k in range(count):
                at, fits = first + k // each, [x for x in space.values() if x >= size]
                if at not in space:  # none has room: the least-cost size for what is left
                    assert not fits
                    space[at] = min((c for c in caps if c >= size), key=lambda c: ((c + overhead) / min(c, max(left, size)), c))
                else:
                    assert space[at] == min(fits)
                space[at], left = space[at] - size, left - size
                sizes.append(size)
        assert sizes == sorted((k for k, n in lengths.items() for _ in range(n)), reverse=True) and left == 0
        assert sum(n for _, n, *_ in bins) == len(space)


def test_clashing_names_are_kept(spark):
    d = table(spark, ["a b c", None])
    for name in ("length", "bin", "n_words", "size", "found"):
        d = d.withColumn(name, F.lit(name))
    assert {r["length"] + r["bin"] for r in packing.pack(d, keep=("doc_id", "length", "bin")).collect()} == {"lengthbin"}
    assert sorted((r["n_words"], r["n_words_"]) for r in quality_rules.ledger(d, keep=("doc_id", "n_words")).collect()) == [(0, "n_words"), (3, "n_words")]
    assert sorted((r["size"], r["size_"]) for r in sharding.ring_shards(d, keep=("doc_id", "size")).collect()) == [("size", 8), ("size", 13)]
    assert [(r["found"], r["found_"]) for r in secrets.find_secrets(d, keep=("doc_id", "found")).collect()] == [("found", [])] * 2


def test_repeated_messages_count_once(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", None)] * 2 + [(2, 1, None, None, None, 1.0)]
    m = spark.createDataFrame(rows, "tree bigint, node bigint, parent bigint, role string, text string, score double")
    assert {r["tree"]: chat.parse_turns(r["formatted"]) for r in chat.format_trees(m).collect()} == {1: [("user", "q"), ("assistant", "a")], 2: [("", "")]}
    assert chat.format_trees(m.limit(0)).count() == 0
    long = "<#\\ " * 50_000
    one = chat.format_trees(spark.createDataFrame([(1, 1, None, "assistant", long, 0.0)], m.schema)).first()
    assert chat.parse_turns(one["formatted"]) == [("assistant", long)]


def test_classifier_takes_any_integer(spark):
    d, labels = T.documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    small = lambda x: x.withColumn("doc_id", F.col("doc_id").cast("int"))
    wide, narrow = classifier.classify(d, labels), classifier.classify(small(d), small(labels))
    assert narrow.schema["doc_id"].dataType.simpleString() == "int"
    a, b = (x.select("doc_id", "score", "held_out").orderBy("doc_id").toPandas() for x in (wide, narrow))
    assert (a.held_out == b.held_out).all() and np.allclose(a.score, b.score, atol=1e-6)


def test_normal_equations_and_curve_against_a_direct_solve(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, classifier.N_STATS))
    y, fold = (x[:, 0] + rng.normal(size=300) > 0).astype(int), rng.integers(1, classifier.FOLDS, 300)
    train = spark.createDataFrame([(a.tolist(), int(b), int(c)) for a, b, c in zip(x, y, fold, strict=True)], "s array<double>, y int, fold int").repartition(4)
    m = classifier.fit(train, features=16)
    f = classifier.fourier(x, x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-4)), 16, classifier.WIDTH, classifier.SEED)
    assert np.allclose(m.weights, np.linalg.solve(f.T @ f + classifier.RIDGE * np.eye(f.shape[1]), f.T @ y), atol=1e-6)
    assert (np.diff(m.curve[0]) > 0).all() and (np.diff(m.curve[1]) > 0).all()
    order = np.argsort(m.raw(x))
    assert (np.diff(m.score(x)[order]) >= 0).all()


def test_base_spans_of_secrets_by_regex(spark):
    assign = re.compile("(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    sf = SF.replace("0.001", "0.01")
    text, seen = {r["doc_id"]: r["text"] or "" for r in T.documents(spark, sf).collect()}, 0
    for r in secrets.find_secrets(T.documents(spark, sf)).collect():
        t = text[r["doc_id"]]
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24]
        assert [(x["start"], x["kind"], x["end"]) for x in r["found"] if x["kind"] < 3] == sorted(want)
        seen += len(r["tests"])
        assert all(0 < x["uniform"] <= 1 and 0 < x["runs"] <= 2 and 0 < x["serial"] <= 2 for x in r["tests"])
    assert seen


def test_false_discoveries_among_random_tokens_stay_few(spark):
    rng = np.random.default_rng(9)
    letters, code = list("abcdefghijklmnopqrstuvwxyz"), list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    skewed = 1 / np.arange(1, 27)
    word = lambda n: "".join(rng.choice(letters, n, p=skewed / skewed.sum()))
    plain = [" ".join(word(rng.integers(12, 30)) for _ in range(100)) for _ in range(60)]
    texts = [f"{plain[i]} {word(12)}-{word(14)}" for i in range(30)] + [f"{plain[30 + i]} {''.join(rng.choice(code, 44))}" for i in range(30)]
    got = secrets.find_secrets(table(spark, texts)).collect()
    hits = [r["doc_id"] for r in got if any(x["random"] for x in r["tests"])]
    assert sum(len(r["tests"]) for r in got) == 60 and sum(x < 30 for x in hits) <= 1 and sum(x >= 30 for x in hits) >= 10


def test_compressed_bits_rank_and_select():
    rng = np.random.default_rng(3)
    for share in (0, 0.01, 0.5, 0.99, 1):
        b = np.concatenate([rng.random(1000) < share, np.ones(300, bool), np.zeros(500, bool)])
        bits, at = substring.Bits(b), np.arange(len(b) + 1)
        assert bits.rank(at).tolist() == [0, *np.cumsum(b).tolist()]
        assert bits.select(np.arange(b.sum())).tolist() == np.flatnonzero(b).tolist()


def test_matching_statistics_by_brute_force():
    rng = np.random.default_rng(7)
    for width in (5, 13):
        for sigma in (1, 3, 9):
            held = [rng.integers(0, sigma, rng.integers(width, 22)) for _ in range(12)]
            asked = [rng.integers(0, sigma + 1, rng.integers(width, 22)) for _ in range(30)] + held[:3] + [np.concatenate([held[0][:3], held[1]])]
            owner = rng.integers(0, 9, len(held))
            cat = lambda x: (np.concatenate(x).astype(np.uint64) * np.uint64(99), np.concatenate([[0], np.cumsum([len(a) for a in x])]))
            statistic, least = substring.Index(*cat(held), owner, width).stream(*cat(asked))
            grams = {}
            for h, o in zip(held, owner.tolist(), strict=True):
                for k in range(1, width + 1):
                    for i in range(len(h) - k + 1):
                        g = tuple(h[i : i + k].tolist())
                        grams[g] = min(o, grams.get(g, o))
            want = []
            for a in asked:
                for i in range(len(a)):
                    k = max((k for k in range(1, min(width, len(a) - i) + 1) if tuple(a[i : i + k].tolist()) in grams), default=0)
                    want.append((k, grams[tuple(a[i : i + k].tolist())] if k == width else substring.LAST))
            assert list(zip(statistic.tolist(), least.tolist(), strict=True)) == want


def test_index_is_compressed():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 21, np.uint64)
    near = np.stack([np.where(rng.random(21) < 0.95, base, rng.integers(0, 1 << 60, 21, np.uint64)) for _ in range(3000)])
    index = substring.Index(near.ravel(), np.arange(0, near.size + 1, 21), np.arange(3000), 13)
    plain = near.nbytes + 8 * index.n  # the words and a suffix array
    assert index.nbytes - index.least.nbytes - index.words.nbytes - index.symbol.nbytes - index.shift.nbytes < plain / 2


def test_repeats_of_documents_outside_the_index(spark):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(300)]
    held = [" ".join(words[k : k + 60]) for k in range(0, 240, 40)] + [None, "", "short one"] + [" ".join(rng.choice(["a", "b"], 80)) for _ in range(5)]
    asked = [" ".join(["x", *words[20:45], "y", *words[100:112], "z", *words[5:18]]), " ".join(words), " ".join(words[50:70]), None, "", "x"] + [" ".join(rng.choice(["a", "b"], 90)) for _ in range(5)]
    asked += asked[:2] + ["only here " * 30] * 2
    grams = {tuple(t.split()[i : i + 13]) for t in held if t for i in range(len(t.split()) - 12)}
    ids = [*range(len(asked) - 1), None]
    d, h = table(spark, asked, ids).withColumn("owner", F.lit("x")), table(spark, held, [None] * len(held))
    got = {r["doc_id"]: r for r in substring.find_repeats(d.repartition(3), h, chunk=1 << 10, bucket=1 << 10, shard=1 << 10).collect()}
    assert len(got) == len(asked)
    for i, t in zip(ids, asked, strict=True):
        w = (t or "").split()
        gone = sorted({j for k in range(len(w) - 12) if tuple(w[k : k + 13]) in grams for j in range(k, k + 13)})
        assert [j for x in got[i]["repeats"] for j in range(x["start"], x["end"])] == gone, i
        assert all(a["end"] < b["start"] for a, b in zip(got[i]["repeats"], got[i]["repeats"][1:], strict=False))
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["text"]) == (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in set(gone)))
    assert substring.find_repeats(d.limit(0), h).count() == 0 and substring.find_repeats(d, h.limit(0)).agg(F.sum("n_removed")).first()[0] == 0
    with pytest.raises(ValueError):
        substring.remove_repeats(d, width=4)


def test_batches_are_bounded_by_bytes(spark):
    T.ship(spark)
    rows = spark.range(0, 4000, 1, 1).selectExpr("repeat('word ', 1000) AS text")
    sizes = [r["n"] for r in rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n bigint").collect()]
    assert len(sizes) > 1 and max(sizes) <= T.BATCH + 6000
