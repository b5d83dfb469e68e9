"""Closed forms, brute force on small fixtures, bounds and independence of partitions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbtrace.functions import counters, scalars, special
from plumbtrace.operators import (
    attribution, audit, cleaning, ireval, kernels, metrics, ordered, paired, quality, retrieval, scoring, splits, summaries, textoverlap,
)
from plumbtrace.plans import training
from plumbtrace.sources import files, sinks


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [(str(i), [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    return spark.createDataFrame(data, "row_id string, x array<double>").cache()


BASE, WEIGHTS = [0.1, -0.2, 0.3, 0.0], [0.5, -0.3, 0.2, 0.4]
LOGISTIC = scoring.LinearScorer(WEIGHTS, 0.1, "logistic")
IDENTITY = scoring.LinearScorer([0.05, -0.03, 0.02, 0.04], 0.5)


class ColumnOnly(scoring.LinearScorer):
    """The same score without its matrix form, to exercise the expression path."""

    def batch(self, features):
        return None


class Exploded(ColumnOnly):
    """The same score as if it were a fitted model, to exercise the exploded path."""

    def expression(self, features):
        return None

    def score(self, df, features, out):
        return df.withColumn(out, scoring.LinearScorer.expression(self, F.col(features)))


def phi_of(df):
    return {r["row_id"]: r["phi"] for r in df.select("row_id", "phi").collect()}


def test_shapley_adds_up_and_paths_agree(rows):
    results = []
    for cls in (scoring.LinearScorer, ColumnOnly, Exploded):
        e = attribution.ShapleyExplainer(cls(WEIGHTS, 0.1, "logistic"), BASE, 3, 4)
        results.append(phi_of(e.explain(rows, ["row_id"], "x", "phi")))
    x = {r["row_id"]: np.array(r["x"]) for r in rows.collect()}
    base = LOGISTIC.batch(np.array([BASE]))[0, 1]
    for k, phi in results[0].items():
        assert sum(phi) == pytest.approx(LOGISTIC.batch(x[k][None])[0, 1] - base, abs=1e-9)
        for other in results[1:]:
            assert phi == pytest.approx(other[k], abs=1e-9)


def test_sampled_shapley_equals_closed_form_for_identity(rows):
    sampled = phi_of(attribution.ShapleyExplainer(IDENTITY, BASE, 3, 4).explain(rows, ["row_id"], "x", "phi"))
    exact = phi_of(attribution.LinearExplainer(IDENTITY, BASE).explain(rows, ["row_id"], "x", "phi"))
    for k in exact:
        assert sampled[k] == pytest.approx(exact[k], abs=1e-9)


def test_faithfulness_paths_agree_and_are_bounded(rows):
    explained = attribution.LinearExplainer(IDENTITY, BASE).explain(rows, ["row_id"], "x", "phi")
    cols = ["deletion_auc", "insertion_auc", "ablation_correlation", "faithfulness"]
    outs = []
    for cls in (scoring.LinearScorer, ColumnOnly, Exploded):
        s = cls(IDENTITY.weights, IDENTITY.bias)
        out = quality.faithfulness(explained, ["row_id"], "x", "phi", BASE, s).select("row_id", "target", *cols)
        outs.append({r["row_id"]: r for r in out.collect()})
    for k, r in outs[0].items():
        assert 0 <= r["deletion_auc"] <= 1 and 0 <= r["insertion_auc"] <= 1 and -1 - 1e-9 <= r["ablation_correlation"] <= 1 + 1e-9
        for other in outs[1:]:
            assert [r[c] for c in cols] == pytest.approx([other[k][c] for c in cols], abs=1e-9)
            assert r["target"] == other[k]["target"]


def test_robustness_bounds_and_partition_independence(rows):
    e = attribution.LinearExplainer(IDENTITY, BASE)
    def run(df):
        explained = e.explain(df, ["row_id"], "x", "phi")
        out = quality.robustness(explained, ["row_id"], "x", "phi", e, 9, 5, 2)
        return {r["row_id"]: (r["jaccard_similarity"], r["importance_variance"], r["robustness"]) for r in out.collect()}
    one, many = run(rows.repartition(1)), run(rows.repartition(17))
    assert one == many
    assert all(0 <= v <= 1 for r in one.values() for v in r)
    none = quality.robustness(e.explain(rows, ["row_id"], "x", "phi"), ["row_id"], "x", "phi", None)
    assert none.filter("robustness IS NOT NULL").count() == 0


def test_counters_agree_with_numpy(spark):
    df = spark.range(50).withColumn("w", counters.row_word("s", "id"))
    got = df.select("w", counters.counter_u32(F.col("w"), F.lit(7)).alias("c"), counters.counter_normal(F.col("w"), F.lit(7)).alias("n")).collect()
    words = np.array([r["w"] for r in got])
    assert [r["c"] for r in got] == counters.np_counter_u32(words, np.array([7]))[:, 0].tolist()
    assert [r["n"] for r in got] == pytest.approx(counters.np_counter_normal(words, np.array([7]))[:, 0], abs=1e-12)


def test_surrogate_finds_the_signs(rows):
    edges = [[-3.0, -0.7, 0.0, 0.7, 3.0]] * 4
    e = attribution.SurrogateExplainer(LOGISTIC, edges, list("abcd"), 1, 400)
    phi = phi_of(e.explain(rows, ["row_id"], "x", "phi"))
    top = [r for r in rows.collect() if r["x"][0] > 0.7]
    assert np.mean([phi[r["row_id"]][0] for r in top]) > 0
    rules = e.explain(rows, ["row_id"], "x", "phi").select(F.explode(e.rules(F.col("x"))).alias("rule"))
    parsed = files.split_rules(rules, "rule")
    assert parsed.filter("NOT feature IN ('a', 'b', 'c', 'd')").count() == 0


def test_surrogate_model_path_equals_batch_path(rows):
    edges, few = [[-3.0, -0.7, 0.0, 0.7, 3.0]] * 4, rows.limit(10)
    a = phi_of(attribution.SurrogateExplainer(LOGISTIC, edges, list("abcd"), 1, 30).explain(few, ["row_id"], "x", "phi"))
    b = phi_of(attribution.SurrogateExplainer(Exploded(WEIGHTS, 0.1, "logistic"), edges, list("abcd"), 1, 30).explain(few, ["row_id"], "x", "phi"))
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-9)


def test_edges_of_the_measures(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([0.5],), ([0.3, 0.3],)], "phi array<double>")
    got = [tuple(r) for r in df.select(quality.effective_complexity(F.col("phi")), quality.sparsity(F.col("phi")), scalars.normalised_area(F.col("phi"))).collect()]
    assert got[0] == (1.0, 1.0, 0.5)
    assert got[1] == (1.0, 0.0, 0.0)
    assert got[2][0] == pytest.approx(1 / (1 + math.exp(2))) and got[2][2] == 0.5
    assert quality.curve_points(1) == [1] and quality.curve_points(5) == [1, 2, 3, 4, 5] and quality.curve_points(36)[-1] == 36
    assert kernels.area(np.array([[0.2, 0.2]]))[0] == 0.5


def test_order_helpers_with_a_heavy_value(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 41).cast("double").alias("v"))
    got = {r["id"]: r["rn"] for r in ordered.row_numbers(df, "v", ["id"], "rn").collect()}
    want = {i: n + 1 for n, (_, i) in enumerate(sorted((r["v"], r["id"]) for r in df.collect()))}
    assert got == want


def test_split_is_exact_and_stable(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") < 4500, "a").otherwise("b").alias("label"))
    run = lambda d: {r["id"]: r["split"] for r in splits.stratified_split(d, "label", ["id"], 1).collect()}
    one = run(df.repartition(1))
    assert one == run(df.repartition(13))
    assert sum(1 for i, s in one.items() if i < 4500 and s == "train") == 2700
    assert sum(1 for i, s in one.items() if i >= 4500 and s == "val") == 100


def test_missing_group_names_keep_their_rows(spark):
    df = spark.range(900).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), (F.col("id") % 10).cast("double").alias("v"))
    assert splits.stratified_split(df, "g", ["id"], 1).count() == 900
    assert ordered.with_mid_ranks(df, ["g"], "v").count() == 900
    assert ordered.row_numbers(df, "v", ["id"], "rn", ["g"]).agg(F.count("rn")).first()[0] == 900
    assert summaries.describe_by(df, ["g"], "v").filter("median IS NULL").count() == 0


def test_auc_against_all_pairs(spark):
    rng = random.Random(2)
    data = [(rng.randint(0, 1), round(rng.random(), 1)) for _ in range(200)]
    df = spark.createDataFrame(data, "y int, s double")
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(df, F.col("y") == 1, "s").first()["auc"] == pytest.approx(want)
    ci = metrics.bootstrap_average_precision(df, F.col("y") == 1, "s", 1, 50).first()
    assert ci["low"] <= ci["average_precision"] <= ci["high"]


def test_rank_tests_on_a_hand_worked_table(spark):
    diffs = [1, 2, -1, 0, 3]
    df = spark.createDataFrame([("g", float(v)) for v in diffs], "g string, d double")
    drop = paired.signed_rank(df, ["g"], "d").first()
    assert (drop["w_plus"], drop["w_minus"], drop["n_nonzero"], drop["n_zero"]) == (8.5, 1.5, 4, 1)
    assert drop["rank_biserial"] == pytest.approx(0.7)
    pratt = paired.signed_rank(df, ["g"], "d", "pratt").first()
    assert (pratt["w_plus"], pratt["w_minus"]) == (11.5, 2.5)
    zero = spark.createDataFrame([("g", 0.0)] * 3, "g string, d double")
    assert paired.signed_rank(zero, ["g"], "d").first()["p_value"] == 1.0


def test_distribution_functions(spark):
    df = spark.createDataFrame([(1.96, 10.0), (0.0, 3.0), (2.228, 10.0)], "z double, n double")
    got = df.select(special.normal_two_sided(F.col("z")), special.student_two_sided(F.col("z"), F.col("n"))).collect()
    assert got[0][0] == pytest.approx(0.0499958, abs=1e-6)
    assert got[1][0] == pytest.approx(1.0, abs=1e-6) and got[1][1] == pytest.approx(1.0, abs=1e-6)
    assert got[2][1] == pytest.approx(0.05, abs=1e-4)


def test_lcs_and_rouge_l(spark):
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2))
        assert textoverlap.lcs_length(a, b) == slow(a, b)
    df = spark.createDataFrame([(1, "the cat sat", "the cat lay"), (2, "", "x")], "k int, a string, b string")
    got = {r["k"]: r["f1"] for r in textoverlap.rouge_l(df, ["k"], "a", "b").collect()}
    assert got[1] == pytest.approx(2 / 3) and got[2] == 0.0


def pack(text, size, overlap):
    """Greedy packing written out by hand."""
    import re
    units = []
    for s in re.split(r"(?<=[.!?])\s+", text):
        w = s.split()
        units += [w[i:i + size] for i in range(0, len(w), size)]
    done, open_ = [], []
    for u in units:
        if open_ and sum(map(len, open_)) + len(u) > size:
            done.append(" ".join(w for x in open_ for w in x))
            keep, room = [], min(overlap, size - len(u))
            for x in reversed(open_):
                if sum(map(len, keep)) + len(x) > room:
                    break
                keep.insert(0, x)
            open_ = keep
        open_.append(u)
    return done + ([" ".join(w for x in open_ for w in x)] if open_ else [])


def test_sentence_chunks_against_hand_packing(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["aa", "b.", "cc", "d!", "eee"]) for _ in range(rng.randint(0, 120))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {}
    for r in retrieval.sentence_chunks(df, "k", "t", 12, 4).collect():
        got.setdefault(r["k"], {})[r["chunk_pos"]] = r["text"]
    for k, t in enumerate(texts):
        assert [got.get(k, {}).get(i) for i in range(len(got.get(k, {})))] == pack(t, 12, 4)


def test_vector_search_paths_agree(spark, monkeypatch):
    rng = np.random.default_rng(0)
    data = [(i, [float(v) for v in rng.normal(size=6)]) for i in range(400)]
    df = spark.createDataFrame(data, "k long, v array<double>")
    q = df.filter("k % 10 = 0").select(F.col("k").alias("q"), F.col("v").alias("qv"))
    for metric in ("l2", "cosine"):
        a = {(r["q"], r["rank"]): r["k"] for r in retrieval.vector_topk(q, "q", "qv", df, "k", "v", 3, metric).collect()}
        with monkeypatch.context() as m:
            m.setattr(retrieval, "BROADCAST_BYTES", 0)
            b = {(r["q"], r["rank"]): r["k"] for r in retrieval.vector_topk(q, "q", "qv", df, "k", "v", 3, metric).collect()}
        assert a == b and len(a) == 120


def test_bm25_salted_join_equals_broadcast(spark):
    docs = spark.createDataFrame([(f"c{i}", f"alpha beta {'gamma ' * (i % 4)} word{i % 7}") for i in range(60)], "id string, t string")
    q = spark.createDataFrame([(1, "alpha gamma word3"), (2, "beta beta word5 unseen")], "q int, text string")
    run = lambda n: sorted(map(tuple, retrieval.bm25_topk(q, "q", "text", docs, "id", "t", broadcast_limit=n).collect()))
    assert run(20_000) == run(0)


def test_bm25_holds_no_pairs(spark):
    """Without a row per (query, chunk): the plan that ranks has no aggregate or join keyed by both."""
    docs = spark.createDataFrame([(f"c{i % 50}" if i else None, f"alpha beta {'gamma ' * (i % 4)} word{i % 7}") for i in range(120)] + [("empty", ""), ("none", None)], "id string, t string")
    q = spark.createDataFrame([(1, "alpha gamma word3"), (2, "beta beta word5 unseen"), (2, "word6"), (None, "gamma")], "q int, text string")
    run = lambda n: retrieval.bm25_topk(q, "q", "text", docs, "id", "t", 5, broadcast_limit=n)
    few, many = run(20_000), run(0)
    assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect())) and few.count() == 15
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [q" not in plan and "MapInArrow" in plan


def test_bm25_counts_of_unique_chunks(spark):
    docs = spark.createDataFrame([(f"c{i}", f"alpha beta {'gamma ' * (i % 4)} word{i % 7}") for i in range(60)] + [("empty", ""), ("none", None)], "id string, t string")
    q = spark.createDataFrame([(1, "alpha gamma word3"), (2, "beta beta word5 unseen")], "q int, text string")
    counts = retrieval.bm25_counts(docs, "id", "t", unique=True)
    assert sorted(map(tuple, retrieval.postings_of(counts, "id").collect())) == sorted(map(tuple, retrieval.bm25_postings(docs, "id", "t").collect()))
    a = retrieval.bm25_topk(q, "q", "text", docs, "id", "t", counts=counts)
    b = retrieval.bm25_topk(q, "q", "text", docs, "id", "t")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_retrieval_metric_edges(spark):
    runs = spark.createDataFrame([(1, "bm25", ["a", "b", "c"]), (1, "none", []), (2, "bm25", ["x"])], "q int, engine string, ids array<string>")
    qrels = spark.createDataFrame([(1, "b"), (1, "z"), (2, None)], "q int, chunk string")
    s = {(r["q"], r["engine"]): r for r in ireval.score_runs(ireval.judged_runs(runs, qrels, "q", "engine", "ids", "chunk"), "q", "engine", "ids").collect()}
    a = s[(1, "bm25")]
    assert a["precision_at_3"] == pytest.approx(1 / 3) and a["recall_at_3"] == 0.5 and a["mrr"] == 0.5
    assert a["ndcg_at_3"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert s[(1, "none")]["mrr"] is None and s[(2, "bm25")]["ndcg_at_3"] == 0.0


def test_leakage_flags(spark):
    df = spark.createDataFrame([("m", 1.0, None, 5), ("m", 1.0, None, 5), ("b", 2.0, 3.0, 5), ("b", 4.0, None, 5)], "label string, a double, b double, c int")
    got = {r["column"]: tuple(r)[1:] for r in audit.leakage_audit(df, "label", "m", ["a", "b", "c"]).collect()}
    assert got == {"a": (True, False, False), "b": (True, True, False), "c": (False, False, True)}


def test_cleaning_edges(spark):
    df = spark.createDataFrame([("tcp",), (None,), ("arp",)], "p string")
    hot = cleaning.one_hot(cleaning.collapse_rare(df, "p", ["arp"]), ["p"]).collect()
    assert [(r["p_other"], r["p_tcp"]) for r in hot] == [(False, True), (False, False), (True, False)]
    with pytest.raises(ValueError):
        cleaning.category_values(spark.range(50), "id", 10)


def test_report_of_models_beats_majority(spark, rows):
    df = spark.range(3000).select(F.col("id").cast("string").alias("row_id"), F.array((F.col("id") % 17).cast("double"), (F.col("id") % 5).cast("double")).alias("x"),
                                  (F.col("id") % 17 > 8).cast("int").alias("label"))
    split = splits.hash_split(df, ["row_id"], 1)
    table = training.benchmark({"d": (split, 2)}, {"tree": training.decision_tree(4), "mlp": training.network(2, 2, [8], 60)}, "x", "label", "split", ["row_id"]).collect()
    assert {r["model"] for r in table} == {"tree", "mlp"}
    assert all(r["accuracy"] > 0.8 and r["auc"] > 0.8 for r in table)


def test_surrogate_rows_sum_to_the_direct_ridge(rows):
    edges, few = [[-3.0, -0.7, 0.0, 0.7, 3.0]] * 4, rows.limit(3)
    e = attribution.SurrogateExplainer(Exploded(WEIGHTS, 0.1, "logistic"), edges, list("abcd"), 1, 5000, "predicted", residual="off")
    got = {r["row_id"]: r for r in e.explain(few, ["row_id"], "x", "phi").collect()}
    assert len(got) == 3 and max(r["off"] for r in got.values()) < 1e-9
    hashed = few.withColumn("h", F.xxhash64(F.lit("1"), "row_id")).collect()
    for r in hashed:
        x, h = np.array([r["x"]], dtype="float64"), np.array([r["h"]])
        values, z = attribution.draw_altered(x, h, edges, 5000)
        y = attribution.pick_class(LOGISTIC.batch(values), "predicted")
        assert got[r["row_id"]]["phi"] == pytest.approx(attribution.solve_ridge(z, y)[0], abs=1e-9)
        # the number of a sample alone decides its draw
        one, _ = attribution.draw_samples(np.repeat(x, 5000, 0), np.repeat(h, 5000), edges, 5000, np.arange(5000))
        assert (one == values[0]).all()


def test_documents_are_sorted_before_they_are_built(spark, tmp_path):
    """Documents given as an expression reach their folders compressed, and the sort for the writer holds no document."""
    df = spark.range(200).select(F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("model"), "id")
    path = str(tmp_path / "documents")
    sinks.sink_documents(df, F.to_json(F.struct("id", F.repeat(F.lit("x"), 500).alias("long"))), path, ("model",), "snappy")
    files_ = list((tmp_path / "documents").rglob("part-*"))
    assert files_ and sum(f.stat().st_size for f in files_) < 200 * 500 / 4
    got = spark.read.schema("id long, long string, model string").json(path)
    assert got.where("model = concat('m', id % 3) and length(long) = 500").select("id").distinct().count() == 200


def test_relevance_file_of_many_queries(spark, tmp_path):
    (tmp_path / "a.txt").write_text('{"Q1": ["a", "b"], "Q2": [], "Q3": ["c"]}')
    got = sorted(map(tuple, files.scan_relevance(spark, str(tmp_path)).collect()), key=str)
    assert got == [("Q1", "a"), ("Q1", "b"), ("Q2", None), ("Q3", "c")]


def test_perturbed_copies_equal_the_expression(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 4.0]), (2, [5.0, None, 1.0]), (2, [0.5, 7.0]), (None, [3.0, 3.0, 9.0]), (4, None)], "k int, x array<double>")
    got = sorted(map(repr, quality.perturbed_copies(df, ["k"], "x", 42, 4, "draw", "xp").select("k", "draw", F.transform("xp", lambda v: F.round(v, 9)).alias("xp")).collect()))
    word = counters.row_word(42, "k")
    rows = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(3))))
    want = rows.select("k", "draw", F.transform(quality.perturbed(word, F.col("x"), F.col("draw")), lambda v: F.round(v, 9)).alias("xp"))
    assert got == sorted(map(repr, want.collect())) and len(got) == 20
    assert "ArrowEvalPython" in quality.perturbed_copies(df, ["k"], "x", 42, 4, "draw", "xp")._jdf.queryExecution().optimizedPlan().toString()
