"""Infinite values, NaN, long lists and quotas that can't be filled."""

import math

import pytest
from pyspark.sql import functions as F

from plumbtrace.operators import audit, cleaning, ireval, metrics, splits


def test_infinite_scores_rank_like_any_other(spark):
    rows = [(k, float(k), k % 2) for k in range(50)] + [(100, math.inf, 1), (101, -math.inf, 0)] + [(200 + k, math.inf, 1) for k in range(200)]
    scored = spark.createDataFrame(rows, "id long, score double, y int")
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    row = metrics.roc_auc(scored, F.col("y") == 1, "score").first().asDict()
    assert abs(next(v for k, v in row.items() if "auc" in k) - want) < 1e-9


def test_nan_is_missing(spark):
    rows = [("bad", math.nan, 1.0), ("bad", math.nan, 2.0), ("good", 1.0, math.nan), ("good", 2.0, None)]
    df = spark.createDataFrame(rows, "label string, a double, b double")
    assert {r.label: r.a for r in audit.null_ratio(df, "label", ["a"]).collect()} == {"bad": 1.0, "good": 0.0}
    found = {r.column: r for r in audit.leakage_audit(df, "label", "bad", ["a", "b"]).collect()}
    assert found["a"].missing_in_malicious and not found["b"].missing_in_malicious
    assert {r.label: r.b for r in audit.distinct_including_null(df, "label", ["b"]).collect()} == {"bad": 2, "good": 1}
    assert cleaning.drop_sparse_columns(df, 3).columns == ["label"]


def test_first_hit_beyond_twenty(spark):
    rows = [("q", k, int(k == 35)) for k in range(60)] + [("r", k, 0) for k in range(3)]
    got = ireval.first_hit_rank(spark.createDataFrame(rows, "q string, n int, s int"), ["q"], "n", F.col("s") == 1)
    assert {r.q: r.first_hit for r in got.collect()} == {"q": 36, "r": None}


def test_quotas_that_no_seed_fills_raise(spark):
    df = spark.createDataFrame([("a", "x", "c", 1)], "query string, engine string, cell string, level int")
    with pytest.raises(ValueError):
        splits.quota_sample(df, "query", "engine", "cell", "level", {("c", "x"): 5}, [1], 1, seeds=3)
