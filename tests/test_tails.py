"""Tails of distributions against closed forms and numeric integrals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbtrace.functions.special import chi_square_tail, incomplete_beta, log_gamma, student_two_sided
from plumbtrace.operators import metrics, paired


def integral_of_student(t: float, dof: float) -> float:
    log_scale = math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2) - 0.5 * math.log(dof * math.pi)
    x = np.linspace(0, t, 200_001)
    y = np.exp(log_scale - (dof + 1) / 2 * np.log1p(x * x / dof))
    h = t / 200_000
    return 1 - 2 * h / 3 * float(y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())


def test_student_tail_at_any_degrees_of_freedom(spark):
    cases = [(t, d) for d in (1.0, 2.0, 3.0, 30.0, 999.0, 1000.0, 1001.0, 50_000.0, 2_000_000.0) for t in (0.01, 0.7, 1.96, 4.5)] + [(0.0, 5.0), (-1.96, 30.0)]
    rows = spark.createDataFrame(cases, "t double, d double").withColumn("p", student_two_sided(F.col("t"), F.col("d"))).collect()
    for r in rows:
        expected = integral_of_student(abs(r["t"]), r["d"]) if r["t"] else 1.0
        assert r["p"] == pytest.approx(expected, abs=1e-9), r
    closed = {(r["t"], r["d"]): r["p"] for r in rows}
    assert closed[(1.96, 1.0)] == pytest.approx(1 - 2 / math.pi * math.atan(1.96), abs=1e-12)
    assert closed[(0.7, 2.0)] == pytest.approx(1 - 0.7 / math.sqrt(2 + 0.49), abs=1e-12)
    none = spark.createDataFrame([(1.0, 0.5)], "t double, d double").select(student_two_sided(F.col("t"), F.col("d")).alias("p")).first()
    assert none["p"] is None


def test_beta_and_gamma_functions(spark):
    df = spark.createDataFrame([(z,) for z in (0.25, 0.5, 1.0, 2.5, 40.0, 1e6)], "z double")
    for r in df.withColumn("g", log_gamma(F.col("z"))).collect():
        assert r["g"] == pytest.approx(math.lgamma(r["z"]), rel=1e-12, abs=1e-11)
    df = spark.createDataFrame([(x, a) for x in (0.0, 0.1, 0.5, 0.93, 1.0) for a in (1.0, 3.0, 12.0)], "x double, a double")
    for r in df.withColumn("i", incomplete_beta(F.col("x"), F.col("a"), F.lit(1.0))).collect():
        assert r["i"] == pytest.approx(r["x"] ** r["a"], abs=1e-12)


@pytest.mark.parametrize("dof", [1, 2, 3, 4, 9, 10, 60])
def test_chi_square_tail(spark, dof):
    def closed(x):
        q, a = (math.exp(-x), 1.0) if dof % 2 == 0 else (math.erfc(math.sqrt(x)), 0.5)
        while a < dof / 2:
            q += math.exp(a * math.log(x) - x - math.lgamma(a + 1)) if x > 0 else 0.0
            a += 1
        return q

    values = [0.0, 0.01, 0.5, 2.0, 7.8, 30.0, 120.0]
    df = spark.createDataFrame([(v,) for v in values], "x double").withColumn("p", chi_square_tail(F.col("x"), dof))
    for r in df.collect():
        assert r["p"] == pytest.approx(closed(r["x"] / 2), abs=1e-11)


def test_friedman_takes_any_number_of_engines(spark):
    rng = np.random.default_rng(4)
    rows = [("m", b, f"e{e}", float(rng.integers(0, 4)) + 0.3 * e) for b in range(40) for e in range(5)]
    out = paired.friedman(spark.createDataFrame(rows, "g string, b long, e string, v double"), ["g"], "b", "e", "v", [f"e{e}" for e in range(5)]).first()
    x = out["chi_square"] / 2
    assert out["p_value"] == pytest.approx(math.exp(-x) * (1 + x), abs=1e-12)
    with pytest.raises(ValueError):
        paired.friedman(spark.createDataFrame(rows, "g string, b long, e string, v double"), ["g"], "b", "e", "v", ["e0"])


def test_poisson_weights_are_exact_beyond_every_old_limit(spark):
    draws = 4000
    for n in (1, 16, 17, 400, 10_000):
        df = spark.range(draws).select(metrics.poisson_draw(metrics.poisson_steps(F.lit(n).cast("long")), 5, F.col("id")).alias("w"))
        w = np.array([r["w"] for r in df.collect()], dtype="float64")
        assert abs(w.mean() - n) < 5 * math.sqrt(n / draws)
        assert w.var() == pytest.approx(n, rel=0.15)
        skew = ((w - w.mean()) ** 3).mean() / w.std() ** 3
        assert skew == pytest.approx(1 / math.sqrt(n), abs=0.2)
    # a step function that ends at 1, and the share of zeros
    steps = spark.range(1).select(metrics.poisson_steps(F.lit(17)).alias("s")).first()["s"]
    assert steps["first"] == 0 and steps["steps"][0] == pytest.approx(math.exp(-17)) and steps["steps"][-1] == pytest.approx(1, abs=1e-13)
    none = spark.range(1).select(metrics.poisson_draw(metrics.poisson_steps(F.lit(0)), 5, F.lit(1)).alias("w")).first()
    assert none["w"] == 0


def test_searched_weights_equal_the_steps_one_by_one(spark):
    """Also of values so frequent that adding up an array for each step would not end."""
    df = spark.range(300).withColumn("n", F.element_at(F.array(*[F.lit(v).cast("long") for v in (0, 1, 5, 300, 4000)]), (F.col("id") % 5 + 1).cast("int")))
    both = df.select(metrics.poisson_weight(F.col("n"), 5, F.col("id")).alias("a"),
                     metrics.poisson_draw(metrics.poisson_steps(F.col("n")), 5, F.col("id")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both)
    n = 40_000_000
    few = spark.createDataFrame([(0.1, n, 2 * n), (0.5, n, n), (0.9, 2 * n, n)], "s double, p long, q long")
    weights = few.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(199)))).select(metrics.poisson_weight(F.col("p"), 1, F.col("s"), F.col("i")).alias("w"), "p")
    r = weights.agg(F.avg((F.col("w") - F.col("p")) / F.sqrt("p")).alias("m"), F.stddev((F.col("w") - F.col("p")) / F.sqrt("p")).alias("s")).first()
    assert abs(r["m"]) < 0.2 and abs(r["s"] - 1) < 0.15
