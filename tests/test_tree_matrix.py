"""A fitted tree scored on matrices inside tasks, against the same tree scored as a transform of altered copies."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from plumbtrace.operators import attribution, quality, scoring
from plumbtrace.plans import quality as quality_plan, training

BASE = [0.1, -0.2, 0.3, 0.0]


@pytest.fixture(scope="module")
def scorer(spark):
    rng = random.Random(8)
    x = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(400)]
    rows = spark.createDataFrame([(v, float(v[0] * v[1] > 0.2) + float(v[2] > 1), 1.0 + (v[3] > 0)) for v in x], "x array<double>, label double, weight double")
    return training.fit(training.decision_tree(6), rows.withColumn("features", array_to_vector("x")), 3)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(9)
    data = [(str(i), [rng.gauss(0, 1) for _ in range(4)], i % 2) for i in range(50)]
    # keys that repeat, with equal and with other features, and one without a key
    return spark.createDataFrame([*data, data[3], ("4", [0.0, 1.0, 2.0, 3.0], 1), (None, [0.0] * 4, 0)], "row_id string, x array<double>, y int").cache()


class Transformed(scoring.ModelScorer):
    matrix = None


def found(df):
    return sorted((tuple(np.round(v, 9).tolist() if isinstance(v, (list, float)) else v for v in r) for r in df.collect()), key=str)


def test_tree_as_arrays_equals_the_transform(scorer, rows):
    x = np.array([r["x"] for r in rows.collect()])
    scored = np.array([r["p"] for r in scorer.score(rows, "x", "p").collect()])
    assert (scorer.matrix(x) == scored).all()
    assert (scorer.matrix(np.stack([x, x], 1))[:, 1] == scored).all()
    assert np.isfinite(scorer.matrix(np.full((1, 4), np.nan))).all()


def test_quality_equals_the_copies(scorer, rows):
    plain = Transformed(scorer.model, 3)
    outs = []
    for s in (scorer, plain):
        e = attribution.ShapleyExplainer(s, BASE, 5, 3)
        out = quality_plan.quality_per_case(rows, ["row_id"], "x", BASE, s, e, "y", seed=7, draws=3, k=2)
        outs.append(found(out.select("row_id", "phi", "deletion_curve", "faithfulness", "robustness", "complexity", "overall", "predicted_label", "prediction_correct")))
    assert len(outs[0]) == 52 and outs[0] == outs[1]


def test_no_row_is_exploded_for_a_tree(scorer, rows):
    """A row whose key is its own becomes no copies."""
    e = attribution.ShapleyExplainer(scorer, BASE, 5, 3)
    single = rows.where("row_id not in ('3', '4')")
    explained = e.explain(single, ["row_id"], "x", "phi")
    seen = spark_rows(explained, "Generate")
    assert explained.count() == 48 and seen == 0


def spark_rows(df, operator):
    """Rows that come out of an operator's nodes of the executed plan."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            waiting.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            waiting.append(node.plan())
            continue
        if name.startswith(operator) and "explode(" in node.toString():
            metric = node.metrics().get("numOutputRows")
            total += metric.get().value() if metric.isDefined() else 0
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return total


@pytest.mark.parametrize("target", [1, "predicted"])
def test_patterns_solve_the_same_surrogate(target):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12, 4))
    hashes = rng.integers(-2 ** 63, 2 ** 63, 12)
    edges = [[-3.0, -0.7, 0.1, 0.8, 3.0 + k] for k in range(4)]
    model = scoring.LinearScorer([0.5, -0.3, 0.2, 0.4], 0.1, "logistic")
    altered, z = attribution.draw_altered(x, hashes, edges, 300)
    plain = attribution.solve_ridge(z, attribution.pick_class(model.batch(altered), target))
    solver = attribution.PatternSurrogate(edges, 300)
    for r in range(12):
        values, pattern = solver.altered(x[r], hashes.astype("uint64")[r])
        assert (values == altered[r]).all() and (solver.z[pattern] == z[r]).all()
    assert solver(x, hashes, model.batch, target) == pytest.approx(plain, abs=1e-9)


def test_faithfulness_moves_whole_arrays(rows):
    """Rows travel as Arrow lists, never as one Python object each; missing numbers are NaN and unequal rows an error."""
    e = attribution.LinearExplainer(scoring.LinearScorer([0.05, -0.03, 0.02, 0.04], 0.5), BASE)
    out = quality.faithfulness(e.explain(rows, ["row_id"], "x", "phi"), ["row_id"], "x", "phi", BASE, e.scorer).collect()
    assert len(out) == 53 and all(len(r["deletion_curve"]) == 4 and len(r["probability"]) == 2 for r in out)
    import pyarrow as pa

    two = pa.array([[9.0], [1.0, None], [3.0, 4.0]], pa.list_(pa.float64())).slice(1)
    assert np.array_equal(quality.arrow_matrix(two), [[1.0, np.nan], [3.0, 4.0]], equal_nan=True)
    assert quality.arrow_column(np.array([1.0, np.nan])).to_pylist() == [1.0, None]
    assert quality.arrow_column(np.array([[1.0, np.nan]])).to_pylist() == [[1.0, None]]
    with pytest.raises(ValueError):
        quality.arrow_matrix(pa.array([[1.0], [1.0, 2.0]]))
