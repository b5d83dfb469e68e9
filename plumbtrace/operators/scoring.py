"""Models seen as `features array -> probability array`.

A scorer that is a column expression is evaluated inside the row, for any number
of altered copies of the row, without a shuffle. A fitted model scores exploded
copies as an ordinary distributed transform.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import Protocol

import numpy as np
from pyspark.ml.classification import DecisionTreeClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbtrace.functions.binding import bind, let
from plumbtrace.functions.scalars import array_sum, logistic

#: A tree of more nodes stays in Spark.
TREE_NODES = 20_000


class Scorer(Protocol):
    classes: int

    def expression(self, features: Column) -> Column | None:
        """Probability array as a column, or None when only `score` works."""

    def batch(self, features: np.ndarray) -> np.ndarray | None:
        """Probabilities of a matrix inside a task, where the model is small enough for that."""

    def score(self, df: DataFrame, features: str, out: str) -> DataFrame:
        """Add the probability array of a features column."""


class _ExpressionScorer:
    def score(self, df: DataFrame, features: str, out: str) -> DataFrame:
        return df.withColumn(out, self.expression(F.col(features)))


class LinearScorer(_ExpressionScorer):
    """Two classes: p = link(w.x + b), link 'identity' or 'logistic'."""

    classes = 2

    def __init__(self, weights: list[float], bias: float, link: str = "identity"):
        self.weights, self.bias, self.link = [float(w) for w in weights], float(bias), link

    def margin(self, features: Column) -> Column:
        w = F.array(*[F.lit(v) for v in self.weights])
        return array_sum(F.zip_with(features, w, lambda x, v: x * v)) + self.bias

    def expression(self, features: Column) -> Column:
        m = self.margin(features)
        p = m if self.link == "identity" else logistic(m)
        return let(p, lambda v: F.array(1.0 - v, v))

    def batch(self, features: np.ndarray) -> np.ndarray:
        m = features @ np.asarray(self.weights) + self.bias
        p = m if self.link == "identity" else 1.0 / (1.0 + np.exp(-m))
        return np.stack([1.0 - p, p], axis=-1)


class SoftmaxScorer(_ExpressionScorer):
    """k classes: softmax of one linear margin per class."""

    def __init__(self, weights: list[list[float]], biases: list[float]):
        self.weights, self.biases, self.classes = weights, biases, len(biases)

    def expression(self, features: Column) -> Column:
        margins = F.array(*[
            array_sum(F.zip_with(features, F.array(*[F.lit(float(v)) for v in w]), lambda x, v: x * v)) + float(b)
            for w, b in zip(self.weights, self.biases)])
        shifted = let(margins, lambda m: let(F.array_max(m), lambda top: F.transform(m, lambda v: F.exp(v - top))))
        return let(shifted, normalised)

    def batch(self, features: np.ndarray) -> np.ndarray:
        m = features @ np.asarray(self.weights, dtype="float64").T + np.asarray(self.biases, dtype="float64")
        e = np.exp(m - m.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)


def normalised(a: Column) -> Column:
    """An array divided by its sum; `a` must be bound."""
    return let(F.greatest(array_sum(a), F.lit(1e-12)), lambda total: F.transform(a, lambda v: v / total))


class TreeMatrix:
    """The nodes of a fitted decision tree as arrays, so that a task can score matrices by itself."""

    def __init__(self, feature: list[int], threshold: list[float], children: list[list[int]], probability: list[list[float]], depth: int):
        """`feature` is -1 in leaves; `children` holds the left and the right node, a leaf twice itself."""
        self.feature, self.threshold, self.depth = np.asarray(feature), np.asarray(threshold, "float64"), depth
        self.children, self.probability = np.asarray(children).reshape(-1, 2), np.asarray(probability, "float64")

    @classmethod
    def of(cls, model) -> TreeMatrix | None:
        """None where `model` is no single tree over numbers, or has too many nodes to be read one by one."""
        if not isinstance(model, DecisionTreeClassificationModel) or model.numNodes > TREE_NODES or model.isSet("thresholds"):
            return None
        feature, threshold, children, probability = [], [], [], []
        waiting = [(model._java_obj.rootNode(), -1, 0)]
        while waiting:
            node, parent, side = waiting.pop()
            at = len(feature)
            if parent >= 0:
                children[parent][side] = at
            stats = list(node.impurityStats().stats())
            total = sum(stats)
            probability.append([v / total for v in stats] if total else stats)
            children.append([at, at])
            inner = "InternalNode" in node.getClass().getName()
            if inner and "ContinuousSplit" not in node.split().getClass().getName():
                return None
            feature.append(node.split().featureIndex() if inner else -1)
            threshold.append(node.split().threshold() if inner else 0.0)
            if inner:
                waiting += [(node.leftChild(), at, 0), (node.rightChild(), at, 1)]
        return cls(feature, threshold, children, probability, model.depth)

    def __call__(self, features: np.ndarray) -> np.ndarray:
        """Probabilities of a matrix, or of any stack of matrices."""
        flat = np.ascontiguousarray(features, "float64").reshape(-1, features.shape[-1])
        at, row = np.zeros(len(flat), "int64"), np.arange(len(flat)) * flat.shape[1]
        for _ in range(self.depth):
            # a leaf's children are itself, whatever its row is compared with
            value = np.take(flat, row + np.maximum(self.feature, 0)[at])
            at = self.children[at, (~(value <= self.threshold[at])).astype("int64")]
        return self.probability[at].reshape(*features.shape[:-1], -1)


class ModelScorer:
    """A fitted Spark ML classifier that takes a vector of features."""

    def __init__(self, model, classes: int = 2, features_col: str = "features", probability_col: str = "probability"):
        self.model, self.classes = model, classes
        self.features_col, self.probability_col = features_col, probability_col

    @functools.cached_property
    def matrix(self) -> TreeMatrix | None:
        """The model as a function of matrices, where there is one."""
        return TreeMatrix.of(self.model)

    def expression(self, features: Column) -> None:
        return None

    def batch(self, features: np.ndarray) -> None:
        return None

    def score(self, df: DataFrame, features: str, out: str) -> DataFrame:
        given = df.withColumn(self.features_col, array_to_vector(F.col(features)))
        scored = self.model.transform(given)
        extra = [c for c in scored.columns if c not in given.columns]
        if self.probability_col in extra:
            p = vector_to_array(F.col(self.probability_col))
        else:
            # one-vs-rest ensembles report margins: squash each and normalise
            raw = F.transform(vector_to_array(F.col("rawPrediction")), lambda v: logistic(2.0 * v))
            p = let(raw, normalised)
        return scored.select(*[c for c in df.columns if c != out], p.alias(out))


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Use all cores when the input has fewer splits than there are cores.

    Scoring many altered copies is bound by processors, so a small file that arrives
    as one split is spread by key. A large input has more splits and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def score_variants(df: DataFrame, keys: list[str], scorer: Scorer, count: Column | int,
                   variant: Callable[[Column], Column], out: str, partitions: int | None = None) -> DataFrame:
    """Add `out`: probability arrays of `count` altered feature arrays per row.

    `variant(i)` builds the i-th altered array from columns of the row. With a model
    the copies are exploded, scored and gathered again. The rows are first placed by
    key, so gathering and joining back happen where they are: one shuffle in all.
    """
    n = F.lit(count) if isinstance(count, int) else count
    indexes = F.sequence(F.lit(0), n.cast("int") - 1)
    if scorer.expression(F.array(F.lit(0.0))) is not None:
        return bind(df, **{out: F.transform(indexes, lambda i: scorer.expression(variant(i)))})
    placed = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    copies = placed.withColumn("_i", F.explode(indexes)).select(*keys, "_i", variant(F.col("_i")).alias("_x"))
    scored = scorer.score(copies, "_x", "_p").select(*keys, "_i", "_p")
    gathered = scored.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_p"))).alias("_s"))
    return placed.join(gathered.select(*keys, F.transform("_s", lambda s: s["_p"]).alias(out)), keys)


def by_matrix(df: DataFrame, keys: list[str], x: str, size: int, in_tasks: Callable[[DataFrame], DataFrame],
              by_copies: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of a key that comes once, with all features, go through `in_tasks`; the others, few or none, through `by_copies`.

    Copies are gathered by key, so what `by_copies` gives a row depends on the other rows of its key. One shuffle, which both sides share.
    """
    placed = df.repartition(*keys).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    whole = (F.col("_n") == 1) & known & F.coalesce((F.size(x) == size) & ~F.exists(x, lambda v: v.isNull()), F.lit(False))
    out = in_tasks(placed.where(whole).drop("_n"))
    return out.unionByName(by_copies(placed.where(~whole).drop("_n")).select(*out.columns))


# ---- standardisation -------------------------------------------------------------


def standard_fit(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a constant column gets deviation 1."""
    row = df.agg(*[a for c in columns for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def standard_apply(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})
