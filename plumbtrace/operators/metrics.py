"""Classification metrics. Row-scaled work ends at the first aggregate."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbtrace.functions.binding import bind, let
from plumbtrace.functions.hashing import hash_uniform
from plumbtrace.functions.scalars import ratio
from plumbtrace.functions.special import log_gamma
from .bounded import attach_one, join_on
from .ordered import BUCKETS, boundaries, prefix_sums, with_bucket


def pair_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, label: str, prediction: str, classes: list) -> DataFrame:
    """Dense k x k counts; the class list is short and is spelled out as literals."""
    counts = pair_counts(df, label, prediction)
    names = F.array(*[F.lit(c) for c in classes])
    # k*k zero rows next to the counts: one aggregate fills the empty cells, no join
    blank = df.sparkSession.range(1).select(F.explode(names).alias("label")).select(
        "label", F.explode(names).alias("prediction"), F.lit(0).cast("long").alias("n"))
    return counts.unionByName(blank).groupBy("label", "prediction").agg(F.sum("n").alias("n"))


def binary_confusion(df: DataFrame, label: str, prediction: str, positive=1) -> DataFrame:
    y, p = F.col(label) == positive, F.col(prediction) == positive
    return df.agg(F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"),
                  F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"))


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Per class precision, recall, F1 and support, then accuracy, macro and weighted rows.

    One scan: pair counts, then a rollup whose total row is turned into three.
    """
    counts = pair_counts(df, label, prediction)
    sides = counts.select(F.inline(F.array(
        F.struct(F.col("label").cast("string").alias("class"), F.col("n").alias("support"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("prediction").cast("string").alias("class"), F.lit(0).cast("long").alias("support"),
                 F.lit(0).cast("long").alias("tp"), F.col("n").alias("predicted")),
    )))
    per_class = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"))
    precision = ratio(F.col("tp"), F.col("predicted"))
    recall = ratio(F.col("tp"), F.col("support"))
    scored = per_class.select("class", "support", "tp", precision.alias("precision"), recall.alias("recall"))
    scored = scored.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    metrics = ("precision", "recall", "f1")
    rolled = scored.rollup("class").agg(
        F.grouping("class").alias("is_total"), F.sum("support").alias("support"), F.sum("tp").alias("tp"),
        *[F.avg(m).alias(f"macro_{m}") for m in metrics],
        *[ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in metrics])

    def row(name: Column, *values: Column) -> Column:
        return F.struct(name.alias("class"), *[v.alias(m) for v, m in zip(values, metrics)], F.col("support"))

    accuracy = ratio(F.col("tp"), F.col("support"))
    total = F.array(
        row(F.lit("accuracy"), accuracy, accuracy, accuracy),
        row(F.lit("macro avg"), *[F.col(f"macro_{m}") for m in metrics]),
        row(F.lit("weighted avg"), *[F.col(f"weighted_{m}") for m in metrics]))
    single = F.array(row(F.col("class"), *[F.col(f"macro_{m}") for m in metrics]))
    return rolled.select(F.inline(F.when(F.col("is_total") == 1, total).otherwise(single)))


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def score_counts(df: DataFrame, groups: list[str], positive: Column, score: str) -> DataFrame:
    """One row per distinct score: positives and negatives."""
    return df.groupBy(*groups, F.col(score).cast("double").alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))


def roc_auc(df: DataFrame, positive: Column, score: str, groups: list[str] | None = None) -> DataFrame:
    """Tie-aware area: sum of pos * (negatives below + half of the tied ones)."""
    groups = groups or []
    ordered = prefix_sums(score_counts(df, groups, positive, score), groups, "score", {"neg_before": "neg"})
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    out = ordered.groupBy(*groups) if groups else ordered
    return out.agg(F.sum("pos").alias("n_positive"), F.sum("neg").alias("n_negative"),
                   F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def one_vs_rest(df: DataFrame, label: str, probability: str, classes: int) -> DataFrame:
    """k rows per row: class, whether it is the label, and its probability."""
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)),
        lambda c: F.struct(c.alias("class"), (F.col(label) == c).alias("is_class"), F.col(probability)[c].cast("double").alias("score")))
    kept = [F.col(c) for c in df.columns if c not in (label, probability)]
    return df.select(*kept, F.inline(cells))


def roc_auc_ovr(df: DataFrame, label: str, probability: str, classes: int) -> DataFrame:
    """Area per class, and their mean over the classes where it is defined."""
    per = roc_auc(one_vs_rest(df, label, probability, classes), F.col("is_class"), "score", ["class"])
    return per.agg(F.avg("auc").alias("macro_auc"), F.min("auc").alias("min_auc"), F.max("auc").alias("max_auc"))


def pr_points(df: DataFrame, positive: Column, score: str, groups: list[str] | None = None) -> DataFrame:
    """Precision and recall at every distinct score, highest score first."""
    groups = groups or []
    counts = score_counts(df, groups, positive, score)
    ordered = prefix_sums(counts, groups, "score", {"tp_before": "pos", "fp_before": "neg"}, descending=True)
    tp = F.col("tp_before") + F.col("pos")
    points = ordered.withColumn("tp", tp).withColumn("fp", F.col("fp_before") + F.col("neg"))
    totals = counts.groupBy(*groups).agg(F.sum("pos").alias("total")) if groups else counts.agg(F.sum("pos").alias("total"))
    points = join_on(points, totals, groups) if groups else attach_one(points, totals)
    return points.select(
        *groups, F.col("score").alias("threshold"), "pos", "total",
        ratio(F.col("tp"), F.col("total")).alias("recall"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def average_precision(df: DataFrame, positive: Column, score: str, groups: list[str] | None = None) -> DataFrame:
    """Step-wise area: recall gain times precision, nothing interpolated."""
    groups = groups or []
    counts = score_counts(df, groups, positive, score)
    ordered = prefix_sums(counts, groups, "score", {"tp_before": "pos", "fp_before": "neg"}, descending=True)
    tp = F.col("tp_before") + F.col("pos")
    gain = F.col("pos") * tp / (tp + F.col("fp_before") + F.col("neg"))
    out = ordered.groupBy(*groups) if groups else ordered
    return out.agg(ratio(F.sum(gain), F.sum("pos")).alias("average_precision"), F.sum("pos").alias("n_positive"))


def average_precision_multiclass(df: DataFrame, label: str, probability: str, classes: int) -> DataFrame:
    """Rows per class, `macro` (their mean) and `micro` (all one-vs-rest pairs pooled)."""
    pairs = one_vs_rest(df, label, probability, classes)
    pooled = pairs.select(
        F.explode(F.array(F.col("class").cast("string"), F.lit("micro"))).alias("class"), "is_class", "score")
    per = average_precision(pooled, F.col("is_class"), "score", ["class"])
    macro = F.avg(F.when(F.col("class") != "micro", F.col("average_precision")))
    rolled = per.rollup("class").agg(F.first("average_precision").alias("ap"), macro.alias("macro"), F.grouping("class").alias("g"))
    return rolled.select(
        F.when(F.col("g") == 1, "macro").otherwise(F.col("class")).alias("class"),
        F.when(F.col("g") == 1, F.col("macro")).otherwise(F.col("ap")).alias("average_precision"))


def poisson_steps(n: Column) -> Column:
    """(first, steps): cumulated probabilities of a Poisson(n) count from `first` on, within nine deviations of its mean.

    Masses are taken in log space, so any n will do; what lies outside is below 1e-15.
    """
    mean = n.cast("double")
    reach = 9.0 * F.sqrt(mean) + 8.0
    first = F.greatest(F.floor(mean - reach), F.lit(0).cast("long"))
    mass = lambda k: F.exp(k * F.log(mean) - mean - log_gamma(k + 1.0))
    masses = F.transform(F.sequence(first, F.ceil(mean + reach)), lambda k: mass(k.cast("double")))
    added = F.aggregate(masses, F.array(F.lit(0.0)), lambda s, p: F.concat(s, F.array(F.element_at(s, -1) + p)))
    return F.when(n > 0, F.struct(first.alias("first"), F.slice(added, F.lit(2), F.size(added) - 1).alias("steps")))


def poisson_draw(steps: Column, seed, *keys) -> Column:
    """Replicate weight of identical rows by inversion of their `poisson_steps`: the number of steps that a uniform number passes.

    The sum of n Poisson(1) draws is Poisson(n), so rows that share a value are drawn together. No rows weigh nothing.
    """
    passed = let(hash_uniform(seed, *keys), lambda u: F.size(F.filter(steps["steps"], lambda c: c <= u)))
    return F.when(steps.isNull(), F.lit(0)).otherwise(steps["first"].cast("int") + passed)


@functools.lru_cache(maxsize=256)
def _cumulated(n: int) -> tuple[int, np.ndarray]:
    """What `poisson_steps` holds, in a task."""
    reach = 9.0 * math.sqrt(n) + 8.0
    first = max(math.floor(n - reach), 0)
    k = np.arange(first, math.ceil(n + reach) + 1, dtype="float64")
    return first, np.cumsum(np.exp(k * math.log(n) - n - np.array([math.lgamma(v + 1.0) for v in k])))


def poisson_weight(n: Column, seed, *keys) -> Column:
    """`poisson_draw` of `poisson_steps`, for very frequent values: the steps of a count are added up once a batch and searched by halves.

    Their number grows with the root of the count; a draw costs its logarithm.
    """
    def weigh(counts: pd.Series, uniform: pd.Series) -> pd.Series:
        out, u = np.zeros(len(counts), dtype="int64"), uniform.to_numpy()
        values, place = np.unique(counts.to_numpy(), return_inverse=True)
        order = np.argsort(place, kind="stable")
        for n, rows in zip(values.tolist(), np.split(order, np.cumsum(np.bincount(place, minlength=len(values)))[:-1])):
            if n > 0:
                first, steps = _cumulated(n)
                out[rows] = first + np.searchsorted(steps, u[rows], side="right")
        return pd.Series(out)

    return F.pandas_udf(weigh, "long")(n, hash_uniform(seed, *keys))


def bootstrap_average_precision(df: DataFrame, positive: Column, score: str, seed, replicates: int = 200,
                                groups: list[str] | None = None, level: float = 0.95, buckets: int = BUCKETS) -> DataFrame:
    """Point value and percentile interval of average precision.

    Rows are collapsed to distinct scores, shuffled once by score bucket, and only
    then multiplied by the replicates: aggregates and windows that follow are keyed
    by the bucket and stay in the same partition.
    """
    groups = groups or []
    counts = score_counts(df, groups, positive, score)
    bucketed = with_bucket(counts, "score", boundaries(counts, "score", buckets)).repartition("_bucket")
    # replicate -1 carries the unweighted counts
    drawn = bucketed.withColumn("replicate", F.explode(F.sequence(F.lit(-1), F.lit(replicates - 1))))
    weight = lambda c: F.when(F.col("replicate") < 0, F.col(c)).otherwise(
        poisson_weight(F.col(c), seed, *groups, F.round(F.col("score") * 1000000000).cast("long"), F.col("replicate"), F.lit(c)))
    drawn = drawn.select(*groups, "_bucket", "replicate", "score", weight("pos").alias("pos"), weight("neg").alias("neg"))
    keys = [*groups, "replicate"]
    totals = drawn.groupBy(*keys, "_bucket").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    after = Window.partitionBy(*keys).orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket", F.coalesce(F.sum("p").over(after), F.lit(0)).alias("p0"),
                            F.coalesce(F.sum("q").over(after), F.lit(0)).alias("q0"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    local = drawn.select("*", F.sum("pos").over(inside).alias("p1"), F.sum("neg").over(inside).alias("q1"))
    joined = join_on(local, offsets, [*keys, "_bucket"])
    tp = F.col("p0") + F.col("p1")
    gain = F.col("pos") * ratio(tp, tp + F.col("q0") + F.col("q1"))
    per = joined.groupBy(*keys).agg(ratio(F.sum(gain), F.sum("pos")).alias("ap"))
    tail = (1 - level) / 2
    draws = F.when(F.col("replicate") >= 0, F.col("ap"))
    out = per.groupBy(*groups) if groups else per
    return out.agg(
        F.max(F.when(F.col("replicate") < 0, F.col("ap"))).alias("average_precision"),
        F.percentile(draws, F.lit(tail)).alias("low"), F.percentile(draws, F.lit(1 - tail)).alias("high"))


STEPS = 100


def threshold_sweep(df: DataFrame, positive: Column, score: str, steps: int = STEPS) -> DataFrame:
    """F1 at `steps` evenly spaced thresholds: one row per threshold, at most `steps` rows."""
    last = steps - 1
    s = F.col(score).cast("double")
    guess = F.floor(s * last)
    # the highest threshold i/last at or below the score, safe against rounding of the product
    index = guess + ((guess + 1) / float(last) <= s).cast("long") - (guess / float(last) > s).cast("long")
    counts = df.groupBy(F.greatest(F.least(index, F.lit(last)), F.lit(-1)).alias("bin")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    blank = df.sparkSession.range(steps).select(F.col("id").alias("bin"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"))
    filled = counts.unionByName(blank).groupBy("bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # at most steps + 1 rows from here on
    suffix = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    swept = filled.select(
        "bin", F.sum("pos").over(suffix).alias("tp"), F.sum("neg").over(suffix).alias("fp"),
        F.sum("pos").over(everything).alias("p")).filter("bin >= 0")
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("p"))
    return swept.select(
        (F.col("bin") / float(last)).alias("threshold"), (F.col("tp") + F.col("fp")).alias("n_predicted"),
        precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"))


def best_threshold(df: DataFrame, positive: Column, score: str, steps: int = STEPS, default: float = 0.5) -> DataFrame:
    """Lowest threshold with the highest F1, and predicted positives there and at the default."""
    swept = threshold_sweep(df, positive, score, steps)
    best = swept.agg(F.max_by(F.struct("threshold", "f1", "n_predicted"), F.struct(F.col("f1"), -F.col("threshold"))).alias("b"))
    plain = df.agg(F.count_if(F.col(score) >= default).alias("n_at_default"))
    return attach_one(best, plain).select(
        F.col("b.threshold").alias("threshold"), F.col("b.f1").alias("f1"),
        F.col("b.n_predicted").alias("n_at_best"), "n_at_default")
