"""Paired comparisons: rank tests, corrections, correlations and bootstrap intervals.

Every test first collapses its rows to distinct values with counts, so its
cost follows the number of different scores, and heavy ties are one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbtrace.functions.binding import bind
from plumbtrace.functions.scalars import array_sum, ratio
from plumbtrace.functions.special import chi_square_tail, normal_two_sided, student_two_sided
from .metrics import poisson_weight
from .ordered import prefix_sums, with_mid_ranks

# Metrics that have no meaning without retrieval, and the comparisons made.
CONTEXT_METRICS = ("faithfulness", "context_utilization_score")
COMPARISONS = (("bm25", "none"), ("vector", "none"), ("bm25", "vector"))
JUDGE_METRICS = ("faithfulness", "correctness", "answer_relevancy", "security_specificity",
                 "context_utilization_score", "hallucinated_security_reasoning")


def long_scores(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, score) from one column per metric."""
    return wide.unpivot(keys, list(metrics), "metric", "score")


def paired_differences(scores: DataFrame, query: str, engine: str, comparisons=COMPARISONS,
                       undefined: str = "none", context_metrics=CONTEXT_METRICS, keep: list[str] | None = None) -> DataFrame:
    """score(a) - score(b) per query, metric and comparison; pairs need both sides. Of repeated scores the largest counts."""
    keep = keep or []
    engines = sorted({e for pair in comparisons for e in pair})
    wide = scores.groupBy(*keep, query, "metric").pivot(engine, engines).agg(F.max("score"))
    cells = F.array(*[
        F.struct(F.lit(f"{a} vs {b}").alias("comparison"), F.lit(b == undefined).alias("bare"),
                 (F.col(f"`{a}`") - F.col(f"`{b}`")).cast("double").alias("difference"))
        for a, b in comparisons])
    rows = wide.select(*keep, query, "metric", F.inline(cells))
    skip = F.col("bare") & F.col("metric").isin(*context_metrics) if context_metrics else F.lit(False)
    return rows.filter(F.col("difference").isNotNull() & ~skip).drop("bare")


def signed_rank(diffs: DataFrame, groups: list[str], difference: str, zeros: str = "drop") -> DataFrame:
    """Wilcoxon signed-rank statistics per group.

    zeros='drop' leaves equal pairs out; zeros='pratt' ranks them but adds their
    ranks to neither side. p is the tie-corrected normal value, 1 if nothing differs.
    """
    d = F.round(F.col(difference), 9)
    kept = diffs.filter(F.col(difference).isNotNull())
    counts = kept.groupBy(*groups, F.abs(d).alias("size")).agg(
        F.count_if(d > 0).alias("pos"), F.count_if(d < 0).alias("neg"), F.count_if(d == 0).alias("zero"))
    ranked_n = F.col("pos") + F.col("neg") + (F.col("zero") if zeros == "pratt" else F.lit(0))
    counts = counts.withColumn("n", ranked_n)
    placed = prefix_sums(counts, groups, "size", {"before": "n"})
    rank = F.col("before") + (F.col("n") + 1) / 2.0
    live = F.col("size") > 0
    n = F.col("n").cast("double")
    sums = placed.groupBy(*groups).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n_nonzero"), F.sum("zero").alias("n_zero"),
        F.sum(F.col("pos") * rank).alias("w_plus"), F.sum(F.col("neg") * rank).alias("w_minus"),
        F.sum(F.col("n") * rank).alias("rank_sum"),
        F.sum(F.when(live, n * n * n - n).otherwise(0.0)).alias("ties"))
    z0 = F.col("n_zero").cast("double") if zeros == "pratt" else F.lit(0.0)
    m = F.col("n_nonzero") + z0
    mean = m * (m + 1) / 4.0 - z0 * (z0 + 1) / 4.0
    var = (m * (m + 1) * (2 * m + 1) - z0 * (z0 + 1) * (2 * z0 + 1)) / 24.0 - F.col("ties") / 48.0
    statistic = F.least("w_plus", "w_minus")
    z = F.when(var > 0, (statistic - mean) / F.sqrt(var))
    return sums.select(
        *groups, "n_nonzero", "n_zero", "w_plus", "w_minus", statistic.alias("statistic"),
        F.when(F.col("n_nonzero") == 0, F.lit(1.0)).otherwise(normal_two_sided(z)).alias("p_value"),
        ratio(F.col("w_plus") - F.col("w_minus"), F.col("rank_sum")).alias("rank_biserial"))


def friedman(scores: DataFrame, groups: list[str], block: str, engine: str, value: str, engines: list[str]) -> DataFrame:
    """Friedman chi-square over complete blocks, tie-corrected, for any number of engines. Null when everything ties.

    The p-value is the chi-square tail at one degree less than engines. Of repeated scores of a block and engine
    the largest counts, so the result doesn't depend on the order of rows.
    """
    k = len(engines)
    if k < 2:
        raise ValueError("friedman compares two engines or more")
    wide = scores.groupBy(*groups, block).pivot(engine, engines).agg(F.max(value))
    v = F.array(*[F.col(f"`{e}`").cast("double") for e in engines])
    complete = wide.filter(F.forall(v, lambda x: x.isNotNull())).withColumn("_v", v)
    below = lambda x: F.size(F.filter("_v", lambda y: y < x))
    same = lambda x: F.size(F.filter("_v", lambda y: y == x))
    ranked = complete.select(
        *groups, F.transform("_v", lambda x: below(x) + (same(x) + 1) / 2.0).alias("_r"),
        array_sum(F.transform("_v", lambda x: (same(x) * same(x) - 1).cast("double"))).alias("_t"))
    sums = ranked.groupBy(*groups).agg(
        F.count("*").alias("n_blocks"), F.sum("_t").alias("_ties"),
        *[F.sum(F.col("_r")[i]).alias(f"_s{i}") for i in range(k)])
    n = F.col("n_blocks").cast("double")
    squares = sum((F.col(f"_s{i}") * F.col(f"_s{i}") for i in range(1, k)), F.col("_s0") * F.col("_s0"))
    raw = 12.0 / (n * k * (k + 1)) * squares - 3.0 * n * (k + 1)
    correction = 1.0 - F.col("_ties") / (n * k * (k * k - 1))
    chi = F.when(correction > 1e-12, raw / correction)
    p = F.when(chi.isNotNull(), chi_square_tail(F.coalesce(chi, F.lit(0.0)), k - 1))
    return sums.select(*groups, "n_blocks", chi.alias("chi_square"), p.alias("p_value"),
                       *[(F.col(f"_s{i}") / n).alias(f"mean_rank_{e}") for i, e in enumerate(engines)])


def bonferroni(p: Column, tests: int = 3) -> Column:
    return F.least(p * tests, F.lit(1.0))


def holm(tests: DataFrame, groups: list[str], p: str, tie: list[str], alpha: float = 0.05) -> DataFrame:
    """Step-down adjusted p-values inside each group of tests; missing p stays missing.

    One row per test, so the windows hold a handful of rows.
    """
    w = Window.partitionBy(*groups)
    order = w.orderBy(F.col(p).asc_nulls_last(), *tie)
    ranked = tests.withColumn("_i", F.row_number().over(order)).withColumn("_m", F.count(p).over(w))
    step = (F.col("_m") - F.col("_i") + 1) * F.col(p)
    running = F.max(step).over(order.rowsBetween(Window.unboundedPreceding, 0))
    adjusted = F.when(F.col(p).isNotNull(), F.least(running, F.lit(1.0)))
    out = ranked.withColumn("p_holm", adjusted).drop("_i", "_m")
    return out.withColumn("significant", F.col("p_holm") < alpha)


def spearman(df: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation over rows that have both values, with n and a t-based p-value."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *groups, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    # pairs of equal values are one row with a weight: the joins below stay small under ties
    pairs = both.groupBy(*groups, "_x", "_y").agg(F.count("*").alias("_w"))

    def ranks(side: str, out: str) -> DataFrame:
        counts = pairs.groupBy(*groups, side).agg(F.sum("_w").alias("_n"))
        placed = prefix_sums(counts, groups, side, {"_b": "_n"})
        return placed.select(*groups, side, (F.col("_b") + (F.col("_n") + 1) / 2.0).alias(out))

    ranked = pairs.join(ranks("_x", "_rx"), [*groups, "_x"]).join(ranks("_y", "_ry"), [*groups, "_y"])
    w, rx, ry = F.col("_w").cast("double"), F.col("_rx"), F.col("_ry")
    sums = ranked.groupBy(*groups).agg(
        F.sum("_w").alias("n"), F.sum(w * rx).alias("sx"), F.sum(w * ry).alias("sy"),
        F.sum(w * rx * ry).alias("sxy"), F.sum(w * rx * rx).alias("sxx"), F.sum(w * ry * ry).alias("syy"))
    n = F.col("n").cast("double")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    rho = F.when((vx > 1e-12) & (vy > 1e-12), F.greatest(F.least(cov / F.sqrt(vx * vy), F.lit(1.0)), F.lit(-1.0)))
    scored = sums.select(*groups, "n", rho.alias("rho"))
    t = F.col("rho") * F.sqrt((n - 2) / (1 - F.col("rho") * F.col("rho")))
    p = F.when(n < 3, F.lit(None).cast("double")).when(F.abs(F.col("rho")) >= 1.0 - 1e-12, F.lit(0.0)).when(
        F.col("rho").isNotNull(), student_two_sided(t, n - 2))
    return scored.withColumn("p_value", p)


def bootstrap_mean(df: DataFrame, groups: list[str], value: str, seed, replicates: int = 10_000, level: float = 0.95) -> DataFrame:
    """Mean and percentile bootstrap interval per group.

    Equal values are drawn together with one Poisson(count) weight, so 0-2 scores
    cost a few draws per replicate however many rows there are. Replicate sums are
    combined before the shuffle.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    drawn = counts.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    weight = poisson_weight(F.col("_n"), seed, *groups, F.round(F.col("_v") * 1000000).cast("long"), F.col("_rep"))
    drawn = drawn.select(*groups, "_rep", "_v", weight.alias("_w"))
    means = drawn.groupBy(*groups, "_rep").agg(ratio(F.sum(F.col("_w") * F.col("_v")), F.sum("_w"), None).alias("_mean"))
    tail = (1 - level) / 2
    ci = means.groupBy(*groups).agg(F.percentile("_mean", F.lit(tail)).alias("low"), F.percentile("_mean", F.lit(1 - tail)).alias("high"))
    point = counts.groupBy(*groups).agg(F.sum("_n").alias("n"), (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean"))
    return point.join(ci, groups, "left")


def discordant(scores: DataFrame, query: str, engine: str, quality: str, answer: str, better: str = "vector", worse: str = "bm25") -> DataFrame:
    """Queries where `better` retrieves better but answers worse than `worse`."""
    wide = scores.groupBy(query).pivot(engine, [worse, better]).agg(F.max(quality).alias("q"), F.max(answer).alias("a"))
    q = lambda e: F.col(f"`{e}_q`")
    a = lambda e: F.col(f"`{e}_a`")
    return wide.filter((q(better) > q(worse)) & (a(better) < a(worse))).select(
        query, q(worse).alias(f"{quality}_{worse}"), q(better).alias(f"{quality}_{better}"),
        a(worse).alias(f"{answer}_{worse}"), a(better).alias(f"{answer}_{better}"))
