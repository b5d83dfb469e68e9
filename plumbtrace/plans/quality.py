"""Explanation quality: combined scores and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbtrace.operators.bounded import attach_one
from plumbtrace.operators import quality

# Weights of the three dimensions.
DIMENSIONS = {"faithfulness": 0.40, "robustness": 0.35, "complexity": 0.25}


def overall_quality(scores: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of the dimensions; a missing dimension adds nothing."""
    weights = weights or DIMENSIONS
    total = F.lit(0.0)
    for name, w in weights.items():
        if name in scores:
            total = total + F.coalesce(scores[name] * w, F.lit(0.0))
    return total


def average_quality(cases: DataFrame, groups: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Mean dimension and overall scores per group of cases."""
    scored = cases.withColumn("overall", overall_quality({n: F.col(n) for n in DIMENSIONS if n in cases.columns}, weights))
    names = [n for n in DIMENSIONS if n in cases.columns]
    return scored.groupBy(*groups).agg(F.count("*").alias("n"), *[F.avg(n).alias(n) for n in names], F.avg("overall").alias("overall"))


def global_vector(df: DataFrame, phi: str, size: int) -> list[float]:
    """Mean absolute attribution of every feature: one row of `size` numbers."""
    row = df.agg(*[F.avg(F.abs(F.col(phi)[i])).alias(f"f{i}") for i in range(size)]).first()
    return [float(v or 0.0) for v in row]


def quality_per_case(df: DataFrame, keys: list[str], x: str, baseline: list[float], scorer, explainer, label: str,
                     seed=42, draws: int = quality.DRAWS, k: int = quality.TOP_FEATURES, weights: dict[str, float] | None = None) -> DataFrame:
    """All three dimensions for every row, next to its label, prediction and correctness."""
    explained = explainer.explain(df, keys, x, "phi")
    faithful = quality.faithfulness(explained, keys, x, "phi", baseline, scorer)
    robust = quality.robustness(faithful, keys, x, "phi", explainer, seed, draws, k)
    scored = quality.complexity(robust, "phi")
    dims = {n: F.col(n) for n in DIMENSIONS}
    return scored.withColumn("overall", overall_quality(dims, weights)).withColumnRenamed("target", "predicted_label").withColumn(
        "prediction_correct", F.col("predicted_label") == F.col(label))


def global_quality(df: DataFrame, keys: list[str], x: str, phi: str, baseline: list[float], scorer, seed=42,
                   k: int = quality.TOP_FEATURES, subsets: int = quality.SUBSETS, digits: int | None = None) -> DataFrame:
    """Quality of the one ranking that holds for the whole table."""
    ranking = global_vector(df, phi, len(baseline))
    ranking = ranking if digits is None else [round(v, digits) for v in ranking]
    faithful = quality.faithfulness(df, keys, x, phi, baseline, scorer, ranking).agg(
        F.avg("deletion_auc").alias("deletion_auc"), F.avg("insertion_auc").alias("insertion_auc"),
        F.avg("ablation_correlation").alias("ablation_correlation"), F.avg("faithfulness").alias("faithfulness"))
    robust = quality.global_robustness(df, keys, phi, len(baseline), seed, subsets, k=k)
    both = attach_one(faithful, robust).withColumn("phi_all", F.array(*[F.lit(v) for v in ranking]))
    scored = quality.complexity(both, "phi_all").drop("phi_all")
    return scored.withColumn("overall", overall_quality({n: F.col(n) for n in DIMENSIONS}))


def quality_document(df: DataFrame, sample: str, label: str) -> DataFrame:
    """One nested JSON result per case, in the layout of the stored quality results."""
    return df.select(F.to_json(F.struct(
        F.col("overall").alias("overall_score"),
        F.struct(F.col("faithfulness").alias("overall_score"), "deletion_auc", "insertion_auc", "ablation_correlation").alias("faithfulness"),
        F.struct(F.col("robustness").alias("overall_score"), "jaccard_similarity", "importance_variance").alias("robustness"),
        F.struct(F.col("complexity").alias("overall_score"), "sparsity", "effective_complexity").alias("complexity"),
        F.col(sample).alias("sample_index"), F.col(label).cast("int").alias("true_label"), "predicted_label", "prediction_correct",
    )).alias("document"))
