"""Checks that run before a model sees the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbtrace.functions.scalars import ratio
from .bounded import attach_one
from .cleaning import nan_as_null, quoted


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def positive_weight(df: DataFrame, label: str, positive) -> DataFrame:
    """Negatives per positive."""
    pos = F.count_if(quoted(label) == positive)
    neg = F.count_if(quoted(label) != positive)
    return df.agg(neg.alias("n_negative"), pos.alias("n_positive"), ratio(neg, pos, None).alias("weight"))


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """One row per class: n / (classes * rows of the class)."""
    counts = class_counts(df, label)
    whole = counts.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    return attach_one(counts, whole).select(
        label, "n", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str, weights: DataFrame, out: str = "weight") -> DataFrame:
    """Attach the class weight to rows; the class table is collected into a literal map."""
    pairs = {r[label]: r["weight"] for r in weights.select(label, "weight").limit(10_001).collect()}
    if len(pairs) > 10_000:
        return df.join(weights.select(label, F.col("weight").alias(out)), label, "left")
    lookup = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return df.withColumn(out, lookup[quoted(label)])


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first copy, and their share in percent."""
    counts = df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count("*").alias("_n"))
    total, extra = F.sum("_n"), F.sum(F.col("_n") - 1)
    return counts.agg(total.alias("n_rows"), extra.alias("n_duplicates"),
                      (100.0 * ratio(extra, total)).alias("percent"))


def distinct_including_null(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Distinct values per class, a missing value (null or NaN) counting as one more."""
    return nan_as_null(df, columns).groupBy(label).agg(*[
        (F.count_distinct(quoted(c)) + F.max(quoted(c).isNull().cast("int"))).alias(c) for c in columns])


def null_ratio(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Share of missing values (null or NaN) per class."""
    return nan_as_null(df, columns).groupBy(label).agg(*[F.avg(quoted(c).isNull().cast("double")).alias(c) for c in columns])


def leakage_audit(df: DataFrame, label: str, malicious, columns: list[str]) -> DataFrame:
    """Three flags per column from one pass over the table.

    A column is constant when it has one value and no gaps, or only gaps; min = max
    decides that without counting distinct values. NaN is a gap.
    """
    df = nan_as_null(df, columns)
    bad = quoted(label) == malicious

    def facts(c: str, side: str, cond):
        v = F.when(cond, quoted(c))
        return [
            F.min(v).cast("string").alias(f"{c}|{side}|min"), F.max(v).cast("string").alias(f"{c}|{side}|max"),
            F.count(v).alias(f"{c}|{side}|count"),
        ]

    sides = {"mal": bad, "ben": ~bad, "all": F.lit(True)}
    aggregates = [F.count_if(cond).alias(f"|{s}|rows") for s, cond in sides.items()]
    for c in columns:
        for s, cond in sides.items():
            aggregates += facts(c, s, cond)
    wide = df.agg(*aggregates)

    def constant(c: str, s: str):
        count, rows = F.col(f"`{c}|{s}|count`"), F.col(f"`|{s}|rows`")
        single = (F.col(f"`{c}|{s}|min`") == F.col(f"`{c}|{s}|max`")) & (count == rows)
        return F.coalesce((rows > 0) & ((count == 0) | single), F.lit(False))

    def variable(c: str, s: str):
        return (F.col(f"`|{s}|rows`") > 0) & ~constant(c, s)

    def empty(c: str, s: str):
        return (F.col(f"`|{s}|rows`") > 0) & (F.col(f"`{c}|{s}|count`") == 0)

    rows = [
        F.struct(
            F.lit(c).alias("column"),
            (constant(c, "mal") & variable(c, "ben")).alias("constant_in_malicious"),
            (empty(c, "mal") & ~empty(c, "ben")).alias("missing_in_malicious"),
            constant(c, "all").alias("constant_overall"),
        )
        for c in columns
    ]
    return wide.select(F.inline(F.array(*rows)))
