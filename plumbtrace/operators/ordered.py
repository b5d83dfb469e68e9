"""Global order without a one-task window.

Values are cut into buckets at quantile boundaries. Bucket totals are few, so a
window over them gives each bucket its offset; inside a bucket an ordinary
window finishes the job. Rows that share a value are collapsed before any
window sees them, so one very frequent value is one row.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from .bounded import join_on

BUCKETS = 256


def boundaries(df: DataFrame, value: str, buckets: int = BUCKETS) -> list[float]:
    """Distinct finite quantiles of a numeric column: at most `buckets` numbers reach the driver.

    Infinite values need no bound of their own: they fall in the first or the last bucket.
    """
    probes = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(F.col(value).cast("double"), probes, 10 * buckets).alias("q")).first()
    return sorted({float(v) for v in (row["q"] or []) if v is not None and math.isfinite(v)})


def with_bucket(df: DataFrame, value: str, bounds: list[float], out: str = "_bucket") -> DataFrame:
    """Number of boundaries at or below the value (binary search in the JVM)."""
    if not bounds:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *bounds, float("inf")]
    tagged = Bucketizer(splits=splits, inputCol="_bucketed", outputCol=out, handleInvalid="keep").transform(
        df.withColumn("_bucketed", F.col(value).cast("double")))
    return tagged.withColumn(out, F.col(out).cast("int")).drop("_bucketed")


def prefix_sums(collapsed: DataFrame, groups: list[str], value: str, sums: dict[str, str],
                tie: list[str] | None = None, descending: bool = False,
                bounds: list[float] | None = None) -> DataFrame:
    """Add, for each (output, input) in `sums`, the sum over strictly earlier rows.

    `collapsed` holds one row per (groups, value[, tie]). Order is by value, then
    by the tie columns; `descending` turns the value order around.
    """
    tie = tie or []
    bounds = boundaries(collapsed, value) if bounds is None else bounds
    tagged = with_bucket(collapsed, value, bounds)
    sign = -1 if descending else 1
    tagged = tagged.withColumn("_bucket", F.col("_bucket") * sign)
    totals = tagged.groupBy(*groups, "_bucket").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    across = Window.partitionBy(*[F.col(g) for g in groups]).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *groups, "_bucket", *[F.coalesce(F.sum(f"_t_{o}").over(across), F.lit(0)).alias(f"_o_{o}") for o in sums])
    order = [F.col(value).desc() if descending else F.col(value).asc(), *[F.col(t) for t in tie]]
    inside = Window.partitionBy(*groups, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_l_{o}") for o, c in sums.items()])
    joined = join_on(local, offsets, [*groups, "_bucket"])
    return joined.select(
        *collapsed.columns, *[(F.col(f"_l_{o}") + F.col(f"_o_{o}")).alias(o) for o in sums])


def mid_ranks(df: DataFrame, groups: list[str], value: str, out: str = "rank", descending: bool = False) -> DataFrame:
    """One row per distinct value with its tie count `n` and average rank."""
    collapsed = df.groupBy(*groups, value).agg(F.count("*").alias("n"))
    ranked = prefix_sums(collapsed, groups, value, {"_before": "n"}, descending=descending)
    return ranked.withColumn(out, F.col("_before") + (F.col("n") + 1) / 2.0).drop("_before")


def with_mid_ranks(df: DataFrame, groups: list[str], value: str, out: str = "rank", descending: bool = False) -> DataFrame:
    """Attach the average rank to every row.

    The rank table has one row per distinct value, and a frequent value meets
    exactly one rank row, so AQE can split its side of the join.
    """
    ranks = mid_ranks(df, groups, value, out, descending).drop("n")
    return join_on(df, ranks, [*groups, value])


TIE_BUCKETS = 64


def row_numbers(df: DataFrame, value: str, tie: list[str], out: str, groups: list[str] | None = None,
                descending: bool = False) -> DataFrame:
    """row_number over (groups ordered by value, tie) where `tie` makes rows distinct.

    A value held by very many rows is spread over sub-buckets of the tie order:
    the first tie column is cut at its own quantiles, so sub-buckets keep order.
    """
    groups = groups or []
    tie_bounds = boundaries(df, tie[0], TIE_BUCKETS)
    tagged = with_bucket(df, tie[0], tie_bounds, "_sub")
    collapsed = tagged.groupBy(*groups, value, "_sub").agg(F.count("*").alias("n"))
    offsets = prefix_sums(collapsed, groups, value, {"_before": "n"}, tie=["_sub"], descending=descending).drop("n")
    inside = Window.partitionBy(*groups, value, "_sub").orderBy(*tie)
    numbered = tagged.withColumn("_in", F.row_number().over(inside))
    return join_on(numbered, offsets, [*groups, value, "_sub"]).withColumn(out, F.col("_in") + F.col("_before")).drop("_in", "_before", "_sub")


def hash_row_numbers(df: DataFrame, hashed: str, tie: list[str], out: str, bits: int = 16,
                     groups: list[str] | None = None) -> DataFrame:
    """row_number in the order of a uniform 32-bit number: buckets are its leading bits."""
    groups = groups or []
    tagged = df.withColumn("_b", F.shiftright(hashed, 32 - bits).cast("int"))
    counts = tagged.groupBy(*groups, "_b").agg(F.count("*").alias("_n"))
    across = Window.partitionBy(*[F.col(g) for g in groups]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, "_b", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*groups, "_b").orderBy(hashed, *tie)
    return join_on(tagged.withColumn("_in", F.row_number().over(inside)), offsets, [*groups, "_b"]).withColumn(
        out, F.col("_in") + F.col("_before")).drop("_in", "_before", "_b")


def top_k(df: DataFrame, groups: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """First k rows per group. Each map task keeps only its own first k before the shuffle."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)
