"""Broadcast only what has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

LIMIT_ROWS = 20_000


def broadcast_if_small(df: DataFrame, limit: int = LIMIT_ROWS) -> DataFrame:
    """Compute a summary table once; broadcast it when it has at most `limit` rows.

    At most limit + 1 rows reach the driver. A larger table is returned untouched,
    so that the join shuffles and every row is still there.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def attach_one(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row, as scalar subqueries."""
    return df.select("*", *[one.select(c).scalar().alias(c) for c in one.columns])


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches a missing key with a missing key.

    Groups may have a null name; an ordinary join would lose their rows.
    """
    if not keys:
        raise ValueError("join_on needs at least one key")
    renamed = right.select(*[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])
