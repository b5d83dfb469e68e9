"""Evaluate an intermediate value once.

Spark merges neighbouring projections, so a column used inside a lambda would be
computed again for every element. `let` binds a value inside one expression,
`bind` fixes whole columns before later projections use them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a one-element generator, which projections do not merge across."""
    kept = [c for c in df.columns if c not in columns]
    one = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*kept, F.inline(F.array(one)))
