"""Lookup joins that attach reference data to rows."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Texts used when a query has no evidence file, or none can be found.
NO_EVIDENCE = "No XAI data provided."
MISSING_EVIDENCE = "Error loading XAI: not found"
UNREADABLE_EVIDENCE = "Error loading XAI: "
EVIDENCE_CHARS = 1500


def _one_line_json(text: str | None, limit: int) -> str | None:
    """The start of a JSON document on one line, or why it can't be read."""
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text))[:limit]
    except (ValueError, RecursionError) as error:
        return f"{UNREADABLE_EVIDENCE}{error}"


def evidence_lookup(queries: DataFrame, documents: DataFrame, key: str, text: str,
                    limit: int = EVIDENCE_CHARS) -> DataFrame:
    """Attach the first `limit` characters of the document a query names.

    Documents named `.json` are first written on one line without indentation,
    so that white space takes none of the limit; one that is no JSON gives an
    error text. Every document is cut before the join, whole texts aren't shuffled.
    """
    @F.pandas_udf("string")
    def one_line(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _one_line_json(t, limit))

    wanted = F.lower(F.coalesce(F.col(key), F.lit("none")))
    is_json = F.col(key).endswith(".json")
    docs = documents.select(F.col(key), F.coalesce(
        one_line(F.when(is_json, F.col(text))),
        F.when(~is_json, F.substring(F.col(text), 1, limit))).alias("_evidence"))
    joined = queries.join(docs, key, "left")
    return joined.withColumn(
        "evidence",
        F.when(wanted.isin("none", ""), F.lit(NO_EVIDENCE)).otherwise(
            F.coalesce(F.col("_evidence"), F.lit(MISSING_EVIDENCE))),
    ).drop("_evidence")


def lookup(df: DataFrame, table: DataFrame, on: list[str], value: str, default) -> DataFrame:
    """Left join one value column; rows without a partner get the default."""
    right = table.select(*on, F.col(value).alias("_looked_up"))
    joined = df.join(right, on, "left")
    return joined.withColumn(value, F.coalesce(F.col("_looked_up"), F.lit(default))).drop("_looked_up")


def category_of(key: Column, groups: dict[str, list[str]], default: str) -> Column:
    """Name of the listed group that holds the key, or the default name."""
    out = None
    for name, members in groups.items():
        hit = key.isin(*members)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def complete_pairs(df: DataFrame, keys: list[str], side: str, left: str, right: str, value: str) -> DataFrame:
    """Value under two sides next to each other, for keys that have both."""
    wide = df.filter(F.col(side).isin(left, right)).groupBy(*keys).pivot(side, [left, right]).agg(F.first(value))
    return wide.select(*keys, F.col(left).alias("a"), F.col(right).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
