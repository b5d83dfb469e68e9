"""Overlap of candidate and reference texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbtrace.functions.binding import let
from plumbtrace.functions.scalars import dot, ratio

OVERLAP_TOKEN = "[a-z0-9]+"


def overlap_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(OVERLAP_TOKEN), 0)


def ngrams(tokens: Column, n: int) -> Column:
    if n == 1:
        return tokens
    return let(tokens, lambda t: F.when(F.size(t) < n, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " "))))


def f_measure(hits: Column, candidate: Column, reference: Column) -> Column:
    p, r = ratio(hits, candidate), ratio(hits, reference)
    return ratio(2 * p * r, p + r)


def rouge_n(pairs: DataFrame, key: list[str], candidate: str, reference: str, n: int) -> DataFrame:
    """Precision, recall and F of shared n-grams, repeated ones counted as often as both have them.

    Grams are counted per (pair, gram), so even a very long text is spread out.
    """
    sides = pairs.select(*key, F.explode(F.array(
        F.struct(F.lit(1).alias("c"), F.lit(0).alias("r"), ngrams(overlap_tokens(F.col(candidate)), n).alias("g")),
        F.struct(F.lit(0).alias("c"), F.lit(1).alias("r"), ngrams(overlap_tokens(F.col(reference)), n).alias("g")),
    )).alias("s"))
    # explode_outer keeps a pair whose texts have no grams at all
    grams = sides.select(*key, "s.c", "s.r", F.explode_outer("s.g").alias("gram"))
    has = F.col("gram").isNotNull().cast("int")
    counts = grams.groupBy(*key, "gram").agg(F.sum(F.col("c") * has).alias("c"), F.sum(F.col("r") * has).alias("r"))
    sums = counts.groupBy(*key).agg(F.sum(F.least("c", "r")).alias("hits"), F.sum("c").alias("c"), F.sum("r").alias("r"))
    return sums.select(*key, ratio(F.col("hits"), F.col("c")).alias("precision"), ratio(F.col("hits"), F.col("r")).alias("recall"),
                       f_measure(F.col("hits"), F.col("c"), F.col("r")).alias("f1"))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence: one bit per token of `a`, one pass over `b`."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        shared = row & places.get(w, 0)
        row = ((row + shared) | (row - shared)) & full
    return len(a) - bin(row).count("1")


@F.pandas_udf(T.IntegerType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(x), list(y)) for x, y in zip(a, b)])


def rouge_l(pairs: DataFrame, key: list[str], candidate: str, reference: str) -> DataFrame:
    """F-measure of the longest common subsequence of whole texts (Arrow batches)."""
    t = pairs.select(*key, overlap_tokens(F.col(candidate)).alias("c"), overlap_tokens(F.col(reference)).alias("r"))
    scored = t.select(*key, F.size("c").alias("nc"), F.size("r").alias("nr"), _lcs("c", "r").alias("lcs"))
    return scored.select(*key, ratio(F.col("lcs"), F.col("nc")).alias("precision"), ratio(F.col("lcs"), F.col("nr")).alias("recall"),
                         f_measure(F.col("lcs"), F.col("nc"), F.col("nr")).alias("f1"))


BLOCK = 64


def embedding_match(tokens: DataFrame, pair: str, side: str, position: str, vector: str,
                    candidate: str = "candidate", reference: str = "reference") -> DataFrame:
    """Greedy match of token vectors: mean best cosine seen from either side.

    Tokens meet blocks of the other side's vectors in an equi-join on the pair; the
    best value per token is a map-side maximum, so no pair is gathered as a whole.
    """
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    unit = tokens.select(pair, side, position, F.transform(vector, lambda x: x.cast("double") / norm).alias("_v"))
    blocks = unit.groupBy(pair, side, F.floor(F.col(position) / BLOCK).alias("_b")).agg(F.collect_list("_v").alias("_vs"))
    other = blocks.withColumn(side, F.when(F.col(side) == candidate, reference).otherwise(candidate))
    best = unit.join(other, [pair, side]).select(
        pair, side, position, F.array_max(F.transform("_vs", lambda w: dot(F.col("_v"), w))).alias("_s"))
    per_token = best.groupBy(pair, side, position).agg(F.max("_s").alias("_s"))
    means = per_token.groupBy(pair).agg(
        F.avg(F.when(F.col(side) == candidate, F.col("_s"))).alias("precision"),
        F.avg(F.when(F.col(side) == reference, F.col("_s"))).alias("recall"))
    return means.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
