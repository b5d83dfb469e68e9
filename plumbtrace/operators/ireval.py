"""Retrieval metrics of ranked lists."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from plumbtrace.functions.scalars import array_sum, ratio, rounded
from .bounded import join_on


def first_hit(relevant: Column) -> Column:
    """One-based position of the first true element, null without one."""
    p = F.array_position(relevant, True)
    return F.when(p > 0, p).cast("int")


def first_hit_rank(df: DataFrame, keys: list[str], order: str, hit: Column) -> DataFrame:
    """(keys, first_hit): rank of the first row that is a hit, over the whole list of each key; null without one.

    Two aggregates and no gathered list, so lists of any length will do. `order` ranks rows without ties.
    """
    first = df.groupBy(*keys).agg(F.min(F.when(hit, F.col(order))).alias("_first"))
    joined = join_on(df.select(*keys, order), first, keys)
    n = F.count_if(F.col(order) <= F.col("_first")).cast("int")
    return joined.groupBy(*keys).agg(F.when(n > 0, n).alias("first_hit"))


def precision_at(relevant: Column, k: int) -> Column:
    """Hits among the first k over k, however short the list is."""
    return F.size(F.filter(F.slice(relevant, 1, k), lambda r: r)) / F.lit(float(k))


def recall_at(relevant: Column, total: Column, k: int) -> Column:
    return ratio(F.size(F.filter(F.slice(relevant, 1, k), lambda r: r)), total)


def hit_at(relevant: Column, k: int) -> Column:
    return F.exists(F.slice(relevant, 1, k), lambda r: r).cast("int")


def reciprocal_rank(relevant: Column) -> Column:
    """Over the whole list, not only its first k."""
    return F.coalesce(1.0 / first_hit(relevant), F.lit(0.0))


def ndcg_at(relevant: Column, total: Column, k: int) -> Column:
    gains = F.transform(F.slice(relevant, 1, k), lambda r, i: F.when(r, 1.0 / F.log2(i + 2.0)).otherwise(0.0))
    discounts = F.array(*[F.lit(1.0 / math.log2(i + 2)) for i in range(k)])
    ideal = array_sum(F.slice(discounts, 1, F.least(total, F.lit(k)).cast("int")))
    return F.when(total > 0, array_sum(gains) / ideal).otherwise(F.lit(0.0))


def relevance_join(runs: DataFrame, qrels: DataFrame, query: str, engine: str, ids: str, item: str) -> DataFrame:
    """One row per retrieved item with its rank and whether it is marked relevant."""
    marks = qrels.filter(F.col(item).isNotNull()).select(query, item).distinct().withColumn("_hit", F.lit(True))
    rows = runs.select(query, engine, F.posexplode(ids).alias("_pos", item)).join(marks, [query, item], "left")
    return rows.select(query, engine, (F.col("_pos") + 1).alias("rank"), item, F.coalesce("_hit", F.lit(False)).alias("relevant"))


def judged_runs(runs: DataFrame, qrels: DataFrame, query: str, engine: str, ids: str, item: str) -> DataFrame:
    """Add `relevant` (true/false by rank) and `n_relevant` to each run.

    Only retrieved items are looked up; judgements are counted, never gathered, so a
    query may have any number of them. A query without judgements gets zero.
    """
    marks = qrels.filter(F.col(item).isNotNull()).select(query, item).distinct()
    totals = marks.groupBy(query).agg(F.count("*").cast("int").alias("n_relevant"))
    found = relevance_join(runs, marks, query, engine, ids, item)
    flags = found.groupBy(query, engine).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("relevant").alias("hit")))).alias("_f"))
    joined = runs.join(flags, [query, engine], "left").join(totals, query, "left")
    relevant = F.coalesce(F.transform("_f", lambda x: x["hit"]), F.array().cast("array<boolean>"))
    return joined.withColumn("relevant", relevant).withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0))).drop("_f")


def score_runs(judged: DataFrame, query: str, engine: str, ids: str, k: int = 3, undefined: str = "none") -> DataFrame:
    """All retrieval metrics per run; null for the engine without retrieval and for empty lists."""
    defined = (F.col(engine) != undefined) & (F.size(ids) > 0)
    rel, total = F.col("relevant"), F.col("n_relevant")
    metrics = {
        f"precision_at_{k}": precision_at(rel, k), f"recall_at_{k}": recall_at(rel, total, k),
        f"hit_at_{k}": hit_at(rel, k).cast("double"), "mrr": reciprocal_rank(rel), f"ndcg_at_{k}": ndcg_at(rel, total, k),
    }
    return judged.select(query, engine, *[F.when(defined, c).alias(n) for n, c in metrics.items()])


def engine_summary(scores: DataFrame, engine: str, metrics: list[str], digits: int = 4) -> DataFrame:
    """Mean over the runs where the metric is defined."""
    return scores.groupBy(engine).agg(*[rounded(F.avg(m), digits).alias(m) for m in metrics], F.count(metrics[0]).alias("n"))
