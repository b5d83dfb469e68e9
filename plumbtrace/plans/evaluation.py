"""Evaluation reports put together from the paired operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbtrace.operators import paired, summaries
from plumbtrace.streaming.resume import work_grid


def category_means(scores: DataFrame, category: Column, engine: str, seed, replicates: int = 10_000,
                   undefined: str = "none", context_metrics=paired.CONTEXT_METRICS) -> DataFrame:
    """Mean and interval per category, engine and metric; context metrics need retrieval."""
    defined = ~((F.col(engine) == undefined) & F.col("metric").isin(*context_metrics))
    rows = scores.filter(defined).withColumn("category", category)
    return paired.bootstrap_mean(rows, ["category", engine, "metric"], "score", seed, replicates)


def category_differences(diffs: DataFrame, category: Column, seed, replicates: int = 10_000) -> DataFrame:
    rows = diffs.withColumn("category", category)
    return paired.bootstrap_mean(rows, ["category", "comparison", "metric"], "difference", seed, replicates)


def correlation_subsets(df: DataFrame, keep: Column, groups: list[str], x: str, y: str, name: str, whole: str = "all queries") -> DataFrame:
    """Rank correlation over all rows and over the rows that satisfy `keep`, in one pass."""
    marked = df.withColumn("_keep", keep)
    subsets = marked.withColumn("subset", F.explode(F.when(F.col("_keep"), F.array(F.lit(whole), F.lit(name))).otherwise(F.array(F.lit(whole)))))
    return paired.spearman(subsets, ["subset", *groups], x, y)


def ablation_comparison(before: DataFrame, after: DataFrame, query: str, engine: str, metric: str) -> DataFrame:
    """Summary per engine and overall, before and after, on the queries of the later run."""
    shared = before.join(after.select(query).distinct(), query, "left_semi")
    both = shared.select(F.lit("pre").alias("dataset"), engine, metric).unionByName(after.select(F.lit("post").alias("dataset"), engine, metric))
    rows = both.select("dataset", F.explode(F.array(F.col(engine), F.lit("overall"))).alias(engine), metric)
    return summaries.describe_by(rows, ["dataset", engine], metric)


def judge_vs_human(sheet: DataFrame, key: DataFrame, on: str, human: str, judge: str) -> DataFrame:
    """Agreement counts after the blinded sheet meets its key."""
    joined = sheet.join(key, on)
    return joined.groupBy(human, judge).agg(F.count("*").alias("n")).withColumn("agrees", F.col(human) == F.col(judge))


def judge_statistics(raw: DataFrame, keys: list[str], order: str, metrics: list[str], engine: str) -> DataFrame:
    """First judgement per key, then statistics per engine and metric."""
    first = summaries.first_per_key(raw, keys, order)
    long = paired.long_scores(first.select(*keys, *metrics), keys, metrics)
    return summaries.describe_by(long, [engine, "metric"], "score")


def missing_pairs(queries: DataFrame, found: DataFrame, query: str, engine: str, engines: list[str]) -> DataFrame:
    return work_grid(queries.select(query), engines, engine).join(found.select(query, engine), [query, engine], "left_anti")


def significance_table(diffs: DataFrame) -> DataFrame:
    """Counts, effect size, raw and Holm-adjusted p per comparison and metric."""
    groups = ["comparison", "metric"]
    counts = summaries.win_tie_loss(diffs, groups, "difference")
    tests = paired.signed_rank(diffs, groups, "difference").select(*groups, "rank_biserial", "p_value")
    adjusted = paired.holm(tests, ["comparison"], "p_value", ["metric"]).drop("significant")
    return counts.join(adjusted, groups)
