"""Descriptive tables: quantiles, importance roll-ups, coverage and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbtrace.functions.scalars import ratio
from .bounded import attach_one, join_on
from .ordered import prefix_sums, top_k


def exact_quantiles(df: DataFrame, groups: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per group from ranks of the distinct values.

    No group is gathered anywhere: distinct values are counted, their positions
    come from bucketed prefix sums, and the two neighbours of each quantile are
    picked by a conditional maximum.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = prefix_sums(counts, groups, "_v", {"_before": "_n"})
    sizes = counts.groupBy(*groups).agg(F.sum("_n").alias("_size")) if groups else counts.agg(F.sum("_n").alias("_size"))
    rows = join_on(placed, sizes, groups) if groups else attach_one(placed, sizes)

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("_before") <= index) & (index < F.col("_before") + F.col("_n")), F.col("_v")))

    position = lambda p: (F.col("_size") - 1) * F.lit(p)
    picked = []
    for name, p in probabilities.items():
        picked += [at(F.floor(position(p))).alias(f"_lo_{name}"), at(F.ceil(position(p))).alias(f"_hi_{name}"),
                   F.max(position(p) - F.floor(position(p))).alias(f"_w_{name}")]
    out = rows.groupBy(*groups).agg(*picked) if groups else rows.agg(*picked)
    return out.select(*groups, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n) for n in probabilities])


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def describe_by(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """count, mean, sample deviation, minimum, quartiles and maximum per group."""
    v = F.col(value).cast("double")
    simple = df.groupBy(*groups).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return join_on(simple, exact_quantiles(df, groups, value, QUARTILES), groups, "left")


def describe_with_overall(df: DataFrame, group: str, value: str, overall: str = "overall") -> DataFrame:
    """describe_by plus one row over all groups."""
    both = df.select(F.explode(F.array(F.col(group).cast("string"), F.lit(overall))).alias(group), value)
    return describe_by(both, [group], value)


def mean_std(df: DataFrame, groups: list[str], values: list[str]) -> DataFrame:
    return df.groupBy(*groups).agg(
        *[c for v in values for c in (F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std"))])


def global_importance(df: DataFrame, groups: list[str], feature: str, attribution: str) -> DataFrame:
    """Mean absolute attribution per feature."""
    return df.groupBy(*groups, feature).agg(F.avg(F.abs(F.col(attribution))).alias("importance"))


def surrogate_rollup(df: DataFrame, row_key: list[str], feature: str, weight: str, per_row: int = 10, keep: int = 50) -> DataFrame:
    """Share of each feature in the absolute weights of every row's strongest rules."""
    strongest = top_k(df, row_key, [F.abs(F.col(weight)).desc(), F.col(feature)], per_row, "_r")
    sums = strongest.groupBy(feature).agg(F.sum(F.abs(F.col(weight))).alias("_s"))
    total = sums.agg(F.sum("_s").alias("_t"))
    shares = attach_one(sums, total).select(feature, ratio(F.col("_s"), F.col("_t")).alias("importance"))
    return shares.orderBy(F.col("importance").desc(), feature).limit(keep)


def duplicate_pairs(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Keys seen more than once, and whether their scores disagree."""
    conflict = F.greatest(*[F.count_distinct(m) for m in metrics]) if len(metrics) > 1 else F.count_distinct(metrics[0])
    return df.groupBy(*keys).agg(F.count("*").alias("n"), (conflict > 1).alias("conflicting")).filter("n > 1")


def coverage_audit(results: DataFrame, expected: DataFrame, query: str, engine: str, engines: list[str]) -> DataFrame:
    """Counters of a result table against its query list, and an overall pass flag."""
    malformed = F.coalesce(F.col(query).cast("string"), F.lit("")) == ""
    no_engine = F.coalesce(F.col(engine), F.lit("")) == ""
    usable = results.filter(~malformed & ~no_engine)
    known = F.col(engine).isin(*engines)
    per_pair = usable.groupBy(query, engine).agg(F.count("*").alias("n"))
    per_query = per_pair.groupBy(query).agg(
        F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("duplicates"),
        F.count_if(known).alias("engines"), F.count_if(~known).alias("unknown"),
        F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("unknown_rows"))
    asked = expected.groupBy(query).agg(F.count("*").alias("asked"))
    both = asked.join(per_query, query, "full")
    found, wanted = F.col("rows").isNotNull(), F.col("asked").isNotNull()
    facts = both.agg(
        F.count_if(wanted).alias("expected_queries"),
        F.count_if(wanted & found & (F.col("engines") == len(engines)) & (F.col("rows") == len(engines))).alias("complete_queries"),
        F.count_if(wanted & ~found).alias("missing_queries"),
        F.count_if(wanted & (F.coalesce("engines", F.lit(0)) < len(engines))).alias("queries_missing_engines"),
        F.count_if(~wanted).alias("unexpected_queries"),
        F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicate_pairs"),
        F.count_if(F.col("asked") > 1).alias("duplicate_expected"),
        F.coalesce(F.sum("unknown_rows"), F.lit(0)).alias("unexpected_engine_rows"))
    broken = results.agg(F.count_if(malformed | no_engine).alias("malformed_rows"), F.count("*").alias("result_rows"))
    problems = ["missing_queries", "queries_missing_engines", "unexpected_queries", "duplicate_pairs",
                "duplicate_expected", "unexpected_engine_rows", "malformed_rows"]
    passed = sum((F.col(c) for c in problems[1:]), F.col(problems[0])) == 0
    return attach_one(facts, broken).withColumn("passed", passed)


def win_tie_loss(pairs: DataFrame, groups: list[str], difference: str) -> DataFrame:
    d = F.col(difference)
    return pairs.groupBy(*groups).agg(
        F.count(d).alias("n"), F.avg(d).alias("mean_diff"),
        F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d < 0).alias("losses"))


def distribution(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts row x column with a total per row and a row of totals."""
    counts = df.select(F.explode(F.array(F.col(row).cast("string"), F.lit("total"))).alias(row), column)
    wide = counts.groupBy(row).pivot(column, values).agg(F.count(F.lit(1)))
    filled = wide.select(row, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(v) for v in values])
    return filled.withColumn("total", sum((F.col(f"`{v}`") for v in values[1:]), F.col(f"`{values[0]}`")))


def request_statistics(log: DataFrame, success: Column, tokens: str) -> DataFrame:
    calls, ok = F.count("*"), F.count_if(success)
    used = F.coalesce(F.sum(F.when(success, F.col(tokens))), F.lit(0))
    return log.agg(calls.alias("calls"), ok.alias("successes"), used.alias("tokens"),
                   ratio(ok, calls).alias("success_rate"), ratio(used, ok).alias("mean_tokens"))


def cumulative_selection(importance: DataFrame, feature: str, value: str, share: float = 0.99, floor: float = 0.8,
                         groups: list[str] | None = None) -> DataFrame:
    """Features in order until their running share reaches `share`, at least floor*n + 1 of them.

    One row per feature: the windows see tens to thousands of rows, never the data.
    """
    groups = groups or []
    order = [F.col(value).desc(), F.col(feature)]
    w = Window.partitionBy(*groups)
    running = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = importance.select(
        *groups, feature, value,
        F.row_number().over(w.orderBy(*order)).alias("rank"),
        F.count("*").over(w).alias("_n"),
        ratio(F.sum(value).over(running), F.sum(value).over(w)).alias("cumulative_share"))
    reached = F.min(F.when(F.col("cumulative_share") >= share, F.col("rank"))).over(w)
    keep = F.greatest(F.coalesce(reached, F.col("_n")), F.floor(F.lit(floor) * F.col("_n") + 1).cast("int"))
    return ranked.withColumn("_keep", keep).filter("rank <= _keep").drop("_n", "_keep")


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The earliest row of each key: a map-side aggregate, no sort of the group."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row")).select(*keys, "_row.*")


def feature_ranks(df: DataFrame, groups: list[str], feature: str, value: str, out: str = "rank") -> DataFrame:
    """Rank of each feature by absolute value; ties go to the smaller feature."""
    w = Window.partitionBy(*groups).orderBy(F.abs(F.col(value)).desc(), F.col(feature))
    return df.withColumn(out, F.row_number().over(w))


def common_features(df: DataFrame, model: str, feature: str, value: str, k: int, models: int) -> DataFrame:
    """Features that are among the first k of every model."""
    best = top_k(df, [model], [F.abs(F.col(value)).desc(), F.col(feature)], k)
    return best.groupBy(feature).agg(F.count_distinct(model).alias("models")).filter(F.col("models") == models).select(feature)


def side_by_side(df: DataFrame, model: str, feature: str, value: str, k: int, models: list[str]) -> DataFrame:
    """First k features of each model as columns, one row per rank."""
    best = top_k(df, [model], [F.abs(F.col(value)).desc(), F.col(feature)], k)
    return best.groupBy("rank").pivot(model, models).agg(F.first(feature))
