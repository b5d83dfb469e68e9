"""Paired tests, corrections, correlations and intervals on judge-like scores of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbtrace.functions.scalars import rounded, stars
from plumbtrace.operators import enrich, paired, summaries
from plumbtrace.plans import evaluation

from .metrics import rnd
from .randomness import poisson_cdf_sql, poisson_sql
from .ranking import DESCRIBE, STATS
from .registry import Tables, query

ENGINES = ["none", "bm25", "vector"]
METRICS = list(paired.JUDGE_METRICS)
ENGINE_SQL = "CASE event_type WHEN 'signup' THEN 'none' WHEN 'click' THEN 'bm25' WHEN 'view' THEN 'vector' END"
JUDGE = f"""raw AS (SELECT event_id, user_id, {ENGINE_SQL} AS engine, value, {', '.join(f'floor(value * {i + 1})::BIGINT % 3 AS {m}' for i, m in enumerate(METRICS))} FROM events),
judge AS (SELECT * FROM raw WHERE engine IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, engine ORDER BY event_id) = 1),
long AS (UNPIVOT (SELECT user_id, engine, {', '.join(METRICS)} FROM judge) ON {', '.join(METRICS)} INTO NAME metric VALUE score)"""

DIFFS = f"""{JUDGE}, pairs AS (SELECT * FROM (VALUES ('bm25', 'none'), ('vector', 'none'), ('bm25', 'vector')) v(a, b)),
diffs AS (SELECT p.a || ' vs ' || p.b AS comparison, x.metric, x.user_id, (x.score - y.score)::DOUBLE AS difference FROM pairs p JOIN long x ON x.engine = p.a
  JOIN long y ON y.engine = p.b AND y.user_id = x.user_id AND y.metric = x.metric
  WHERE NOT (p.b = 'none' AND x.metric IN ('faithfulness', 'context_utilization_score')))"""


def raw_judgements(spark, d):
    engine = F.when(F.col("event_type") == "signup", "none").when(F.col("event_type") == "click", "bm25").when(F.col("event_type") == "view", "vector")
    return Tables(spark, d).events.select(
        "event_id", "user_id", engine.alias("engine"), "value",
        *[(F.floor(F.col("value") * (i + 1)) % 3).alias(m) for i, m in enumerate(METRICS)]).filter("engine IS NOT NULL")


def judge(spark, d):
    return summaries.first_per_key(raw_judgements(spark, d), ["user_id", "engine"], "event_id")


def long(spark, d):
    return paired.long_scores(judge(spark, d).select("user_id", "engine", *METRICS), ["user_id", "engine"], METRICS)


def diffs(spark, d):
    return paired.paired_differences(long(spark, d), "user_id", "engine")


def np_sql(z):
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.2316419::DOUBLE * abs({z})))"
    poly = "0.0::DOUBLE"
    for b in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        poly = f"(({poly} + {b!r}::DOUBLE) * {t})"
    return f"least(2.0::DOUBLE * exp(-({z}) * ({z}) / 2.0::DOUBLE) / sqrt(2.0::DOUBLE * pi()) * {poly}, 1.0::DOUBLE)"


def wilcoxon_sql(source, groups, zeros):
    g = ", ".join(groups)
    keep = "difference <> 0" if zeros == "drop" else "true"
    return f"""rk AS (SELECT {g}, difference, rank() OVER (PARTITION BY {g} ORDER BY abs(difference)) + (count(*) OVER (PARTITION BY {g}, abs(difference)) - 1) / 2.0::DOUBLE AS r,
  count(*) OVER (PARTITION BY {g}, abs(difference)) AS t FROM {source} WHERE {keep}),
zz AS (SELECT {g}, count(*) FILTER (difference = 0) AS n_zero, count(*) FILTER (difference <> 0) AS n_nonzero FROM {source} GROUP BY ALL),
ww AS (SELECT {g}, coalesce(sum(r) FILTER (difference > 0), 0)::DOUBLE AS w_plus, coalesce(sum(r) FILTER (difference < 0), 0)::DOUBLE AS w_minus, sum(r)::DOUBLE AS rank_sum,
  coalesce(sum((t * t - 1)::DOUBLE) FILTER (difference <> 0), 0) AS ties FROM rk GROUP BY ALL),
st AS (SELECT {g}, n_nonzero, n_zero, coalesce(w_plus, 0) AS w_plus, coalesce(w_minus, 0) AS w_minus, least(coalesce(w_plus, 0), coalesce(w_minus, 0)) AS statistic, coalesce(rank_sum, 0) AS rank_sum, coalesce(ties, 0) AS ties,
  {'n_zero' if zeros == 'pratt' else '0'}::DOUBLE AS z0 FROM zz LEFT JOIN ww USING ({g})),
vv AS (SELECT *, (n_nonzero + z0) * (n_nonzero + z0 + 1) / 4 - z0 * (z0 + 1) / 4 AS mean,
  ((n_nonzero + z0) * (n_nonzero + z0 + 1) * (2 * (n_nonzero + z0) + 1) - z0 * (z0 + 1) * (2 * z0 + 1)) / 24 - ties / 48 AS var FROM st),
wx AS (SELECT {g}, n_nonzero, n_zero, w_plus, w_minus, statistic, CASE WHEN n_nonzero = 0 THEN 1.0 ELSE {np_sql('((statistic - mean) / sqrt(var))')} END AS p_value,
  CASE WHEN rank_sum = 0 THEN 0 ELSE (w_plus - w_minus) / rank_sum END AS rank_biserial FROM vv)"""


G = ["comparison", "metric"]


@query("e10_paired_differences", f"WITH {DIFFS} SELECT * FROM diffs")
def e10(spark, d):
    return diffs(spark, d)


@query("e11_wilcoxon", f"WITH {DIFFS}, {wilcoxon_sql('diffs', G, 'drop')} SELECT comparison, metric, n_nonzero, n_zero, w_plus, w_minus, statistic, round(p_value, 4) AS p_value FROM wx")
def e11(spark, d):
    return rnd(paired.signed_rank(diffs(spark, d), G, "difference"), "p_value", digits=4).drop("rank_biserial")


@query("e12_wilcoxon_pratt", f"WITH {DIFFS}, {wilcoxon_sql('diffs', G, 'pratt')} SELECT comparison, metric, n_nonzero, n_zero, w_plus, w_minus, statistic, round(p_value, 4) AS p_value FROM wx")
def e12(spark, d):
    return rnd(paired.signed_rank(diffs(spark, d), G, "difference", "pratt"), "p_value", digits=4).drop("rank_biserial")


@query("e13_rank_biserial", f"WITH {DIFFS}, {wilcoxon_sql('diffs', G, 'drop')} SELECT comparison, metric, round(rank_biserial, 6) AS rank_biserial FROM wx")
def e13(spark, d):
    return rnd(paired.signed_rank(diffs(spark, d), G, "difference").select(*G, "rank_biserial"), "rank_biserial")


@query("e14_rank_biserial_pratt", f"WITH {DIFFS}, {wilcoxon_sql('diffs', G, 'pratt')} SELECT comparison, metric, round(rank_biserial, 3) AS rank_biserial FROM wx")
def e14(spark, d):
    return rnd(paired.signed_rank(diffs(spark, d), G, "difference", "pratt").select(*G, "rank_biserial"), "rank_biserial", digits=3)


@query("e15_friedman", f"""WITH {JUDGE}, c AS (SELECT *, count(*) OVER (PARTITION BY metric, user_id) AS k FROM long),
r AS (SELECT metric, user_id, engine, rank() OVER (PARTITION BY metric, user_id ORDER BY score) + (count(*) OVER (PARTITION BY metric, user_id, score) - 1) / 2.0::DOUBLE AS r,
  count(*) OVER (PARTITION BY metric, user_id, score) AS t FROM c WHERE k = 3),
s AS (SELECT metric, engine, sum(r) AS s, count(*) AS n FROM r GROUP BY ALL),
t AS (SELECT metric, sum(t * t - 1)::DOUBLE AS ties FROM r GROUP BY metric),
x AS (SELECT metric, any_value(n) AS n, (12.0::DOUBLE / (any_value(n) * 12.0::DOUBLE) * sum(s * s) - 12.0::DOUBLE * any_value(n)) / (1 - any_value(ties) / (any_value(n) * 24.0::DOUBLE)) AS chi,
  max(s) FILTER (engine = 'none') AS a, max(s) FILTER (engine = 'bm25') AS b, max(s) FILTER (engine = 'vector') AS c FROM s JOIN t USING (metric) GROUP BY metric)
SELECT metric, n AS n_blocks, round(chi, 6) AS chi_square, round(exp(-chi / 2), 6) AS p_value, round(a / n, 6) AS mean_rank_none, round(b / n, 6) AS mean_rank_bm25, round(c / n, 6) AS mean_rank_vector FROM x""")
def e15(spark, d):
    out = paired.friedman(long(spark, d), ["metric"], "user_id", "engine", "score", ENGINES)
    return rnd(out, "chi_square", "p_value", "mean_rank_none", "mean_rank_bm25", "mean_rank_vector")


@query("e16_bonferroni", f"WITH {DIFFS}, {wilcoxon_sql('diffs', G, 'pratt')} SELECT comparison, metric, round(least(p_value * 3, 1), 4) AS p_bonferroni FROM wx")
def e16(spark, d):
    t = paired.signed_rank(diffs(spark, d), G, "difference", "pratt")
    return t.select(*G, rounded(paired.bonferroni(F.col("p_value")), 4).alias("p_bonferroni"))


@query("e17_holm", f"""WITH {DIFFS}, {wilcoxon_sql('diffs', G, 'drop')}, i AS (SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY p_value, metric) AS i, count(*) OVER (PARTITION BY comparison) AS m FROM wx),
h AS (SELECT comparison, metric, least(max((m - i + 1) * p_value) OVER (PARTITION BY comparison ORDER BY i), 1) AS p_holm FROM i)
SELECT comparison, metric, round(p_holm, 4) AS p_holm, p_holm < 0.05 AS significant, CASE WHEN p_holm < 0.001 THEN '***' WHEN p_holm < 0.01 THEN '**' WHEN p_holm < 0.05 THEN '*' ELSE '' END AS stars FROM h""")
def e17(spark, d):
    t = paired.holm(paired.signed_rank(diffs(spark, d), G, "difference"), ["comparison"], "p_value", ["metric"])
    return t.select("comparison", "metric", rounded(F.col("p_holm"), 4).alias("p_holm"), "significant", stars(F.col("p_holm")).alias("stars"))


@query("f13_significance_stars", """SELECT event_id, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM (SELECT event_id, value / 1000.0::DOUBLE AS p FROM events)""")
def f13(spark, d):
    return Tables(spark, d).events.select("event_id", stars(F.col("value") / 1000.0).alias("stars"))


# nDCG-like quality per run, in tenths.
NDCG = f"{JUDGE}, q AS (SELECT user_id, engine, floor(value)::BIGINT % 11 / 10.0::DOUBLE AS ndcg, correctness, faithfulness, context_utilization_score FROM judge)"


def quality(spark, d):
    return judge(spark, d).select("user_id", "engine", (F.floor("value") % 11 / 10.0).alias("ndcg"), "correctness", "faithfulness", "context_utilization_score")


def student_sql(t, dof):
    """Central probability: the integral of cos^(dof - 1) up to atan(|t| / sqrt(dof)) by Simpson's rule, over its closed form up to pi / 2."""
    h = f"(atan(abs({t}) / sqrt({dof})) / 4000)"
    w = "CASE WHEN i = 0 OR i = 4000 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END::DOUBLE"
    inner = f"(list_sum(list_transform(range(4001), lambda i: {w} * pow(greatest(cos(i * {h}), 0.0::DOUBLE), {dof} - 1.0::DOUBLE))) * {h} / 3)"
    whole = f"(sqrt(pi()) / 2 * exp(lgamma({dof} / 2) - lgamma(({dof} + 1) / 2)))"
    return f"greatest(1 - {inner} / {whole}, 0)"


def spearman_sql(source, groups):
    g = ", ".join(groups)
    return f"""rr AS (SELECT {g}, rank() OVER (PARTITION BY {g} ORDER BY x) + (count(*) OVER (PARTITION BY {g}, x) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY {g} ORDER BY y) + (count(*) OVER (PARTITION BY {g}, y) - 1) / 2.0::DOUBLE AS ry FROM {source}),
cc AS (SELECT {g}, count(*) AS n, corr(rx, ry) AS rho FROM rr GROUP BY ALL),
sp AS (SELECT *, {student_sql('(rho * sqrt((n - 2) / (1 - rho * rho)))', '(n - 2)::DOUBLE')} AS p_value FROM cc)"""


@query("e18_spearman", f"""WITH {NDCG}, src AS (SELECT engine, metric, ndcg AS x, score AS y FROM (UNPIVOT q ON correctness, faithfulness, context_utilization_score INTO NAME metric VALUE score)), {spearman_sql('src', ['engine', 'metric'])}
SELECT engine, metric, n, round(rho, 6) AS rho, round(p_value, 4) AS p_value FROM sp""")
def e18(spark, d):
    q = quality(spark, d).unpivot(["user_id", "engine", "ndcg"], ["correctness", "faithfulness", "context_utilization_score"], "metric", "score")
    out = paired.spearman(q, ["engine", "metric"], "ndcg", "score")
    return rnd(rnd(out, "rho"), "p_value", digits=4)


BOOT = 10_000


def bootstrap_sql(source, groups, seed):
    g = ", ".join(groups)
    keys = [*groups, "round(v * 1000000)::BIGINT", "rep"]
    return f"""v0 AS (SELECT {g}, v, count(*) AS n FROM {source} GROUP BY ALL),
vc AS (SELECT *, {poisson_cdf_sql('n')} AS cdf FROM v0),
dr AS (SELECT {g}, rep, v, {poisson_sql('n', 'cdf', seed, keys)} AS w FROM vc, range({BOOT}) r(rep)),
mm AS (SELECT {g}, rep, sum(w * v)::DOUBLE / nullif(sum(w), 0)::DOUBLE AS m FROM dr GROUP BY ALL),
ci AS (SELECT {g}, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM mm GROUP BY ALL),
pt AS (SELECT {g}, sum(n)::BIGINT AS n, sum(v * n)::DOUBLE / sum(n)::DOUBLE AS mean FROM vc GROUP BY ALL),
bs AS (SELECT * FROM pt JOIN ci USING ({g}))"""


@query("e19_bootstrap_mean_ci", f"""WITH {DIFFS}, src AS (SELECT comparison, metric, difference AS v FROM diffs), {bootstrap_sql('src', G, 42)}
SELECT comparison, metric, n, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM bs""")
def e19(spark, d):
    return rnd(paired.bootstrap_mean(diffs(spark, d), G, "difference", 42, BOOT), "mean", "low", "high")


CATEGORY = "CASE WHEN user_id % 4 = 0 THEN 'knowledge-base' WHEN user_id % 4 = 1 THEN 'other (no KB answer)' ELSE 'SHAP/LIME interpretation' END"


def category():
    m = F.col("user_id") % 4
    return F.when(m == 0, "knowledge-base").when(m == 1, "other (no KB answer)").otherwise("SHAP/LIME interpretation")


@query("e20_category_means", f"""WITH {JUDGE}, src AS (SELECT {CATEGORY} AS category, engine, metric, score::DOUBLE AS v FROM long WHERE NOT (engine = 'none' AND metric IN ('faithfulness', 'context_utilization_score'))),
{bootstrap_sql('src', ['category', 'engine', 'metric'], 42)} SELECT category, engine, metric, n, round(mean, 3) AS mean, round(low, 3) + 0.0 AS low, round(high, 3) + 0.0 AS high FROM bs""")
def e20(spark, d):
    return rnd(evaluation.category_means(long(spark, d), category(), "engine", 42, BOOT), "mean", "low", "high", digits=3)


@query("e20b_category_differences", f"""WITH {DIFFS}, src AS (SELECT {CATEGORY} AS category, comparison, metric, difference AS v FROM diffs),
{bootstrap_sql('src', ['category', 'comparison', 'metric'], 42)} SELECT category, comparison, metric, n, round(mean, 3) AS mean, round(low, 3) + 0.0 AS low, round(high, 3) + 0.0 AS high FROM bs""")
def e20b(spark, d):
    return rnd(evaluation.category_differences(diffs(spark, d), category(), 42, BOOT), "mean", "low", "high", digits=3)


@query("e21_correlation_subsets", f"""WITH {NDCG}, src AS (SELECT s.subset, engine, ndcg AS x, correctness AS y FROM q, (VALUES ('all queries'), ('excluding other')) s(subset) WHERE s.subset = 'all queries' OR {CATEGORY} <> 'other (no KB answer)'),
{spearman_sql('src', ['subset', 'engine'])} SELECT subset, engine, n, round(rho, 6) AS rho, round(p_value, 4) AS p_value FROM sp""")
def e21(spark, d):
    out = evaluation.correlation_subsets(quality(spark, d), category() != "other (no KB answer)", ["engine"], "ndcg", "correctness", "excluding other")
    return rnd(rnd(out, "rho"), "p_value", digits=4)


@query("e22_discordant", f"""WITH {NDCG} SELECT b.user_id, b.ndcg AS ndcg_bm25, v.ndcg AS ndcg_vector, b.correctness AS correctness_bm25, v.correctness AS correctness_vector
FROM q b JOIN q v ON b.user_id = v.user_id AND b.engine = 'bm25' AND v.engine = 'vector' WHERE v.ndcg > b.ndcg AND v.correctness < b.correctness""")
def e22(spark, d):
    return paired.discordant(quality(spark, d), "user_id", "engine", "ndcg", "correctness")


@query("e23_ablation_comparison", f"""WITH {JUDGE}, later AS (SELECT * FROM raw WHERE engine IS NOT NULL AND user_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id, engine ORDER BY event_id DESC) = 1),
x AS (SELECT 'pre' AS dataset, engine, correctness::DOUBLE AS v FROM judge WHERE user_id IN (SELECT user_id FROM later) UNION ALL SELECT 'post', engine, correctness::DOUBLE FROM later),
y AS (SELECT * FROM x UNION ALL SELECT dataset, 'overall', v FROM x)
SELECT dataset, engine, {DESCRIBE} FROM y GROUP BY ALL""")
def e23(spark, d):
    r = raw_judgements(spark, d).filter("user_id % 2 = 0")
    rest = [c for c in r.columns if c not in ("user_id", "engine")]
    later = r.groupBy("user_id", "engine").agg(F.max_by(F.struct(*rest), F.col("event_id")).alias("x")).select("user_id", "engine", "x.*")
    return rnd(evaluation.ablation_comparison(judge(spark, d), later, "user_id", "engine", "correctness"), *STATS)


@query("e24_judge_vs_human", """WITH k AS (SELECT doc_id, quality + toxic AS human, doc_id % 3 AS judge FROM labels)
SELECT human, judge, count(*) AS n, human = judge AS agrees FROM k GROUP BY ALL""")
def e24(spark, d):
    l = Tables(spark, d).labels
    blind = F.concat(F.lit("A"), F.col("doc_id").cast("string")).alias("id")
    sheet = l.select(blind, (F.col("quality") + F.col("toxic")).alias("human"))
    key = l.select(blind, (F.col("doc_id") % 3).alias("judge"))
    return evaluation.judge_vs_human(sheet, key, "id", "human", "judge")


@query("e25_judge_ingestion", f"""WITH {JUDGE} SELECT engine, metric, count(v) AS n, round(avg(v), 3) AS mean, round(stddev_samp(v), 3) AS std, round(min(v), 3) AS min, round(quantile_cont(v, 0.25), 3) AS q1,
round(quantile_cont(v, 0.5), 3) AS median, round(quantile_cont(v, 0.75), 3) AS q3, round(max(v), 3) AS max FROM (SELECT engine, metric, score::DOUBLE AS v FROM long) GROUP BY ALL""")
def e25(spark, d):
    stats = evaluation.judge_statistics(raw_judgements(spark, d), ["user_id", "engine"], "event_id", METRICS, "engine")
    return rnd(stats, *STATS, digits=3)


@query("e25b_judge_completeness", f"""WITH {JUDGE}, q AS (SELECT DISTINCT user_id FROM raw) SELECT q.user_id, e.engine FROM q, (VALUES ('none'), ('bm25'), ('vector')) e(engine)
WHERE NOT EXISTS (SELECT 1 FROM raw r WHERE r.user_id = q.user_id AND r.engine = e.engine AND r.value > 90)""")
def e25b(spark, d):
    kept = raw_judgements(spark, d).filter("value > 90")
    asked_ids = Tables(spark, d).events.select("user_id").distinct()
    return evaluation.missing_pairs(asked_ids, kept, "user_id", "engine", ENGINES)


@query("e26_significance_table", f"""WITH {DIFFS}, {wilcoxon_sql('diffs', G, 'drop')}, wl AS (SELECT comparison, metric, count(*) AS n, avg(difference) AS mean_diff, count(*) FILTER (difference > 0) AS wins, count(*) FILTER (difference = 0) AS ties, count(*) FILTER (difference < 0) AS losses FROM diffs GROUP BY ALL),
i AS (SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY p_value, metric) AS i, count(*) OVER (PARTITION BY comparison) AS m FROM wx),
h AS (SELECT *, least(max((m - i + 1) * p_value) OVER (PARTITION BY comparison ORDER BY i), 1) AS p_holm FROM i)
SELECT comparison, metric, n, round(mean_diff, 4) AS mean_diff, wins, ties, losses, round(rank_biserial, 4) AS rank_biserial, round(p_value, 4) AS p_value, round(p_holm, 4) AS p_holm FROM h JOIN wl USING (comparison, metric)""")
def e26(spark, d):
    return rnd(evaluation.significance_table(diffs(spark, d)), "mean_diff", "rank_biserial", "p_value", "p_holm", digits=4)
