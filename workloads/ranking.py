"""Summaries, ranks, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbtrace.functions.scalars import jaccard, rounded
from plumbtrace.operators import enrich, ordered, splits, summaries

from .audit import h
from .metrics import rnd
from .registry import Tables, query

ENGINES = ["click", "view", "error"]

# Judge-like scores: 0..2 per (user, kind) event.
JUDGED = "judged AS (SELECT event_id, user_id, event_type AS engine, floor(value)::BIGINT % 3 AS score, value FROM events)"


def judged(spark, d):
    return Tables(spark, d).events.select(
        "event_id", "user_id", F.col("event_type").alias("engine"), (F.floor("value") % 3).alias("score"), "value")


DESCRIBE = """count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS q1,
round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3, round(max(v), 6) AS max"""
STATS = ["mean", "std", "min", "q1", "median", "q3", "max"]


@query("a17_describe_by", f"WITH {JUDGED} SELECT engine, {DESCRIBE.replace('v)', 'value)').replace('(v,', '(value,')} FROM judged GROUP BY engine")
def a17(spark, d):
    return rnd(summaries.describe_by(judged(spark, d), ["engine"], "value"), *STATS)


@query("a18_describe_with_overall", f"""WITH {JUDGED}, x AS (SELECT engine, score::DOUBLE AS v FROM judged UNION ALL SELECT 'overall', score::DOUBLE FROM judged)
SELECT engine, {DESCRIBE} FROM x GROUP BY engine""")
def a18(spark, d):
    return rnd(summaries.describe_with_overall(judged(spark, d), "engine", "score"), *STATS)


@query("a19_mean_std", f"""WITH {JUDGED} SELECT engine, round(avg(score), 6) AS score_mean, round(stddev_samp(score), 6) AS score_std,
round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_std FROM judged GROUP BY engine""")
def a19(spark, d):
    out = summaries.mean_std(judged(spark, d), ["engine"], ["score", "value"])
    return rnd(out, "score_mean", "score_std", "value_mean", "value_std")


@query("a20_mean_ignoring_undefined", """
SELECT event_type AS engine, round(avg(CASE WHEN value > 20 THEN value END), 6) AS mean, count(CASE WHEN value > 20 THEN 1 END) AS n FROM events GROUP BY 1""")
def a20(spark, d):
    v = F.when(F.col("value") > 20, F.col("value"))
    return Tables(spark, d).events.groupBy(F.col("event_type").alias("engine")).agg(rounded(F.avg(v)).alias("mean"), F.count(v).alias("n"))


# Attributions of a linear score, long form: model = return flag, feature = brand.
LONG = """long AS (SELECT l_returnflag AS model, p_brand AS feature, (l_quantity - 25) * p_size AS attribution,
  l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey),
imp AS (SELECT model, feature, avg(abs(attribution)) AS importance FROM long GROUP BY ALL)"""


def long(spark, d):
    t = Tables(spark, d)
    return t.lineitem.join(t.part.withColumnRenamed("p_partkey", "l_partkey"), "l_partkey").select(
        F.col("l_returnflag").alias("model"), F.col("p_brand").alias("feature"),
        ((F.col("l_quantity") - 25) * F.col("p_size")).alias("attribution"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def importance(spark, d):
    return summaries.global_importance(long(spark, d), ["model"], "feature", "attribution")


@query("a21_global_importance", f"WITH {LONG} SELECT model, feature, round(importance, 6) AS importance FROM imp")
def a21(spark, d):
    return rnd(importance(spark, d), "importance")


@query("a22_surrogate_rollup", f"""WITH {LONG}, r AS (SELECT l_orderkey, feature, sum(abs(attribution)) AS w FROM long GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY w DESC, feature) AS rk FROM r),
s AS (SELECT feature, sum(w) AS s FROM k WHERE rk <= 10 GROUP BY feature)
SELECT feature, round(s / (SELECT sum(s) FROM s), 6) AS importance FROM s ORDER BY s DESC, feature LIMIT 50""")
def a22(spark, d):
    rows = long(spark, d).groupBy("l_orderkey", "feature").agg(F.sum(F.abs("attribution")).alias("w"))
    return rnd(summaries.surrogate_rollup(rows, ["l_orderkey"], "feature", "w"), "importance")


@query("a23_duplicate_pairs", f"""WITH {JUDGED} SELECT user_id, engine, count(*) AS n,
  greatest(count(DISTINCT score), count(DISTINCT value)) > 1 AS conflicting FROM judged GROUP BY ALL HAVING count(*) > 1""")
def a23(spark, d):
    return summaries.duplicate_pairs(judged(spark, d), ["user_id", "engine"], ["score", "value"])


COVERAGE = f"""WITH r AS (SELECT CASE WHEN event_id % 50 = 0 THEN NULL ELSE user_id END AS q, CASE WHEN event_id % 70 = 0 THEN '' ELSE event_type END AS e FROM events),
x AS (SELECT DISTINCT c_custkey AS q FROM customer WHERE c_nationkey < 20), en AS (SELECT * FROM (VALUES ('click'), ('view'), ('error')) v(e)),
ok AS (SELECT * FROM r WHERE q IS NOT NULL AND e <> ''), p AS (SELECT q, e, count(*) AS n FROM ok GROUP BY ALL),
f AS (SELECT
 (SELECT count(*) FROM x) AS expected_queries,
 (SELECT count(*) FROM x WHERE (SELECT count(*) FROM p WHERE p.q = x.q) = 3 AND (SELECT count(*) FROM ok WHERE ok.q = x.q) = 3
    AND (SELECT count(*) FROM p JOIN en USING (e) WHERE p.q = x.q) = 3) AS complete_queries,
 (SELECT count(*) FROM x WHERE q NOT IN (SELECT q FROM ok)) AS missing_queries,
 (SELECT count(*) FROM x WHERE (SELECT count(*) FROM p JOIN en USING (e) WHERE p.q = x.q) < 3) AS queries_missing_engines,
 (SELECT count(DISTINCT q) FROM ok WHERE q NOT IN (SELECT q FROM x)) AS unexpected_queries,
 (SELECT count(*) FROM p WHERE n > 1) AS duplicate_pairs,
 0::BIGINT AS duplicate_expected,
 (SELECT count(*) FROM ok WHERE e NOT IN (SELECT e FROM en)) AS unexpected_engine_rows,
 (SELECT count(*) FROM r WHERE q IS NULL OR e = '') AS malformed_rows, (SELECT count(*) FROM r) AS result_rows)
SELECT *, missing_queries + queries_missing_engines + unexpected_queries + duplicate_pairs + duplicate_expected + unexpected_engine_rows + malformed_rows = 0 AS passed FROM f"""


@query("a24_coverage_audit", COVERAGE)
def a24(spark, d):
    t = Tables(spark, d)
    r = t.events.select(F.when(F.col("event_id") % 50 != 0, F.col("user_id")).alias("q"),
                        F.when(F.col("event_id") % 70 == 0, "").otherwise(F.col("event_type")).alias("e"))
    x = t.customer.filter("c_nationkey < 20").select(F.col("c_custkey").alias("q"))
    return summaries.coverage_audit(r, x, "q", "e", ENGINES)


@query("a25_win_tie_loss", f"""WITH {JUDGED}, a AS (SELECT user_id, avg(score) FILTER (engine = 'click') AS a, avg(score) FILTER (engine = 'view') AS b FROM judged GROUP BY user_id),
d AS (SELECT round(a - b, 6) AS d FROM a WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT 'click vs view' AS comparison, count(d) AS n, round(avg(d), 6) AS mean_diff, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d = 0) AS ties, count(*) FILTER (d < 0) AS losses FROM d""")
def a25(spark, d):
    means = judged(spark, d).groupBy("user_id", "engine").agg(F.avg("score").alias("score"))
    pairs = enrich.complete_pairs(means, ["user_id"], "engine", "click", "view", "score")
    diffs = pairs.select(F.lit("click vs view").alias("comparison"), rounded(F.col("a") - F.col("b")).alias("d"))
    return rnd(summaries.win_tie_loss(diffs, ["comparison"], "d"), "mean_diff")


@query("a26_average_quality", """
SELECT l_returnflag AS model, l_linestatus AS method, count(*) AS n, round(avg(l_discount), 6) AS faithfulness, round(avg(l_tax), 6) AS robustness,
round(avg(l_quantity / 50), 6) AS complexity, round(avg(0.4::DOUBLE * l_discount + 0.35::DOUBLE * l_tax + 0.25::DOUBLE * l_quantity / 50), 6) AS overall FROM lineitem GROUP BY ALL""")
def a26(spark, d):
    from plumbtrace.plans.quality import average_quality

    c = Tables(spark, d).lineitem.select(
        F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("method"), F.col("l_discount").alias("faithfulness"),
        F.col("l_tax").alias("robustness"), (F.col("l_quantity") / 50).alias("complexity"))
    return rnd(average_quality(c, ["model", "method"]), "faithfulness", "robustness", "complexity", "overall")


@query("a27_distribution", """
WITH x AS (SELECT o_orderpriority AS p, o_orderstatus AS s FROM orders UNION ALL SELECT 'total', o_orderstatus FROM orders)
SELECT p AS priority, count(*) FILTER (s = 'F') AS "F", count(*) FILTER (s = 'O') AS "O", count(*) FILTER (s = 'P') AS "P", count(*) AS total FROM x GROUP BY p""")
def a27(spark, d):
    o = Tables(spark, d).orders.select(F.col("o_orderpriority").alias("priority"), "o_orderstatus")
    return summaries.distribution(o, "priority", "o_orderstatus", ["F", "O", "P"])


@query("a28_request_statistics", """
SELECT count(*) AS calls, count(*) FILTER (role <> 'system') AS successes, sum(length(text)) FILTER (role <> 'system')::BIGINT AS tokens,
round(count(*) FILTER (role <> 'system') / count(*)::DOUBLE, 6) AS success_rate,
round(sum(length(text)) FILTER (role <> 'system')::DOUBLE / count(*) FILTER (role <> 'system')::DOUBLE, 6) AS mean_tokens FROM conversations""")
def a28(spark, d):
    log = Tables(spark, d).conversations.select("role", F.length("text").alias("tokens"))
    return rnd(summaries.request_statistics(log, F.col("role") != "system", "tokens"), "success_rate", "mean_tokens")


CUM = f"""WITH {LONG}, i AS (SELECT model, feature, round(importance, 6) AS importance FROM imp),
c AS (SELECT *, row_number() OVER w AS rank, sum(importance) OVER (w ROWS UNBOUNDED PRECEDING) / sum(importance) OVER (PARTITION BY model) AS share,
count(*) OVER (PARTITION BY model) AS n FROM i WINDOW w AS (PARTITION BY model ORDER BY importance DESC, feature))"""


@query("a29_cumulative_selection", f"""{CUM}, k AS (SELECT *, greatest(coalesce(min(CASE WHEN share >= 0.9 THEN rank END) OVER (PARTITION BY model), n), floor(0.5 * n + 1)) AS keep FROM c)
SELECT model, feature, importance, rank::INTEGER AS rank, round(share, 6) AS cumulative_share FROM k WHERE rank <= keep""")
def a29(spark, d):
    imp = rnd(importance(spark, d), "importance")
    return rnd(summaries.cumulative_selection(imp, "feature", "importance", 0.9, 0.5, ["model"]), "cumulative_share")


# ---- windows -------------------------------------------------------------------


@query("w01_feature_rank", f"""WITH {LONG}, i AS (SELECT model, feature, round(importance, 6) AS importance FROM imp)
SELECT *, (row_number() OVER (PARTITION BY model ORDER BY abs(importance) DESC, feature))::INTEGER AS rank FROM i""")
def w01(spark, d):
    return summaries.feature_ranks(rnd(importance(spark, d), "importance"), ["model"], "feature", "importance")


@query("w02_cumulative_share", f"{CUM} SELECT model, feature, round(share, 6) AS cumulative_share FROM c")
def w02(spark, d):
    imp = rnd(importance(spark, d), "importance")
    out = summaries.cumulative_selection(imp, "feature", "importance", 2.0, 1.0, ["model"])
    return rnd(out.select("model", "feature", "cumulative_share"), "cumulative_share")


@query("w03_mid_rank", f"""WITH {JUDGED}, v AS (SELECT event_id, engine, round(value, 1) AS value FROM judged)
SELECT event_id, engine, value, rank() OVER w + (count(*) OVER (PARTITION BY engine, value) - 1) / 2.0::DOUBLE AS rank FROM v WINDOW w AS (PARTITION BY engine ORDER BY value)""")
def w03(spark, d):
    v = judged(spark, d).select("event_id", "engine", F.round("value", 1).alias("value"))
    return ordered.with_mid_ranks(v, ["engine"], "value")


@query("w03b_global_row_number", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS position FROM lineitem""")
def w03b(spark, d):
    li = Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return ordered.row_numbers(li, "l_quantity", keys, "position", descending=True).drop("l_quantity")


@query("w04_first_per_key", f"""WITH {JUDGED} SELECT user_id, engine, event_id, score FROM
(SELECT *, row_number() OVER (PARTITION BY user_id, engine ORDER BY event_id) AS r FROM judged) WHERE r = 1""")
def w04(spark, d):
    return summaries.first_per_key(judged(spark, d).drop("value"), ["user_id", "engine"], "event_id")


@query("w05_running_max", """
WITH p AS (SELECT event_type AS comparison, user_id AS metric, round(min(value) / 100.0::DOUBLE, 4) AS p FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY p, metric) AS i, count(*) OVER (PARTITION BY comparison) AS m FROM p)
SELECT comparison, metric, p, round(least(max((m - i + 1) * p) OVER (PARTITION BY comparison ORDER BY i), 1.0), 6) AS p_holm FROM r""")
def w05(spark, d):
    from plumbtrace.operators.paired import holm

    p = Tables(spark, d).events.groupBy(F.col("event_type").alias("comparison"), F.col("user_id").alias("metric")).agg(
        F.round(F.min("value") / 100.0, 4).alias("p"))
    return rnd(holm(p, ["comparison"], "p", ["metric"]).drop("significant"), "p_holm")


@query("w06_first_hit", f"""WITH {JUDGED}, r AS (SELECT user_id, engine, event_id, score, row_number() OVER (PARTITION BY user_id, engine ORDER BY event_id) AS rank FROM judged)
SELECT user_id, engine, min(rank) FILTER (score = 2)::INTEGER AS first_hit FROM r GROUP BY ALL""")
def w06(spark, d):
    from plumbtrace.operators.ireval import first_hit_rank

    return first_hit_rank(judged(spark, d), ["user_id", "engine"], "event_id", F.col("score") == 2)


@query("w07_blinded_ids", f"""
SELECT item_id, 'A' || lpad(n::VARCHAR, greatest(length(n::VARCHAR), 2)::INTEGER, '0') AS id FROM
(SELECT item_id, row_number() OVER (ORDER BY {h('42', 'item_id')}, item_id) AS n FROM benchmark)""")
def w07(spark, d):
    return splits.blinded(Tables(spark, d).benchmark.select("item_id"), ["item_id"], 42)


@query("t01_top_features", f"""WITH {LONG}, i AS (SELECT model, feature, round(importance, 6) AS importance FROM imp)
SELECT model, feature, importance, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS rank FROM i) WHERE rank <= 10""")
def t01(spark, d):
    imp = rnd(importance(spark, d), "importance")
    return ordered.top_k(imp, ["model"], [F.col("importance").desc(), F.col("feature")], 10)


@query("t02_top_k_per_query", """
SELECT user_id, event_id, value, rank::INTEGER AS rank FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3""")
def t02(spark, d):
    ev = Tables(spark, d).events.select("user_id", "event_id", "value")
    return ordered.top_k(ev, ["user_id"], [F.col("value").desc(), F.col("event_id")], 3)


# ---- set operations --------------------------------------------------------------


@query("u01_union_results", """
SELECT 'orders' AS dataset, o_orderstatus AS label, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 2
UNION ALL SELECT 'lineitem', l_linestatus, count(*), round(avg(l_extendedprice), 4) FROM lineitem GROUP BY 2""")
def u01(spark, d):
    t = Tables(spark, d)
    a = t.orders.groupBy(F.col("o_orderstatus").alias("label")).agg(F.count("*").alias("n"), rounded(F.avg("o_totalprice"), 4).alias("mean"))
    b = t.lineitem.groupBy(F.col("l_linestatus").alias("label")).agg(rounded(F.avg("l_extendedprice"), 4).alias("mean"), F.count("*").alias("n"))
    return a.withColumn("dataset", F.lit("orders")).unionByName(b.withColumn("dataset", F.lit("lineitem")))


TOP10 = f"""WITH {LONG}, i AS (SELECT model, feature, round(importance, 6) AS importance FROM imp),
k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS rank FROM i)"""


@query("u02_common_features", f"{TOP10} SELECT feature FROM k WHERE rank <= 15 GROUP BY feature HAVING count(DISTINCT model) = 3")
def u02(spark, d):
    return summaries.common_features(rnd(importance(spark, d), "importance"), "model", "feature", "importance", 15, 3)


@query("u03_difference", """
SELECT DISTINCT user_id AS id FROM events EXCEPT SELECT DISTINCT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'""")
def u03(spark, d):
    t = Tables(spark, d)
    return t.events.select(F.col("user_id").alias("id")).subtract(t.customer.filter("c_mktsegment = 'BUILDING'").select("c_custkey"))


@query("u04_topk_jaccard", f"""{TOP10}, s AS (SELECT model, list(feature) AS f FROM k WHERE rank <= 10 GROUP BY model)
SELECT a.model AS model_a, b.model AS model_b, round(len(list_intersect(a.f, b.f)) / len(list_distinct(list_concat(a.f, b.f)))::DOUBLE, 6) AS jaccard FROM s a JOIN s b ON a.model < b.model""")
def u04(spark, d):
    imp = rnd(importance(spark, d), "importance")
    best = ordered.top_k(imp, ["model"], [F.col("importance").desc(), F.col("feature")], 10)
    # three models with ten features each: sets, not rows, are compared
    s = best.groupBy("model").agg(F.collect_set("feature").alias("f")).agg(F.array_sort(F.collect_list(F.struct("model", "f"))).alias("sets"))
    pairs = s.select(F.explode(F.flatten(F.transform("sets", lambda a: F.transform(
        F.filter("sets", lambda b: a["model"] < b["model"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    return pairs.select(F.col("p.a.model").alias("model_a"), F.col("p.b.model").alias("model_b"),
                        rounded(jaccard(F.col("p.a.f"), F.col("p.b.f"))).alias("jaccard"))


@query("u05_pooled_union", """
SELECT DISTINCT user_id % 40 AS query_id, event_id % 300 AS chunk_id FROM events WHERE event_type IN ('click', 'view')""")
def u05(spark, d):
    from plumbtrace.operators.retrieval import pooled

    ev = Tables(spark, d).events.select((F.col("user_id") % 40).alias("query_id"), (F.col("event_id") % 300).alias("chunk_id"), "event_type")
    return pooled(ev.filter("event_type = 'click'").drop("event_type"), ev.filter("event_type = 'view'").drop("event_type"), ["query_id", "chunk_id"])


@query("u06_side_by_side", f"""{TOP10} SELECT rank::INTEGER AS rank, any_value(feature) FILTER (model = 'A') AS "A", any_value(feature) FILTER (model = 'N') AS "N", any_value(feature) FILTER (model = 'R') AS "R"
FROM k WHERE rank <= 10 GROUP BY rank""")
def u06(spark, d):
    return summaries.side_by_side(rnd(importance(spark, d), "importance"), "model", "feature", "importance", 10, ["A", "N", "R"])
