"""Classification metrics on a linear score of line items and on class centroids of embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbtrace.functions.scalars import rounded, argmax
from plumbtrace.operators import metrics

from .registry import Tables, query

# A coarse logistic score, so that ties occur, of a line item; label is the line status.
SCORE_SQL = """round(1.0::DOUBLE / (1.0::DOUBLE + exp(-((l_quantity - 25) * 0.05::DOUBLE + (l_discount - 0.05::DOUBLE) * 10.0::DOUBLE
  + CASE WHEN l_linestatus = 'F' THEN 0.3 ELSE 0.0 END::DOUBLE))), 4)"""
SCORED = f"scored AS (SELECT (l_linestatus = 'F')::INTEGER AS label, l_returnflag, {SCORE_SQL} AS score FROM lineitem)"


def scored(spark, d):
    z = (F.col("l_quantity") - 25) * 0.05 + (F.col("l_discount") - 0.05) * 10.0 + F.when(F.col("l_linestatus") == "F", 0.3).otherwise(0.0)
    return Tables(spark, d).lineitem.select(
        (F.col("l_linestatus") == "F").cast("int").alias("label"), "l_returnflag",
        F.round(1.0 / (1.0 + F.exp(-z)), 4).alias("score"))


# Multiclass: probabilities over the three return flags from two columns.
MULTI = """multi AS (SELECT list_position(['A', 'N', 'R'], l_returnflag)::INTEGER - 1 AS label,
  [round(a / (a + b + c), 3), round(b / (a + b + c), 3), round(c / (a + b + c), 3)] AS probability FROM (
  SELECT l_returnflag, l_quantity + CASE WHEN l_returnflag = 'A' THEN 9 ELSE 0 END AS a,
         l_linenumber * 7.0::DOUBLE AS b, 60.0::DOUBLE - l_quantity AS c FROM lineitem))"""


def multi(spark, d):
    a = F.col("l_quantity") + F.when(F.col("l_returnflag") == "A", 9).otherwise(0)
    b, c = F.col("l_linenumber") * 7.0, 60.0 - F.col("l_quantity")
    s = a + b + c
    return Tables(spark, d).lineitem.select(
        (F.array_position(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("l_returnflag")) - 1).cast("int").alias("label"),
        F.array(F.round(a / s, 3), F.round(b / s, 3), F.round(c / s, 3)).alias("probability"))


PRED = "list_position(probability, list_max(probability))::INTEGER - 1"
def POS():
    return F.col("label") == 1



def rnd(df, *names, digits=6):
    return df.withColumns({n: rounded(F.col(n), digits) for n in names})


@query("a08_confusion_matrix", f"""
WITH {MULTI}, p AS (SELECT label, {PRED} AS prediction FROM multi)
SELECT l.c AS label, q.c AS prediction, (SELECT count(*) FROM p WHERE p.label = l.c AND p.prediction = q.c) AS n
FROM (VALUES (0), (1), (2), (3)) l(c), (VALUES (0), (1), (2), (3)) q(c)""")
def a08(spark, d):
    df = multi(spark, d).select("label", argmax(F.col("probability")).alias("prediction"))
    return metrics.confusion_matrix(df, "label", "prediction", [0, 1, 2, 3])


@query("a08b_binary_confusion", f"""
WITH {SCORED} SELECT count(*) FILTER (label = 0 AND score < 0.5) AS tn, count(*) FILTER (label = 0 AND score >= 0.5) AS fp,
count(*) FILTER (label = 1 AND score < 0.5) AS fn, count(*) FILTER (label = 1 AND score >= 0.5) AS tp FROM scored""")
def a08b(spark, d):
    df = scored(spark, d).select("label", (F.col("score") >= 0.5).cast("int").alias("prediction"))
    return metrics.binary_confusion(df, "label", "prediction")


REPORT = """
k AS (SELECT DISTINCT c FROM (SELECT label AS c FROM p UNION ALL SELECT prediction FROM p)),
t AS (SELECT c, (SELECT count(*) FROM p WHERE label = c) AS support, (SELECT count(*) FROM p WHERE prediction = c) AS predicted,
      (SELECT count(*) FROM p WHERE label = c AND prediction = c) AS tp FROM k),
m AS (SELECT c, support, tp, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted::DOUBLE END AS precision,
      CASE WHEN support = 0 THEN 0 ELSE tp / support::DOUBLE END AS recall FROM t),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m)
SELECT c::VARCHAR AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'accuracy', round(sum(tp)::DOUBLE / sum(support)::DOUBLE, 6), round(sum(tp)::DOUBLE / sum(support)::DOUBLE, 6), round(sum(tp)::DOUBLE / sum(support)::DOUBLE, 6), sum(support)::BIGINT FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support)::DOUBLE, 6), round(sum(recall * support) / sum(support)::DOUBLE, 6),
  round(sum(f1 * support) / sum(support)::DOUBLE, 6), sum(support)::BIGINT FROM f"""


@query("a09_classification_report", f"WITH {MULTI}, p AS (SELECT label, {PRED} AS prediction FROM multi), {REPORT}")
def a09(spark, d):
    df = multi(spark, d).select("label", argmax(F.col("probability")).alias("prediction"))
    return rnd(metrics.classification_report(df, "label", "prediction"), "precision", "recall", "f1")


@query("a10_accuracy", f"WITH {SCORED} SELECT round(avg((label = (score >= 0.5)::INTEGER)::DOUBLE), 6) AS accuracy FROM scored")
def a10(spark, d):
    df = scored(spark, d).select("label", (F.col("score") >= 0.5).cast("int").alias("prediction"))
    return rnd(metrics.accuracy(df, "label", "prediction"), "accuracy")


AUC = """
c AS (SELECT {g} score, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM s GROUP BY ALL),
o AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {p} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
auc AS (SELECT {g} sum(pos)::BIGINT AS n_positive, sum(neg)::BIGINT AS n_negative,
  sum(pos * (below::DOUBLE + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE) AS auc FROM o GROUP BY ALL)"""


@query("a11_roc_auc", f"WITH {SCORED}, s AS (SELECT label = 1 AS y, score FROM scored), {AUC.format(g='', p='1')} SELECT n_positive, n_negative, round(auc, 6) AS auc FROM auc")
def a11(spark, d):
    return rnd(metrics.roc_auc(scored(spark, d), POS(), "score"), "auc")


OVR = f"""{MULTI}, s AS (SELECT c AS class, label = c AS y, probability[c + 1] AS score FROM multi, (VALUES (0), (1), (2)) k(c))"""


@query("a12_roc_auc_ovr", f"WITH {OVR}, {AUC.format(g='class,', p='class')} SELECT round(avg(auc), 6) AS macro_auc, round(min(auc), 6) AS min_auc, round(max(auc), 6) AS max_auc FROM auc")
def a12(spark, d):
    return rnd(metrics.roc_auc_ovr(multi(spark, d), "label", "probability", 3), "macro_auc", "min_auc", "max_auc")


AP = """
c AS (SELECT {g} score, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM s GROUP BY ALL),
o AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {p}) AS total FROM c
      WINDOW w AS (PARTITION BY {p} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("a13_average_precision", f"""WITH {SCORED}, s AS (SELECT label = 1 AS y, score FROM scored), {AP.format(g='', p='1')}
SELECT round(sum(pos::DOUBLE * tp::DOUBLE / (tp + fp)::DOUBLE) / sum(pos)::DOUBLE, 6) AS average_precision, sum(pos)::BIGINT AS n_positive FROM o""")
def a13(spark, d):
    return rnd(metrics.average_precision(scored(spark, d), POS(), "score"), "average_precision")


@query("a14_average_precision_multiclass", f"""WITH {OVR.replace(', s AS (', ', raw AS (')},
s AS (SELECT class::VARCHAR AS class, y, score FROM raw UNION ALL SELECT 'micro', y, score FROM raw), {AP.format(g='class,', p='class')},
r AS (SELECT class, sum(pos::DOUBLE * tp::DOUBLE / (tp + fp)::DOUBLE) / sum(pos)::DOUBLE AS ap FROM o GROUP BY class)
SELECT class, round(ap, 6) AS average_precision FROM r UNION ALL SELECT 'macro', round(avg(ap), 6) FROM r WHERE class <> 'micro'""")
def a14(spark, d):
    return rnd(metrics.average_precision_multiclass(multi(spark, d), "label", "probability", 3), "average_precision")


def boot_sql(groups, seed=42, replicates=200):
    from .randomness import poisson_cdf_sql, poisson_sql

    g = "".join(f"{x}, " for x in groups)
    p = "".join(f"{x}, " for x in groups)
    key = [*groups, "round(score * 1000000000)::BIGINT", "rep"]
    return f"""c0 AS (SELECT {g} score, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM s GROUP BY ALL),
c AS (SELECT *, {poisson_cdf_sql('pos')} AS pos_cdf, {poisson_cdf_sql('neg')} AS neg_cdf FROM c0),
d AS (SELECT {g} rep, score, CASE WHEN rep < 0 THEN pos ELSE {poisson_sql('pos', 'pos_cdf', seed, [*key, "'pos'"])} END AS pos, CASE WHEN rep < 0 THEN neg ELSE {poisson_sql('neg', 'neg_cdf', seed, [*key, "'neg'"])} END AS neg FROM c, range(-1, {replicates}) r(rep)),
o AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM d WINDOW w AS (PARTITION BY {p} rep ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a AS (SELECT {g} rep, sum(CASE WHEN tp + fp = 0 THEN 0 ELSE pos::DOUBLE * tp::DOUBLE / (tp + fp)::DOUBLE END) / sum(pos)::DOUBLE AS ap FROM o GROUP BY ALL)
SELECT {g} round(max(ap) FILTER (rep < 0), 6) AS average_precision, round(quantile_cont(ap, 0.025) FILTER (rep >= 0), 6) AS low, round(quantile_cont(ap, 0.975) FILTER (rep >= 0), 6) AS high FROM a GROUP BY ALL"""


@query("a15_bootstrap_ap_ci", f"WITH {SCORED}, s AS (SELECT label = 1 AS y, score FROM scored), {boot_sql([])}")
def a15(spark, d):
    return rnd(metrics.bootstrap_average_precision(scored(spark, d), POS(), "score", 42), "average_precision", "low", "high")


@query("a15b_bootstrap_ap_ci_multiclass", f"""WITH {OVR.replace(', s AS (', ', raw AS (')},
s AS (SELECT class::VARCHAR AS class, y, score FROM raw UNION ALL SELECT 'micro', y, score FROM raw), {boot_sql(['class'])}""")
def a15b(spark, d):
    pairs = metrics.one_vs_rest(multi(spark, d), "label", "probability", 3)
    pooled = pairs.select(F.explode(F.array(F.col("class").cast("string"), F.lit("micro"))).alias("class"), "is_class", "score")
    return rnd(metrics.bootstrap_average_precision(pooled, F.col("is_class"), "score", 42, groups=["class"]), "average_precision", "low", "high")


SWEEP = """t AS (SELECT i / 99.0::DOUBLE AS threshold, (SELECT count(*) FROM scored WHERE label = 1) AS p FROM range(100) r(i)),
c AS (SELECT threshold, any_value(p) AS p, count(*) FILTER (label = 1) AS tp, count(*) FILTER (label = 0) AS fp FROM t LEFT JOIN scored ON score >= threshold GROUP BY threshold),
m AS (SELECT threshold, tp + fp AS n_predicted, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END AS precision, tp / p::DOUBLE AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m)"""


@query("a16_threshold_sweep", f"""WITH {SCORED}, {SWEEP}
SELECT round(threshold, 6) AS threshold, n_predicted, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f""")
def a16(spark, d):
    return rnd(metrics.threshold_sweep(scored(spark, d), POS(), "score"), "threshold", "precision", "recall", "f1")


@query("a16b_best_threshold", f"""WITH {SCORED}, {SWEEP}
SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1, n_predicted AS n_at_best, (SELECT count(*) FROM scored WHERE score >= 0.5) AS n_at_default
FROM f ORDER BY f.f1 DESC, f.threshold LIMIT 1""")
def a16b(spark, d):
    return rnd(metrics.best_threshold(scored(spark, d), POS(), "score"), "threshold", "f1")


@query("a30_pr_curve", f"""WITH {SCORED}, s AS (SELECT label = 1 AS y, score FROM scored), {AP.format(g='', p='1')}
SELECT score AS threshold, round(tp::DOUBLE / total::DOUBLE, 6) AS recall, round(tp::DOUBLE / (tp + fp)::DOUBLE, 6) AS precision FROM o""")
def a30(spark, d):
    return rnd(metrics.pr_points(scored(spark, d), POS(), "score"), "recall", "precision").drop("pos", "total")


@query("a30b_pr_curve_multiclass", f"""WITH {OVR}, {AP.format(g='class,', p='class')}
SELECT class, score AS threshold, round(tp::DOUBLE / total::DOUBLE, 6) AS recall, round(tp::DOUBLE / (tp + fp)::DOUBLE, 6) AS precision FROM o""")
def a30b(spark, d):
    pairs = metrics.one_vs_rest(multi(spark, d), "label", "probability", 3)
    return rnd(metrics.pr_points(pairs, F.col("is_class"), "score", ["class"]), "recall", "precision").drop("pos", "total")


@query("a31_one_vs_rest_labels", f"""WITH {OVR} SELECT class, y AS is_class, count(*) AS n, round(sum(score), 3) AS mass FROM s GROUP BY ALL""")
def a31(spark, d):
    pairs = metrics.one_vs_rest(multi(spark, d), "label", "probability", 3)
    return pairs.groupBy("class", "is_class").agg(F.count("*").alias("n"), rounded(F.sum("score"), 3).alias("mass"))
