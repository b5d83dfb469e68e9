"""Attributions and their quality for every line item under linear and logistic scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbtrace.functions.scalars import argmax, normalise_probability, rounded
from plumbtrace.operators import attribution, quality, scoring, summaries
from plumbtrace.plans import quality as quality_plan

from .audit import h
from .common import stored
from .metrics import rnd
from .registry import Tables, query

COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
NAMES = ["quantity", "price", "discount", "tax", "line"]
W = [0.07, -0.05, 0.03, 0.10, -0.02]
WL = [0.9, -0.6, 0.4, 1.2, -0.3]  # logistic variant
D = len(W)
ID = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity::BIGINT, round(l_extendedprice * 100)::BIGINT)"

FEATURES = f"""st AS (SELECT {', '.join(f'round(stddev_pop({c}), 6) AS s{i}' for i, c in enumerate(COLUMNS))} FROM lineitem),
f AS (SELECT {ID} AS row_id, l_returnflag, l_linestatus, [{', '.join(f'{c} / s{i}' for i, c in enumerate(COLUMNS))}] AS x FROM lineitem, st),
bm AS (SELECT [{', '.join(f'round(avg(x[{i + 1}]), 6)' for i in range(D))}] AS b FROM f),
long AS (SELECT row_id, l_returnflag, l_linestatus, unnest({list(range(D))}) AS i, unnest(x) AS x, unnest(b) AS b, unnest({W}::DOUBLE[]) AS w, unnest({WL}::DOUBLE[]) AS wl FROM f, bm),
bias AS (SELECT round(0.5::DOUBLE - ({' + '.join(f'{w!r}::DOUBLE * b[{i + 1}]' for i, w in enumerate(W))}), 6) AS bias FROM bm),
ph AS (SELECT *, w * (x - b) AS phi FROM long),
rk AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(phi) DESC, i) AS r FROM ph)"""


MIXED = """mx0 AS (SELECT row_id, c, (word + (c + 1) * 2654435769) & 4294967295 AS v FROM {source}),
mx1 AS (SELECT row_id, c, xor(v, v >> 16) AS v FROM mx0),
mx2 AS (SELECT row_id, c, (v * 51819 + ((v * 34283) & 65535) * 65536) & 4294967295 AS v FROM mx1),
mx3 AS (SELECT row_id, c, xor(v, v >> 13) AS v FROM mx2),
mx4 AS (SELECT row_id, c, (v * 44597 + ((v * 49842) & 65535) * 65536) & 4294967295 AS v FROM mx3),
mx AS (SELECT row_id, c, xor(v, v >> 16) AS v FROM mx4)"""
WORDS = f"(SELECT row_id, {h('42', 'row_id')}::BIGINT AS word, c FROM f, range({{n}}) t(c))"


def row_id():
    """A key that is unique in every supplied scale."""
    parts = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return F.concat_ws("-", *parts, F.col("l_quantity").cast("long"), F.round(F.col("l_extendedprice") * 100).cast("long"))


class Setup:
    """Scaled features per line item, baseline, scorers and explainers."""

    def __init__(self, spark, d):
        t = Tables(spark, d)
        stats = scoring.standard_fit(t.lineitem, COLUMNS)
        scale = [round(stats[c][1], 6) for c in COLUMNS]
        x = F.array(*[(F.col(c) / F.lit(s)).cast("double") for c, s in zip(COLUMNS, scale)])
        self.keys = ["row_id"]
        self.rows = scoring.spread(t.lineitem.select(row_id().alias("row_id"), "l_returnflag", "l_linestatus", x.alias("x")), self.keys)
        self.baseline = [round(b, 6) for b in attribution.baseline_means(self.rows, "x", D)]
        self.linear = scoring.LinearScorer(W, round(0.5 - sum(w * b for w, b in zip(W, self.baseline)), 6))
        self.logistic = scoring.LinearScorer(WL, 0.25 - sum(w * b for w, b in zip(WL, self.baseline)), "logistic")
        self.explainer = attribution.LinearExplainer(self.linear, self.baseline)

    def explained(self):
        return self.explainer.explain(self.rows, self.keys, "x", "phi")


_setups: dict = {}


def setup(spark, d) -> Setup:
    key = (spark.sparkContext.applicationId, d)
    if key not in _setups:
        _setups[key] = Setup(spark, d)
    return _setups[key]


def cells(*names):
    return ", ".join(names)


@query("m01_standardize", f"""SELECT {ID} AS row_id, {', '.join(f'round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem), 6) + 0.0 AS {n}' for c, n in zip(COLUMNS, NAMES))}, 0.0::DOUBLE AS same FROM lineitem""")
def m01(spark, d):
    li = Tables(spark, d).lineitem.select(
        row_id().alias("row_id"),
        *[F.col(c).cast("double").alias(n) for c, n in zip(COLUMNS, NAMES)], F.lit(3.0).alias("same"))
    stats = scoring.standard_fit(li, [*NAMES, "same"])
    return rnd(scoring.standard_apply(li, stats), *NAMES, "same")


@query("m08_probability_scorer", f"""WITH {FEATURES}, s AS (SELECT row_id, any_value(bias) + sum(w * x) AS p, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(0.25::DOUBLE + sum(wl * (x - b))))) AS q FROM long, bias GROUP BY row_id)
SELECT row_id, round(1.0::DOUBLE - p, 6) AS p0, round(p, 6) AS p1, round(q, 6) AS logistic FROM s""")
def m08(spark, d):
    s = setup(spark, d)
    scored = s.logistic.score(s.linear.score(s.rows, "x", "p"), "x", "q")
    return scored.select("row_id", rounded(F.col("p")[0]).alias("p0"), rounded(F.col("p")[1]).alias("p1"), rounded(F.col("q")[1]).alias("logistic"))


@query("m09_imbalance_weights", """WITH c AS (SELECT l_linestatus, count(*) AS n FROM lineitem WHERE l_returnflag <> 'A' OR l_linestatus = 'F' GROUP BY 1)
SELECT l_linestatus, n, round((sum(n) OVER ())::DOUBLE / ((count(*) OVER ()) * n), 6) AS weight FROM c""")
def m09(spark, d):
    from plumbtrace.operators import audit

    li = Tables(spark, d).lineitem.filter("l_returnflag <> 'A' OR l_linestatus = 'F'")
    weighted = audit.with_class_weight(li, "l_linestatus", audit.balanced_weights(li, "l_linestatus"))
    return rnd(weighted.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.max("weight").alias("weight")), "weight")


# ---- scalar functions on probabilities and curves -----------------------------------


@query("f07_logistic", "SELECT event_id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(value - 50) / 25)), 6) AS p FROM events")
def f07(spark, d):
    from plumbtrace.functions.scalars import logistic

    return Tables(spark, d).events.select("event_id", rounded(logistic((F.col("value") - 50) / 25)).alias("p"))


@query("f08_normalise_probability", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN [1.0 - p, p] WHEN o_orderkey % 3 = 1 THEN [p, p] ELSE [p, 0.0] END AS p
FROM (SELECT o_orderkey, (o_custkey % 8) / 8.0::DOUBLE AS p FROM orders)""")
def f08(spark, d):
    p = (F.col("o_custkey") % 8) / 8.0
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.array(p)).when(F.col("o_orderkey") % 3 == 1, F.array(p, p, p)).otherwise(F.array(p, F.lit(0.0)))
    return Tables(spark, d).orders.select("o_orderkey", normalise_probability(raw, 2).alias("p"))


@query("f09_argmax", """SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS dimension FROM embeddings""")
def f09(spark, d):
    return Tables(spark, d).embeddings.select("vec_id", argmax(F.col("embedding")).alias("dimension"))


@query("f10_std_and_cv", """SELECT vec_id, round(stddev_pop(x), 6) AS std, round(stddev_pop(x) / avg(abs(x)), 6) AS cv FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id""")
def f10(spark, d):
    from plumbtrace.functions.scalars import array_mean, array_std_pop

    v = F.transform("embedding", lambda x: x.cast("double"))
    return Tables(spark, d).embeddings.select("vec_id", v.alias("v")).select(
        "vec_id", rounded(array_std_pop(F.col("v"))).alias("std"),
        rounded(array_std_pop(F.col("v")) / array_mean(F.transform("v", lambda x: F.abs(x)))).alias("cv"))


@query("f11_trapezoid", """SELECT vec_id, round((sum(x) - (max(x) FILTER (i = 1) + max(x) FILTER (i = 64)) / 2) / 63, 6) AS area FROM
(SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY vec_id""")
def f11(spark, d):
    from plumbtrace.functions.scalars import trapezoid

    v = F.transform("embedding", lambda x: x.cast("double"))
    return Tables(spark, d).embeddings.select("vec_id", rounded(trapezoid(v)).alias("area"))


@query("f12_row_pearson", """SELECT vec_id, round(corr(x, i), 6) AS r FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY vec_id""")
def f12(spark, d):
    from plumbtrace.functions.scalars import array_pearson

    v = F.transform("embedding", lambda x: x.cast("double"))
    i = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda x: x.cast("double"))
    return Tables(spark, d).embeddings.select("vec_id", v.alias("v")).select("vec_id", rounded(array_pearson(F.col("v"), i)).alias("r"))


# ---- attributions ---------------------------------------------------------------------


@query("x01_shapley_linear", f"WITH {FEATURES} SELECT row_id, i::INTEGER AS feature_idx, {NAMES}[i + 1] AS feature, round(phi, 6) AS attribution FROM ph")
def x01(spark, d):
    s = setup(spark, d)
    return rnd(attribution.long_attributions(s.explained(), s.keys, "phi", NAMES), "attribution")


PERMS = 4


@query("x01b_shapley_sampled", f"""WITH {FEATURES}, {MIXED.format(source=WORDS.format(n=PERMS // 2 * D))},
o AS (SELECT row_id, i, wl * (x - b) AS g, c // {D} AS pr, row_number() OVER (PARTITION BY row_id, c // {D} ORDER BY v, i) AS pos FROM mx JOIN long USING (row_id) WHERE c % {D} = i),
m AS (SELECT row_id, i, g, pr * 2 AS m, pos FROM o UNION ALL SELECT row_id, i, g, pr * 2 + 1, {D + 1} - pos FROM o),
c AS (SELECT row_id, i, 0.25::DOUBLE + sum(g) OVER (PARTITION BY row_id, m ORDER BY pos) AS z, g FROM m)
SELECT row_id, i::INTEGER AS feature_idx, {NAMES}[i + 1] AS feature, round(avg(1.0::DOUBLE / (1.0::DOUBLE + exp(-z)) - 1.0::DOUBLE / (1.0::DOUBLE + exp(-(z - g)))), 6) AS attribution FROM c GROUP BY row_id, i""")
def x01b(spark, d):
    s = setup(spark, d)
    e = attribution.ShapleyExplainer(s.logistic, s.baseline, 42, PERMS)
    out = e.explain(s.rows, s.keys, "x", "phi")
    return rnd(attribution.long_attributions(out, s.keys, "phi", NAMES), "attribution")


SAMPLES = 5000


def _surrogate(spark, d):
    s = setup(spark, d)
    flat = s.rows.select(F.posexplode("x").alias("i", "v"))
    q = summaries.exact_quantiles(flat, ["i"], "v", {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "q4": 1.0})
    edges = [[r[c] for c in ("q0", "q1", "q2", "q3", "q4")] for r in sorted(q.collect(), key=lambda r: r["i"])]
    return s, attribution.SurrogateExplainer(s.logistic, edges, NAMES, 42, SAMPLES)


@query("x02_surrogate")
def x02(spark, d):
    s, e = _surrogate(spark, d)
    out = e.explain(s.rows, s.keys, "x", "phi").withColumn("rules", e.rules(F.col("x")))
    rows = out.select("row_id", F.inline(F.arrays_zip(F.col("rules").alias("rule"), F.col("phi").alias("weight"))))
    return rnd(rows, "weight")


@query("f05_rule_to_feature", f"""WITH n AS (SELECT unnest({NAMES}) AS feature, unnest({list(range(D))}) AS idx),
r AS (SELECT event_id, {NAMES}[(event_id % 5 + 1)::INTEGER] AS f, round(value, 2) AS v FROM events)
SELECT event_id, idx::INTEGER AS feature_idx, CASE WHEN event_id % 2 = 0 THEN '>' ELSE 'between' END AS op, CASE WHEN event_id % 2 = 0 THEN v ELSE 0.5 END AS lower, CASE WHEN event_id % 2 = 1 THEN v END AS upper FROM r JOIN n ON n.feature = r.f""")
def f05(spark, d):
    from plumbtrace.sources.files import split_rules

    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("event_id") % 5 + 1).cast("int"))
    v = F.format_string("%.2f", F.round("value", 2))
    rule = F.when(F.col("event_id") % 2 == 0, F.concat(name, F.lit(" > "), v)).otherwise(F.concat(F.lit("0.50 < "), name, F.lit(" <= "), v))
    parsed = split_rules(Tables(spark, d).events.select("event_id", rule.alias("rule")), "rule")
    index = F.create_map(*[y for i, n in enumerate(NAMES) for y in (F.lit(n), F.lit(i))])
    return parsed.select("event_id", index[F.col("feature")].alias("feature_idx"), "op", "lower", "upper")


@query("x03_select_class", f"""WITH {FEATURES}, s AS (SELECT row_id, any_value(bias) + sum(w * x) AS p FROM long, bias GROUP BY row_id)
SELECT row_id, round(p, 6) AS positive, round(greatest(p, 1 - p), 6) AS predicted, round((p + (1 - p)) / 2, 6) AS mean FROM s""")
def x03(spark, d):
    s = setup(spark, d)
    p = s.linear.score(s.rows, "x", "p")
    return p.select("row_id", rounded(attribution.select_class(F.col("p"), 1)).alias("positive"),
                    rounded(attribution.select_class(F.col("p"))).alias("predicted"), rounded(attribution.select_class(F.col("p"), "mean")).alias("mean"))


@query("x04_explanation_table", f"WITH {FEATURES} SELECT row_id, i::INTEGER AS feature_idx, round(CASE WHEN r <= 2 THEN phi ELSE 0 END, 6) AS attribution FROM rk")
def x04(spark, d):
    s = setup(spark, d)
    top = attribution.export_top(s.explained(), s.keys, "x", "phi", [str(i) for i in range(D)], 2)
    sparse = top.select("row_id", F.explode("top").alias("t")).select("row_id", F.col("t.feature").cast("int").alias("feature_idx"), F.col("t.attribution").alias("attribution"))
    return rnd(attribution.explanation_table(sparse, s.keys, "feature_idx", "attribution", D), "attribution")


@query("x05_export_top", f"WITH {FEATURES} SELECT row_id, r::INTEGER AS rank, {NAMES}[i + 1] AS feature, round(phi, 6) AS attribution, round(x, 6) AS feature_value FROM rk WHERE r <= 3")
def x05(spark, d):
    s = setup(spark, d)
    top = attribution.export_top(s.explained(), s.keys, "x", "phi", NAMES, 3)
    rows = top.select("row_id", F.posexplode("top").alias("p", "t")).select("row_id", (F.col("p") + 1).alias("rank"), "t.*")
    return rnd(rows, "attribution", "feature_value")


@query("x06_masking_baseline", f"WITH {FEATURES} SELECT unnest({NAMES}) AS feature, unnest(b) AS baseline FROM bm")
def x06(spark, d):
    s = setup(spark, d)
    means = s.rows.agg(*[F.avg(F.col("x")[i]).alias(n) for i, n in enumerate(NAMES)])
    return rnd(means.unpivot([], NAMES, "feature", "baseline"), "baseline")


# ---- faithfulness -----------------------------------------------------------------------

SIGN = "CASE WHEN p > 1 - p THEN {v} ELSE 1 - ({v}) END"


def faith_sql(rank="rk", imp="phi"):
    return f"""{FEATURES}, p0 AS (SELECT row_id, any_value(bias) + sum(w * x) AS p FROM long, bias GROUP BY row_id),
cv AS (SELECT row_id, k, any_value(bias) + sum(CASE WHEN r <= k THEN w * b ELSE w * x END) AS dl, any_value(bias) + sum(CASE WHEN r <= k THEN w * x ELSE w * b END) AS ins FROM {rank}, bias, range(1, {D + 1}) t(k) GROUP BY row_id, k),
tc AS (SELECT row_id, k, {SIGN.format(v='dl')} AS dl, {SIGN.format(v='ins')} AS ins FROM cv JOIN p0 USING (row_id)),
ar AS (SELECT row_id, list(dl ORDER BY k) AS dels, list(ins ORDER BY k) AS inss, min(1 - dl) AS lo_d, max(1 - dl) AS hi_d, (sum(1 - dl) - sum(1 - dl) FILTER (k IN (1, {D})) / 2) / {D - 1} AS ar_d,
  min(ins) AS lo_i, max(ins) AS hi_i, (sum(ins) - sum(ins) FILTER (k IN (1, {D})) / 2) / {D - 1} AS ar_i FROM tc GROUP BY row_id),
au AS (SELECT row_id, dels, inss, CASE WHEN hi_d - lo_d <= 1e-8 + 1e-5 * abs(lo_d) THEN 0.5 ELSE (ar_d - lo_d) / (hi_d - lo_d) END AS deletion_auc,
  CASE WHEN hi_i - lo_i <= 1e-8 + 1e-5 * abs(lo_i) THEN 0.5 ELSE (ar_i - lo_i) / (hi_i - lo_i) END AS insertion_auc FROM ar),
ab AS (SELECT row_id, coalesce(corr(abs({imp}), CASE WHEN p > 1 - p THEN w * (x - b) ELSE -w * (x - b) END), 0) AS ablation FROM {rank} JOIN p0 USING (row_id) GROUP BY row_id),
fa AS (SELECT row_id, dels, inss, deletion_auc, insertion_auc, ablation, 0.4::DOUBLE * deletion_auc + 0.4::DOUBLE * insertion_auc + 0.2::DOUBLE * ablation AS faithfulness FROM au JOIN ab USING (row_id))"""


def faith(spark, d):
    s = setup(spark, d)
    return quality.faithfulness(s.explained(), s.keys, "x", "phi", s.baseline, s.linear)


def curve_rows(df, name):
    return df.select("row_id", F.posexplode(name).alias("p", "probability")).select(
        "row_id", (F.col("p") + 1).alias("step"), rounded(F.col("probability")).alias("probability"))


@query("x07_deletion_curve", f"WITH {faith_sql()} SELECT row_id, k::INTEGER AS step, round(dl, 6) AS probability FROM tc")
def x07(spark, d):
    return curve_rows(faith(spark, d), "deletion_curve")


@query("x08_insertion_curve", f"WITH {faith_sql()} SELECT row_id, k::INTEGER AS step, round(ins, 6) AS probability FROM tc")
def x08(spark, d):
    return curve_rows(faith(spark, d), "insertion_curve")


@query("x09_normalised_auc", f"WITH {faith_sql()} SELECT row_id, round(deletion_auc, 6) AS deletion_auc, round(insertion_auc, 6) AS insertion_auc FROM au")
def x09(spark, d):
    return rnd(faith(spark, d).select("row_id", "deletion_auc", "insertion_auc"), "deletion_auc", "insertion_auc")


@query("x10_ablation_correlation", f"WITH {faith_sql()} SELECT row_id, round(ablation, 6) AS ablation_correlation FROM ab")
def x10(spark, d):
    return rnd(faith(spark, d).select("row_id", "ablation_correlation"), "ablation_correlation")


@query("x11_faithfulness", f"WITH {faith_sql()} SELECT l_returnflag AS model, count(*) AS n, round(avg(deletion_auc), 6) AS deletion_auc, round(avg(insertion_auc), 6) AS insertion_auc, round(avg(ablation), 6) AS ablation_correlation, round(avg(faithfulness), 6) AS faithfulness FROM fa JOIN f USING (row_id) GROUP BY 1")
def x11(spark, d):
    m = ["deletion_auc", "insertion_auc", "ablation_correlation", "faithfulness"]
    return rnd(faith(spark, d).groupBy(F.col("l_returnflag").alias("model")).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in m]), *m)


GLOBAL_RANK = f"""gi AS (SELECT i, round(avg(abs(phi)), 6) AS imp FROM ph GROUP BY i), gr AS (SELECT i, imp, row_number() OVER (ORDER BY imp DESC, i) AS r FROM gi),
grk AS (SELECT ph.row_id, ph.i, x, b, w, phi, imp, gr.r FROM ph JOIN gr USING (i))"""


def with_global(sql):
    return sql.replace(FEATURES, FEATURES + ", " + GLOBAL_RANK)


@query("x12_global_faithfulness", f"WITH {with_global(faith_sql('grk', 'imp'))} SELECT count(*) AS n, round(avg(deletion_auc), 6) AS deletion_auc, round(avg(insertion_auc), 6) AS insertion_auc, round(avg(ablation), 6) AS ablation_correlation, round(avg(faithfulness), 6) AS faithfulness FROM fa")
def x12(spark, d):
    s = setup(spark, d)
    ranking = [round(v, 6) for v in quality_plan.global_vector(s.explained(), "phi", D)]
    out = quality.faithfulness(s.explained(), s.keys, "x", "phi", s.baseline, s.linear, ranking)
    m = ["deletion_auc", "insertion_auc", "ablation_correlation", "faithfulness"]
    return rnd(out.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in m]), *m)


# ---- robustness -------------------------------------------------------------------------

DRAWS, K = 10, 2


NOISE = f"""{MIXED.format(source=WORDS.format(n=DRAWS * (2 * D + 1)))},
sd AS (SELECT row_id, stddev_pop(x) AS sd FROM long GROUP BY row_id),
lv AS (SELECT row_id, c // {2 * D + 1} AS dr, sd * ([0.05, 0.1, 0.2]::DOUBLE[])[(v % 3 + 1)::INTEGER] AS scale FROM mx JOIN sd USING (row_id) WHERE c % {2 * D + 1} = 0),
nn AS (SELECT row_id, c // {2 * D + 1} AS dr, (c % {2 * D + 1} - 1) // 2 AS i, max(v) FILTER ((c % {2 * D + 1}) % 2 = 1) AS v1, max(v) FILTER ((c % {2 * D + 1}) % 2 = 0) AS v2 FROM mx WHERE c % {2 * D + 1} > 0 GROUP BY ALL),
nz AS (SELECT row_id, dr, i, x + scale * g AS xp, w * (x + scale * g - b) AS phip, phi FROM
  (SELECT row_id, dr, i, sqrt(-2.0::DOUBLE * ln((v1 + 1.0::DOUBLE) / 4294967296.0::DOUBLE)) * cos(2.0::DOUBLE * pi() * v2 / 4294967296.0::DOUBLE) AS g FROM nn) JOIN lv USING (row_id, dr) JOIN ph USING (row_id, i)),
nk AS (SELECT *, row_number() OVER (PARTITION BY row_id, dr ORDER BY abs(phip) DESC, i) AS rp FROM nz),
jc AS (SELECT row_id, dr, count(*) FILTER (rp <= {K} AND r <= {K}) AS both_ FROM nk JOIN (SELECT row_id, i, r FROM rk) USING (row_id, i) GROUP BY ALL),
jj AS (SELECT row_id, avg(both_ / ({2 * K} - both_)::DOUBLE) AS jaccard FROM jc GROUP BY row_id),
vf AS (SELECT row_id, i, var_pop(phip) AS v FROM nz GROUP BY ALL),
vv AS (SELECT row_id, least(avg(v) / (any_value(vo) + 1e-9::DOUBLE), 1) AS variance FROM vf JOIN (SELECT row_id, var_pop(phi) AS vo FROM ph GROUP BY row_id) USING (row_id) GROUP BY row_id),
ro AS (SELECT row_id, jaccard, variance, 0.6::DOUBLE * jaccard + 0.4::DOUBLE * (1 - variance) AS robustness FROM jj JOIN vv USING (row_id))"""


@query("x13_perturb", f"WITH {FEATURES}, {NOISE} SELECT row_id, dr::INTEGER AS draw, round(sum(xp), 5) AS total FROM nz GROUP BY ALL")
def x13(spark, d):
    from plumbtrace.functions.scalars import array_sum

    noisy = quality.perturbed_copies(setup(spark, d).rows, ["row_id"], "x", 42, DRAWS, "draw", "xp")
    return noisy.select("row_id", "draw", rounded(array_sum(F.col("xp")), 5).alias("total"))


def robust(spark, d):
    s = setup(spark, d)
    return quality.robustness(s.explained(), s.keys, "x", "phi", s.explainer, 42, DRAWS, K)


@query("x14_topk_stability", f"WITH {FEATURES}, {NOISE} SELECT row_id, round(jaccard, 6) AS jaccard_similarity FROM jj")
def x14(spark, d):
    return rnd(robust(spark, d).select("row_id", "jaccard_similarity"), "jaccard_similarity")


@query("x15_importance_variance", f"WITH {FEATURES}, {NOISE} SELECT row_id, round(variance, 6) AS importance_variance FROM vv")
def x15(spark, d):
    return rnd(robust(spark, d).select("row_id", "importance_variance"), "importance_variance")


@query("x16_robustness", f"WITH {FEATURES}, {NOISE} SELECT l_returnflag AS model, count(*) AS n, round(avg(jaccard), 6) AS jaccard_similarity, round(avg(variance), 6) AS importance_variance, round(avg(robustness), 6) AS robustness FROM ro JOIN f USING (row_id) GROUP BY 1")
def x16(spark, d):
    m = ["jaccard_similarity", "importance_variance", "robustness"]
    return rnd(robust(spark, d).groupBy(F.col("l_returnflag").alias("model")).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in m]), *m)


SUBSET = f"""mb AS (SELECT row_id, i, phi, s FROM ph, range(30) t(s) WHERE ({h('42', 'row_id')} >> s::INTEGER) & 1 = 1),
si AS (SELECT s, i, avg(abs(phi)) AS imp FROM mb GROUP BY ALL),
sk AS (SELECT s, i, row_number() OVER (PARTITION BY s ORDER BY imp DESC, i) AS rs FROM si),
ga AS (SELECT i, avg(abs(phi)) AS imp FROM ph GROUP BY i), gk AS (SELECT i, row_number() OVER (ORDER BY imp DESC, i) AS rg FROM ga),
sj AS (SELECT s, count(*) FILTER (rs <= {K} AND rg <= {K}) AS c FROM sk JOIN gk USING (i) GROUP BY s),
cvv AS (SELECT least(avg(sd / m) FILTER (m > 1e-9) / 0.5::DOUBLE, 1) AS v FROM (SELECT i, stddev_pop(imp) AS sd, avg(imp) AS m FROM si GROUP BY i)),
gro AS (SELECT (SELECT avg(c / ({2 * K} - c)::DOUBLE) FROM sj) AS j, v, (SELECT count(*) FROM sj) AS n FROM cvv)"""


@query("x17_global_robustness", f"WITH {FEATURES}, {SUBSET} SELECT round(j, 6) AS subset_jaccard_similarity, round(v, 6) AS subset_importance_variance, n AS n_subsets, round(0.6::DOUBLE * j + 0.4::DOUBLE * (1 - v), 6) AS robustness FROM gro")
def x17(spark, d):
    s = setup(spark, d)
    out = quality.global_robustness(s.explained(), s.keys, "phi", D, 42, k=K)
    return rnd(out, "subset_jaccard_similarity", "subset_importance_variance", "robustness")


# ---- complexity and overall ---------------------------------------------------------------

COMPLEX = """co AS (SELECT row_id, 1 - count(*) FILTER (abs(phi) > 0.02) / count(*)::DOUBLE AS sparsity, 1.0::DOUBLE / (1.0::DOUBLE + exp(-2 * (stddev_pop(abs(phi)) / avg(abs(phi)) - 1))) AS effective FROM ph GROUP BY row_id),
cx AS (SELECT row_id, sparsity, effective, 0.6::DOUBLE * sparsity + 0.4::DOUBLE * effective AS complexity FROM co)"""


def comp(spark, d):
    return quality.complexity(setup(spark, d).explained(), "phi")


@query("x18_sparsity", f"WITH {FEATURES}, {COMPLEX} SELECT row_id, round(sparsity, 6) AS sparsity FROM co")
def x18(spark, d):
    return rnd(comp(spark, d).select("row_id", "sparsity"), "sparsity")


@query("x19_effective_complexity", f"WITH {FEATURES}, {COMPLEX} SELECT row_id, round(effective, 6) AS effective_complexity FROM co")
def x19(spark, d):
    return rnd(comp(spark, d).select("row_id", "effective_complexity"), "effective_complexity")


@query("x20_complexity", f"WITH {FEATURES}, {COMPLEX} SELECT l_returnflag AS model, count(*) AS n, round(avg(complexity), 6) AS complexity FROM cx JOIN f USING (row_id) GROUP BY 1")
def x20(spark, d):
    return rnd(comp(spark, d).groupBy(F.col("l_returnflag").alias("model")).agg(F.count("*").alias("n"), F.avg("complexity").alias("complexity")), "complexity")


@query("x21_overall_quality", f"""WITH {faith_sql()}, {COMPLEX} SELECT row_id, round(0.4::DOUBLE * faithfulness + 0.25::DOUBLE * complexity, 6) AS without_robustness,
round(0.5::DOUBLE * faithfulness + 0.5::DOUBLE * complexity, 6) AS reweighted FROM fa JOIN cx USING (row_id)""")
def x21(spark, d):
    both = quality.complexity(faith(spark, d), "phi")
    none = F.lit(None).cast("double")
    dims = {"faithfulness": F.col("faithfulness"), "robustness": none, "complexity": F.col("complexity")}
    return both.select("row_id", rounded(quality_plan.overall_quality(dims)).alias("without_robustness"),
                       rounded(quality_plan.overall_quality(dims, {"faithfulness": 0.5, "complexity": 0.5})).alias("reweighted"))


@query("x22_quality_per_case", f"""WITH {faith_sql()}, {NOISE}, {COMPLEX}
SELECT row_id, round(0.4::DOUBLE * faithfulness + 0.35::DOUBLE * robustness + 0.25::DOUBLE * complexity, 6) AS overall, round(faithfulness, 6) AS faithfulness, round(robustness, 6) AS robustness,
round(complexity, 6) AS complexity, (l_linestatus = 'F')::INTEGER AS true_label, (p > 1 - p)::INTEGER AS predicted_label, (l_linestatus = 'F') = (p > 1 - p) AS prediction_correct
FROM fa JOIN ro USING (row_id) JOIN cx USING (row_id) JOIN f USING (row_id) JOIN p0 USING (row_id)""")
def x22(spark, d):
    s = setup(spark, d)
    out = quality_plan.quality_per_case(s.rows.withColumn("true_label", (F.col("l_linestatus") == "F").cast("int")), s.keys, "x", s.baseline,
                                        s.linear, s.explainer, "true_label", seed=42, draws=DRAWS, k=K)
    m = ["overall", "faithfulness", "robustness", "complexity"]
    return rnd(out.select("row_id", *m, "true_label", "predicted_label", "prediction_correct"), *m)


@query("x23_global_quality", f"""WITH {with_global(faith_sql('grk', 'imp'))}, {SUBSET}, gc AS (SELECT 0.6::DOUBLE * (1 - count(*) FILTER (imp > 0.02) / count(*)::DOUBLE) + 0.4::DOUBLE / (1.0::DOUBLE + exp(-2 * (stddev_pop(imp) / avg(imp) - 1))) AS complexity FROM gi),
t AS (SELECT (SELECT avg(faithfulness) FROM fa) AS faithfulness, (SELECT 0.6::DOUBLE * j + 0.4::DOUBLE * (1 - v) FROM gro) AS robustness, complexity FROM gc)
SELECT round(faithfulness, 6) AS faithfulness, round(robustness, 6) AS robustness, round(complexity, 6) AS complexity, round(0.4::DOUBLE * faithfulness + 0.35::DOUBLE * robustness + 0.25::DOUBLE * complexity, 6) AS overall FROM t""")
def x23(spark, d):
    s = setup(spark, d)
    out = quality_plan.global_quality(s.explained(), s.keys, "x", "phi", s.baseline, s.linear, seed=42, k=K, digits=6)
    return rnd(out.select("faithfulness", "robustness", "complexity", "overall"), "faithfulness", "robustness", "complexity", "overall")
