"""Leakage checks, class weights, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbtrace.functions.scalars import rounded
from plumbtrace.operators import audit, splits

from .randomness import h, u
from .registry import Tables, query

KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


KEYS = ", ".join(KEY)
HK = h("7", *KEY)


@query("a01_class_counts", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def a01(spark, d):
    return audit.class_counts(Tables(spark, d).lineitem, "l_returnflag")


@query("a02_scale_pos_weight", """
SELECT count(*) FILTER (quality <> 1) AS n_negative, count(*) FILTER (quality = 1) AS n_positive,
       round(count(*) FILTER (quality <> 1) / count(*) FILTER (quality = 1)::DOUBLE, 6) AS weight FROM labels""")
def a02(spark, d):
    w = audit.positive_weight(Tables(spark, d).labels, "quality", 1)
    return w.withColumn("weight", rounded(F.col("weight")))


@query("a03_balanced_class_weight", """
SELECT label, n, round((sum(n) OVER ())::DOUBLE / ((count(*) OVER ()) * n), 6) AS weight
FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)""")
def a03(spark, d):
    w = audit.balanced_weights(Tables(spark, d).embeddings, "label")
    return w.withColumn("weight", rounded(F.col("weight")))


@query("a04_duplicate_rows", """
SELECT sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS n_duplicates, round(100.0::DOUBLE * sum(n - 1)::DOUBLE / sum(n)::DOUBLE, 6) AS percent
FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang)""")
def a04(spark, d):
    out = audit.duplicate_rows(Tables(spark, d).documents.select("text", "lang"))
    return out.withColumn("percent", rounded(F.col("percent")))


WITH_GAPS = """SELECT l_linestatus AS label, CASE WHEN l_tax > 0.02 THEN l_tax END AS tax,
  CASE WHEN l_linestatus = 'F' THEN NULL ELSE l_quantity END AS gone,
  CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE l_discount + 0.0 END::DOUBLE AS fixed, 5 AS same, l_linenumber AS line FROM lineitem"""


def _gaps(spark, d):
    f = F.col("l_linestatus") == "F"
    return Tables(spark, d).lineitem.select(
        F.col("l_linestatus").alias("label"), F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("tax"),
        F.when(~f, F.col("l_quantity")).alias("gone"),
        F.when(f, 1.0).otherwise(F.col("l_discount") + F.lit(0.0)).alias("fixed"), F.lit(5).alias("same"),
        F.col("l_linenumber").alias("line"))


COLS = ["tax", "gone", "fixed", "same", "line"]


@query("a05_distinct_including_null", f"""
WITH g AS ({WITH_GAPS}) SELECT label, {', '.join(f'count(DISTINCT {c}) + max(({c} IS NULL)::INTEGER) AS {c}' for c in COLS)} FROM g GROUP BY label""")
def a05(spark, d):
    return audit.distinct_including_null(_gaps(spark, d), "label", COLS)


@query("a06_null_ratio", f"""
WITH g AS ({WITH_GAPS}) SELECT label, {', '.join(f'round(avg(({c} IS NULL)::DOUBLE), 6) AS {c}' for c in COLS)} FROM g GROUP BY label""")
def a06(spark, d):
    out = audit.null_ratio(_gaps(spark, d), "label", COLS)
    return out.select("label", *[rounded(F.col(c)).alias(c) for c in COLS])


def _leak_sql():
    parts = []
    for c in COLS:
        distinct = f"count(DISTINCT {c}) {{f}} + coalesce(max(({c} IS NULL)::INTEGER) {{f}}, 0)"
        mal, ben = "FILTER (label = 'F')", "FILTER (label <> 'F')"
        parts.append(f"""SELECT '{c}' AS "column",
  ({distinct.format(f=mal)}) = 1 AND ({distinct.format(f=ben)}) > 1 AS constant_in_malicious,
  (count({c}) {mal}) = 0 AND (count({c}) {ben}) > 0 AS missing_in_malicious,
  ({distinct.format(f='')}) = 1 AS constant_overall FROM g""")
    return f"WITH g AS ({WITH_GAPS}) " + " UNION ALL ".join(parts)


@query("a07_leakage_audit", _leak_sql())
def a07(spark, d):
    return audit.leakage_audit(_gaps(spark, d), "label", "F", COLS)


# ---- splits and samples --------------------------------------------------------


@query("t03_evaluation_sample", f"""
SELECT {KEYS} FROM (SELECT {KEYS}, row_number() OVER (ORDER BY {HK}, {KEYS}) AS r FROM lineitem) WHERE r <= 1000""")
def t03(spark, d):
    return splits.sample(Tables(spark, d).lineitem.select(*KEY), KEY, 7, 1000)


@query("t04_stratified_sample", f"""
WITH c AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1),
q AS (SELECT l_returnflag, round(n * 200::DOUBLE / (SELECT sum(n) FROM c)::DOUBLE) AS quota FROM c),
r AS (SELECT l_returnflag, {KEYS}, row_number() OVER (PARTITION BY l_returnflag ORDER BY {HK}, {KEYS}) AS r FROM lineitem)
SELECT l_returnflag, {KEYS} FROM r JOIN q USING (l_returnflag) WHERE r <= quota""")
def t04(spark, d):
    return splits.stratified_sample(Tables(spark, d).lineitem.select("l_returnflag", *KEY), "l_returnflag", KEY, 7, 200)


def _split_sql(cuts):
    case = " ".join(f"WHEN r <= floor({c} * n + 1e-9) THEN '{name}'" for c, name in cuts[:-1])
    return f"""
SELECT {KEYS}, l_linestatus, CASE {case} ELSE '{cuts[-1][1]}' END AS split FROM (
  SELECT {KEYS}, l_linestatus, row_number() OVER (PARTITION BY l_linestatus ORDER BY {HK}, {KEYS}) AS r,
         count(*) OVER (PARTITION BY l_linestatus) AS n FROM lineitem)"""


@query("t05_stratified_split_60_20_20", _split_sql([(0.6, "train"), (0.8, "val"), (1, "test")]))
def t05(spark, d):
    return splits.stratified_split(Tables(spark, d).lineitem.select(*KEY, "l_linestatus"), "l_linestatus", KEY, 7)


@query("t06_stratified_split_80_20", _split_sql([(0.8, "train"), (1, "test")]))
def t06(spark, d):
    return splits.stratified_split(
        Tables(spark, d).lineitem.select(*KEY, "l_linestatus"), "l_linestatus", KEY, 7, (("train", 0.8), ("test", 0.2)))


@query("t05b_hash_split", f"""
SELECT {KEYS}, CASE WHEN {u('7', *KEY)} < 0.6::DOUBLE THEN 'train' WHEN {u('7', *KEY)} < 0.8::DOUBLE THEN 'val' ELSE 'test' END AS split FROM lineitem""")
def t05b(spark, d):
    return splits.hash_split(Tables(spark, d).lineitem.select(*KEY), KEY, 7)


@query("t07_group_split", f"""
WITH s AS (SELECT event_id, user_id, concat_ws('-', user_id::VARCHAR, coalesce(nullif(event_type, 'error'), '0')) AS session FROM events)
SELECT event_id, session, CASE WHEN {u('11', 'session')} < 0.6::DOUBLE THEN 'train' WHEN {u('11', 'session')} < 0.8::DOUBLE THEN 'val' ELSE 'test' END AS split FROM s""")
def t07(spark, d):
    ev = Tables(spark, d).events.select("event_id", "user_id", F.nullif("event_type", F.lit("error")).alias("kind"))
    out = splits.group_split(ev, ["user_id", "kind"], 11)
    return out.select("event_id", splits.session_key(["user_id", "kind"]).alias("session"), "split")


@query("t08_ordered_cut", """
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY epoch(o_orderdate), o_orderkey) <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split
FROM orders""")
def t08(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", F.unix_timestamp("o_orderdate").alias("day"))
    return splits.ordered_cut(o, "day", ["o_orderkey"]).drop("day")


@query("t09_balanced_cases", f"""
SELECT {KEYS}, correct FROM (SELECT *, row_number() OVER (PARTITION BY correct ORDER BY {HK}, {KEYS}) AS r
  FROM (SELECT {KEYS}, (l_quantity > 25) = (l_linestatus = 'F') AS correct FROM lineitem)) WHERE r <= 3""")
def t09(spark, d):
    li = Tables(spark, d).lineitem.select(*KEY, ((F.col("l_quantity") > 25) == (F.col("l_linestatus") == "F")).alias("correct"))
    return splits.balanced_cases(li, "correct", KEY, 7)


@query("t10_background_sample", f"""
WITH n AS (SELECT count(*) AS n FROM lineitem),
q AS (SELECT CASE WHEN n <= 1000 THEN least(100, n) WHEN n <= 10000 THEN least(500, n) ELSE least(1000, n) END AS k FROM n)
SELECT {KEYS} FROM (SELECT {KEYS}, row_number() OVER (ORDER BY {h('bg', *KEY)}, {KEYS}) AS r FROM lineitem), q WHERE r <= k""")
def t10(spark, d):
    return splits.background_sample(Tables(spark, d).lineitem.select(*KEY), KEY, "bg")


QUOTAS = {("low", "click"): 3, ("low", "view"): 2, ("low", "error"): 2, ("high", "click"): 2, ("high", "view"): 3, ("high", "error"): 2}
SEEDS = 1000


def _quota_sql() -> str:
    """All seeds at once; the engines of a cell draw in the hashed order of their turns."""
    drawn = "[]::STRUCT(e VARCHAR, q BIGINT, l BIGINT)[]"
    steps = [f"d0 AS (SELECT seed, cell, turns, {drawn} AS used FROM turns)"]
    for k in range(3):
        steps.append(f"""d{k + 1} AS (SELECT seed, cell, turns, list_concat(used, list_transform(list_filter(turns[{k + 1}].o,
  lambda x: NOT list_contains(list_transform(used, lambda z: z.q), x.q))[1:turns[{k + 1}].n], lambda x: {{'e': turns[{k + 1}].e, 'q': x.q, 'l': x.l}})) AS used FROM d{k})""")
    return ", ".join(steps)


@query("t11_quota_sample", f"""
WITH best AS (SELECT user_id, event_type, max(event_id) AS e FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY ALL),
r AS (SELECT user_id, event_type, CASE WHEN user_id % 2 = 0 THEN 'low' ELSE 'high' END AS cell, e % 3 AS level FROM best),
c AS (SELECT r.*, s AS seed, {h('pick', 's', 'user_id', 'event_type')} AS hh FROM r, range(0, {SEEDS}) t(s)),
q AS (SELECT * FROM (VALUES {', '.join(f"('{c}', '{e}', {n})" for (c, e), n in QUOTAS.items())}) v(cell, event_type, quota)),
k AS (SELECT * FROM c JOIN q USING (cell, event_type) QUALIFY row_number() OVER (PARTITION BY seed, cell, event_type ORDER BY hh, user_id) <= {sum(QUOTAS.values())}),
o AS (SELECT seed, cell, event_type, any_value(quota) AS quota, list({{'q': user_id, 'l': level}} ORDER BY hh, user_id) AS o FROM k GROUP BY ALL),
turns AS (SELECT seed, cell, list({{'e': event_type, 'n': quota, 'o': o}} ORDER BY {h('turn', 'seed', 'cell', 'event_type')}, event_type) AS turns FROM o GROUP BY ALL),
{_quota_sql()},
p AS (SELECT seed, cell, unnest(used) AS u FROM d3),
v AS (SELECT min(seed) AS seed FROM (SELECT seed FROM p GROUP BY seed HAVING count(*) = {sum(QUOTAS.values())}
      AND count(*) FILTER (u.l = 0) >= 3 AND count(*) FILTER (u.l = 1) >= 3 AND count(*) FILTER (u.l = 2) >= 3))
SELECT p.seed::INTEGER AS seed, u.q AS user_id, u.e AS event_type, cell, u.l AS level FROM p JOIN v USING (seed)""")
def t11(spark, d):
    ev = Tables(spark, d).events.filter(F.col("event_type").isin("click", "view", "error"))
    rows = ev.groupBy("user_id", "event_type").agg(F.max("event_id").alias("e")).select(
        "user_id", "event_type", F.when(F.col("user_id") % 2 == 0, "low").otherwise("high").alias("cell"),
        (F.col("e") % 3).alias("level"))
    return splits.quota_sample(rows, "user_id", "event_type", "cell", "level", QUOTAS, [0, 1, 2], 3, seeds=SEEDS)


@query("t12_seeded_shuffle", f"""
SELECT o_orderkey, row_number() OVER (ORDER BY {h('42', 'o_orderkey')}, o_orderkey) AS position FROM orders""")
def t12(spark, d):
    return splits.shuffled(Tables(spark, d).orders.select("o_orderkey"), ["o_orderkey"], 42)


@query("t13_random_negatives", f"""
WITH ring AS (SELECT doc_id, row_number() OVER (ORDER BY {h('neg', 'doc_id')}, doc_id) AS slot, count(*) OVER () AS size FROM documents),
pool AS (SELECT DISTINCT user_id % 40 AS item_id, event_id % 500 AS doc_id FROM events WHERE value > 150),
steps AS (SELECT b.item_id, r.doc_id, (r.slot - 1 - {h('neg-start', 'b.item_id')}::HUGEINT % r.size + r.size) % r.size AS step FROM benchmark b, ring r)
SELECT item_id, doc_id FROM (
  SELECT s.item_id, s.doc_id, row_number() OVER (PARTITION BY s.item_id ORDER BY step) AS r FROM steps s
  WHERE NOT EXISTS (SELECT 1 FROM pool p WHERE p.item_id = s.item_id AND p.doc_id = s.doc_id)) WHERE r <= 2""")
def t13(spark, d):
    t = Tables(spark, d)
    pool = t.events.filter("value > 150").select((F.col("user_id") % 40).alias("item_id"), (F.col("event_id") % 500).alias("doc_id"))
    return splits.random_negatives(t.benchmark.select("item_id"), t.documents.select("doc_id"), pool, "item_id", "doc_id", "neg")
