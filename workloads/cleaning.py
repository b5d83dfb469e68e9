"""Column selection and value cleaning over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbtrace.functions.scalars import DASHBOARD_BANDS, band, coerce_double, map_values, rounded
from plumbtrace.operators import cleaning, enrich

from .registry import Tables, query


@query("p01_drop_sparse_columns", """
SELECT l_orderkey, l_quantity, CASE WHEN l_linenumber <> 7 THEN l_tax + 0.0 END AS mostly FROM lineitem""")
def p01(spark, d):
    li = Tables(spark, d).lineitem.select(
        "l_orderkey", "l_quantity",
        F.when(F.col("l_linenumber") != 7, F.col("l_tax") + F.lit(0.0)).alias("mostly"),
        F.when(F.col("l_linenumber") > 4, F.col("l_tax")).alias("sparse"),
        F.lit(None).cast("double").alias("empty"))
    return cleaning.drop_sparse_columns(li)


@query("p02_collapse_rare", """
SELECT p_partkey, CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'other' ELSE p_brand END AS p_brand FROM part""")
def p02(spark, d):
    return cleaning.collapse_rare(Tables(spark, d).part, "p_brand", ["Brand#1", "Brand#2", "Brand#3"]).select("p_partkey", "p_brand")


@query("p03_one_hot", """
WITH o AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, o_orderpriority AS priority FROM orders)
SELECT o_orderkey, coalesce(status = 'F', false) AS "status_F", coalesce(status = 'O', false) AS "status_O",
       priority = '1-URGENT' AS "priority_1-URGENT", priority = '2-HIGH' AS "priority_2-HIGH",
       priority = '3-MEDIUM' AS "priority_3-MEDIUM", priority = '4-NOT SPECIFIED' AS "priority_4-NOT SPECIFIED",
       priority = '5-LOW' AS "priority_5-LOW" FROM o""")
def p03(spark, d):
    o = Tables(spark, d).orders.select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.col("o_orderpriority").alias("priority"))
    return cleaning.one_hot(o, ["status", "priority"]).drop("status", "priority")


@query("p04_drop_columns", "SELECT s_suppkey, s_acctbal FROM supplier")
def p04(spark, d):
    return cleaning.drop_if_present(Tables(spark, d).supplier, ["s_name", "s_nationkey", "sDSb", "Seq"])


@query("p05_drop_null_rows", """
SELECT o_orderkey, o_orderstatus AS status, o_totalprice AS price FROM orders
WHERE o_orderstatus <> 'P' AND o_totalprice >= 50000""")
def p05(spark, d):
    o = Tables(spark, d).orders.select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice")).alias("price"))
    return cleaning.drop_null_rows(o)


@query("p06_feature_columns", """
SELECT l_quantity, l_extendedprice, l_discount + 0.0 AS l_discount, l_tax + 0.0 AS l_tax FROM lineitem""")
def p06(spark, d):
    li = Tables(spark, d).lineitem.withColumn("l_discount", F.col("l_discount") + F.lit(0.0)).withColumn("l_tax", F.col("l_tax") + F.lit(0.0))
    drop = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"]
    return li.select(cleaning.feature_names(li.withColumnRenamed("l_linenumber", "Unnamed: 0"), drop))


@query("p07_numeric_only", """
SELECT c_acctbal, c_custkey, 0.0::DOUBLE AS c_extra FROM customer""")
def p07(spark, d):
    numeric = cleaning.numeric_only(Tables(spark, d).customer)
    return cleaning.align_columns(numeric, ["c_acctbal", "c_custkey", "c_extra"])


@query("p08_coerce_numeric", """
SELECT event_id, coalesce(try_cast(CASE WHEN event_type = 'error' THEN 'n/a' ELSE value::VARCHAR END AS DOUBLE), 0.0)::DOUBLE AS value,
       coalesce(try_cast(CASE WHEN event_type = 'click' THEN NULL ELSE user_id::VARCHAR END AS DOUBLE), 0.0)::DOUBLE AS user_id FROM events""")
def p08(spark, d):
    ev = Tables(spark, d).events.select(
        "event_id",
        F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string")).alias("value"),
        F.when(F.col("event_type") != "click", F.col("user_id").cast("string")).alias("user_id"))
    return cleaning.coerce_numeric(ev, ["value", "user_id"])


FLAG = """CASE event_type WHEN 'view' THEN '0' WHEN 'click' THEN 'A' WHEN 'purchase' THEN 'PA' WHEN 'signup' THEN 'FPA' END"""


@query("p09_map_values", f"""
SELECT event_id, coalesce(CASE {FLAG} WHEN '0' THEN 0 WHEN 'A' THEN 1 WHEN 'PA' THEN 2 WHEN 'FPA' THEN 3 END, 0)::INTEGER AS flag FROM events""")
def p09(spark, d):
    ev = Tables(spark, d).events
    code = map_values(F.col("event_type"), {"view": "0", "click": "A", "purchase": "PA", "signup": "FPA"})
    return ev.select("event_id", map_values(code, cleaning.FLAG_CODES, 0).alias("flag"))


@query("p10_binary_label", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'Benign' ELSE 'Malicious' END AS label,
       CASE o_orderstatus WHEN 'O' THEN 'Benign' WHEN 'F' THEN 'Malicious' END AS mapped FROM orders""")
def p10(spark, d):
    o = Tables(spark, d).orders
    return o.select("o_orderkey", cleaning.binary_label(F.col("o_orderstatus"), "O").alias("label"),
                    map_values(F.col("o_orderstatus"), {"O": "Benign", "F": "Malicious"}).alias("mapped"))


@query("p11_attack_subset", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag AS target FROM lineitem WHERE l_linestatus = 'F'""")
def p11(spark, d):
    return cleaning.attack_subset(Tables(spark, d).lineitem, "l_linestatus", "F", "l_returnflag").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "target")


@query("p12_normalize_keys", "SELECT c_custkey, lower(trim(' ' || c_mktsegment || '  ')) AS segment FROM customer")
def p12(spark, d):
    c = Tables(spark, d).customer.select("c_custkey", F.concat(F.lit(" "), "c_mktsegment", F.lit("  ")).alias("segment"))
    return cleaning.normalise_keys(c, ["segment"])


@query("p13_label_column", "SELECT 'LABEL ' AS label_column, count(*) AS n FROM labels GROUP BY quality")
def p13(spark, d):
    df = Tables(spark, d).labels.withColumnRenamed("quality", "LABEL ")
    name = cleaning.label_column(df.columns)
    return df.groupBy(name).count().select(F.lit(name).alias("label_column"), F.col("count").alias("n"))


@query("p14_quality_level", """
SELECT event_id, CASE WHEN s >= 0.9 THEN 'Excellent' WHEN s >= 0.7 THEN 'Good' WHEN s >= 0.5 THEN 'Fair' WHEN s >= 0 THEN 'Poor' END AS level,
       CASE WHEN s >= 0.7 THEN 'high' WHEN s >= 0.4 THEN 'medium' WHEN s >= 0 THEN 'low' END AS dashboard
FROM (SELECT event_id, value / 100.0::DOUBLE AS s FROM events)""")
def p14(spark, d):
    s = F.col("value") / 100.0
    return Tables(spark, d).events.select("event_id", band(s).alias("level"), band(s, DASHBOARD_BANDS).alias("dashboard"))


@query("p15_term_filter", """
SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'and')""")
def p15(spark, d):
    return cleaning.term_filter(Tables(spark, d).documents, "text", ["The", "AND"]).select("doc_id")


@query("p16_query_category", """
SELECT user_id, CASE WHEN event_type IN ('click', 'view') THEN 'knowledge-base' WHEN event_type = 'error' THEN 'other (no KB answer)'
       ELSE 'SHAP/LIME interpretation' END AS category, count(*) AS n FROM events GROUP BY ALL""")
def p16(spark, d):
    groups = {"knowledge-base": ["click", "view"], "other (no KB answer)": ["error"]}
    return Tables(spark, d).events.groupBy(
        "user_id", enrich.category_of(F.col("event_type"), groups, "SHAP/LIME interpretation").alias("category")
    ).agg(F.count("*").alias("n"))


@query("p17_strip_reasoning", """
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN trim(text) ELSE text END AS answer FROM conversations""")
def p17(spark, d):
    c = Tables(spark, d).conversations
    raw = F.when(F.col("role") == "assistant", F.concat(F.lit("<think>a</think> b </think> "), "text", F.lit(" "))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", cleaning.strip_reasoning(raw).alias("answer"))


@query("p18_truncate", """
SELECT doc_id, substr(text, 1, 1500) AS evidence, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM documents""")
def p18(spark, d):
    return Tables(spark, d).documents.select(
        "doc_id", cleaning.truncate(F.col("text"), 1500).alias("evidence"), cleaning.truncate(F.col("text"), 200, "...").alias("preview"))


@query("p19_project_id_and_text", "SELECT item_id AS id, text AS query FROM benchmark")
def p19(spark, d):
    return Tables(spark, d).benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("query"))


@query("p20_subset_by_id", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def p20(spark, d):
    t = Tables(spark, d)
    wanted = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(wanted, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("p21_score_matrix", """
SELECT user_id || ' / ' || event_type AS row, round(avg(value), 6) AS avg_value, max(event_id) AS last_event
FROM events GROUP BY user_id, event_type""")
def p21(spark, d):
    m = Tables(spark, d).events.groupBy("user_id", "event_type").agg(
        rounded(F.avg("value")).alias("avg_value"), F.max("event_id").alias("last_event"))
    return cleaning.score_matrix(m, "user_id", "event_type", ["avg_value", "last_event"]).orderBy("row")


# ---- joins -------------------------------------------------------------------

BASE = "SELECT user_id, event_type, value FROM events"


@query("j01_inner_join_pair", """
SELECT a.conv_id, a.turn, a.role, b.n_words FROM conversations a
JOIN (SELECT conv_id, turn, len(string_split(text, ' ')) AS n_words FROM conversations) b USING (conv_id, turn)""")
def j01(spark, d):
    c = Tables(spark, d).conversations
    words = c.select("conv_id", "turn", F.size(F.split("text", " ")).cast("long").alias("n_words"))
    return c.select("conv_id", "turn", "role").join(words, ["conv_id", "turn"], "inner")


@query("j02_unblind", """
SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)""")
def j02(spark, d):
    t = Tables(spark, d)
    blind = F.concat(F.lit("A"), F.col("doc_id").cast("string"))
    sheet = t.labels.select(blind.alias("id"), "quality", "toxic")
    key = t.documents.select(blind.alias("id"), "doc_id", "source")
    return sheet.join(key, "id").select("doc_id", "source", "quality", "toxic")


@query("j03_semi_join", """
SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def j03(spark, d):
    t = Tables(spark, d)
    hit = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(hit, "o_orderkey", "left_semi").select("o_orderkey")


@query("j04_anti_join_both_ways", """
SELECT c_custkey AS id, 'missing' AS side FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)
UNION ALL SELECT DISTINCT user_id, 'unexpected' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)""")
def j04(spark, d):
    t = Tables(spark, d)
    found = t.events.select(F.col("user_id").alias("id")).distinct()
    expected = t.customer.select(F.col("c_custkey").alias("id"), "c_nationkey")
    missing = expected.select("id").join(found, "id", "left_anti").withColumn("side", F.lit("missing"))
    extra = found.join(expected.filter("c_nationkey < 12"), "id", "left_anti").withColumn("side", F.lit("unexpected"))
    return missing.unionByName(extra)


@query("j05_work_grid", """
SELECT item_id AS query_id, engine FROM benchmark, (VALUES ('none'), ('bm25'), ('vector')) e(engine)""")
def j05(spark, d):
    from plumbtrace.streaming.resume import work_grid

    return work_grid(Tables(spark, d).benchmark.select(F.col("item_id").alias("query_id")), ["none", "bm25", "vector"])


@query("j06_lookup_default", """
SELECT o_orderkey, coalesce(c_mktsegment, '') AS c_mktsegment FROM orders LEFT JOIN
  (SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey""")
def j06(spark, d):
    t = Tables(spark, d)
    notes = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return enrich.lookup(t.orders.select("o_orderkey", "o_custkey"), notes, ["o_custkey"], "c_mktsegment", "").drop("o_custkey")


@query("j07_keyed_combine", """
WITH m AS (SELECT user_id, event_type, round(avg(value), 6) AS m FROM events GROUP BY ALL),
n AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY ALL)
SELECT m.user_id, m.event_type, m.m, n.n FROM m JOIN n USING (user_id, event_type)""")
def j07(spark, d):
    ev = Tables(spark, d).events
    m = ev.groupBy("user_id", "event_type").agg(rounded(F.avg("value")).alias("m"))
    n = ev.filter("value > 50").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return m.join(n, ["user_id", "event_type"])


@query("j08_class_weight_lookup", """
WITH c AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1),
w AS (SELECT l_returnflag, (sum(n) OVER ())::DOUBLE / ((count(*) OVER ()) * n) AS w FROM c)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(w, 6) AS weight FROM lineitem JOIN w USING (l_returnflag)""")
def j08(spark, d):
    from plumbtrace.operators import audit

    li = Tables(spark, d).lineitem
    return audit.with_class_weight(li, "l_returnflag", audit.balanced_weights(li, "l_returnflag")).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", rounded(F.col("weight")).alias("weight"))


@query("j09_sample_join", """
SELECT d.doc_id AS sample_id, d.lang, l.quality, b.text AS matched FROM documents d
LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id""")
def j09(spark, d):
    from plumbtrace.plans.prompts import sample_join

    t = Tables(spark, d)
    return sample_join(
        t.documents.select(F.col("doc_id").alias("sample_id"), "lang"),
        t.labels.select(F.col("doc_id").alias("sample_id"), "quality"),
        t.benchmark.select(F.col("item_id").alias("sample_id"), F.col("text").alias("matched")))
