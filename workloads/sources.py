"""Scans and sinks: tables are written in the format under test and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from plumbtrace.sources import files, scratch, sinks
from plumbtrace.streaming import resume
from plumbtrace.functions.scalars import rounded

from .registry import Tables, query

RECORD = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
])


@query("s01_scan_csv", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders""")
def s01(spark, d):
    t = Tables(spark, d)
    path = scratch.fresh_path(spark, "orders_csv")
    cols = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    # headers with leading blanks, as exported flow tables have them
    sinks.sink_csv(cols.toDF(*[f" {c}" for c in cols.columns]), path)
    return files.scan_csv(spark, path, cols.schema)


@query("s02_drop_index_columns", """
SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def s02(spark, d):
    t = Tables(spark, d)
    df = t.customer.select(
        F.col("c_custkey").alias("Unnamed: 0"), "c_custkey",
        F.col("c_name").alias("Unnamed: 0.1"), "c_nationkey", "c_acctbal", "c_mktsegment")
    return files.drop_index_columns(df)


@query("s03_scan_json_records", """
SELECT event_id, user_id, event_type, value FROM events""")
def s03(spark, d):
    # bundles of at most 500 rows; every second file wraps its list in an object
    events = Tables(spark, d).events.select(*RECORD.names)
    body = F.to_json(F.collect_list(F.struct(*RECORD.names)))
    bundles = events.groupBy(F.floor(F.col("event_id") / 500).alias("bundle")).agg(body.alias("body"))
    text = F.when(F.col("bundle") % 2 == 0, F.col("body")).otherwise(
        F.concat(F.lit('{"meta": {"n": 1}, "judgments": '), F.col("body"), F.lit("}")))
    path = scratch.fresh_path(spark, "records")
    bundles.select("bundle", text.alias("value")).write.partitionBy("bundle").text(path)
    return files.scan_json_records(spark, path + "/*/*.txt", RECORD)


@query("s04_scan_lenient_json", """
SELECT event_id, user_id, event_type, value FROM events""")
def s04(spark, d):
    # comma-joined objects without brackets, files of at most 500 rows
    events = Tables(spark, d).events.select(*RECORD.names)
    line = F.concat(F.to_json(F.struct(*RECORD.names)), F.lit(","))
    bundle = F.floor(F.col("event_id") / 500).alias("bundle")
    path = scratch.fresh_path(spark, "lenient")
    events.select(bundle, line.alias("value")).repartition("bundle").write.partitionBy("bundle").text(path)
    return files.scan_lenient_json(spark, path + "/*/*.txt", RECORD)


NAMES = ("quantity", "price", "discount", "tax")


def _attribution_parts(t: Tables):
    """Line items with the folder of their document, and the document as an expression."""
    li = t.lineitem.select(F.substring("l_returnflag", 1, 1).alias("model"), "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                           "l_discount", "l_tax", "l_linestatus")
    values = [F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount") + F.lit(0.0), F.col("l_tax") + F.lit(0.0)]
    phi = [values[0] * 0.01, values[1] * 0.00001, values[2] * -2.0, values[3] * 3.0]
    return li, sinks.attribution_document(
        F.col("l_orderkey") * 1000 + F.col("l_linenumber"), F.lit(0.5),
        F.array(*[F.lit(n) for n in NAMES]), F.array(*values),
        F.array(*[F.round(p, 8) + F.lit(0.0) for p in phi]),
        (F.col("l_linestatus") == "F").cast("double"), (F.col("l_quantity") > 25).cast("double"))


LONG_SQL = """
WITH base AS (
  SELECT l_orderkey * 1000 + l_linenumber AS sample_index,
         (l_linestatus = 'F')::DOUBLE AS prediction, (l_quantity > 25)::DOUBLE AS true_label,
         l_quantity AS v1, l_extendedprice AS v2, l_discount + 0.0 AS v3, l_tax + 0.0 AS v4,
         round(l_quantity * 0.01::DOUBLE, 8) AS p1, round(l_extendedprice * 0.00001::DOUBLE, 8) AS p2,
         round(l_discount * -2.0::DOUBLE, 8) + 0.0::DOUBLE AS p3, round(l_tax * 3.0::DOUBLE, 8) AS p4,
         l_partkey, l_suppkey
  FROM lineitem),
long AS (
  SELECT sample_index, l_partkey, l_suppkey, prediction, true_label, unnest([0, 1, 2, 3]) AS i,
         unnest(['quantity', 'price', 'discount', 'tax']) AS feature,
         unnest([p1, p2, p3, p4]) AS attribution, unnest([v1, v2, v3, v4]) AS feature_value
  FROM base),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY sample_index, l_partkey, l_suppkey, prediction, true_label
                               ORDER BY abs(attribution) DESC, i) AS rank
  FROM long)
"""


@query("s05_scan_attribution_documents", LONG_SQL + """
SELECT sample_index, prediction, true_label, rank::INTEGER AS rank, feature,
       attribution, feature_value + 0.0 AS feature_value FROM ranked""")
def s05(spark, d):
    path = scratch.fresh_path(spark, "attributions")
    items, document = _attribution_parts(Tables(spark, d))
    sinks.sink_documents(items, document, path, ("model",), "snappy")
    rows = files.scan_attribution_documents(spark, path, multiline=False)
    return rows.select("sample_index", "prediction", "true_label", "rank", "feature", "attribution",
                       (F.col("feature_value") + F.lit(0.0)).alias("feature_value"))


@query("s06_scan_surrogate_documents", """
WITH p AS (SELECT p_partkey, p_type, p_size, p_retailprice FROM part),
r AS (
  SELECT p_partkey, 1 AS rank, 'size > ' || (p_size::VARCHAR) AS rule, 0.25::DOUBLE AS weight,
         'size' AS feature, '>' AS op, p_size::DOUBLE AS lower, NULL::DOUBLE AS upper FROM p
  UNION ALL
  SELECT p_partkey, 2, '-0.50 < Down/Up Ratio <= ' || (p_size::VARCHAR), -0.125::DOUBLE,
         'Down/Up Ratio', 'between', -0.5::DOUBLE, p_size::DOUBLE FROM p
  UNION ALL
  SELECT p_partkey, 3, ' source IP <= ' || (p_partkey::VARCHAR), 0.0625::DOUBLE,
         ' source IP', '<=', NULL::DOUBLE, p_partkey::DOUBLE FROM p)
SELECT r.p_partkey AS sample_id, p.p_type AS prediction, (p.p_size % 2)::VARCHAR AS true_label,
       r.rank::INTEGER AS rank, r.rule, r.weight, r.feature, r.op, r.lower, r.upper
FROM r JOIN p USING (p_partkey)""")
def s06(spark, d):
    size = F.col("p_size").cast("string")
    docs = Tables(spark, d).part.select(sinks.surrogate_document(
        F.col("p_partkey"), F.col("p_type"), F.col("p_size") % 2,
        F.array(F.lit("size"), F.lit("retail price")), F.array(F.col("p_size").cast("double"), F.col("p_retailprice")),
        F.array(F.concat(F.lit("size > "), size), F.concat(F.lit("-0.50 < Down/Up Ratio <= "), size),
                F.concat(F.lit(" source IP <= "), F.col("p_partkey").cast("string"))),
        F.array(F.lit(0.25), F.lit(-0.125), F.lit(0.0625))).alias("value"))
    return files.parse_surrogate_documents(docs)


@query("s07_scan_documents", """
SELECT event_type AS name, count(*) AS n_lines, sum(length(props)) + count(*) AS n_chars
FROM events GROUP BY event_type""")
def s07(spark, d):
    path = scratch.fresh_path(spark, "texts")
    ev = Tables(spark, d).events.select("event_type", F.col("props").alias("value"))
    ev.repartition(5, "event_type").write.partitionBy("event_type").text(path)
    docs = files.scan_documents(spark, path + "/*/*.txt")
    return docs.groupBy(F.regexp_extract("path", r"event_type=([a-z]+)", 1).alias("name")).agg(
        F.sum(F.size(F.split("text", "\n")) - 1).cast("long").alias("n_lines"),
        F.sum(F.length("text")).alias("n_chars"))


@query("s08_scan_relevance", """
WITH k AS (SELECT DISTINCT event_id // 50 AS q FROM events)
SELECT 'Q' || k.q AS query_id, e.event_id::VARCHAR AS chunk_id
FROM k LEFT JOIN events e ON e.event_id // 50 = k.q AND e.event_type = 'click' AND e.value > 120""")
def s08(spark, d):
    ev = Tables(spark, d).events
    hit = (F.col("event_type") == "click") & (F.col("value") > 120)
    q = F.floor(F.col("event_id") / 50)
    lists = ev.groupBy(q.alias("q")).agg(F.collect_list(F.when(hit, F.col("event_id").cast("string"))).alias("chunks"))
    # a file holds the lists of 1,000 queries
    entry = F.struct(F.concat(F.lit("Q"), F.col("q").cast("string")), F.col("chunks"))
    whole = lists.groupBy(F.floor(F.col("q") / 1000).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    path = scratch.fresh_path(spark, "qrels")
    whole.write.partitionBy("part").text(path)
    return files.scan_relevance(spark, path + "/*/*.txt")


@query("s08b_scan_query_set", """
SELECT item_id::VARCHAR AS id, CASE WHEN item_id % 2 = 0 THEN 'retrieval' ELSE 'usefulness' END AS category,
       item_id::VARCHAR AS sample_id, 'none' AS xai_file, text AS query, md5(text) AS ground_truth
FROM benchmark""")
def s08b(spark, d):
    b = Tables(spark, d).benchmark
    path = scratch.fresh_path(spark, "query_set")
    b.select(F.col("item_id").cast("string").alias("id"),
             F.when(F.col("item_id") % 2 == 0, "retrieval").otherwise("usefulness").alias("category"),
             F.col("item_id").cast("string").alias("sample_id"), F.lit("none").alias("xai_file"),
             F.col("text").alias("query"), F.md5("text").alias("ground_truth")).write.json(path)
    return spark.read.schema(files.QUERY_SCHEMA).json(path)


@query("s09_sink_csv", "SELECT doc_id, text, lang, source FROM documents")
def s09(spark, d):
    docs = Tables(spark, d).documents.select("doc_id", "text", "lang", "source")
    path = scratch.fresh_path(spark, "docs_csv")
    sinks.sink_csv(docs, path)
    return spark.read.schema(docs.schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


@query("s10_sink_json", """
SELECT l_returnflag AS model, l_linestatus AS task, count(*) AS n, sum(l_quantity)::BIGINT AS quantity
FROM lineitem GROUP BY ALL""")
def s10(spark, d):
    m = Tables(spark, d).lineitem.groupBy(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("task")).agg(
        F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))
    path = scratch.fresh_path(spark, "metrics")
    sinks.sink_json(m, path, ("model", "task"))
    return spark.read.schema(m.schema).json(path)


@query("s11_result_layout", """
SELECT 'li' AS dataset, l_linestatus AS task, l_returnflag AS model, l_suppkey, round(sum(l_extendedprice), 2) AS total
FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'R' GROUP BY ALL""")
def s11(spark, d):
    r = Tables(spark, d).lineitem.groupBy(
        F.lit("li").alias("dataset"), F.col("l_linestatus").alias("task"), F.col("l_returnflag").alias("model"), "l_suppkey",
    ).agg(rounded(F.sum("l_extendedprice"), 2).alias("total"))
    path = scratch.fresh_path(spark, "results")
    sinks.sink_results(r, path)
    return spark.read.schema(r.schema).parquet(path).filter("task = 'F' AND model = 'R'")


@query("s12_latest_artifacts", """
SELECT 'cust' AS dataset, c_mktsegment AS task, 'N' || c_nationkey AS model, 'report' AS artifact,
       CASE WHEN c_nationkey % 3 = 0 THEN 'md' ELSE 'txt' END AS extension, count(*)::VARCHAR AS content
FROM customer GROUP BY c_mktsegment, c_nationkey""")
def s12(spark, d):
    # markdown for every model, text for two thirds of them: text wins where both exist
    counts = Tables(spark, d).customer.groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").cast("string").alias("content"))
    base = F.concat(F.lit("/out/cust/"), F.col("c_mktsegment"), F.lit("/N"), F.col("c_nationkey").cast("string"), F.lit("/report."))
    md = counts.select(F.concat(base, F.lit("md")).alias("path"), "content")
    txt = counts.filter("c_nationkey % 3 <> 0").select(F.concat(base, F.lit("txt")).alias("path"), "content")
    other = counts.select(F.concat(base, F.lit("png")).alias("path"), "content")
    return files.latest_artifacts(md.unionByName(txt).unionByName(other))


ENGINES = ["none", "bm25", "vector"]


@query("s13_resume_work_list", """
WITH done AS (
  SELECT DISTINCT user_id, ['none', 'bm25', 'vector'][(event_id % 3 + 1)::INTEGER] AS engine,
         CASE WHEN event_type = 'error' THEN 'failed' END AS error FROM events)
SELECT q.user_id AS query_id, e.engine FROM (SELECT DISTINCT user_id FROM events) q,
     (VALUES ('none'), ('bm25'), ('vector')) e(engine)
WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.user_id = q.user_id AND d.engine = e.engine AND d.error IS NULL)
UNION ALL
SELECT c_custkey, e.engine FROM customer, (VALUES ('none'), ('bm25'), ('vector')) e(engine)
WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
def s13(spark, d):
    t = Tables(spark, d)
    ev = t.events
    engine = F.element_at(F.array(*[F.lit(e) for e in ENGINES]), (F.col("event_id") % 3 + 1).cast("int"))
    done = ev.select(F.col("user_id").alias("query_id"), engine.alias("engine"),
                     F.when(F.col("event_type") == "error", "failed").alias("error"))
    asked = ev.select(F.col("user_id").alias("query_id")).union(t.customer.select("c_custkey")).distinct()
    return resume.resume_work_list(asked, ENGINES, done)


@query("s14_input_fingerprint", """
SELECT p_partkey AS name, sha256(p_name || chr(10)) AS sha256, length(p_name) + 1 AS length FROM part""")
def s14(spark, d):
    part = Tables(spark, d).part
    line = part.select("p_partkey", F.concat("p_name", F.lit("\n")).cast("binary").alias("content"))
    return line.select(F.col("p_partkey").alias("name"), F.sha2("content", 256).alias("sha256"),
                       F.length("content").cast("long").alias("length"))


@query("s14b_file_fingerprint")
def s14b(spark, d):
    return files.input_fingerprint(spark, d + "/*.parquet").select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "length", "sha256")


@query("s15_case_documents", """
SELECT c_custkey AS case_id, c_mktsegment AS model, length(doc) AS n_chars,
       CASE WHEN length(doc) > 200 THEN substr(doc, 1, 200) || '...' ELSE doc END AS preview
FROM (SELECT c_custkey, c_mktsegment,
        'LIME Explanation for Sample ' || c_custkey || chr(10) || 'Prediction: ' || c_mktsegment || chr(10) ||
        'True Label: ' || c_nationkey || chr(10) || chr(10) || 'Feature Values:' || chr(10) ||
        'nation    ' || c_nationkey || chr(10) || 'name    ' || c_name || chr(10) || chr(10) ||
        'LIME Feature Importance (Top 10):' || chr(10) || '1. nation > ' || c_nationkey || ': 0.5000' || chr(10) ||
        '2. name = ' || c_custkey || ': -0.2500' AS doc FROM customer)""")
def s15(spark, d):
    c = Tables(spark, d).customer
    nation, key = F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")
    doc = sinks.surrogate_document(
        F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_nationkey"),
        F.array(F.lit("nation"), F.lit("name")), F.array(nation, F.col("c_name")),
        F.array(F.concat(F.lit("nation > "), nation), F.concat(F.lit("name = "), key)),
        F.array(F.lit(0.5), F.lit(-0.25)))
    cases = c.select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("model"), doc.alias("document"))
    path = scratch.fresh_path(spark, "cases")
    cases.write.partitionBy("model").json(path)
    back = spark.read.schema(cases.schema).json(path)
    return sinks.document_index(back, ("case_id", "model"), "document")


@query("s16_evidence_lookup", """
SELECT b.item_id, b.xai_file, CASE WHEN b.xai_file = 'none' THEN 'No XAI data provided.'
       WHEN d.doc_id IS NULL THEN 'Error loading XAI: not found' ELSE substr(d.text, 1, 1500) END AS evidence
FROM (SELECT doc_id AS item_id, CASE WHEN quality = 0 THEN 'none' ELSE 'doc_' || (doc_id * 2) || '.txt' END AS xai_file FROM labels) b
LEFT JOIN documents d ON b.xai_file = 'doc_' || d.doc_id || '.txt'""")
def s16(spark, d):
    from plumbtrace.operators.enrich import evidence_lookup

    t = Tables(spark, d)
    asked = t.labels.select(
        F.col("doc_id").alias("item_id"),
        F.when(F.col("quality") == 0, "none").otherwise(
            F.concat(F.lit("doc_"), (F.col("doc_id") * 2).cast("string"), F.lit(".txt"))).alias("xai_file"))
    named = t.documents.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("xai_file"), "text")
    return evidence_lookup(asked, named, "xai_file", "text").select("item_id", "xai_file", "evidence")


@query("s16b_json_evidence", """
SELECT b.item_id, b.xai_file, CASE WHEN e.vec_id IS NULL THEN 'Error loading XAI: not found'
       ELSE substr('{"id": ' || e.vec_id || ', "values": [' || array_to_string(list_transform(e.embedding, lambda x: CASE WHEN isfinite(x) THEN CAST(CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS VARCHAR) ELSE 'null' END), ', ') || ']}', 1, 1500) END AS evidence
FROM (SELECT vec_id AS item_id, 'vec_' || (vec_id * 2) || '.json' AS xai_file FROM embeddings) b
LEFT JOIN (SELECT * FROM embeddings WHERE embedding IS NOT NULL) e ON b.xai_file = 'vec_' || e.vec_id || '.json'""")
def s16b(spark, d):
    from plumbtrace.operators.enrich import evidence_lookup

    rows = Tables(spark, d).embeddings
    asked = rows.select(
        F.col("vec_id").alias("item_id"), F.concat(F.lit("vec_"), (F.col("vec_id") * 2).cast("string"), F.lit(".json")).alias("xai_file"))
    values = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) < float("inf"), F.floor(1024 * x.cast("double"))))
    body = F.to_json(F.struct(F.col("vec_id").alias("id"), values.alias("values")), {"pretty": "true"})
    named = rows.filter(F.col("embedding").isNotNull()).select(
        F.concat(F.lit("vec_"), F.col("vec_id").cast("string"), F.lit(".json")).alias("xai_file"), body.alias("text"))
    return evidence_lookup(asked, named, "xai_file", "text").select("item_id", "xai_file", "evidence")
