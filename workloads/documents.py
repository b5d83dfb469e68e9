"""Prompts, reports and what is parsed back from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbtrace.functions import parsing
from plumbtrace.functions.scalars import rounded
from plumbtrace.operators import retrieval
from plumbtrace.plans import prompts

from .metrics import rnd
from .registry import Tables, query
from .retrieval import WITH_RUNS, chunk_table, runs

REPORT_SRC = """src AS (SELECT p_brand, round(sqrt(avg(p_size)) / 8.0::DOUBLE, 6) AS a, round(sqrt(avg(p_retailprice)) / 70.0::DOUBLE, 6) AS b, round(sqrt(max(p_size)) / 9.0::DOUBLE, 6) AS c, count(*) AS n FROM part GROUP BY p_brand)"""


def report_source(spark, d):
    return Tables(spark, d).part.groupBy("p_brand").agg(
        rounded(F.sqrt(F.avg("p_size")) / 8.0).alias("a"), rounded(F.sqrt(F.avg("p_retailprice")) / 70.0).alias("b"),
        rounded(F.sqrt(F.max("p_size")) / 9.0).alias("c"), F.count("*").alias("n"))


@query("f01_report_metrics", f"""WITH {REPORT_SRC} SELECT p_brand, round(a, 4) AS accuracy, round(b, 4) AS precision, round(c, 4) AS recall, round(a, 4) AS f1_score FROM src""")
def f01(spark, d):
    s = report_source(spark, d)
    rows = s.select("p_brand", F.inline(F.array(
        F.struct(F.lit("accuracy").alias("class"), F.col("a").alias("precision"), F.col("a").alias("recall"), F.col("a").alias("f1"), F.col("n").alias("support"), F.lit(1).alias("o")),
        F.struct(F.lit("weighted avg").alias("class"), F.col("b").alias("precision"), F.col("c").alias("recall"), F.col("a").alias("f1"), F.col("n").alias("support"), F.lit(2).alias("o")))))
    texts = prompts.report_table(rows, ["p_brand"], "o")
    return texts.select("p_brand", *[c.alias(n) for n, c in parsing.report_metrics(F.col("report")).items()])


DIMS = ("faithfulness", "robustness", "complexity")


def quality_report(spark, d):
    s = report_source(spark, d)
    dims = {"faithfulness": (F.col("a"), {"deletion_auc": F.col("b")}), "robustness": (F.col("b"), {"jaccard_similarity": F.col("c")}),
            "complexity": (F.col("c"), {})}
    return s.select("p_brand", prompts.score_report(F.col("a"), dims).alias("report"))


@query("f02_quality_scores", f"WITH {REPORT_SRC} SELECT p_brand, round(a, 3) AS overall, round(a, 3) AS faithfulness, round(b, 3) AS robustness, round(c, 3) AS complexity FROM src")
def f02(spark, d):
    r = quality_report(spark, d)
    return r.select("p_brand", *[c.alias(n) for n, c in parsing.quality_scores(F.col("report")).items()])


@query("f19_report_text", f"""WITH {REPORT_SRC}, r AS (SELECT p_brand, printf('%.3f', a) AS a, printf('%.3f', b) AS b, printf('%.3f', c) AS c FROM src)
SELECT p_brand, '# Simplified XAI Quality Assessment Report' || chr(10) || chr(10) || '## Overall Score: ' || a || chr(10) || chr(10) || '## Detailed Dimension Scores' || chr(10) || chr(10)
 || '### Faithfulness: ' || a || chr(10) || '- deletion_auc: ' || b || chr(10) || chr(10) || '### Robustness: ' || b || chr(10) || '- jaccard_similarity: ' || c || chr(10) || chr(10)
 || '### Complexity: ' || c || chr(10) || chr(10) AS report FROM r""")
def f19(spark, d):
    return quality_report(spark, d)


@query("f03_json_field", """SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, coalesce(json_extract_string(props, '$.missing.deep'), 'n/a') AS missing FROM events""")
def f03(spark, d):
    return Tables(spark, d).events.select(
        "event_id", parsing.json_field(F.col("props"), "$.k", "none").alias("k"), parsing.json_field(F.col("props"), "$.missing.deep", "n/a").alias("missing"))


@query("f04_prediction_correct", """SELECT event_id, CASE WHEN event_type = 'error' OR event_type = 'view' THEN NULL ELSE value > 50 END AS prediction_correct FROM events""")
def f04(spark, d):
    flag = F.when(F.col("value") > 50, "true").otherwise("false")
    text = F.when(F.col("event_type") == "error", F.lit("no json")).when(F.col("event_type") == "view", F.lit('{"other": 1}')).otherwise(
        F.concat(F.lit('{"note": "prediction_correct: maybe", "prediction_correct": '), flag, F.lit("}")))
    return Tables(spark, d).events.select("event_id", parsing.prediction_correct(text).alias("prediction_correct"))


def prompt_sql(instruction):
    lines = ["You are a 5G Security Expert.", "", "Use the provided TECHNICAL DOCUMENTATION to interpret the MACHINE LEARNING XAI DATA.", "", "[TECHNICAL DOCUMENTATION]",
             None, "", "[MACHINE LEARNING XAI DATA (SHAP/LIME)]", "No XAI data provided.", "", "[USER QUERY]", 0, "", instruction, ""]
    parts = ["c.context" if x is None else "b.text" if x == 0 else "'" + x.replace("\n", "' || chr(10) || '") + "'" for x in lines]
    return f"""{WITH_RUNS}, x AS (SELECT item_id, engine, unnest(ids) AS chunk_id, generate_subscripts(ids, 1) AS i FROM runs),
t AS (SELECT item_id, engine, string_agg(text, chr(10) ORDER BY i) AS context FROM x JOIN chunks USING (chunk_id) GROUP BY ALL),
c AS (SELECT r.item_id, r.engine, coalesce(t.context, 'No additional technical documentation available.') AS context FROM runs r LEFT JOIN t ON t.item_id = r.item_id AND t.engine = r.engine)
SELECT b.item_id, c.engine, {' || chr(10) || '.join(parts)} AS prompt FROM c JOIN benchmark b USING (item_id)"""


def prompt_rows(spark, d, variant):
    from plumbtrace.operators.enrich import NO_EVIDENCE

    c = retrieval.contexts(runs(spark, d), "item_id", chunk_table(spark, d), "chunk_id", "text")
    q = Tables(spark, d).benchmark.select("item_id", F.col("text").alias("query"))
    return c.join(q, "item_id").select("item_id", "engine", prompts.retrieval_prompt(F.col("context"), F.lit(NO_EVIDENCE), F.col("query"), variant).alias("prompt"))


@query("f14_retrieval_prompt", prompt_sql("INSTRUCTION: \nProvide a brief explanation (under 6 sentences if possible) and give \nactionable guidance when it is requested in the query.\n"))
def f14(spark, d):
    return prompt_rows(spark, d, "full")


@query("f14b_retrieval_prompt_short", prompt_sql("INSTRUCTION:\nAnswer the prompt briefly."))
def f14b(spark, d):
    return prompt_rows(spark, d, "short")


@query("f15_judge_prompt", """SELECT a.conv_id, a.turn, 'Rate the answer.' || chr(10) || chr(10) || 'QUERY_ID: ' || a.conv_id || chr(10) || 'ENGINE: ' || a.role || chr(10) || chr(10) || '[QUERY]' || chr(10) || a.text || chr(10) || chr(10)
 || '[CONTEXT]' || chr(10) || chr(10) || chr(10) || '[ANSWER]' || chr(10) || coalesce(b.text, '') || chr(10) || chr(10) || '[GROUND_TRUTH]' || chr(10) || a.role || chr(10) AS prompt
FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
def f15(spark, d):
    c = Tables(spark, d).conversations
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    j = c.join(nxt, ["conv_id", "turn"], "left")
    return j.select("conv_id", "turn", prompts.judge_prompt(
        "Rate the answer.", F.col("conv_id"), F.col("role"), F.col("text"), F.lit(None), F.col("answer"), F.col("role")).alias("prompt"))


@query("f16_model_context", """WITH m AS (SELECT l_returnflag AS model, avg(l_discount) * 10 AS acc, avg(l_tax) * 10 AS prec, count(*) FILTER (l_quantity > 25) AS tp, count(*) FILTER (l_quantity <= 25) AS tn,
  round(avg(l_discount), 6) AS f1, round(avg(l_tax), 6) AS f2 FROM lineitem GROUP BY 1)
SELECT model, 'Task Type: binary classification' || chr(10) || 'Model: ' || model || chr(10) || chr(10) || '**Performance Metrics**:' || chr(10) || '- Accuracy: ' || printf('%.3f', round(acc, 6)) || chr(10) || '- Precision: ' || printf('%.3f', round(prec, 6)) || chr(10)
 || chr(10) || '**Confusion Matrix (values)**:' || chr(10) || '- TN: ' || tn || ', TP: ' || tp || chr(10) || chr(10) || '**SHAP Importance (Top Features)**:' || chr(10) || '- discount: ' || printf('%.4f', f1) || '; tax: ' || printf('%.4f', f2) AS context FROM m""")
def f16(spark, d):
    m = Tables(spark, d).lineitem.groupBy(F.col("l_returnflag").alias("model")).agg(
        rounded(F.avg("l_discount") * 10).alias("acc"), rounded(F.avg("l_tax") * 10).alias("prec"),
        F.count_if(F.col("l_quantity") > 25).alias("tp"), F.count_if(F.col("l_quantity") <= 25).alias("tn"),
        rounded(F.avg("l_discount")).alias("f1"), rounded(F.avg("l_tax")).alias("f2"))
    features = prompts.feature_list(F.array(F.lit("discount"), F.lit("tax")), F.array("f1", "f2"), "SHAP Importance")
    return m.select("model", prompts.model_context(
        F.lit("binary"), F.col("model"), {"Accuracy": F.col("acc"), "Precision": F.col("prec"), "Recall": F.lit(None).cast("double")},
        {"TN": F.col("tn"), "TP": F.col("tp")}, features).alias("context"))


CASE_SQL = """WITH s AS (SELECT p_partkey, p_type, p_size, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 3 = 1 END AS ok, p_size * 0.5::DOUBLE AS a, -(p_partkey % 7) * 1.25::DOUBLE AS b FROM part)
SELECT p_partkey, CASE WHEN ok THEN 'Explain the success.' WHEN NOT ok THEN 'Explain the miss.' ELSE 'Explain the case.' END || chr(10) || chr(10) ||
 '**Sample ID**: ' || p_partkey || chr(10) || '**Model**: ' || p_type || chr(10) || '**Task Type**: binary classification' || chr(10) ||
 CASE WHEN ok IS NULL THEN '' ELSE chr(10) || '**Sample Evaluation Results**:' || chr(10) || '- Prediction Correct: ' || CASE WHEN ok THEN 'True' ELSE 'False' END || chr(10) || '- True Label: 1' || chr(10) || '- Predicted Label: ' || CASE WHEN ok THEN '1' ELSE '0' END || chr(10) END ||
 chr(10) || '**SHAP Explanation Data**:' || chr(10) || '- Feature Values:' || chr(10) || '  • size: ' || p_size || chr(10) || '  • key: ' || p_partkey || chr(10) || '- SHAP Feature Importance (Top 10):' || chr(10) ||
 CASE WHEN abs(a) >= abs(b) THEN '  • size: ' || printf('%.4f', a) || ' (value: ' || p_size || ')' || chr(10) || '  • key: ' || printf('%.4f', b) || ' (value: ' || p_partkey || ')'
   ELSE '  • key: ' || printf('%.4f', b) || ' (value: ' || p_partkey || ')' || chr(10) || '  • size: ' || printf('%.4f', a) || ' (value: ' || p_size || ')' END || chr(10) || '- SHAP Base Value: 0.5000' AS prompt FROM s"""


@query("f17_case_prompt", CASE_SQL)
def f17(spark, d):
    m = F.col("p_size") % 3
    correct = F.when(m != 0, m == 1)
    p = Tables(spark, d).part.withColumn("ok", correct)
    phi = F.array(F.col("p_size") * 0.5, -(F.col("p_partkey") % 7) * 1.25)
    context = prompts.case_context(
        F.col("p_partkey"), F.col("p_type"), F.lit("binary"), F.col("ok"), F.lit(1), F.when(F.col("ok"), 1).otherwise(0),
        F.array(F.lit("size"), F.lit("key")), F.array(F.col("p_size").cast("long"), F.col("p_partkey")), phi, F.lit(0.5))
    texts = {"correct": "Explain the success.", "incorrect": "Explain the miss.", "unknown": "Explain the case."}
    return p.select("p_partkey", prompts.case_prompt(context, F.col("ok"), texts).alias("prompt"))


@query("f18_judge_reply", """SELECT event_id, event_type AS engine, CASE WHEN event_type <> 'error' THEN (user_id % 3)::INTEGER END AS faithfulness, CASE WHEN event_type <> 'error' THEN 2 END AS correctness,
 NULL::INTEGER AS answer_relevancy, NULL::INTEGER AS security_specificity, NULL::INTEGER AS context_utilization_score, NULL::INTEGER AS hallucinated_security_reasoning,
 CASE WHEN event_type = 'view' THEN 'unsure' ELSE '' END AS notes, CASE WHEN event_type = 'error' THEN 'Sorry, {' END AS error FROM events""")
def f18(spark, d):
    note = F.when(F.col("event_type") == "view", F.lit(', "notes": "unsure"')).otherwise(F.lit(""))
    reply = F.when(F.col("event_type") == "error", F.lit("Sorry, {")).otherwise(F.concat(
        F.lit('{"query_id": "made up", "engine": "other", "faithfulness": '), (F.col("user_id") % 3).cast("string"), F.lit(', "correctness": 2'), note, F.lit("}")))
    rows = Tables(spark, d).events.select("event_id", F.col("event_type").alias("engine"), reply.alias("reply"))
    return prompts.parse_replies(rows, "reply", "event_id", "engine")
