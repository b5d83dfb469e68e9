"""Prompt and report texts as columns, one row per case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbtrace.functions.binding import bind
from plumbtrace.operators.attribution import top_features

# Wording of the retrieval prompt; only the instruction differs between variants.
OPENING = "You are a 5G Security Expert."
TASK = "Use the provided TECHNICAL DOCUMENTATION to interpret the MACHINE LEARNING XAI DATA."
DOCUMENTATION, EVIDENCE, QUESTION = "[TECHNICAL DOCUMENTATION]", "[MACHINE LEARNING XAI DATA (SHAP/LIME)]", "[USER QUERY]"
INSTRUCTIONS = {
    "full": "INSTRUCTION: \nProvide a brief explanation (under 6 sentences if possible) and give \nactionable guidance when it is requested in the query.\n",
    "short": "INSTRUCTION:\nAnswer the prompt briefly.",
}
JUDGE_SECTIONS = ("[QUERY]", "[CONTEXT]", "[ANSWER]", "[GROUND_TRUTH]")


def sample_join(first: DataFrame, *others: DataFrame, key: str = "sample_id") -> DataFrame:
    """Attach the other artifacts of a sample; a missing one leaves gaps."""
    for other in others:
        first = first.join(other, key, "left")
    return first


def retrieval_prompt(context: Column, evidence: Column, question: Column, variant: str = "full") -> Column:
    return F.concat_ws(
        "\n", F.lit(OPENING), F.lit(""), F.lit(TASK), F.lit(""),
        F.lit(DOCUMENTATION), context, F.lit(""), F.lit(EVIDENCE), evidence, F.lit(""),
        F.lit(QUESTION), question, F.lit(""), F.lit(INSTRUCTIONS[variant]), F.lit(""))


def judge_prompt(rubric: str, query_id: Column, engine: Column, query: Column, context: Column, answer: Column, truth: Column) -> Column:
    """The rubric, the request ids and the four labelled sections; gaps become empty."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    parts = [F.lit(rubric), F.lit(""), F.concat(F.lit("QUERY_ID: "), text(query_id)), F.concat(F.lit("ENGINE: "), text(engine))]
    for heading, value in zip(JUDGE_SECTIONS, (query, context, answer, truth)):
        parts += [F.lit(""), F.lit(heading), text(value)]
    return F.concat(F.concat_ws("\n", *parts), F.lit("\n"))


REPLY_METRICS = ("faithfulness", "correctness", "answer_relevancy", "security_specificity",
                 "context_utilization_score", "hallucinated_security_reasoning")
REPLY_SCHEMA = T.StructType([
    T.StructField("query_id", T.StringType()), T.StructField("engine", T.StringType()),
    *[T.StructField(m, T.IntegerType()) for m in REPLY_METRICS],
    T.StructField("notes", T.StringType()), T.StructField("_corrupt_record", T.StringType()),
])


def parse_replies(df: DataFrame, reply: str, query: str, engine: str) -> DataFrame:
    """Typed judge scores. Ids come from the request, whatever the reply says; a reply
    that is no JSON object keeps its text in `error`."""
    parsed = bind(df, _r=F.from_json(reply, REPLY_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    return parsed.select(
        query, engine, *[F.col(f"_r.{m}").alias(m) for m in REPLY_METRICS],
        F.coalesce("_r.notes", F.lit("")).alias("notes"), F.col("_r._corrupt_record").alias("error"))


def feature_list(names: Column, values: Column, label: str, limit: int = 10) -> Column:
    """`**label (Top Features)**` and name: value pairs to four decimals."""
    pairs = F.transform(F.slice(F.arrays_zip(names.alias("n"), values.alias("v")), 1, limit),
                        lambda z: F.format_string("%s: %.4f", z["n"], z["v"]))
    return F.when(F.size(names) > 0, F.concat(F.lit(f"\n**{label} (Top Features)**:\n- "), F.array_join(pairs, "; ")))


def model_context(task: Column, model: Column, metrics: dict[str, Column], cells: dict[str, Column], *features: Column) -> Column:
    """Context of one model: headline metrics, confusion cells and its strongest features."""
    lines = [F.concat(F.lit("Task Type: "), task, F.lit(" classification")), F.concat(F.lit("Model: "), model)]
    lines.append(F.lit("\n**Performance Metrics**:"))
    lines += [F.when(v.isNotNull() & (v != 0), F.concat(F.lit(f"- {n}: "), F.format_string("%.3f", v))) for n, v in metrics.items()]
    lines.append(F.lit("\n**Confusion Matrix (values)**:"))
    lines.append(F.concat(F.lit("- "), F.concat_ws(", ", *[F.concat(F.lit(f"{n}: "), v.cast("string")) for n, v in cells.items()])))
    return F.concat_ws("\n", *lines, *features)


def case_context(sample: Column, model: Column, task: Column, correct: Column, truth: Column, predicted: Column,
                 names: Column, values: Column, phi: Column, base: Column, limit: int = 10) -> Column:
    """Context of one explained row: result, first feature values, strongest attributions, base value.

    Result lines are left out while the correctness is unknown.
    """
    first = F.transform(F.slice(F.arrays_zip(names.alias("n"), values.alias("v")), 1, limit),
                        lambda z: F.concat(F.lit("  • "), z["n"], F.lit(": "), z["v"].cast("string")))
    top = F.transform(top_features(phi, limit), lambda i: F.concat(
        F.lit("  • "), F.element_at(names, i + 1), F.format_string(": %.4f", F.element_at(phi, i + 1)),
        F.lit(" (value: "), F.element_at(values, i + 1).cast("string"), F.lit(")")))
    known = correct.isNotNull()
    word = F.when(correct, "True").otherwise("False")
    result = F.when(known, F.concat_ws(
        "\n", F.lit("\n**Sample Evaluation Results**:"), F.concat(F.lit("- Prediction Correct: "), word),
        F.concat(F.lit("- True Label: "), truth.cast("string")), F.concat(F.lit("- Predicted Label: "), predicted.cast("string"))))
    return F.concat_ws(
        "\n", F.concat(F.lit("**Sample ID**: "), sample.cast("string")), F.concat(F.lit("**Model**: "), model),
        F.concat(F.lit("**Task Type**: "), task, F.lit(" classification")), result,
        F.lit("\n**SHAP Explanation Data**:"), F.lit("- Feature Values:"), F.array_join(first, "\n"),
        F.lit("- SHAP Feature Importance (Top 10):"), F.array_join(top, "\n"),
        F.concat(F.lit("- SHAP Base Value: "), F.format_string("%.4f", base)))


def case_prompt(context: Column, correct: Column, instructions: dict[str, str]) -> Column:
    """Instruction by outcome (keys correct, incorrect, unknown), then the context."""
    head = F.when(correct, F.lit(instructions["correct"])).when(~correct, F.lit(instructions["incorrect"])).otherwise(F.lit(instructions["unknown"]))
    return F.concat_ws("\n\n", head, context)


def score_report(overall: Column, dimensions: dict[str, tuple[Column, dict[str, Column]]]) -> Column:
    """Quality report text: overall, then every dimension with its parts."""
    three = lambda c: F.format_string("%.3f", c)
    parts = [F.lit("# Simplified XAI Quality Assessment Report\n\n## Overall Score: "), three(overall), F.lit("\n\n## Detailed Dimension Scores\n\n")]
    for name, (score, details) in dimensions.items():
        parts += [F.lit(f"### {name.title()}: "), three(score), F.lit("\n")]
        for key, value in details.items():
            parts += [F.lit(f"- {key}: "), three(value), F.lit("\n")]
        parts.append(F.lit("\n"))
    return F.concat(*parts)


def report_table(report: DataFrame, groups: list[str], order: str) -> DataFrame:
    """Classification report rows as a table with bars, one text per group.

    A report has as many lines as classes, so its lines fit one row.
    """
    line = F.format_string("| %s | %.4f | %.4f | %.4f | %d |", F.col("class"), F.col("precision"), F.col("recall"), F.col("f1"), F.col("support"))
    lines = report.select(*groups, F.struct(F.col(order).alias("o"), line.alias("l")).alias("s"))
    texts = lines.groupBy(*groups).agg(F.array_sort(F.collect_list("s")).alias("s"))
    head = "| class | precision | recall | f1-score | support |\n|---|---|---|---|---|\n"
    return texts.select(*groups, F.concat(F.lit(head), F.array_join(F.transform("s", lambda x: x["l"]), "\n")).alias("report"))
