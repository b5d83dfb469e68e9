"""Writers. Executors write; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

RESULT_LAYOUT = ("dataset", "task", "model")


def sink_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def sink_json(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.json(path)


def sink_results(df: DataFrame, path: str, layout: tuple[str, ...] = RESULT_LAYOUT, mode: str = "append") -> None:
    """Results below dataset=/task=/model= so that a reader prunes to what it asks for."""
    df.write.mode(mode).partitionBy(*layout).parquet(path)


def attribution_document(sample: Column, base: Column, names: Column, values: Column, phi: Column,
                         prediction: Column, truth: Column) -> Column:
    """One explained row as a JSON attribution document.

    `names`, `values` and `phi` are parallel arrays; the importance list is sorted
    by absolute attribution, ties in feature order.
    """
    items = F.transform(
        F.arrays_zip(names.alias("n"), values.alias("v"), phi.alias("p")),
        lambda z, i: F.struct(
            (-F.abs(z["p"])).alias("k"), i.alias("i"),
            F.struct(z["n"].alias("feature"), z["p"].alias("shap_value"), z["v"].alias("feature_value")).alias("item"),
        ),
    )
    ordered = F.transform(F.array_sort(items), lambda z: z["item"])
    return F.to_json(F.struct(
        sample.alias("sample_index"), base.alias("base_value"),
        F.map_from_arrays(names, values).alias("feature_values"),
        phi.alias("shap_values"), names.alias("feature_names"),
        prediction.cast("double").alias("prediction"), truth.cast("double").alias("true_label"),
        ordered.alias("feature_importance"),
    ))


def surrogate_document(sample: Column, prediction: Column, truth: Column, names: Column, values: Column,
                       rules: Column, weights: Column) -> Column:
    """One explained row as the ranked-rule text layout read by the surrogate scanner."""
    lines = F.zip_with(names, values, lambda n, v: F.concat(n, F.lit("    "), v.cast("string")))
    ranked = F.transform(
        F.arrays_zip(rules.alias("r"), weights.alias("w")),
        lambda z, i: F.format_string("%d. %s: %.4f", i + 1, z["r"], z["w"]),
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("LIME Explanation for Sample "), sample.cast("string")),
        F.concat(F.lit("Prediction: "), prediction.cast("string")),
        F.concat(F.lit("True Label: "), truth.cast("string")),
        F.lit(""), F.lit("Feature Values:"), F.array_join(lines, "\n"),
        F.lit(""), F.lit("LIME Feature Importance (Top 10):"), F.array_join(ranked, "\n"),
    )


def sink_documents(df: DataFrame, document: str | Column, path: str, partition_by: tuple[str, ...], compression: str | None = None) -> None:
    """One document per line of JSON lines, below one folder per partition value.

    The writer takes rows in the order of the folders. Given as an expression, a document is built after that sort,
    so that the sort holds the columns it is made of; given as a column, the sort holds the documents.
    """
    ordered = df.sortWithinPartitions(*partition_by)
    writer = ordered.select(*partition_by, (F.col(document) if isinstance(document, str) else document).alias("value")).write.mode("errorifexists")
    if compression:
        writer = writer.option("compression", compression)
    writer.partitionBy(*partition_by).text(path)


def document_index(df: DataFrame, keys: tuple[str, ...], document: str, preview: int = 200) -> DataFrame:
    """Key columns, length and a short preview of every document."""
    d = F.col(document)
    return df.select(
        *keys,
        F.length(d).alias("n_chars"),
        F.when(F.length(d) > preview, F.concat(F.substring(d, 1, preview), F.lit("..."))).otherwise(d).alias("preview"),
    )
