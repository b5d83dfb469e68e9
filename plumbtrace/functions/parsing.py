"""Numbers and flags read back from report texts and JSON."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

NUMBER = r"(-?\d+(?:\.\d+)?)"
REPORT_COLUMNS = ("precision", "recall", "f1", "support")


def number_after(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern + NUMBER, 1)
    return F.when(found != "", found.cast("double"))


def report_cell(text: Column, row: str, column: str) -> Column:
    """Number in a named row and column of a report table written with bars."""
    before = r"\|\s*-?[\d.]+\s*" * REPORT_COLUMNS.index(column)
    return number_after(text, rf"(?m)^\|\s*{row}\s*{before}\|\s*")


def report_metrics(text: Column, average: str = "weighted avg") -> dict[str, Column]:
    """Accuracy and averaged precision, recall and F1 by table position."""
    return {
        "accuracy": report_cell(text, "accuracy", "precision"),
        "precision": report_cell(text, average, "precision"),
        "recall": report_cell(text, average, "recall"),
        "f1_score": report_cell(text, average, "f1"),
    }


def quality_scores(text: Column) -> dict[str, Column]:
    """Overall and dimension scores of a quality report."""
    out = {"overall": number_after(text, r"(?m)^## Overall Score: ")}
    for name in ("Faithfulness", "Robustness", "Complexity"):
        out[name.lower()] = number_after(text, rf"(?m)^### {name}: ")
    return out


def json_field(text: Column, path: str, default: str) -> Column:
    return F.coalesce(F.get_json_object(text, path), F.lit(default))


def prediction_correct(text: Column) -> Column:
    """The flag of a case document; null when the text is no JSON object or lacks it."""
    schema = T.StructType([T.StructField("prediction_correct", T.BooleanType())])
    return F.from_json(text, schema)["prediction_correct"]
