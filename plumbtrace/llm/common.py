"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers of any cluster, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="plumbtrace-llm-")) / "plumbtrace_llm.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(_PACKAGE.rglob("*.py")):
            z.write(path, path.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id falls in no fold (-1)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds, F.lit(-1).cast("long"))


def distinct_labels(labels: DataFrame, label: str) -> DataFrame:
    """One row per doc_id: (doc_id, y). Repeated ids take the larger label; null ids or labels are left out."""
    return (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
        .where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    )
