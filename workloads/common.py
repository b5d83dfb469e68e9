"""Tables that several queries share, written once per session and folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbtrace.sources import scratch

_stored: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Build a table on first use, write it to the shared folder, read it ever after."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _stored:
        path = scratch.fresh_path(spark, name)
        build().write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])
