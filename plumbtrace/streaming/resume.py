"""Incremental work lists: what is still to do after an interrupted run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def work_grid(queries: DataFrame, engines: list[str], engine: str = "engine") -> DataFrame:
    """Every query with every engine: the short engine list is exploded on each row."""
    return queries.withColumn(engine, F.explode(F.array(*[F.lit(e) for e in engines])))


def resume_work_list(queries: DataFrame, engines: list[str], done: DataFrame,
                     key: str = "query_id", error: str = "error") -> DataFrame:
    """(query, engine) pairs without a successful row; failed rows are tried again."""
    finished = done.filter(F.col(error).isNull()).select(key, "engine")
    return work_grid(queries, engines).join(finished, [key, "engine"], "left_anti")


def append_finished(done: DataFrame, path: str) -> None:
    """Append finished rows; safe to repeat because the work list anti-joins on the key."""
    done.write.mode("append").parquet(path)
