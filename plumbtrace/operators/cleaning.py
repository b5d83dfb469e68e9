"""Column selection, label derivation and value cleaning."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbtrace.functions.scalars import coerce_double, nan_to_null

# Cleaning presets of the flow table and of its benchmark variant.
RARE_VALUES = {
    "Proto": ["lldp", "llc", "arp", "ipv6-icmp"],
    "State": ["ECO", "ACC", "URP", "RSP", "TST", "NRS"],
}
WORKFLOW_PRESET = {"min_non_null": 1215000, "drop": ["Seq", "Offset", "Proto", "Cause", "State", "sDSb"]}
BENCHMARK_PRESET = {"fraction": 0.7, "floor": 1000, "drop": ["sDSb"]}
FLAG_CODES = {"0": 0, "A": 1, "PA": 2, "FPA": 3}
IDENTIFIERS = ["Label", "Attack Type", "Attack Tool"]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def nan_as_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Not-a-number counts as missing: null in the named (or all) floating-point columns."""
    wanted = set(df.columns if columns is None else columns)
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*[nan_to_null(quoted(c)).alias(c) if c in wanted & floats else quoted(c) for c in df.columns])


def drop_sparse_columns(df: DataFrame, min_non_null: int | None = None,
                        fraction: float = 0.7, floor: int = 1000) -> DataFrame:
    """Keep columns with enough values that are neither null nor NaN: one aggregate over the whole table."""
    counts = nan_as_null(df).agg(F.count("*").alias("_n"), *[F.count(quoted(c)).alias(c) for c in df.columns]).first()
    need = min_non_null if min_non_null is not None else max(floor, int(fraction * counts["_n"]))
    return df.select([quoted(c) for c in df.columns if counts[c] >= need])


def collapse_rare(df: DataFrame, column: str, values: Iterable[str], other: str = "other") -> DataFrame:
    c = quoted(column)
    return df.withColumn(column, F.when(c.isin(*values), other).otherwise(c))


MAX_CATEGORIES = 10_000


def category_values(df: DataFrame, column: str, limit: int = MAX_CATEGORIES) -> list:
    """Sorted distinct non-null values; a domain beyond the limit is an error, not a cut."""
    rows = df.select(quoted(column).alias("v")).filter("v IS NOT NULL").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} values; index it instead of one-hot encoding")
    return sorted(r["v"] for r in rows)


def one_hot(df: DataFrame, columns: list[str], values: dict[str, list] | None = None) -> DataFrame:
    """Boolean column per category value; a missing value is false everywhere."""
    values = values or {c: category_values(df, c) for c in columns}
    flags = [
        F.coalesce(quoted(c) == F.lit(v), F.lit(False)).alias(f"{c}_{v}")
        for c in columns for v in values[c]
    ]
    return df.select("*", *flags)


def drop_if_present(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*columns)


def drop_null_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def feature_names(df: DataFrame, exclude: Iterable[str] = IDENTIFIERS) -> list[str]:
    """Every column that is neither listed nor a row number."""
    skip = set(exclude)
    return [c for c in df.columns if c not in skip and not c.strip().startswith("Unnamed")]


def numeric_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def numeric_only(df: DataFrame) -> DataFrame:
    return df.select([quoted(c) for c in numeric_names(df)])


def align_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly the given columns in the given order; absent ones become zero."""
    have = set(df.columns)
    return df.select([quoted(c) if c in have else F.lit(0.0).alias(c) for c in columns])


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: coerce_double(quoted(c)) for c in columns})


def binary_label(label: Column, benign: str, benign_name: str = "Benign", other_name: str = "Malicious") -> Column:
    """Benign stays benign, everything else is malicious; a missing label stays missing."""
    return F.when(label == benign, benign_name).when(label.isNotNull(), other_name)


def attack_subset(df: DataFrame, label: str, malicious: str, attack: str, target: str = "target") -> DataFrame:
    """Only malicious rows, with the attack type as target."""
    return df.filter(quoted(label) == malicious).withColumn(target, quoted(attack))


def label_column(columns: Iterable[str], name: str = "label") -> str | None:
    """First column whose name equals `name` without regard to case or blanks."""
    for c in columns:
        if c.strip().lower() == name.lower():
            return c
    return None


def normalise_keys(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.lower(F.trim(quoted(c))) for c in columns})


def encode_labels(df: DataFrame, label: str, out: str = "label_index") -> DataFrame:
    """Sorted distinct labels become 0..k-1. The mapping has one row per label."""
    names = category_values(df, label)
    index = F.array_position(F.array(*[F.lit(n) for n in names]), quoted(label)) - 1
    return df.withColumn(out, index.cast("int"))


def term_filter(df: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """Rows whose text contains every term, whatever the case."""
    lowered = F.lower(quoted(text))
    keep = F.lit(True)
    for t in terms:
        keep = keep & lowered.contains(t.lower())
    return df.filter(keep)


def score_matrix(df: DataFrame, query: str, engine: str, metrics: list[str]) -> DataFrame:
    """Row label `query / engine` with the metric columns."""
    return df.select(F.concat_ws(" / ", quoted(query), quoted(engine)).alias("row"), *metrics)


def strip_reasoning(answer: Column, marker: str = "</think>") -> Column:
    """Text after the last closing mark; text without the mark is left as it is."""
    return F.when(answer.contains(marker), F.trim(F.substring_index(answer, marker, -1))).otherwise(answer)


def truncate(text: Column, limit: int, mark: str = "") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)
