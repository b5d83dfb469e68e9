"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of whole texts (lengths, shares of kinds of characters, repetition) are standardised with
figures of all rows. Cosines of random projections of them approximate a Gaussian kernel. Each
task sums its part of the normal equations over all labelled rows; these sums are added up in two steps, and the
ridge weights are solved from one small matrix. Scores are calibrated by isotonic regression on
the counts of labels in narrow bins of the ridge score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from plumbtrace.sources.scratch import materialise

FEATURES = 256
WIDTH = 4.0
RIDGE = 1.0
BINS = 400
GROUPS = 16

#: Kinds of bytes: upper, lower, digit, blank, other ASCII, beyond ASCII.
_KIND = np.array([
    3 if c in b" \t\n\r\x0b\x0c" else 0 if 65 <= c <= 90 else 1 if 97 <= c <= 122 else 2 if 48 <= c <= 57 else 5 if c > 127 else 4 for c in range(256)
], np.uint8)

STATISTICS = (
    "log_words", "mean_word", "sd_word", "upper", "digit", "blank", "symbol", "beyond_ascii", "distinct_words", "top_word",
    "repeated_pairs", "repeated_lines", "log_line", "closing_symbol", "inner_symbol", "lone_symbol", "capital_start", "comma_stop", "log_symbols", "longest_run",
)


def statistics(text: str | None) -> np.ndarray:
    """The figures of one text; of null or empty text they are all 0."""
    out = np.zeros(len(STATISTICS), np.float32)
    if not text:
        return out
    data = text.encode("utf-8", "replace")
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=6) / len(data)
    words = text.split()
    n = len(words)
    if not n:
        out[5] = 1
        return out
    size = np.fromiter(map(len, words), np.float32, n)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split("\n") if x.strip()]
    last = Counter(w[-1] for w in words)
    first = Counter(w[0] for w in words)
    closing = sum(c for k, c in last.items() if not k.isalnum() and k not in ".,;:)\"'")
    lone = sum(c for w, c in counts.items() if not any(map(str.isalnum, w)))
    run = best = 1
    for a, b in zip(words, words[1:]):
        run = run + 1 if a == b else 1
        best = max(best, run)
    out[:] = (
        np.log1p(n), size.mean(), size.std(), kinds[0], kinds[2], kinds[3], kinds[4], kinds[5], len(counts) / n, max(counts.values()) / n,
        1 - pairs / max(1, n - 1) if n > 1 else 0, 1 - len(set(lines)) / len(lines), np.log1p(len(data) / len(lines)), closing / n,
        sum(c for w, c in counts.items() if len(w) > 2 and not w[1:-1].isalnum()) / n, lone / n,
        sum(c for k, c in first.items() if k.isupper()) / n, (last["."] + last[","]) / n, np.log1p(kinds[4] * 100), best / n,
    )
    return out


class QualityModel:
    """Standardisation, random features, ridge weights and the calibration steps."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1.0)
        self.w = rng.normal(0, 1 / width, (len(mean), features))
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.weights, self.steps, self.values = np.zeros(features + 1), np.zeros(0), np.full(1, 0.5)

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.sd, -8, 8)
        phi = np.cos(z @ self.w + self.b) * np.sqrt(2 / self.w.shape[1])
        return np.concatenate([phi, np.ones((len(phi), 1))], 1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return self.values[np.searchsorted(self.steps, self.raw(stats), "right")]


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Least-squares non-decreasing fit by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for value, w in zip(y, weight):
        blocks.append([value, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, u, n = blocks.pop()
            p = blocks[-1]
            blocks[-1] = [(p[0] * p[1] + v * u) / (p[1] + u), p[1] + u, p[2] + n]
    return np.concatenate([np.full(n, v) for v, _, n in blocks]) if blocks else np.zeros(0)


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row of docs (doc_id, text), stored once."""

    @F.pandas_udf("array<float>")
    def compute(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return materialise(docs.select("doc_id", compute("text").alias("stats")), "quality_statistics")


def train_quality(labelled: DataFrame, stats: DataFrame) -> QualityModel:
    """Fit on all rows of `labelled` (stats, y). One class only, or no rows: the score is that class's share, or a half."""
    spark = stats.sparkSession
    k = len(STATISTICS)
    cells = [F.avg(F.col("stats")[i].cast("double")) for i in range(k)] + [F.stddev_pop(F.col("stats")[i].cast("double")) for i in range(k)]
    row = stats.agg(*cells).first()
    figures = np.array([x or 0.0 for x in row], float)
    model = QualityModel(figures[:k], figures[k:])
    d = len(model.weights)
    shared = spark.sparkContext.broadcast(model)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, key = np.zeros((d, d + 1)), 0
        for batch in batches:
            if len(batch):
                key = int(batch["task"].iloc[0])
                phi = shared.value.features(np.stack(batch["stats"].to_numpy()).astype(float))
                total[:, :d] += phi.T @ phi
                total[:, d] += phi.T @ batch["y"].to_numpy(float)
        yield pd.DataFrame({"task": [key % GROUPS], "sums": [total.tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            for sums in batch["sums"]:
                x = np.frombuffer(sums)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pd.DataFrame({"sums": [total.tobytes()]})

    tasks = labelled.select("stats", "y", F.spark_partition_id().alias("task"))
    partial = tasks.mapInPandas(part, "task int, sums binary").repartition(GROUPS, "task").mapInPandas(add, "sums binary")
    sums = [np.frombuffer(bytes(r.sums)).reshape(d, d + 1) for r in partial.collect()]  # GROUPS matrices at most
    total = np.sum(sums, axis=0) if sums else np.zeros((d, d + 1))
    model.weights = np.linalg.solve(total[:, :d] + RIDGE * np.eye(d), total[:, d])
    _calibrate(model, labelled)
    return model


def _calibrate(model: QualityModel, labelled: DataFrame) -> None:
    """Isotonic steps from counts of labels in BINS bins of the ridge score; at most BINS rows reach the driver."""
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("int")
    def bin_of(stats: pd.Series) -> pd.Series:
        raw = shared.value.raw(np.stack(stats.to_numpy()).astype(float)) if len(stats) else np.zeros(0)
        return pd.Series(np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int32))

    rows = sorted(labelled.groupBy(bin_of("stats").alias("bin")).agg(F.sum("y").alias("ones"), F.count("*").alias("n")).collect())
    if rows:
        bins, ones, n = np.array([tuple(r) for r in rows], float).T
        share = ones.sum() / n.sum()
        # two rows of the average label keep scores off 0 and 1
        fit = isotonic((ones + 2 * share * n / n.sum()) / (n + 2 * n / n.sum()), n)
        model.steps = bins[1:] / BINS * 2 - 0.5
        model.values = np.clip(fit, 0.0, 1.0)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) of every row of docs (doc_id, text), learned from all rows of labels (doc_id, y).

    score: chance of label 1. Null and empty texts have figures of 0 and a score like any other; repeated
    documents are scored (and learned from) as often as they come; labels without a document are unused.
    """
    stats = document_statistics(docs)
    model = train_quality(stats.join(labels, "doc_id"), stats)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.stack(values.to_numpy()).astype(float)) if len(values) else np.zeros(0))

    return stats.select("doc_id", score("stats").alias("score"))
