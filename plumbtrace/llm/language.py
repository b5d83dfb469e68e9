"""Language identification by a byte convolutional network, trained with numpy.

One-hot bytes meet filters of several widths; each filter's largest response over a fixed-length
window is kept (max pooling), and a softmax layer turns these into language probabilities. The
network is trained with Adam on windows of labelled texts, a bounded sample with as many documents
of each language. Because inputs are one-hot, a trained filter is a table per byte place;
neighbouring places are folded into one table by byte pairs, so that applying a filter is a few lookups.

Every window of the whole text is scored, in batches; a document's answer is the mean of the
windows' log-probabilities, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbtrace.sources.scratch import materialise

UNDETERMINED = "und"
WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Distinct labelled texts of each language that the network is trained on at most.
DOCS_PER_LANGUAGE = 600
WINDOWS_PER_DOC = 3
BATCH_WINDOWS = 256


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)


def _windows(data: np.ndarray) -> np.ndarray:
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[:len(data)] = data
    return out.reshape(n, WINDOW)


class ByteNet:
    """The network. `tables[w][j]` (256 x filters) is what byte place j adds to the filters of width w."""

    def __init__(self, languages: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = list(languages)
        self.tables = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)
        self.pairs = None

    def fold(self) -> "ByteNet":
        """Sum the tables of neighbouring places, once training is over."""
        self.pairs = {
            w: [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS) if j + 1 < w else t[j] for j in range(0, w, 2)]
            for w, t in self.tables.items()
        }
        return self

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Windows (n x WINDOW bytes) -> n x languages."""
        pair = x[:, :-1].astype(np.uint16) << 8 | x[:, 1:]
        pooled = []
        for w in WIDTHS:
            n, total = WINDOW - w + 1, None
            for j, t in zip(range(0, w, 2), self.pairs[w]):
                part = t[pair[:, j:j + n] if j + 1 < w else x[:, j:j + n]]
                total = part if total is None else np.add(total, part, out=total)
            pooled.append(total.max(1))
        h = np.maximum(np.concatenate(pooled, 1) + self.bias, 0)
        return _log_softmax(h @ self.out + self.out_bias)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 5) -> "ByteNet":
        rng = np.random.default_rng(seed)
        params = [*self.tables.values(), self.bias, self.out, self.out_bias]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        step = 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                step += 1
                grads = self._gradients(x[at], y[at])
                for p, g, (m, v) in zip(params, grads, moments):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        return self.fold()

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        pooled, best = [], []
        for w in WIDTHS:
            n = WINDOW - w + 1
            total = sum(self.tables[w][j][x[:, j:j + n]] for j in range(w))
            best.append(total.argmax(1))
            pooled.append(np.take_along_axis(total, best[-1][:, None, :], 1)[:, 0])
        z = np.concatenate(pooled, 1) + self.bias
        h = np.maximum(z, 0)
        d = np.exp(_log_softmax(h @ self.out + self.out_bias))
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        dz = (d @ self.out.T) * (z > 0)
        grads = []
        for k, w in enumerate(WIDTHS):
            g, part = np.zeros_like(self.tables[w]), dz[:, k * FILTERS:(k + 1) * FILTERS]
            rows, filters = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
            for j in range(w):  # only the place with the largest response gets a gradient
                np.add.at(g[j], (x[rows, best[k] + j], filters), part)
            grads.append(g)
        return [*grads, dz.sum(0), h.T @ d, d.sum(0)]


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def train_language_model(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, seed: int = 3) -> ByteNet | None:
    """Fit on `labelled` (text, lang); null texts and languages teach nothing. No usable row: None.

    Of each language's distinct texts, those with the smallest hashes are taken, so the sample depends neither on the
    partitioning nor on how often a text comes; every language with a usable row has examples.
    """
    rows = labelled.select("text", "lang").where("lang is not null and text is not null and text rlike '\\\\p{L}'")
    rows = rows.withColumn("luck", F.xxhash64("text", F.lit(seed)))
    distinct = materialise(rows.select("lang", "luck").distinct(), "language_texts")
    counts = {r.lang: r.n for r in distinct.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts or docs_per_language < 1:
        return None
    # hashes under the bar are enough and few: by 8 standard deviations more than wanted, or all
    asked = docs_per_language + 8 * docs_per_language ** 0.5 + 64
    bars = {k: (1 << 63) - 1 if n <= asked else int(asked / n * (1 << 64)) - (1 << 63) for k, n in counts.items()}
    bar = F.create_map(*[F.lit(v) for pair in bars.items() for v in pair])
    first: dict[str, list[int]] = {}
    for r in distinct.where(F.col("luck") <= F.element_at(bar, F.col("lang"))).collect():
        first.setdefault(r.lang, []).append(r.luck)
    taken = [(lang, k) for lang, lucks in first.items() for k in sorted(lucks)[:docs_per_language]]
    taken = F.broadcast(labelled.sparkSession.createDataFrame(taken, "lang string, luck long"))

    @F.pandas_udf("array<binary>")
    def cut(texts: pd.Series, lucks: pd.Series) -> pd.Series:
        out = []
        for text, k in zip(texts, lucks):
            data, rng = _bytes(text), np.random.default_rng(k % (1 << 30))
            size = rng.integers(12, WINDOW, WINDOWS_PER_DOC, endpoint=True)
            starts = [int(rng.integers(0, max(1, len(data) - s + 1))) for s in size]
            out.append([data[a:a + s].tobytes() for a, s in zip(starts, size)])
        return pd.Series(out)

    sample = (
        rows.join(taken, ["lang", "luck"]).groupBy("lang", "luck").agg(F.first("text").alias("text"))
        .select("lang", F.explode(cut("text", "luck")).alias("data")).where("length(data) > 0").collect()
    )
    languages = sorted(counts)
    sample.sort(key=lambda r: (r.lang, bytes(r.data)))
    x = np.concatenate([_windows(np.frombuffer(bytes(r.data), np.uint8)) for r in sample])
    y = np.asarray([languages.index(r.lang) for r in sample])
    return ByteNet(languages).train(x, y)


def predict_language(text: Column, model: ByteNet | None, spark) -> Column:
    """Struct (lang_pred, score). `und` with score 0 for null texts, texts without a letter, or without a model."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = shared.value
        for texts in batches:
            names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            for start in range(0, len(texts), 128):
                # of a batch's texts, few at a time are Python's
                part = texts.slice(start, 128).to_pylist()
                known = [k for k, t in enumerate(part) if t and net is not None and any(map(str.isalpha, t))]
                if not known:
                    continue
                cut = [_bytes(part[k]) for k in known]
                for k, data, log_p in zip(known, cut, _mean_log_probabilities(net, cut)):
                    p = np.exp(log_p - log_p.max())
                    best = int(p.argmax())
                    names[start + k], scores[start + k] = net.languages[best], float(p[best] / p.sum())
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predict(text)


def _mean_log_probabilities(net: ByteNet, cut: list[np.ndarray]) -> np.ndarray:
    windows = [_windows(d) for d in cut]
    owner = np.repeat(np.arange(len(cut)), [len(w) for w in windows])
    weight = np.concatenate([np.minimum(WINDOW, len(d) - WINDOW * np.arange(len(w))) for d, w in zip(cut, windows)]).astype(float)
    x, sums = np.concatenate(windows), np.zeros((len(cut), len(net.languages)))
    for at in range(0, len(x), BATCH_WINDOWS):
        part = slice(at, at + BATCH_WINDOWS)
        np.add.at(sums, owner[part], net.log_probabilities(x[part]) * weight[part, None])
    return sums / np.bincount(owner, weight)[:, None]


def identify(docs: DataFrame, learn: Column) -> DataFrame:
    """`docs` with a struct column `language` (lang_pred, score), learned from its rows where `learn` holds.

    Repeated rows get equal answers, ties go to the language that sorts first, an empty
    table gives an empty result; a column of that name is replaced.
    """
    model = train_language_model(docs.where(learn))
    return docs.withColumn("language", predict_language(F.col("text"), model, docs.sparkSession))
