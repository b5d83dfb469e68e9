"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Channel: a writer may put look-alikes for letters (l33t), repeat letters, or set letters apart by
blanks or marks. Each suspicious stretch becomes a lattice of readings, and Viterbi decoding finds the
cheapest one under the channel's costs and a character trigram model counted over the
words of all documents. Plain words have one reading and pass as they are.

Score: words and word-internal 4-grams of the restored text that stand out in toxic documents
are the inputs of a logistic regression, fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from plumbtrace.sources.scratch import materialise

#: Labelled documents of each class that the classifier is fitted on at most, about.
DOCS_PER_CLASS = 20_000
SAMPLE_TASKS = 8
FEATURES = 3_000
LEAST_DOCS = 4
GRAM = 4
CACHE_WORDS = 300_000

#: Letters that a look-alike may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "€": "e", "(": "c", "§": "s", "¡": "i",
}
#: Marks that may stand between letters.
MARKS = set(".-_*~,'/\\:;·•^#=")
#: Costs (negative logarithms) of the channel.
COST_LOOKALIKE, COST_KEPT, COST_MARK, COST_GAP, COST_NO_GAP, COST_REPEAT = 3.0, 7.0, 2.0, 2.0, 0.5, 1.5

_SIZE = 28
_OTHER = 27
_CLASS = np.array([c - 96 if 97 <= c <= 122 else c - 64 if 65 <= c <= 90 else _OTHER if c >= 0xC0 else 255 if c >= 0x80 else 0 for c in range(256)], np.uint8)


def letter_class(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else _OTHER if c.isalpha() else 0


def trigram_counts(texts: Iterable[str]) -> np.ndarray:
    """Counts over (two before, one before, letter); 0 is a word's edge, 27 any letter beyond a-z."""
    total = np.zeros(_SIZE ** 3, np.int64)
    for text in texts:
        k = _CLASS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
        k = k[k != 255]
        k = np.concatenate([[0], k[(k > 0) | (np.concatenate([[1], k[:-1]]) > 0)], [0]]).astype(np.int64) if len(k) else np.zeros(1, np.int64)
        if len(k) > 1:
            before = np.concatenate([[0], k[:-2]])
            before[k[:-1] == 0] = 0  # nothing is remembered beyond an edge
            total += np.bincount((before * _SIZE + k[:-1]) * _SIZE + k[1:], minlength=_SIZE ** 3)
    return total


class CharacterModel:
    """Interpolated trigram, bigram and letter costs."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(_SIZE, _SIZE, _SIZE).astype(float)
        bi, one = tri.sum(0), tri.sum((0, 1))
        p1 = (one + 1) / (one.sum() + _SIZE)
        p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
        p3 = (tri + 5 * p2[None]) / (tri.sum(2, keepdims=True) + 5)
        self.cost = (-np.log(p3)).tolist()


def readings(stretch: str) -> list[list[tuple[str, float]]]:
    """The lattice: for each run of equal characters, what it may stand for (letters or nothing) and the cost."""
    nodes, k = [], 0
    while k < len(stretch):
        c, run = stretch[k], 1
        while k + run < len(stretch) and stretch[k + run] == c:
            run += 1
        k += run
        if c.isalpha():
            kept = [(c * min(run, 3), COST_REPEAT * (run > 2))]
            nodes.append(kept if run == 1 else [*kept, (c, COST_REPEAT), *([(c * 2, COST_REPEAT)] if run > 2 else [])])
        elif c == " ":
            nodes.append([(" ", COST_GAP), ("", COST_NO_GAP)])
        else:
            options = [(x * n, COST_LOOKALIKE) for x in LOOKALIKES.get(c, "") for n in ((1, 2) if run > 1 else (1,))]
            if c in MARKS or c in "!":
                options += [("", COST_MARK), (" ", COST_MARK + COST_GAP)]
            nodes.append([*options, (c, COST_KEPT)])
    return nodes


def decode(stretch: str, model: CharacterModel) -> str:
    """The cheapest reading of a lower-case stretch."""
    cost = model.cost
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for options in readings(stretch):
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (so_far, path) in states.items():
            for text, price in options:
                x, y, total = a, b, so_far + price
                for c in text:
                    z = letter_class(c)
                    if z or y:
                        total += cost[x][y][z]
                    x, y = (y if z else 0), z
                if (x, y) not in new or total < new[x, y][0]:
                    new[x, y] = total, (path, text) if text else path
        states = new
    _, path = min((total + (cost[a][b][0] if b else 0.0), path) for (a, b), (total, path) in states.items())
    out = []
    while path:
        path, text = path
        out.append(text)
    return "".join(reversed(out))


_PLAIN_EDGES = ".,;:!?\"'()[]{}<>&%*#$|…«»„“”-_~+=/\\"


def restore_token(token: str, model: CharacterModel) -> str:
    """A lower-case token without blanks, restored; marks at its edges are no letters unless they make a word."""
    core = token.strip(_PLAIN_EDGES)
    if not core:
        return ""
    if core.isalpha():
        if not any(a == b == c for a, b, c in zip(core, core[1:], core[2:])):
            return core if token[0] not in LOOKALIKES or token[0] in "!(+|" and len(token) - len(core) > 1 else _better(token, core, model)
        return decode(core, model)
    if not any(map(str.isalpha, core)):
        return core
    return decode(token.rstrip(_PLAIN_EDGES), model)


def _better(token: str, core: str, model: CharacterModel) -> str:
    return decode(token.rstrip(_PLAIN_EDGES), model) if len(token) - len(token.lstrip(_PLAIN_EDGES)) == 1 else core


class Restorer:
    """Words of the restored text, with what it has decoded kept for later texts."""

    def __init__(self, model: CharacterModel):
        self.model, self.known = model, {}

    def words(self, text: str) -> set[str]:
        tokens = text.lower().split()
        out, known = set(), self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for t in set(tokens):
            r = known.get(t)
            if r is None:
                r = known[t] = tuple(restore_token(t, self.model).split())
            out.update(r)
        out.update(self._spaced(tokens))
        return out

    def _spaced(self, tokens: list[str]) -> Iterator[str]:
        """Words read from three or more one-letter tokens in a row."""
        one = np.fromiter(map(len, tokens), np.int64, len(tokens)) == 1
        if one.sum() < 3:
            return
        edges = np.flatnonzero(np.diff(np.concatenate([[0], one.astype(np.int8), [0]])))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a > 2:
                yield from (w for w in decode(" ".join(tokens[a:b]), self.model).split() if len(w) > 2)

    def text(self, text: str) -> str:
        """The restored text (lower case, blanks squeezed)."""
        out, run = [], []
        for t in [*text.lower().split(), None]:
            if t is not None and len(t) == 1:
                run.append(t)
                continue
            out += decode(" ".join(run), self.model).split() if len(run) > 2 else run
            run = []
            if t is not None:
                out.append(restore_token(t, self.model))
        return " ".join(x for x in out if x)


def features_of(words: Iterable[str]) -> set[str]:
    """Words of three letters and more, and 4-grams inside words, whose start is marked."""
    out = set()
    for w in words:
        if len(w) > 2:
            out.add(w)
            edged = "^" + w
            out.update([edged[k:k + GRAM] for k in range(len(edged) - GRAM + 1)])
    return out


def character_model(docs: DataFrame, text: str = "text") -> CharacterModel:
    """Counted over all rows; each task hands on 28^3 sums, added up in two steps."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = sum((trigram_counts(t for t in b["text"] if t) for b in batches), np.zeros(_SIZE ** 3, np.int64))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at, "n": total[at]})

    rows = docs.select(F.col(text).alias("text")).mapInPandas(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(_SIZE ** 3, np.int64)
    for r in rows:
        counts[r.gram] = r.n
    return CharacterModel(counts)


class ToxicityModel:
    def __init__(self, characters: CharacterModel, index: dict[str, int], weights: np.ndarray, bias: float):
        self.characters, self.index, self.weights, self.bias = characters, index, weights, bias

    def scorer(self):
        restorer, cache, get, w = Restorer(self.characters), {}, self.index.get, self.weights

        def of_word(word: str) -> tuple[int, ...]:
            found = cache.get(word)
            if found is None:
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                found = cache[word] = tuple(k for f in features_of((word,)) if (k := get(f)) is not None)
            return found

        by_token: dict[str, tuple[int, ...]] = {}

        def score(text: str | None) -> float:
            hit: set[int] = set()
            tokens = text.lower().split() if text else []
            if len(by_token) > CACHE_WORDS:
                by_token.clear()
            for t in set(tokens):
                found = by_token.get(t)
                if found is None:
                    found = by_token[t] = tuple({k for word in restore_token(t, self.characters).split() for k in of_word(word)})
                if found:
                    hit.update(found)
            for word in restorer._spaced(tokens):
                hit.update(of_word(word))
            z = self.bias + sum(w[k] for k in sorted(hit))
            return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

        return score


def _sample_words(docs: DataFrame, labels: DataFrame, characters, docs_per_class: int, seed: int) -> tuple[DataFrame, dict[int, int]]:
    """(y, words) of the training sample, stored, and its rows of each label; words: the distinct restored ones.

    Ids are drawn from labels by their hash, about docs_per_class of each label, so the ids that meet the texts are few
    at any size and no text is shuffled. Where ids repeat in docs, rows are thinned again by the hash of their texts.
    """
    labels = labels.where("doc_id is not null and y is not null").select("doc_id", "y")

    def thinned(rows: DataFrame, luck: Column, sizes: dict[int, int]) -> DataFrame:
        bars = {y: int(min(1.0, docs_per_class / sizes[y]) * (1 << 30)) if sizes.get(y) else 0 for y in (0, 1)}
        return rows.where(F.pmod(luck, F.lit(1 << 30)) < F.when(F.col("y") == 1, bars[1]).otherwise(bars[0]))

    def counted(rows: DataFrame) -> dict[int, int]:
        return {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}

    drawn = thinned(labels, F.xxhash64("doc_id", F.lit(seed)), counted(labels))
    met = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    sizes = counted(met)
    if any(n > 2 * docs_per_class for n in sizes.values()):
        met = thinned(met, F.xxhash64("doc_id", "text", F.lit(seed)), sizes)

    @F.pandas_udf("array<string>")
    def words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restorer = Restorer(characters.value)
        for texts in batches:
            yield pd.Series([sorted(set(restorer.words(t or ""))) for t in texts], dtype=object)

    sample = materialise(met.select("y", words("text").alias("words")), "toxicity_sample")
    return sample, counted(sample)


def train_toxicity(docs: DataFrame, labels: DataFrame, docs_per_class: int = DOCS_PER_CLASS, seed: int = 23) -> ToxicityModel:
    """Characters from all of `docs` (doc_id, text); the classifier from those that `labels` (doc_id, y; one row an id) names.

    Without one of the labels every score is the share of label 1, or a half.
    """
    spark = docs.sparkSession
    characters = character_model(docs)
    shared = spark.sparkContext.broadcast(characters)
    sample, sizes = _sample_words(docs, labels, shared, docs_per_class, seed)
    if len(sizes) < 2:
        share = 0.5 if not sizes else 1 - 1e-6 if 1 in sizes else 1e-6
        return ToxicityModel(characters, {}, np.zeros(0), math.log(share / (1 - share)))
    # the sample is bounded, so are the tasks that each hand on counts of their own
    sample = sample.coalesce(SAMPLE_TASKS)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = (Counter(), Counter())
        for b in batches:
            for words, y in zip(b["words"], b["y"]):
                by[y].update(features_of(words))
        names = list(by[0].keys() | by[1].keys())
        yield pd.DataFrame({"feature": pd.Series(names, dtype=object), "n0": [by[0][x] for x in names], "n1": [by[1][x] for x in names]})

    n1, n0 = sizes[1], sizes[0]
    odds = F.log((F.col("n1") + 0.5) / n1) - F.log((F.col("n0") + 0.5) / n0)
    # a cautious figure: odds less one standard error
    cautious = odds - F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    chosen = (
        sample.mapInPandas(count, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .where(F.col("n1") >= LEAST_DOCS).withColumn("c", cautious).where("c > 0").withColumn("rank", F.col("c") * F.sqrt("n1"))
        .orderBy(F.col("rank").desc(), "feature").limit(FEATURES).select("feature").collect()
    )
    index = {r.feature: k for k, r in enumerate(chosen)}
    chosen_b = spark.sparkContext.broadcast(index)

    @F.pandas_udf("array<int>")
    def present(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        get = chosen_b.value.get
        for words in batches:
            yield pd.Series([sorted({k for f in features_of(w) if (k := get(f)) is not None}) for w in words])

    # equal inputs are one row with a count
    rows = sample.select("y", present("words").alias("f")).groupBy("y", "f").agg(F.count("*").alias("n")).collect()
    rows.sort(key=lambda r: (r.y, r.f))
    weights, bias = _logistic([list(r.f) for r in rows], np.array([r.y for r in rows], float), np.array([r.n for r in rows], float), len(index))
    return ToxicityModel(characters, index, weights, bias)


def _logistic(rows: list[list[int]], y: np.ndarray, n: np.ndarray, width: int, penalty: float = 0.3, steps: int = 400) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression on rows of ones, by Adam on the whole sample."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols = np.fromiter((c for r in rows for c in r), np.int64, len(owner))
    w, total = np.zeros(width + 1), n.sum()
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = w[-1] + np.bincount(owner, w[cols], minlength=len(rows))
        d = n * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / total
        g = np.append(np.bincount(cols, d[owner], minlength=width)[:width] + penalty * w[:-1] / total, d.sum())
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
    return w[:-1], float(w[-1])


def toxicity_score(text: Column, model: ToxicityModel, spark) -> Column:
    """Score 0 to 1 of whole texts; null and empty texts have the score of a text without any feature."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = shared.value.scorer()
        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype=float)

    return score(text)


def restored_text(text: Column, characters: CharacterModel, spark) -> Column:
    """Deobfuscated lower-case text; null stays null."""
    shared = spark.sparkContext.broadcast(characters)

    @F.pandas_udf("string")
    def restore(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restorer = Restorer(shared.value)
        for texts in batches:
            yield pd.Series([None if t is None else restorer.text(t) for t in texts], dtype=object)

    return restore(text)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) of every row of docs (doc_id, text), learned from labels (doc_id, y).

    Repeated rows are scored as often as they come and equal texts alike; labels without a document are unused;
    an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    model = train_toxicity(docs, labels)
    return docs.select("doc_id", toxicity_score(F.col("text"), model, docs.sparkSession).alias("score"))
