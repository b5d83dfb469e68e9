"""Gradient-boosted trees over shared histograms: one logistic tree a round for two classes, K soft-max trees for more.

Features become bins at quantiles of all training rows. Rows are packed into blocks of cells (`plans/cells.py`): rows
with equal bins, label and weight have equal margins, so they share gradients, each counted as often as its rows are drawn.
The first pass of a round moves the margins by the trees of the round before and keeps them, with gradients and curvatures,
in Spark's cache. A pass routes every cell through the trees of the running round and adds up, for all classes at
once, gradients and curvatures by (class, node, feature, bin); the tasks' arrays are added where there are few tasks by the
driver, otherwise per node by a shuffle. The driver sees the sums of one level only, picks the splits, and knows the values of
the children from the same sums, so that a round of depth D takes D passes. Keys are read every `STORE_EVERY` rounds only: the
draws of these rounds are then added up by cell, and the margins beside the keys catch up with the trees since.

Gradients are whole multiples of 2 ** -20, so sums don't depend on the order of rows or on partitions. Rows and
columns of a round are drawn by hashes of the row's key, the round and the class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from plumbtrace.plans.cells import bin_numbers, cell_blocks, cell_rows, of_cells

#: So many rounds, margins move in blocks without keys, which know the draws of these rounds; and cells of such a block.
STORE_EVERY, CELLS = 10, 65_536
UNIT = float(1 << 20)
QUANTILE_ACCURACY = 10_000


def _mixed(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return v ^ (v >> np.uint64(31))


def drawn(hashes: np.ndarray, number: int, share: float) -> np.ndarray:
    """Which of the hashed things take part in draw `number`."""
    with np.errstate(over="ignore"):
        v = _mixed(hashes.astype("uint64") + np.uint64(number + 1) * np.uint64(0x9E3779B97F4A7C15))
    return (v >> np.uint64(11)).astype("float64") / 9007199254740992.0 < share


@dataclass
class Trees:
    """The trees of one round, one per margin, as complete binary trees; a node without a feature (-1) is a leaf."""

    depth: int
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, margins: int, depth: int) -> Trees:
        shape = (margins, 2 ** (depth + 1) - 1)
        return cls(depth, np.full(shape, -1, "int32"), np.zeros(shape, "int32"), np.zeros(shape))

    def nodes(self, bins: np.ndarray, k: int, levels: int | None = None) -> np.ndarray:
        """The node of tree k that each row reaches."""
        flat, row = np.ascontiguousarray(bins).reshape(-1), np.arange(len(bins)) * bins.shape[1]
        inner = self.feature[k] >= 0
        feature = np.maximum(self.feature[k], 0).astype("int64")
        # no bin is above a leaf's, so rows stay there
        bound, to = np.where(inner, self.bin[k], 255).astype("uint8"), np.where(inner, 2 * np.arange(len(inner)) + 1, np.arange(len(inner)))
        at = np.zeros(len(bins), "int64")
        for _ in range(self.depth if levels is None else levels):
            at = to[at] + (flat[row + feature[at]] > bound[at])
        return at


@dataclass
class BoostedModel:
    """Rounds of trees over binned features; a scorer for the explainers."""

    edges: list[np.ndarray]
    classes: int
    rounds: list[Trees] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    @property
    def margins(self) -> int:
        return 1 if self.classes == 2 else self.classes

    def binned(self, x: np.ndarray) -> np.ndarray:
        return bin_numbers(self.edges, x)

    def batch(self, features: np.ndarray) -> np.ndarray:
        """Probabilities of a matrix, or of any stack of matrices."""
        flat = features.reshape(-1, features.shape[-1])
        out = np.zeros((len(flat), self.margins))
        bins = self.binned(flat)
        for trees in self.rounds:
            for k in range(self.margins):
                out[:, k] += trees.value[k, trees.nodes(bins, k)]
        return probabilities(out).reshape(*features.shape[:-1], self.classes)

    def expression(self, features: Column) -> None:
        return None

    def score(self, df: DataFrame, features: str, out: str) -> DataFrame:
        model = self

        @F.pandas_udf("array<double>")
        def call(x: pd.Series) -> pd.Series:
            return pd.Series(list(model.batch(np.stack(x.to_numpy()).astype("float64"))) if len(x) else [], dtype=object)

        return df.withColumn(out, call(F.col(features)))


def probabilities(margins: np.ndarray) -> np.ndarray:
    if margins.shape[1] == 1:
        p = 1.0 / (1.0 + np.exp(-margins[:, 0]))
        return np.stack([1.0 - p, p], axis=1)
    e = np.exp(margins - margins.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradients(margins: np.ndarray, label: np.ndarray, weight: np.ndarray, rows: np.ndarray | int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """First and second derivatives of the weighted log loss by margin, and the loss, each row counted `rows` times."""
    p = probabilities(margins)
    loss = float(-(weight * rows * np.log(np.maximum(p[np.arange(len(label)), label], 1e-15))).sum())
    if margins.shape[1] == 1:
        g, h = p[:, 1:] - (label == 1)[:, None], p[:, 1:] * p[:, :1]
    else:
        # twice p(1 - p): the trees of the classes move together
        g, h = p - (label[:, None] == np.arange(p.shape[1])[None]), 2 * p * (1 - p)
    return np.rint(g * weight[:, None] * UNIT), np.rint(np.maximum(h, 1e-16) * weight[:, None] * UNIT), loss


def best_split(g: np.ndarray, h: np.ndarray, columns: np.ndarray, penalty: float, least: float):
    """(gain, feature, bin, G left, H left) of a node from its features x bins sums; None: no split gains."""
    left_g, left_h = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1]
    all_g, all_h = g.sum(1)[:, None], h.sum(1)[:, None]
    part = lambda a, b: a * a / (b + penalty)
    gain = part(left_g, left_h) + part(all_g - left_g, all_h - left_h) - part(all_g, all_h)
    gain[(left_h < least) | (all_h - left_h < least) | ~columns[:, None]] = -np.inf
    at = int(gain.argmax()) if gain.size else 0  # ties go to the first feature, then the first bin
    if not gain.size or gain.flat[at] <= 1e-9:
        return None
    f, b = np.unravel_index(at, gain.shape)
    return float(gain[f, b]), int(f), int(b), float(left_g[f, b]), float(left_h[f, b])


#: Up to so many tasks, the driver adds the sums of a level itself.
TASKS_TO_DRIVER = 64


def _moved(b: dict, rounds: list[Trees]) -> np.ndarray:
    """Margins of a block after the trees of some rounds."""
    margin = b["margin"].copy()
    for trees in rounds:
        for k in range(margin.shape[1]):
            margin[:, k] += trees.value[k, trees.nodes(b["bins"], k)]
    return margin


def _taken(b: dict, number: int, row_share: float) -> np.ndarray:
    """How many rows of each cell take part in a round."""
    return of_cells(drawn(b["key"], number, row_share).astype("int64"), b["first"])


def _ahead(blocks: RDD, numbers: list[int], row_share: float) -> RDD:
    """Blocks without keys, with the rows that each of the next rounds draws from a cell; short blocks are joined."""
    def joined(held: list[dict]) -> dict:
        return {n: np.concatenate([b[n] for b in held], axis=-1 if n == "taken" else 0) for n in held[0]} | {"numbers": numbers}

    def ahead(frames: Iterator[dict]) -> Iterator[dict]:
        held, cells = [], 0
        for b in frames:
            taken, rows = np.stack([_taken(b, number, row_share) for number in numbers]), cell_rows(b)
            held.append({**{n: b[n] for n in ("bins", "label", "weight", "margin")}, "rows": rows, "taken": taken.astype(np.min_scalar_type(int(rows.max())))})
            cells += len(rows)
            if cells >= CELLS:
                yield joined(held)
                held, cells = [], 0
        if held:
            yield joined(held)

    return blocks.mapPartitions(ahead)


def _begun(blocks: RDD, last: Trees | None, d: int, margins: int, number: int, row_share: float) -> RDD:
    """Blocks with margins moved by the trees of the round before, and what the passes of round `number` share.

    Gradients of a cell come once for each of its drawn rows, the loss for all of them.
    """
    def begin(b: dict) -> dict:
        margin, rows = b["margin"] if last is None else _moved(b, [last]), cell_rows(b)
        g, h, loss = gradients(margin, b["label"], b["weight"], rows)
        taken = (b["taken"][b["numbers"].index(number)] if "taken" in b else _taken(b, number, row_share)).astype("float64")[:, None]
        return {**b, "margin": margin, "g": np.ascontiguousarray((g * taken).T), "h": np.ascontiguousarray((h * taken).T),
                "loss": loss, "total": float((b["weight"] * rows).sum())}

    return blocks.map(begin)


def _packed(df: DataFrame, features: str, label: str, weight: str | None, keys: list[str], model: BoostedModel) -> RDD:
    margins = model.margins
    blocks = cell_blocks(df, F.col(features), F.col(label), F.col(weight) if weight else F.lit(1.0), F.xxhash64(*keys), model.binned)
    return blocks.map(lambda b: {**b, "margin": np.zeros((len(b["label"]), margins))})


def _level_sums(begun: RDD, tasks: int, trees: Trees, level: int, d: int, bins_: int):
    """Sums over the level's nodes: {(class, node): (g, h)} of features x bins, the loss and the total weight."""
    margins, first, width = len(trees.feature), 2 ** level - 1, 2 ** level
    # nodes that may split: the root, and children of nodes that did
    live = np.array([[level == 0 or trees.feature[k, (n - 1) // 2] >= 0 for n in range(first, first + width)] for k in range(margins)])

    def add(blocks: Iterator[dict]) -> Iterator[tuple[int, np.ndarray]]:
        total = np.zeros((margins, width, d, 2 * bins_))
        extra = np.zeros(2)
        for b in blocks:
            bins = b["bins"]
            extra += b["loss"], b["total"]
            for k in range(margins):
                g, h = b["g"][k], b["h"][k]
                node = trees.nodes(bins, k, level) - first
                # cells without a drawn row add nothing; a sure and wrong margin has a gradient without curvature
                ok = np.flatnonzero(((g != 0) | (h != 0)) & (node >= 0))
                if level:
                    ok = ok[live[k, node[ok]]]
                if not len(ok):
                    continue
                base, gk, hk, used = node[ok] * bins_, g[ok], h[ok], bins[ok]
                for c in range(d):
                    at = base + used[:, c]
                    total[k, :, c, :bins_] += np.bincount(at, gk, width * bins_).reshape(width, bins_)
                    total[k, :, c, bins_:] += np.bincount(at, hk, width * bins_).reshape(width, bins_)
        yield -1, extra
        for k in range(margins):
            for n in np.flatnonzero(total[k].any((1, 2))).tolist():
                yield k * width + n, total[k, n]

    added = begun.mapPartitions(add)
    if tasks > TASKS_TO_DRIVER:
        added = added.reduceByKey(np.add, max(1, margins * width // 64))
    sums: dict[int, np.ndarray] = {}
    for slot, v in added.collect():
        sums[slot] = sums[slot] + v if slot in sums else v
    loss, total = sums.pop(-1, np.zeros(2))
    return {(s // width, first + s % width): (sums[s][:, :bins_] / UNIT, sums[s][:, bins_:] / UNIT) for s in sorted(sums)}, (loss, total)


def bin_edges(df: DataFrame, features: str, size: int, bins: int) -> list[np.ndarray]:
    """Distinct inner quantiles of each feature over all rows, at most bins - 1; off by at most `1 / QUANTILE_ACCURACY` of the rows."""
    flat = df.select(F.posexplode(features).alias("i", "v")).where(~F.isnan("v"))
    at = F.array(*[F.lit(j / bins) for j in range(1, bins)])
    rows = {r["i"]: r["q"] for r in flat.groupBy("i").agg(F.percentile_approx("v", at, F.lit(QUANTILE_ACCURACY)).alias("q")).collect()}
    return [np.unique(np.array(rows.get(f) or [], "float64")) for f in range(size)]


def fit_boosted(df: DataFrame, features: str, size: int, label: str, classes: int, keys: list[str], weight: str | None = None, rounds: int = 200,
                depth: int = 6, step: float = 0.1, row_share: float = 0.8, column_share: float = 0.8, bins: int = 64, penalty: float = 1.0,
                least: float = 1.0, seed: int = 42) -> BoostedModel:
    """Boost `rounds` rounds of trees on the rows of `df`.

    `features` is an array of `size` numbers (NaN goes right), `label` a class number, `weight` an optional row weight.
    `row_share` and `column_share` are the shares of rows a round and of columns a tree; `penalty` is added to every
    curvature sum, and children need a curvature of `least`. `losses` holds the mean weighted log loss before each round.
    """
    model = BoostedModel(bin_edges(df, features, size, bins), classes)
    # what an executor loses is made again from the rows and the trees
    blocks, kept = _packed(df, features, label, weight, keys, model).persist(StorageLevel.MEMORY_AND_DISK), []
    tasks = blocks.getNumPartitions()
    columns_of = np.arange(size, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15)
    for r in range(rounds):
        trees = Trees.empty(model.margins, depth)
        number = seed * 1_000_003 + r
        columns = [drawn(columns_of + np.uint64(k + 1), number, column_share) for k in range(model.margins)]
        columns = [c if c.any() else np.ones(size, bool) for c in columns]
        # tables that are read for the last time while the first sums of this round are made
        old = kept
        if r % STORE_EVERY == 0:
            if r:
                since, old = model.rounds[-STORE_EVERY:], [*kept, blocks]
                blocks = blocks.map(lambda b, since=since: {**b, "margin": _moved(b, since)}).persist(StorageLevel.MEMORY_AND_DISK)
            given, last = _ahead(blocks, [seed * 1_000_003 + i for i in range(r, min(r + STORE_EVERY, rounds))], row_share), None
        else:
            given, last = kept[0], model.rounds[-1]
        begun = _begun(given, last, size, model.margins, number, row_share).persist(StorageLevel.MEMORY_AND_DISK)
        kept = [begun]
        for level in range(depth):
            sums, (loss, total) = _level_sums(begun, tasks, trees, level, size, bins)
            if level == 0:
                for table in old:
                    table.unpersist()
                model.losses.append(loss / max(total, 1e-300))
            split = False
            for (k, node), (g, h) in sums.items():
                all_g, all_h = g[0].sum(), h[0].sum()
                if level == 0:
                    trees.value[k, node] = -step * all_g / (all_h + penalty)
                found = best_split(g, h, columns[k], penalty, least)
                if found:
                    _, f, b, left_g, left_h = found
                    split = True
                    trees.feature[k, node], trees.bin[k, node] = f, b
                    trees.value[k, 2 * node + 1] = -step * left_g / (left_h + penalty)
                    trees.value[k, 2 * node + 2] = -step * (all_g - left_g) / (all_h - left_h + penalty)
            if not split:
                break
        model.rounds.append(trees)
    for table in [*kept, blocks]:
        table.unpersist()
    return model
