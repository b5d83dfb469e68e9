"""Per-row feature attributions: closed form, permutation sampling, local surrogates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbtrace.functions.binding import bind, let
from plumbtrace.functions.counters import counter_u32, row_word
from plumbtrace.functions.scalars import argmax, array_mean
from . import kernels
from .scoring import LinearScorer, Scorer, by_matrix, score_variants


def literal_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def baseline_means(df: DataFrame, features: str, size: int) -> list[float]:
    """Column means of the evaluated rows; zeros when there are none. One row, `size` numbers."""
    row = df.agg(*[F.avg(F.col(features)[i]).alias(f"m{i}") for i in range(size)]).first()
    return [float(v) if v is not None else 0.0 for v in row]


def select_class(probability: Column, rule: str | int = "predicted") -> Column:
    """Probability of a fixed class, of the predicted class, or the mean over classes."""
    if rule == "predicted":
        return let(probability, lambda p: F.element_at(p, argmax(p) + 1))
    if rule == "mean":
        return array_mean(probability)
    return probability[int(rule)]


class LinearExplainer:
    """Exact attributions of an identity-link linear score: w * (x - baseline)."""

    def __init__(self, scorer: LinearScorer, baseline: list[float]):
        if scorer.link != "identity":
            raise ValueError("the closed form needs an identity link")
        self.scorer, self.baseline = scorer, baseline
        self.batched = True

    def batch(self, x: np.ndarray, words: np.ndarray) -> np.ndarray:
        return np.asarray(self.scorer.weights) * (x - np.asarray(self.baseline))

    def expression(self, x: Column) -> Column:
        pairs = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(float(b)).alias("b")) for w, b in zip(self.scorer.weights, self.baseline)])
        return F.zip_with(x, pairs, lambda v, p: p["w"] * (v - p["b"]))

    def explain(self, df: DataFrame, keys: list[str], x: str, out: str) -> DataFrame:
        return bind(df, **{out: self.expression(F.col(x))})


class ShapleyExplainer:
    """Permutation-sampled Shapley values against a baseline row, in probability space.

    Permutation m walks the features in hash order; odd ones walk the order of their
    predecessor backwards. The attribution of a feature is the mean change of the
    class probability at its step, so each walk sums to f(x) - f(baseline).
    """

    def __init__(self, scorer: Scorer, baseline: list[float], seed=42, permutations: int = 8, target: int = 1):
        self.scorer, self.baseline, self.seed = scorer, baseline, seed
        self.permutations, self.target = permutations, target
        self.batched = scorer.batch(np.zeros((1, len(baseline)))) is not None

    @property
    def matrix(self):
        """The model as a function of matrices, for a fitted model that can be one."""
        return getattr(self.scorer, "matrix", None)

    def batch(self, x: np.ndarray, words: np.ndarray) -> np.ndarray:
        return kernels.shapley(self.scorer.batch, x, np.asarray(self.baseline), words, self.permutations, self.target)

    def _ranks(self) -> Column:
        """Per permutation, the one-based step of each feature; `_w` is the row's random word."""
        d = len(self.baseline)

        def walk(m: Column) -> Column:
            marks = F.array_sort(F.transform(
                F.sequence(F.lit(0), F.lit(d - 1)),
                lambda i: F.struct(counter_u32(F.col("_w"), F.floor(m / 2) * d + i).alias("h"), i.alias("i"))))
            order = F.transform(marks, lambda s: s["i"])
            step = let(order, lambda o: F.transform(
                F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.array_position(o, i).cast("int")))
            return F.transform(step, lambda r: F.when(m % 2 == 1, F.lit(d + 1) - r).otherwise(r))

        return F.transform(F.sequence(F.lit(0), F.lit(self.permutations - 1)), walk)

    def explain(self, df: DataFrame, keys: list[str], x: str, out: str) -> DataFrame:
        word = row_word(self.seed, *keys)
        if self.batched:
            return self._in_tasks(df, x, word, out, self.scorer.batch)
        if self.matrix is not None:
            return by_matrix(df, keys, x, len(self.baseline), lambda rows: self._in_tasks(rows, x, word, out, self.matrix),
                             lambda rows: self._by_copies(rows, keys, x, out, word))
        return self._by_copies(df, keys, x, out, word)

    def _in_tasks(self, df: DataFrame, x: str, word: Column, out: str, model) -> DataFrame:
        # what the tasks need, without the explainer itself: a fitted model stays here
        base, permutations, target = np.asarray(self.baseline), self.permutations, self.target

        def solve(values: pd.Series, words: pd.Series) -> pd.Series:
            features, w = np.stack(values.to_numpy()).astype("float64"), words.to_numpy()
            parts = [kernels.shapley(model, features[i:i + 2000], base, w[i:i + 2000], permutations, target) for i in range(0, len(w), 2000)]
            return pd.Series(list(np.concatenate(parts)))

        call = F.pandas_udf(solve, T.ArrayType(T.DoubleType())).asNondeterministic()
        return df.withColumn(out, call(F.col(x), word))

    def _by_copies(self, df: DataFrame, keys: list[str], x: str, out: str, word: Column) -> DataFrame:
        d, base = len(self.baseline), literal_array(self.baseline)
        ranked = bind(bind(df, _w=word), _ranks=self._ranks())

        def variant(v: Column) -> Column:
            walk = F.element_at("_ranks", (F.floor(v / (d + 1)) + 1).cast("int"))
            step = v % (d + 1)
            return F.transform(F.arrays_zip(F.col(x).alias("x"), base.alias("b"), walk.alias("r")),
                               lambda z: F.when(z["r"] <= step, z["x"]).otherwise(z["b"]))

        scored = score_variants(ranked, keys, self.scorer, self.permutations * (d + 1), variant, "_scores")
        flat = F.transform("_scores", lambda p: p[self.target])
        at = lambda m, j: F.element_at("_flat", (m * (d + 1) + j + 1).cast("int"))
        phi = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.aggregate(
            F.transform("_ranks", lambda r, m: at(m, r[i]) - at(m, r[i] - 1)),
            F.lit(0.0), lambda s, v: s + v, lambda s: s / float(self.permutations)))
        return bind(bind(scored, _flat=flat), **{out: phi}).drop("_w", "_ranks", "_scores", "_flat")


# Defaults of the tabular surrogate.
KERNEL_FACTOR, RIDGE = 0.75, 1.0


def sample_weights(z: np.ndarray) -> np.ndarray:
    """Kernel weight of each sample by the number of features outside the row's bins."""
    d = z.shape[-1]
    return np.sqrt(np.exp(-(d - z.sum(-1)) / (KERNEL_FACTOR ** 2 * d)))


def solve_ridge(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weighted ridge with an unpenalised intercept, one small system per row.

    z is rows x samples x features, y rows x samples; samples far from the row (many
    features in another bin) weigh little.
    """
    d = z.shape[2]
    w = sample_weights(z)
    total = w.sum(1)
    zc = z - (np.einsum("ns,nsd->nd", w, z) / total[:, None])[:, None, :]
    yc = y - ((w * y).sum(1) / total)[:, None]
    zw = zc * w[:, :, None]
    a = np.einsum("nsd,nse->nde", zw, zc) + RIDGE * np.eye(d)
    return np.linalg.solve(a, np.einsum("nsd,ns->nd", zw, yc)[:, :, None])[:, :, 0]


def uniform_grid(row_hash: np.ndarray, first: int, shape: tuple[int, int]) -> np.ndarray:
    """Uniform numbers per (row, sample, feature) from a 64-bit row hash."""
    return uniform_at(row_hash[:, None, None], np.arange(first, first + shape[0] * shape[1], dtype="uint64").reshape(shape)[None])


def uniform_at(row_hash: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Uniform number `counter` of a 64-bit row hash (splitmix64)."""
    with np.errstate(over="ignore"):
        v = row_hash.astype("uint64") + (counter + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        v = v ^ (v >> np.uint64(31))
    return (v >> np.uint64(11)).astype("float64") / 9007199254740992.0


def draw_altered(x: np.ndarray, row_hash: np.ndarray, edges: list[list[float]], samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Altered rows and their same-bin indicators; sample 0 is the row itself."""
    e, d = np.asarray(edges, dtype="float64"), x.shape[1]
    own = (x[:, :, None] > e[None, :, 1:4]).sum(2)
    bins = np.floor(uniform_grid(row_hash, 0, (samples, d)) * 4).astype("int64")
    u = uniform_grid(row_hash, samples * d, (samples, d))
    feature = np.arange(d)[None, None, :]
    low, high = e[feature, bins], e[feature, bins + 1]
    values, z = low + u * (high - low), (bins == own[:, None, :]).astype("float64")
    values[:, 0, :], z[:, 0, :] = x, 1.0
    return values, z


def draw_samples(x: np.ndarray, row_hash: np.ndarray, edges: list[list[float]], samples: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As `draw_altered`, for one sample number per row: altered rows and their same-bin indicators."""
    e, d = np.asarray(edges, dtype="float64"), x.shape[1]
    feature = np.arange(d)
    place = number.astype("uint64")[:, None] * np.uint64(d) + feature.astype("uint64")[None]
    own = (x[:, :, None] > e[None, :, 1:4]).sum(2)
    bins = np.floor(uniform_at(row_hash[:, None], place) * 4).astype("int64")
    u = uniform_at(row_hash[:, None], place + np.uint64(samples * d))
    low, high = e[feature[None], bins], e[feature[None], bins + 1]
    values, z = low + u * (high - low), (bins == own).astype("float64")
    first = number == 0
    values[first], z[first] = x[first], 1.0
    return values, z


def sums_length(d: int) -> int:
    return 2 + 2 * d + d * (d + 1) // 2


def surrogate_sums(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Per sample, what the normal equations add up: weight, weighted score, z, score times z, and the packed outer product of z."""
    d = z.shape[1]
    w = sample_weights(z)
    i, j = np.triu_indices(d)
    return np.concatenate([w[:, None], (w * y)[:, None], w[:, None] * z, (w * y)[:, None] * z, w[:, None] * z[:, i] * z[:, j]], axis=1)


def unpacked_sums(sums: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Matrix and right side of the centred ridge system."""
    total, score, z, zy = sums[0], sums[1], sums[2:2 + d], sums[2 + d:2 + 2 * d]
    outer = np.zeros((d, d))
    i, j = np.triu_indices(d)
    outer[i, j] = outer[j, i] = sums[2 + 2 * d:]
    return outer - np.outer(z, z) / total + RIDGE * np.eye(d), zy - z * score / total


#: With as many features, samples are added up by which features are in the row's bins: 2 ** d patterns at most.
PATTERN_FEATURES = 8


class PatternSurrogate:
    """`solve_ridge` of `draw_altered` rows, row by row.

    Samples that lie in the row's bins with the same features share weight and indicators, so the system needs their number and
    the sum of their scores only. Draws are those of `draw_altered`, made in buffers of samples x features that are used again.
    """

    def __init__(self, edges: list[list[float]], samples: int):
        e = np.asarray(edges, "float64")
        self.edges, self.samples, self.d = e, samples, len(e)
        self.low, self.width = e[:, :4], e[:, 1:] - e[:, :4]
        place = np.arange(samples, dtype="uint64")[None] * np.uint64(self.d) + np.arange(self.d, dtype="uint64")[:, None]
        with np.errstate(over="ignore"):
            self.steps = [(place + np.uint64(first + 1)) * np.uint64(0x9E3779B97F4A7C15) for first in (0, samples * self.d)]
        self.z = (np.arange(2 ** self.d)[:, None] >> np.arange(self.d) & 1).astype("float64")
        self.weight = sample_weights(self.z)
        self.words, self.other, self.bins = (np.empty((self.d, samples), "uint64") for _ in range(3))
        self.values, self.part = np.empty((self.d, samples)), np.empty((self.d, samples))

    def _mixed(self, row_hash: np.uint64, steps: np.ndarray) -> np.ndarray:
        """splitmix64 of the row's hash at all places, as in `uniform_at`."""
        v, t = self.words, self.other
        np.add(steps, row_hash, out=v)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            np.right_shift(v, np.uint64(shift), out=t)
            np.bitwise_xor(v, t, out=v)
            np.multiply(v, np.uint64(factor), out=v)
        np.right_shift(v, np.uint64(31), out=t)
        return np.bitwise_xor(v, t, out=v)

    def altered(self, x: np.ndarray, row_hash: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Altered rows of one row (samples x features, overwritten by the next call), and each one's pattern."""
        # the two highest bits: floor(4 u)
        np.right_shift(self._mixed(row_hash, self.steps[0]), np.uint64(62), out=self.bins)
        bins, own = self.bins.view("int64"), (x[:, None] > self.edges[:, 1:4]).sum(1)
        u = self._mixed(row_hash, self.steps[1])
        np.right_shift(u, np.uint64(11), out=u)
        np.copyto(self.values, u.view("int64"))
        np.multiply(self.values, 1.0 / 9007199254740992.0, out=self.values)
        pattern = np.zeros(self.samples, "int64")
        for f in range(self.d):
            self.values[f] *= np.take(self.width[f], bins[f], out=self.part[f], mode="clip")
            self.values[f] += np.take(self.low[f], bins[f], out=self.part[f], mode="clip")
            pattern += (bins[f] == own[f]).astype("int64") << f
        self.values[:, 0], pattern[0] = x, 2 ** self.d - 1
        return self.values.T, pattern

    def __call__(self, x: np.ndarray, row_hash: np.ndarray, batch, target: int | str) -> np.ndarray:
        n, size = len(x), 2 ** self.d
        count, score = np.empty((n, size)), np.empty((n, size))
        hashes = row_hash.astype("uint64")
        for r in range(n):
            values, pattern = self.altered(x[r], hashes[r])
            y = pick_class(batch(values[None]), target)[0]
            count[r], score[r] = np.bincount(pattern, minlength=size), np.bincount(pattern, y, size)
        w = count * self.weight
        total = w.sum(1)
        zc = self.z[None] - ((w @ self.z) / total[:, None])[:, None, :]
        yc = self.weight * score - w * ((self.weight * score).sum(1) / total)[:, None]
        a = np.einsum("npd,npe->nde", zc * w[:, :, None], zc) + RIDGE * np.eye(self.d)
        return np.linalg.solve(a, np.einsum("npd,np->nd", zc, yc)[:, :, None])[:, :, 0]


def pick_class(p: np.ndarray, target: int | str) -> np.ndarray:
    """rows x samples x classes -> rows x samples of the explained class."""
    if target != "predicted":
        return p[:, :, int(target)]
    chosen = p[:, 0, :].argmax(1)
    return np.take_along_axis(p, chosen[:, None, None], axis=2)[:, :, 0]


class SurrogateExplainer:
    """Local linear surrogate over quartile bins.

    Altered rows draw a bin per feature and a value inside it; z says whether the bin
    is the row's own. A weighted ridge of the class probability on z gives the
    weights. Sample 0 is the row itself. Bin edges come from the training rows.
    """

    def __init__(self, scorer: Scorer, edges: list[list[float]], names: list[str], seed=42, samples: int = 5000,
                 target: int | str = 1, residual: str | None = None):
        """`edges` holds five numbers per feature: minimum, quartiles, maximum. `residual` names a column for the
        relative residual of the normal equations, where copies are rows."""
        self.residual = residual
        self.scorer, self.edges, self.names = scorer, edges, names
        self.seed, self.samples, self.target = seed, samples, target
        self.batched = False

    def _table(self) -> Column:
        return F.array(*[literal_array(e) for e in self.edges])

    def explain(self, df: DataFrame, keys: list[str], x: str, out: str) -> DataFrame:
        """Draw, score and solve in Arrow batches; a model that has to score as a
        distributed transform sees the altered rows exploded instead."""
        hashed = df.withColumn("_h", F.xxhash64(F.lit(str(self.seed)), *keys))
        rows_at_once = max(1, 400_000 // (self.samples * len(self.names)))
        # what the tasks need, without the explainer itself: a fitted model stays here
        edges, samples, target, batch = self.edges, self.samples, self.target, self.scorer.batch
        if batch(np.zeros((1, len(self.names)))) is not None:
            patterns = len(self.names) <= PATTERN_FEATURES

            def solve(values: pd.Series, hashes: pd.Series) -> pd.Series:
                parts, matrix, h = [], np.stack(values.to_numpy()).astype("float64"), hashes.to_numpy()
                if patterns:
                    solver = PatternSurrogate(edges, samples)
                    return pd.Series(list(np.concatenate([solver(matrix[i:i + 500], h[i:i + 500], batch, target) for i in range(0, len(h), 500)])))
                for i in range(0, len(h), rows_at_once):
                    altered, z = draw_altered(matrix[i:i + rows_at_once], h[i:i + rows_at_once], edges, samples)
                    parts.append(solve_ridge(z, pick_class(batch(altered), target)))
                return pd.Series(list(np.concatenate(parts)))

            call = F.pandas_udf(solve, T.ArrayType(T.DoubleType())).asNondeterministic()
            return hashed.withColumn(out, call(F.col(x), F.col("_h"))).drop("_h")

        return self._explain_by_rows(hashed, keys, x, out).drop("_h")

    def _explain_by_rows(self, hashed: DataFrame, keys: list[str], x: str, out: str) -> DataFrame:
        """Altered copies as rows, for a model that scores as a distributed transform.

        A copy is drawn from the row's hash and the number of the sample. Scored copies meet the weights of the
        surrogate in sums of packed outer products (`surrogate_sums`), a few short arrays per row and task, so that
        no row ever holds samples x features. Rows are placed by key first, so the sums stay where they are.
        """
        edges, samples, target, d = self.edges, self.samples, self.target, len(self.names)

        def draw_copies(values: pd.Series, hashes: pd.Series, numbers: pd.Series) -> pd.DataFrame:
            altered, z = draw_samples(np.stack(values.to_numpy()).astype("float64"), hashes.to_numpy(), edges, samples, numbers.to_numpy())
            return pd.DataFrame({"x": list(altered), "z": [r.tobytes() for r in np.packbits(z.astype(bool), axis=1)]})

        def add_up(batches):
            for batch in batches:
                if not len(batch):
                    continue
                z = np.unpackbits(np.frombuffer(b"".join(batch["_z"]), np.uint8).reshape(len(batch), -1), axis=1, count=d).astype("float64")
                p = np.stack(batch["_p"].to_numpy())
                y = p[np.arange(len(p)), batch["_class"].to_numpy()]
                group = batch.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
                sums = np.zeros((group.max() + 1, sums_length(d)))
                np.add.at(sums, group, surrogate_sums(z, y))
                head = batch[keys].iloc[np.unique(group, return_index=True)[1]].reset_index(drop=True)
                yield head.assign(_sums=list(sums))

        def solve(parts: pd.Series) -> pd.DataFrame:
            systems = [unpacked_sums(np.sum(np.stack(p), axis=0), d) for p in parts]
            phi = [np.linalg.solve(a, b) for a, b in systems]
            off = [float(np.abs(a @ x - b).max() / max(np.abs(b).max(), 1e-12)) for (a, b), x in zip(systems, phi)]
            return pd.DataFrame({"phi": phi, "off": off})

        draw = F.pandas_udf(draw_copies, "x array<double>, z binary").asNondeterministic()
        placed = hashed.repartition(*keys)
        if target == "predicted":
            placed = self.scorer.score(placed, x, "_own").withColumn("_class", argmax(F.col("_own"))).drop("_own")
        else:
            placed = placed.withColumn("_class", F.lit(int(target)))
        copies = placed.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("_c", draw(F.col(x), F.col("_h"), F.col("_i")))
        copies = copies.select(*keys, "_class", F.col("_c.x").alias("_x"), F.col("_c.z").alias("_z"))
        scored = self.scorer.score(copies, "_x", "_p").select(*keys, "_class", "_z", "_p")
        schema = T.StructType([*[hashed.schema[k] for k in keys], T.StructField("_sums", T.ArrayType(T.DoubleType()))])
        sums = scored.mapInPandas(add_up, schema).groupBy(*keys).agg(F.collect_list("_sums").alias("_sums"))
        solved = sums.select(*keys, F.pandas_udf(solve, "phi array<double>, off double")("_sums").alias("_s"))
        solved = solved.select(*keys, F.col("_s.phi").alias(out), *([F.col("_s.off").alias(self.residual)] if self.residual else []))
        return placed.drop("_class").join(solved, keys)

    def rules(self, x: Column) -> Column:
        """Text of each feature's bin: `a <= q1`, `q1 < a <= q2`, `a > q3`."""
        parts = F.arrays_zip(x.alias("x"), self._table().alias("e"), F.array(*[F.lit(n) for n in self.names]).alias("n"))
        t = lambda v: F.format_string("%.2f", v)
        return F.transform(parts, lambda p: F.when(p["x"] <= p["e"][1], F.concat(p["n"], F.lit(" <= "), t(p["e"][1])))
                           .when(p["x"] <= p["e"][2], F.concat(t(p["e"][1]), F.lit(" < "), p["n"], F.lit(" <= "), t(p["e"][2])))
                           .when(p["x"] <= p["e"][3], F.concat(t(p["e"][2]), F.lit(" < "), p["n"], F.lit(" <= "), t(p["e"][3])))
                           .otherwise(F.concat(p["n"], F.lit(" > "), t(p["e"][3]))))


def top_features(phi: Column, k: int) -> Column:
    """Indexes of the k largest absolute values; ties keep the feature order."""
    marks = F.array_sort(F.transform(phi, lambda v, i: F.struct((-F.abs(v)).alias("k"), i.alias("i"))))
    return F.slice(F.transform(marks, lambda s: s["i"]), 1, k)


def rank_array(phi: Column) -> Column:
    """One-based rank of every feature by absolute value."""
    return let(top_features(phi, 2 ** 20), lambda o: F.transform(
        F.sequence(F.lit(0), F.size(o) - 1), lambda i: F.array_position(o, i).cast("int")))


def long_attributions(df: DataFrame, keys: list[str], phi: str, names: list[str]) -> DataFrame:
    """One row per (row, feature)."""
    labels = F.array(*[F.lit(n) for n in names])
    return df.select(*keys, F.posexplode(F.arrays_zip(labels.alias("feature"), F.col(phi).alias("attribution"))).alias("feature_idx", "_z")).select(
        *keys, "feature_idx", "_z.feature", "_z.attribution")


def explanation_table(sparse: DataFrame, keys: list[str], feature_idx: str, attribution: str, size: int) -> DataFrame:
    """Every feature of every explained row, absent ones zero: the rows are not crossed
    with anything, each carries its own map and unfolds it."""
    given = bind(sparse.groupBy(*keys).agg(F.collect_list(F.struct(feature_idx, attribution)).alias("_e")), _m=F.map_from_entries("_e"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    return bind(given, _dense=dense).select(*keys, F.posexplode("_dense").alias(feature_idx, attribution))


def export_top(df: DataFrame, keys: list[str], x: str, phi: str, names: list[str], k: int = 10) -> DataFrame:
    """The k strongest features of each row with value and attribution, strongest first."""
    labels = F.array(*[F.lit(n) for n in names])
    picked = F.transform(top_features(F.col(phi), k), lambda i: F.struct(
        F.element_at(labels, i + 1).alias("feature"), F.element_at(F.col(phi), i + 1).alias("attribution"),
        F.element_at(F.col(x), i + 1).alias("feature_value")))
    return df.select(*keys, picked.alias("top"))
