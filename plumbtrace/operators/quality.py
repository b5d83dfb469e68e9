"""Faithfulness, robustness and complexity of attributions, for every row.

Inputs are arrays per row: features `x` and attributions `phi`. With an expression
scorer and explainer all of this is a projection; nothing is shuffled until the
scores are averaged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbtrace.functions.binding import bind, let
from plumbtrace.functions.counters import counter_normal, counter_u32, np_counter_u32, row_word
from plumbtrace.functions.hashing import hash_u32, hash_uniform
from plumbtrace.functions.scalars import (
    argmax, array_mean, array_pearson, array_std_pop, array_variance_pop, jaccard, logistic, normalised_area,
)
from .bounded import attach_one
from . import kernels
from .attribution import literal_array, rank_array, top_features
from .scoring import Scorer, by_matrix, score_variants

# Weights inside the dimensions, curve steps, perturbations, cuts.
FAITHFULNESS = {"deletion": 0.4, "insertion": 0.4, "ablation": 0.2}
ROBUSTNESS = {"jaccard": 0.6, "variance": 0.4}
COMPLEXITY = {"sparsity": 0.6, "effective": 0.4}
CURVE_STEPS = 10
NOISE_LEVELS = (0.05, 0.1, 0.2)
DRAWS = 10
TOP_FEATURES = 10
SPARSITY_CUT = 0.02
SUBSETS, SUBSET_SHARE = 30, 0.5
CV_LIMIT, MEAN_FLOOR, VARIANCE_FLOOR = 0.5, 1e-9, 1e-9


def curve_points(size: int, steps: int = CURVE_STEPS) -> list[int]:
    """How many features are replaced at each step of a curve."""
    steps = min(steps, size)
    if steps <= 1:
        return [1]
    return [int(1 + i * (size - 1) / (steps - 1)) for i in range(steps)]


def faithfulness(df: DataFrame, keys: list[str], x: str, phi: str, baseline: list[float], scorer: Scorer,
                 ranking: list[float] | None = None) -> DataFrame:
    """Deletion and insertion curves, their areas, ablation correlation and the score.

    The target class is the predicted class of the untouched row. `ranking` replaces
    the row's own attributions by one global importance vector.
    """
    if scorer.batch(np.zeros((1, len(baseline)))) is not None:
        return _faithfulness_batches(df, x, phi, baseline, scorer.batch, ranking)
    model = getattr(scorer, "matrix", None)
    if model is not None:
        return by_matrix(df, keys, x, len(baseline), lambda rows: _faithfulness_batches(rows, x, phi, baseline, model, ranking),
                         lambda rows: _faithfulness_copies(rows, keys, x, phi, baseline, scorer, ranking))
    return _faithfulness_copies(df, keys, x, phi, baseline, scorer, ranking)


def _faithfulness_copies(df: DataFrame, keys: list[str], x: str, phi: str, baseline: list[float], scorer: Scorer, ranking: list[float] | None) -> DataFrame:
    """The measures from altered copies, as column expressions or as rows of their own."""
    d = len(baseline)
    points = curve_points(d)
    s = len(points)
    base, ks = literal_array(baseline), F.array(*[F.lit(k) for k in points])
    importance = F.col(phi) if ranking is None else literal_array(ranking)
    ranked = bind(df, _imp=importance, _rank=rank_array(importance))

    def variant(v: Column) -> Column:
        """0: the row; then s deletions, s insertions, d single ablations."""
        k_del = F.try_element_at(ks, v.cast("int"))
        k_ins = F.try_element_at(ks, (v - s).cast("int"))
        single = v - 2 * s - 1
        cells = F.arrays_zip(F.col(x).alias("x"), base.alias("b"), F.col("_rank").alias("r"))
        return F.transform(cells, lambda c, i: F.when(
            ((v >= 1) & (v <= s) & (c["r"] <= k_del))
            | ((v > s) & (v <= 2 * s) & (c["r"] > k_ins))
            | ((v > 2 * s) & (i == single)), c["b"]).otherwise(c["x"]))

    scored = score_variants(ranked, keys, scorer, 1 + 2 * s + d, variant, "_p")
    scored = bind(scored, target=argmax(F.element_at("_p", 1)), probability=F.element_at("_p", 1))
    scored = bind(scored, _t=F.transform("_p", lambda p: F.element_at(p, F.col("target") + 1)))
    out = bind(
        scored, deletion_curve=F.slice("_t", 2, s), insertion_curve=F.slice("_t", 2 + s, s),
        _drops=F.transform(F.slice("_t", 2 + 2 * s, d), lambda p: F.element_at("_t", 1) - p))
    out = bind(
        out,
        deletion_auc=normalised_area(F.transform("deletion_curve", lambda p: 1.0 - p)),
        insertion_auc=normalised_area(F.col("insertion_curve")),
        ablation_correlation=array_pearson(F.transform("_imp", lambda v: F.abs(v)), F.col("_drops")) if d > 1 else F.lit(0.0))
    score = (FAITHFULNESS["deletion"] * F.col("deletion_auc") + FAITHFULNESS["insertion"] * F.col("insertion_auc")
             + FAITHFULNESS["ablation"] * F.col("ablation_correlation"))
    return out.withColumn("faithfulness", score).drop("_imp", "_rank", "_p", "_t", "_drops")


FAITHFULNESS_TYPE = T.StructType([
    T.StructField("target", T.IntegerType()), T.StructField("probability", T.ArrayType(T.DoubleType())),
    T.StructField("deletion_curve", T.ArrayType(T.DoubleType())), T.StructField("insertion_curve", T.ArrayType(T.DoubleType())),
    T.StructField("deletion_auc", T.DoubleType()), T.StructField("insertion_auc", T.DoubleType()),
    T.StructField("ablation_correlation", T.DoubleType()), T.StructField("faithfulness", T.DoubleType()),
])
ROWS_AT_ONCE = 2_000


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


def arrow_matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix; missing numbers are NaN."""
    sizes = np.diff(column.offsets.to_numpy())
    if column.null_count or (sizes != sizes[0]).any():
        raise ValueError("all rows need the same number of features")
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False).reshape(len(column), -1)


def arrow_column(values: np.ndarray) -> pa.Array:
    """A vector or, as lists, a matrix; NaN is null in both."""
    if values.ndim == 1:
        return pa.array(values, from_pandas=True)
    n, size = values.shape
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype="int32") * np.int32(size), pa.array(np.ascontiguousarray(values).reshape(-1), from_pandas=True))


def _faithfulness_batches(df: DataFrame, x: str, phi: str, baseline: list[float], model, ranking: list[float] | None) -> DataFrame:
    """The same measures for scorers that take a matrix: one Arrow pass, no shuffle."""
    base, points = np.asarray(baseline), curve_points(len(baseline))

    def measure(xs: pa.Array, phis: pa.Array) -> pa.Array:
        out, features, given = [], arrow_matrix(xs), arrow_matrix(phis)
        for i in range(0, len(features), ROWS_AT_ONCE):
            f = features[i:i + ROWS_AT_ONCE]
            imp = given[i:i + ROWS_AT_ONCE] if ranking is None else np.broadcast_to(np.asarray(ranking, dtype="float64"), f.shape)
            p = model(f)
            target = p.argmax(1)
            deleted, inserted = kernels.curves(model, f, kernels.ranks(imp), base, points, target)
            original = np.take_along_axis(p, target[:, None], axis=1)[:, 0]
            deletion, insertion = kernels.area(1.0 - deleted), kernels.area(inserted)
            ablation = kernels.ablation(model, f, imp, base, original, target)
            score = FAITHFULNESS["deletion"] * deletion + FAITHFULNESS["insertion"] * insertion + FAITHFULNESS["ablation"] * ablation
            out.append((target.astype("int32"), p, deleted, inserted, deletion, insertion, ablation, score))
        parts = [arrow_column(np.concatenate(column)) for column in zip(*out)]
        return pa.StructArray.from_arrays(parts, names=FAITHFULNESS_TYPE.names)

    call = F.arrow_udf(measure, FAITHFULNESS_TYPE).asNondeterministic()
    return df.withColumn("_f", call(F.col(x), F.col(phi))).select(*df.columns, "_f.*")


def perturbed(word: Column, x: Column, draw: Column, levels=NOISE_LEVELS) -> Column:
    """The row plus Gaussian noise of a drawn level times the spread of its own features.

    `word` is the row's random word. Draw j of d features uses counters from
    j * (2d + 1): one for the level, then two per feature.
    """
    first = lambda v: draw.cast("long") * (2 * F.size(v) + 1)
    level = lambda v: F.element_at(literal_array(levels), (counter_u32(word, first(v)) % len(levels) + 1).cast("int"))
    return let(x, lambda v: let(level(v) * array_std_pop(v), lambda s: F.transform(
        v, lambda e, i: e + s * counter_normal(word, first(v) + 1 + 2 * i))))


def perturbed_copies(df: DataFrame, keys: list[str], x: str, seed, draws: int, draw: str, out: str) -> DataFrame:
    """(keys, draw, out): `draws` perturbed copies of every row, as `perturbed` makes them, from one matrix a batch.

    Rows with missing features keep the column expression.
    """
    def copies(xs: pd.Series, words: pd.Series) -> pd.Series:
        made = pd.Series([None] * len(xs), dtype=object)
        sizes = xs.map(lambda v: -1 if v is None else len(v)).to_numpy()
        for size in set(sizes.tolist()) - {-1, 0}:
            rows = np.flatnonzero(sizes == size)
            for i in range(0, len(rows), ROWS_AT_ONCE):
                part = rows[i:i + ROWS_AT_ONCE]
                noisy = kernels.noisy_rows(matrix(xs.iloc[part]), words.to_numpy()[part], draws, NOISE_LEVELS)
                made.iloc[part] = pd.Series(list(noisy.reshape(len(part), -1)), index=part, dtype=object)
        return made

    call = F.pandas_udf(copies, T.ArrayType(T.DoubleType()))
    whole = (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull())
    worded = df.select(*keys, x, row_word(seed, *keys).alias("_w"))
    made = worded.withColumn("_all", call(F.when(whole, F.col(x)), F.col("_w"))).withColumn(draw, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    own = F.slice("_all", F.col(draw) * F.size(x) + 1, F.size(x))
    return bind(made, **{out: F.when(F.col("_all").isNotNull(), own).otherwise(perturbed(F.col("_w"), F.col(x), F.col(draw)))}).select(*keys, draw, out)


def explain_draws(df: DataFrame, keys: list[str], x: str, explainer, seed, draws: int = DRAWS, out: str = "draw_phi") -> DataFrame:
    """Attributions of `draws` perturbed copies of every row."""
    steps = F.sequence(F.lit(0), F.lit(draws - 1))
    placed = df.repartition(*keys)
    worded = bind(placed.select(*keys, x), _w=row_word(seed, *keys)).withColumn("_draw", F.explode(steps))
    copies = worded.select(*keys, "_draw", perturbed(F.col("_w"), F.col(x), F.col("_draw")).alias("_x"))
    explained = explainer.explain(copies, [*keys, "_draw"], "_x", "_phi")
    gathered = explained.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_draw", "_phi"))).alias("_d"))
    return placed.join(gathered.select(*keys, F.transform("_d", lambda s: s["_phi"]).alias(out)), keys)


def robustness(df: DataFrame, keys: list[str], x: str, phi: str, explainer, seed=42, draws: int = DRAWS, k: int = TOP_FEATURES) -> DataFrame:
    """Top-k stability, normalised variance of attributions, and the score.

    Without an explainer nothing can be recomputed: all three are null.
    """
    if explainer is None:
        none = F.lit(None).cast("double")
        return df.withColumns({"jaccard_similarity": none, "importance_variance": none, "robustness": none})
    if explainer.batched:
        return _robustness_batches(df, keys, x, phi, explainer, seed, draws, k)
    if getattr(explainer, "matrix", None) is not None:
        return by_matrix(df, keys, x, len(explainer.baseline), lambda rows: _robustness_in_tasks(rows, keys, x, phi, explainer, seed, draws, k),
                         lambda rows: _robustness_copies(rows, keys, x, phi, explainer, seed, draws, k))
    return _robustness_copies(df, keys, x, phi, explainer, seed, draws, k)


def _robustness_copies(df: DataFrame, keys: list[str], x: str, phi: str, explainer, seed, draws: int, k: int) -> DataFrame:
    drawn = explain_draws(df, keys, x, explainer, seed, draws)
    first = top_features(F.col(phi), k)
    overlap = let(first, lambda f: array_mean(F.transform("draw_phi", lambda p: jaccard(f, top_features(p, k)))))
    by_feature = F.transform(F.sequence(F.lit(0), F.size(phi) - 1), lambda i: array_variance_pop(F.transform("draw_phi", lambda p: p[i])))
    spread = array_mean(by_feature) / (array_variance_pop(F.col(phi)) + VARIANCE_FLOOR)
    silent = F.array_max(F.transform(phi, lambda v: F.abs(v))) == 0
    variance = F.when(silent, F.lit(0.0)).otherwise(F.least(spread, F.lit(1.0)))
    out = bind(drawn, jaccard_similarity=overlap, importance_variance=variance).drop("draw_phi")
    return out.withColumn("robustness", ROBUSTNESS["jaccard"] * F.col("jaccard_similarity")
                          + ROBUSTNESS["variance"] * (1.0 - F.col("importance_variance")))


def _robustness_batches(df: DataFrame, keys: list[str], x: str, phi: str, explainer, seed, draws: int, k: int) -> DataFrame:
    """Every perturbed copy is a row of its own, with a random word drawn from the row's."""
    return _stability_in_tasks(df, x, phi, row_word(seed, *keys), F.array(row_word(seed, *keys)), draws, k, explainer.batch,
                               lambda own: np_counter_u32(own[:, 0], 2 ** 30 + np.arange(draws)))


def _robustness_in_tasks(df: DataFrame, keys: list[str], x: str, phi: str, explainer, seed, draws: int, k: int) -> DataFrame:
    """For a fitted model as a function of matrices: copies get the words that `explain_draws` gives them."""
    model, base, permutations, target = explainer.matrix, np.asarray(explainer.baseline), explainer.permutations, explainer.target
    again = F.array(*[row_word(explainer.seed, *keys, F.lit(j)) for j in range(draws)])
    return _stability_in_tasks(df, x, phi, row_word(seed, *keys), again, draws, k,
                               lambda rows, words: kernels.shapley(model, rows, base, words, permutations, target), lambda own: own)


def _stability_in_tasks(df: DataFrame, x: str, phi: str, word: Column, again: Column, draws: int, k: int, explain, words_of) -> DataFrame:
    fields = ("jaccard_similarity", "importance_variance", "robustness")

    def measure(xs: pd.Series, phis: pd.Series, words: pd.Series, others: pd.Series) -> pd.DataFrame:
        out, features, given, w, own = [], matrix(xs), matrix(phis), words.to_numpy(), np.stack(others.to_numpy())
        for i in range(0, len(features), ROWS_AT_ONCE):
            part = slice(i, i + ROWS_AT_ONCE)
            noisy = kernels.noisy_rows(features[part], w[part], draws, NOISE_LEVELS)
            n, _, d = noisy.shape
            copies = explain(noisy.reshape(n * draws, d), words_of(own[part]).reshape(-1))
            overlap, variance = kernels.stability(given[part], copies.reshape(n, draws, d), k, VARIANCE_FLOOR)
            out.append(pd.DataFrame(dict(zip(fields, (overlap, variance, ROBUSTNESS["jaccard"] * overlap + ROBUSTNESS["variance"] * (1.0 - variance))))))
        return pd.concat(out, ignore_index=True)

    kind = T.StructType([T.StructField(f, T.DoubleType()) for f in fields])
    call = F.pandas_udf(measure, kind).asNondeterministic()
    return df.withColumn("_r", call(F.col(x), F.col(phi), word, again)).select(*df.columns, "_r.*")


def sparsity(phi: Column, cut: float = SPARSITY_CUT) -> Column:
    return 1.0 - F.size(F.filter(phi, lambda v: F.abs(v) > cut)) / F.size(phi)


def effective_complexity(phi: Column) -> Column:
    """Squashed coefficient of variation of the absolute attributions."""
    spread = lambda a: F.struct(F.size(a).alias("n"), array_mean(a).alias("m"), array_std_pop(a).alias("s"))
    facts = let(F.transform(phi, lambda v: F.abs(v)), spread)
    return let(facts, lambda f: F.when((f["n"] < 2) | (f["m"] == 0), F.lit(1.0)).otherwise(logistic(2.0 * (f["s"] / f["m"] - 1.0))))


def complexity(df: DataFrame, phi: str, cut: float = SPARSITY_CUT) -> DataFrame:
    out = bind(df, sparsity=sparsity(F.col(phi), cut), effective_complexity=effective_complexity(F.col(phi)))
    return out.withColumn("complexity", COMPLEXITY["sparsity"] * F.col("sparsity") + COMPLEXITY["effective"] * F.col("effective_complexity"))


def subset_importance(df: DataFrame, keys: list[str], phi: str, size: int, seed=42, subsets: int = SUBSETS, share: float = SUBSET_SHARE) -> DataFrame:
    """Mean absolute attribution per (subset, feature).

    Each row joins each subset by a hash bit (share 0.5: one digest serves 30
    subsets). Attributions are reused; the aggregate has `subsets` groups and is
    combined before its shuffle.
    """
    indexes = F.sequence(F.lit(0), F.lit(subsets - 1))
    if share == 0.5 and subsets <= 32:
        mask = hash_u32(seed, *keys)
        member = let(mask, lambda m: F.filter(indexes, lambda s: F.floor(m / F.pow(F.lit(2.0), s)) % 2 == 1))
    else:
        member = F.filter(indexes, lambda s: hash_uniform(seed, *keys, s) < share)
    rows = df.select(F.explode(member).alias("subset"), F.col(phi).alias("_phi"))
    sums = rows.groupBy("subset").agg(*[F.avg(F.abs(F.col("_phi")[i])).alias(f"_f{i}") for i in range(size)])
    return sums.select("subset", F.posexplode(F.array(*[F.col(f"_f{i}") for i in range(size)])).alias("feature_idx", "importance"))


def global_robustness(df: DataFrame, keys: list[str], phi: str, size: int, seed=42, subsets: int = SUBSETS,
                      share: float = SUBSET_SHARE, k: int = TOP_FEATURES) -> DataFrame:
    """Overlap of subset rankings with the full ranking, and spread of importances over subsets."""
    per_subset = subset_importance(df, keys, phi, size, seed, subsets, share)
    whole = df.agg(F.array(*[F.avg(F.abs(F.col(phi)[i])) for i in range(size)]).alias("_all"))
    # from here on: subsets x features numbers
    vectors = per_subset.groupBy("subset").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("feature_idx", "importance"))), lambda s: s["importance"]).alias("_v"))
    compared = attach_one(vectors, whole).agg(
        F.avg(jaccard(top_features(F.col("_all"), k), top_features(F.col("_v"), k))).alias("jaccard"), F.count("*").alias("n_subsets"))
    spread = per_subset.groupBy("feature_idx").agg(F.avg("importance").alias("m"), F.stddev_pop("importance").alias("s"))
    cv = spread.agg(F.coalesce(F.avg(F.when(F.col("m") > MEAN_FLOOR, F.col("s") / F.col("m"))), F.lit(0.0)).alias("cv"))
    variance = F.least(F.col("cv") / CV_LIMIT, F.lit(1.0))
    return attach_one(compared, cv).select(
        F.col("jaccard").alias("subset_jaccard_similarity"), variance.alias("subset_importance_variance"), "n_subsets",
        (ROBUSTNESS["jaccard"] * F.col("jaccard") + ROBUSTNESS["variance"] * (1.0 - variance)).alias("robustness"))
