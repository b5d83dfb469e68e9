"""Scalar, array and probability expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from .binding import let


def rounded(c: Column, digits: int = 6) -> Column:
    """Round for reporting; the added zero turns a negative zero into zero."""
    return F.round(c, digits) + F.lit(0.0)


def ratio(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """num / den with a fallback when the denominator is zero or missing."""
    out = F.try_divide(num.cast("double"), den.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def map_values(c: Column, mapping: Mapping, default=None) -> Column:
    """Dictionary lookup; keys that are not listed give the default."""
    out = None
    for k, v in mapping.items():
        out = F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v))
    if out is None:
        return F.lit(default)
    return out.otherwise(F.lit(default)) if default is not None else out


def coerce_double(c: Column, default: float = 0.0) -> Column:
    """Text or number to double; what cannot be read becomes the default."""
    return F.coalesce(c.try_cast("double"), F.lit(float(default)))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


# Quality bands of the report and of the dashboard.
REPORT_BANDS = ((0.9, "Excellent"), (0.7, "Good"), (0.5, "Fair"), (0.0, "Poor"))
DASHBOARD_BANDS = ((0.7, "high"), (0.4, "medium"), (0.0, "low"))


def band(score: Column, bands: Sequence[tuple[float, str]] = REPORT_BANDS) -> Column:
    """Name of the first band whose lower bound the score reaches."""
    out = None
    for bound, name in bands:
        out = F.when(score >= bound, name) if out is None else out.when(score >= bound, name)
    return out


# Significance marks.
STARS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))


def stars(p: Column) -> Column:
    out = None
    for bound, mark in STARS:
        out = F.when(p < bound, mark) if out is None else out.when(p < bound, mark)
    return out.otherwise("")


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def normalise_probability(p: Column, classes: int = 2) -> Column:
    """One score becomes [1-p, p]; otherwise pad with zeros or cut to `classes`."""

    def shaped(a: Column) -> Column:
        missing = F.greatest(F.lit(classes) - F.size(a), F.lit(0))
        padded = F.concat(a, F.array_repeat(F.lit(0.0), missing))
        pair = F.array(1.0 - F.element_at(a, 1), F.element_at(a, 1))
        return F.when(F.size(a) == 1, pair).otherwise(F.slice(padded, 1, classes))

    return let(p, shaped)


def argmax(p: Column) -> Column:
    """Zero-based position of the first maximum."""
    return let(p, lambda a: (F.array_position(a, F.array_max(a)) - 1).cast("int"))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def array_mean(a: Column) -> Column:
    return let(a, lambda v: array_sum(v) / F.size(v))


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def array_std_pop(a: Column) -> Column:
    """Population standard deviation of an array (two passes over the values)."""
    return F.sqrt(array_variance_pop(a))


def array_variance_pop(a: Column) -> Column:
    return let(a, lambda v: let(array_mean(v), lambda m: array_mean(F.transform(v, lambda x: (x - m) * (x - m)))))


def array_pearson(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays; zero when either side is constant."""
    centred = lambda c: let(c, lambda v: let(array_mean(v), lambda m: F.transform(v, lambda x: x - m)))

    def correlation(z: Column) -> Column:
        product = array_sum(F.zip_with(z["a"], z["b"], lambda x, y: x * y))
        va = array_sum(F.transform(z["a"], lambda x: x * x))
        vb = array_sum(F.transform(z["b"], lambda y: y * y))
        return let(F.struct(product.alias("p"), va.alias("va"), vb.alias("vb")), lambda s: F.when(
            (s["va"] > 1e-24) & (s["vb"] > 1e-24), s["p"] / F.sqrt(s["va"] * s["vb"])).otherwise(F.lit(0.0)))

    return let(F.struct(centred(a).alias("a"), centred(b).alias("b")), correlation)


def trapezoid(a: Column) -> Column:
    """Area under evenly spaced points on [0, 1]."""

    def area(v: Column) -> Column:
        ends = (F.element_at(v, 1) + F.element_at(v, -1)) / 2.0
        return (array_sum(v) - ends) / (F.size(v) - 1)

    return let(a, area)


def normalised_area(a: Column) -> Column:
    """Min-max scale, then trapezoid. A flat curve gives 0.5, fewer than two points 0."""

    def scaled(v: Column) -> Column:
        lo, hi = F.array_min(v), F.array_max(v)
        flat = (hi - lo) <= (F.lit(1e-8) + F.lit(1e-5) * F.abs(lo))
        return (
            F.when(F.size(v) < 2, F.lit(0.0))
            .when(flat, F.lit(0.5))
            .otherwise((trapezoid(v) - lo) / (hi - lo))
        )

    return let(a, scaled)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; two empty sets count as no overlap."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: ratio(
        F.size(F.array_intersect(s["a"], s["b"])), F.size(F.array_union(s["a"], s["b"]))))
