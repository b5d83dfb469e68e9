"""SQL twins of the hashed draws."""

from __future__ import annotations


def h(seed, *cols: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(cols)})), 1, 8))::UBIGINT"


def u(seed, *cols: str) -> str:
    return f"({h(seed, *cols)}::DOUBLE / 4294967296.0::DOUBLE)"


def poisson_cdf_sql(n) -> str:
    """Cumulated masses of a Poisson(n) count from `poisson_first_sql` on, nine deviations and more to both sides."""
    mass = f"exp(k * ln({n}::DOUBLE) - {n}::DOUBLE - lgamma(k + 1.0::DOUBLE))"
    masses = f"list_transform(range({poisson_first_sql(n)}, ceil({n} + 9 * sqrt({n}::DOUBLE) + 8)::BIGINT + 1), lambda k: {mass})"
    return f"CASE WHEN {n} > 0 THEN list_transform([{masses}], lambda m: list_transform(range(1, len(m) + 1), lambda i: list_sum(m[1:i])))[1] END"


def poisson_first_sql(n) -> str:
    return f"greatest(floor({n} - 9 * sqrt({n}::DOUBLE) - 8)::BIGINT, 0)"


def poisson_sql(n, cdf, seed, keys) -> str:
    return f"CASE WHEN {n} > 0 THEN {poisson_first_sql(n)} + list_sum(list_transform([{u(seed, *keys)}], lambda uu: len(list_filter({cdf}, lambda c: c <= uu))))::BIGINT ELSE 0 END"
