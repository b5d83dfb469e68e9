"""Batch forms of the row-local quality measures.

Each function takes the feature and attribution matrices of one Arrow batch and
returns one value per row. They serve scorers that can be evaluated on a matrix
inside a task; Spark cuts the batches and runs them in parallel.
"""

from __future__ import annotations

import numpy as np

from plumbtrace.functions.counters import np_counter_normal, np_counter_u32


def ranks(importance: np.ndarray) -> np.ndarray:
    """One-based rank by absolute value; ties keep the feature order."""
    order = np.argsort(-np.abs(importance), axis=1, kind="stable")
    out = np.empty_like(order)
    np.put_along_axis(out, order, np.broadcast_to(np.arange(1, order.shape[1] + 1), order.shape), axis=1)
    return out


def target_probability(batch, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Probability of each row's target class for its altered copies (rows x copies x features)."""
    p = batch(rows)
    return np.take_along_axis(p, target[:, None, None], axis=2)[:, :, 0]


def curves(batch, x: np.ndarray, rank: np.ndarray, base: np.ndarray, points: list[int], target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    masked = rank[:, None, :] <= np.asarray(points)[None, :, None]
    deleted = np.where(masked, base, x[:, None, :])
    inserted = np.where(masked, x[:, None, :], base)
    return target_probability(batch, deleted, target), target_probability(batch, inserted, target)


def area(curve: np.ndarray) -> np.ndarray:
    """Min-max scaled trapezoid area; 0.5 when flat, 0 with fewer than two points."""
    if curve.shape[1] < 2:
        return np.zeros(len(curve))
    lo, hi = curve.min(1), curve.max(1)
    raw = (curve.sum(1) - (curve[:, 0] + curve[:, -1]) / 2.0) / (curve.shape[1] - 1)
    flat = hi - lo <= 1e-8 + 1e-5 * np.abs(lo)
    return np.where(flat, 0.5, (raw - lo) / np.where(flat, 1.0, hi - lo))


def ablation(batch, x: np.ndarray, importance: np.ndarray, base: np.ndarray, original: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Correlation of absolute importance with the drop from masking one feature."""
    d = x.shape[1]
    if d < 2:
        return np.zeros(len(x))
    single = np.where(np.eye(d, dtype=bool)[None], base, x[:, None, :])
    drop = original[:, None] - target_probability(batch, single, target)
    a = np.abs(importance)
    a, b = a - a.mean(1, keepdims=True), drop - drop.mean(1, keepdims=True)
    va, vb = (a * a).sum(1), (b * b).sum(1)
    live = (va > 1e-24) & (vb > 1e-24)
    return np.where(live, (a * b).sum(1) / np.sqrt(np.where(live, va * vb, 1.0)), 0.0)


def noisy_rows(x: np.ndarray, words: np.ndarray, draws: int, levels) -> np.ndarray:
    """rows x draws x features with Gaussian noise; counters as in `quality.perturbed`."""
    d = x.shape[1]
    first = np.arange(draws) * (2 * d + 1)
    level = np.asarray(levels)[(np_counter_u32(words, first) % np.uint64(len(levels))).astype("int64")]
    noise = np_counter_normal(words, first[:, None] + 1 + 2 * np.arange(d)[None, :])
    return x[:, None, :] + (level * x.std(1)[:, None])[:, :, None] * noise


def stability(phi: np.ndarray, drawn: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean Jaccard of top-k sets and capped, normalised variance over draws."""
    n, draws, d = drawn.shape
    k = min(k, d)
    first = ranks(phi) <= k
    again = (ranks(drawn.reshape(n * draws, d)) <= k).reshape(n, draws, d)
    both = (first[:, None, :] & again).sum(2)
    overlap = (both / (2 * k - both)).mean(1)
    spread = drawn.var(1).mean(1) / (phi.var(1) + floor)
    silent = np.abs(phi).max(1) == 0
    return overlap, np.where(silent, 0.0, np.minimum(spread, 1.0))


def walk_ranks(words: np.ndarray, permutations: int, d: int) -> np.ndarray:
    """rows x permutations x features: step of each feature; odd walks run backwards."""
    pairs = (permutations + 1) // 2
    marks = np_counter_u32(words, np.arange(pairs * d).reshape(pairs, d))
    order = np.argsort(marks, axis=2, kind="stable")
    step = np.empty_like(order)
    np.put_along_axis(step, order, np.broadcast_to(np.arange(1, d + 1), order.shape), axis=2)
    both = np.stack([step, d + 1 - step], axis=2).reshape(len(words), pairs * 2, d)
    return both[:, :permutations, :]


def shapley(batch, x: np.ndarray, base: np.ndarray, words: np.ndarray, permutations: int, target: int) -> np.ndarray:
    n, d = x.shape
    step = walk_ranks(words, permutations, d)
    total = np.zeros((n, d))
    for m in range(permutations):
        known = step[:, m, None, :] <= np.arange(d + 1)[None, :, None]
        p = batch(np.where(known, x[:, None, :], base))[:, :, target]
        at = step[:, m, :]
        total += np.take_along_axis(p, at, axis=1) - np.take_along_axis(p, at - 1, axis=1)
    return total / permutations
