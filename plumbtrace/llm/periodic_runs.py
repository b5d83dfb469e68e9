"""Runs of repeating words: all cubic (or higher) maximal repetitions of a text.

A run is a stretch of consecutive words with smallest period q that holds q at least `times` times, has at
least `least` words, and can't be extended by a neighbouring word keeping the period.

1. Marking. A run repeats each of its `gram`-word sequences within q words, so a word can be in a run only if it is
   covered by a sequence that comes again within a third of the stretch around it. Stretches of such words are
   narrowed until nothing changes; ordinary prose has none, and the rest works on what is left. Hash collisions
   mark too much, never too little.
2. Suffix automaton of each stretch. Its suffix links form a tree in which the path from a prefix's state to the
   root holds all suffixes of the prefix.
3. Link-cut access. For each appended word the path is accessed: preferred paths are splay trees, each of one
   colour, the last end position of its substrings. A segment of colour c whose deepest state has length m says
   that the longest suffix last seen at c has m words. With q = e - c, m >= q is a square of period q; m + q words
   that end at e have the smallest period q as soon as m >= (times - 1) * q. Where the next word breaks the
   period, that is a run: m is maximal, so it can't be extended to the left either. Then the whole path takes
   colour e. Accesses cost O(log n) amortised segments.

Why each run is found at its last word t: its suffix of length - q >= 2q words was last seen at t - q, for an
occurrence nearer than q would, with q, give the stretch a smaller period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

LEAST, TIMES = 24, 3

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _gram_distance(ids: np.ndarray, gram: int) -> np.ndarray:
    """For each start of a `gram`-word sequence: words to its nearest other occurrence (a huge number: none)."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * _GOLDEN
    h ^= h >> np.uint64(29)
    # sequences of 2^k words by doubling, then two overlapping ones for the rest
    size = 1
    while size * 2 <= gram:
        h = h[:-size] * np.uint64(0xBF58476D1CE4E5B9) + (h[size:] ^ (h[size:] >> np.uint64(31)))
        size *= 2
    if size < gram:
        rest = gram - size
        h = h[:-rest] * np.uint64(0x94D049BB133111EB) + (h[rest:] ^ (h[rest:] >> np.uint64(31)))
    none = np.iinfo(np.int64).max
    near = np.full(len(h), none)
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    if len(same):
        a, b = order[same], order[same + 1]
        gap = b - a
        near[a] = gap
        near[b] = np.minimum(near[b], gap)
    return near


def periodic_stretches(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """[start, end) of the stretches outside which no run lies."""
    gram = (least + 2) // 3
    found, todo = [], [(0, len(ids))]
    while todo:
        start, end = todo.pop()
        n = end - start
        if n < least:
            continue
        near = _gram_distance(ids[start:end], gram)
        good = near <= n // times
        if not good.any():
            continue
        cover = np.zeros(n + 1, np.int64)
        at = np.flatnonzero(good)
        cover[at] += 1
        cover[at + gram] -= 1  # a start at most gets one each
        edges = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]]).astype(np.int8)))
        parts = [(start + int(a), start + int(b)) for a, b in zip(edges[::2], edges[1::2]) if b - a >= least]
        if parts == [(start, end)]:
            found.append((start, end))
        else:
            todo.extend(parts)
    return sorted(found)


def _automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix link and longest length of every state, and the state of every prefix."""
    link, length, moves, states = [-1], [0], [{}], []
    last = 0
    for w in ids:
        new = len(link)
        link.append(0)
        length.append(length[last] + 1)
        moves.append({})
        p = last
        while p >= 0 and w not in moves[p]:
            moves[p][w] = new
            p = link[p]
        if p >= 0:
            q = moves[p][w]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                moves.append(moves[q].copy())
                while p >= 0 and moves[p].get(w) == q:
                    moves[p][w] = copy
                    p = link[p]
                link[q] = link[new] = copy
        states.append(new)
        last = new
    return link, length, states


def _runs_of_stretch(ids: list[int], least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one stretch."""
    up, length, states = _automaton(ids)
    size, n = len(up), len(ids)
    # `up` holds the splay parent or, at the top of a splay tree, the path's parent state
    left, right, colour = [-1] * size, [-1] * size, [-1] * size

    def rotate(x: int, p: int) -> None:
        g = up[p]
        if g >= 0 and left[g] == p:
            left[g] = x
        elif g >= 0 and right[g] == p:
            right[g] = x
        else:
            colour[x] = colour[p]  # the top of a splay tree tells its colour
        if left[p] == x:
            b = right[x]
            left[p], right[x] = b, p
        else:
            b = left[x]
            right[p], left[x] = b, p
        if b >= 0:
            up[b] = p
        up[p], up[x] = x, g

    def splay(x: int) -> None:
        while True:
            p = up[x]
            if p < 0 or (left[p] != x and right[p] != x):
                return
            g = up[p]
            if g >= 0 and (left[g] == p or right[g] == p):
                if (left[g] == p) == (left[p] == x):
                    rotate(p, g)
                else:
                    rotate(x, p)
                    p = up[x]
            rotate(x, p)

    out = []
    for e in range(n):
        w, below = states[e], -1
        while w >= 0:
            splay(w)
            c = colour[w]
            if right[w] >= 0:
                colour[right[w]] = c
            right[w] = below
            if c >= 0:
                q, m = e - c, length[w]
                if m >= (times - 1) * q and m + q >= least and (e == n - 1 or ids[e + 1] != ids[e + 1 - q]):
                    out.append((e + 1 - m - q, m + q, q))
            below = w
            w = up[w]
        colour[below] = e
        splay(states[e])
    return out


def word_runs(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a list of words, by start, then period."""
    if times < 3:
        raise ValueError("times must be 3 or more")
    if len(words) < least:
        return []
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return []
    out = []
    for start, end in periodic_stretches(ids, least, times):
        out += [(start + s, n, q) for s, n, q in _runs_of_stretch(ids[start:end].tolist(), least, times)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that any run contains after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        drop[s + q] += 1
        drop[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]


def most_periodic(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; ties: smallest start, then period."""
    best = None
    for r in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def periodic_runs(text: Column, least: int = LEAST, times: int = TIMES) -> Column:
    """Struct of a text: n_words; runs, array of (start, length, period) by start, then period; best, the run with the
    greatest length / period (null: no run); collapsed, the kept words joined by one space.

    Words are cut at ASCII white space. Null, empty and blank texts have no words, no runs and an empty collapsed text.
    Texts of any length are read whole; each row stands alone, so rows may repeat, ids may be null, and no row is
    moved. Least words below `least` give no run. `times` must be 3 or more.
    """
    if times < 3:
        raise ValueError("times must be 3 or more")

    run = "struct<start: long, length: long, period: long>"

    @F.pandas_udf(f"n_words long, runs array<{run}>, best {run}, collapsed string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                words = t.encode("utf-8", "surrogatepass").split() if t else []
                runs = word_runs(words, least, times)
                kept = b" ".join(collapse(words, runs)).decode("utf-8", "surrogatepass")
                best = most_periodic(runs)
                rows.append((len(words), [told(r) for r in runs], best and told(best), kept))
            yield pd.DataFrame(rows, columns=["n_words", "runs", "best", "collapsed"])

    def told(r: tuple[int, int, int]) -> dict[str, int]:
        return dict(zip(("start", "length", "period"), r))

    return find(text)
