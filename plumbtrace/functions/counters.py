"""Counter-based random words: one hashed word per row, mixed with a counter.

The same numbers come out of column expressions and of numpy, so an operator may
run on either without changing its result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

from .binding import let
from .hashing import TWO_32, hash_u32

# 32-bit finaliser of MurmurHash3 and the golden-ratio step.
STEP, MIX_A, MIX_B = 0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35
MASK = 0xFFFFFFFF


def row_word(seed, *keys) -> Column:
    return hash_u32(seed, *keys)


def _times(h: Column, factor: int) -> Column:
    """Low 32 bits of h * factor, in two halves that stay far below 64 bits."""
    low, high = factor & 0xFFFF, factor >> 16
    return (h * F.lit(low) + (h * F.lit(high)).bitwiseAND(F.lit(0xFFFF)) * F.lit(65536)).bitwiseAND(F.lit(MASK))


def _fold(h: Column, bits: int) -> Column:
    return let(h, lambda v: v.bitwiseXOR(F.shiftright(v, bits)))


def counter_u32(word: Column, counter: Column) -> Column:
    """32-bit word number `counter` of a row."""
    start = (word + (counter.cast("long") + 1) * F.lit(STEP)).bitwiseAND(F.lit(MASK))
    mixed = let(_fold(start, 16), lambda v: _times(v, MIX_A))
    mixed = let(_fold(mixed, 13), lambda v: _times(v, MIX_B))
    return _fold(mixed, 16)


def counter_normal(word: Column, counter: Column) -> Column:
    """Standard normal from words `counter` and `counter` + 1."""
    radius = F.sqrt(-2.0 * F.log((counter_u32(word, counter) + 1.0) / TWO_32))
    return radius * F.cos(2.0 * math.pi * counter_u32(word, counter + 1) / TWO_32)


def np_counter_u32(words: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """Row words (n) and counters (any shape) to n x shape words."""
    shape = (-1,) + (1,) * counters.ndim
    h = (words.astype("uint64").reshape(shape) + (counters.astype("uint64") + np.uint64(1)) * np.uint64(STEP)) & np.uint64(MASK)
    h = ((h ^ (h >> np.uint64(16))) * np.uint64(MIX_A)) & np.uint64(MASK)
    h = ((h ^ (h >> np.uint64(13))) * np.uint64(MIX_B)) & np.uint64(MASK)
    return h ^ (h >> np.uint64(16))


def np_counter_normal(words: np.ndarray, counters: np.ndarray) -> np.ndarray:
    a = np_counter_u32(words, counters).astype("float64")
    b = np_counter_u32(words, counters + 1).astype("float64")
    return np.sqrt(-2.0 * np.log((a + 1.0) / TWO_32)) * np.cos(2.0 * math.pi * b / TWO_32)
