"""Stars are found on nodes alone: cards aren't dealt by bucket, and a pair that shares several buckets is fetched once."""

import numpy as np
from pyspark.sql import functions as F

from plumbtrace.llm import near_duplicates as near


def _candidates(spark):
    rng = np.random.default_rng(3)
    card = np.uint32(50).tobytes() + rng.integers(0, 256, near.HASHES, dtype=np.uint8).tobytes()
    other = np.uint32(50).tobytes() + rng.integers(0, 256, near.HASHES, dtype=np.uint8).tobytes()
    rows = [(bytes([k]) * 16, card, keys) for k, keys in ((1, [7, 8]), (200, [7, 8]), (3, [8, 9]))] + [(bytes([4]) * 16, other, [9])]
    return spark.createDataFrame([(n, bytearray(c), k) for n, c, k in rows], "node binary, card binary, keys array<long>")


def test_stars_join_each_bucket_to_its_smallest_node(spark):
    found = sorted((bytes(r.a)[0], bytes(r.b)[0]) for r in near._star_pairs(_candidates(spark)).collect())
    assert found == [(3, 1), (200, 1)]  # bytes compare unsigned; the pair of different cards is dropped


def test_cards_are_not_grouped_by_bucket(spark):
    plan = near._star_pairs(_candidates(spark))._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.splitlines() if "Aggregate" in line]
    assert grouped and not any("card" in line for line in grouped)
