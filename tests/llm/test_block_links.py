"""Where blocks meet, pairs are verified in place: only links that join components become rows."""

import random

import numpy as np
import pytest

from plumbtrace.llm import near_duplicates as near

N = 90


def _under_the_bar():
    """Edits of one text that is not there itself: nearly all pairs are plausible, few link."""
    rng, base, rows = random.Random(11), [f"w{k}" for k in range(900)], []
    for k in range(N):
        w = list(base)
        for at in (56 * j + rng.randrange(56) for j in range(16)):
            w[at] = f"x{k}_{at}"
        rows.append((k, " ".join(w)))
    return rows


def _components(rows):
    shingles = {d: {tuple(w[k:k + near.SHINGLE]) for k in range(len(w) - near.SHINGLE + 1)} for d, w in ((d, t.split()) for d, t in rows)}
    root = {d: d for d, _ in rows}
    for a, x in shingles.items():
        for b, y in shingles.items():
            if a < b and 100 * len(x & y) >= near.NUMERATOR * len(x | y):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {d: new if r == old else r for d, r in root.items()}
    return root


@pytest.mark.parametrize("block_bytes", [near.BLOCK_BYTES, 60_000] if hasattr(near, "BLOCK_BYTES") else [0])
def test_pairs_under_the_bar_become_no_rows(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(near, "SMALL", 2)
    monkeypatch.setattr(near, "BLOCK_BYTES", block_bytes, raising=False)
    counted, verified = [], near._verified
    monkeypatch.setattr(near, "_verified", lambda pairs, texts: counted.append(pairs.count()) or verified(pairs, texts))
    rows = _under_the_bar()
    got = {r.doc_id: r.component_id for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = _components(rows)
    assert got == want and len(set(want.values())) > N // 3
    assert sum(counted[1:]) <= N  # a pair of each bucket of two; those of larger ones stay where blocks meet


def test_blocks_hold_few_bytes_of_sets(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_BYTES", 60_000)
    rows = [(bytes([k]) * 16, t) for k, t in _under_the_bar()]
    texts = spark.createDataFrame(rows, "node binary, text string")
    told = texts.selectExpr("7L key", "node", "node root", "true large", "node card")
    homes, meets = near._blocks(told, texts)
    sizes = {r.block: r.n for r in homes.selectExpr("block", "octet_length(hashes) n").groupBy("block").agg({"n": "sum"}).toDF("block", "n").collect()}
    blocks = -(-sum(sizes.values()) // 60_000)
    assert blocks > 8 and blocks // 2 < len(sizes) <= blocks
    assert meets.count() == len(sizes) * (len(sizes) + 1) // 2


def test_meeting_pairs_with_sets_join_components_once():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
    sets = [base, base[:190], base[:180], base[:100], np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))]
    card = np.frombuffer(np.uint32(200).tobytes() + bytes(near.LONG), np.uint8)  # equal cards: every pair is plausible
    u = np.array([np.concatenate([np.full(16, k, np.uint8), np.full(16, k, np.uint8), card]) for k in range(5)])
    for left, right in ((u, None), (u[:2], u[2:])):
        for best in (True, False):
            links = near._meeting_pairs(left, right, best, sets)
            assert len(links) == 2 and {n[0] for link in links for n in link} == {0, 1, 2}
