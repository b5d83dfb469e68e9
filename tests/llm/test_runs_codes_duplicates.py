"""Runs of words, vector codes and embedding near-duplicates against brute force, and their edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbtrace.llm import embedding_duplicates as ed, periodic_runs as pr, vector_codes as vc


def brute_runs(words, least, times):
    ids = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    out = []
    for q in range(1, len(a) // times + 1):
        same = np.flatnonzero(np.diff(np.concatenate([[False], a[q:] == a[:-q], [False]]).astype(np.int8)))
        for s, t in zip(same[::2], same[1::2]):
            n = int(t - s) + q
            if n >= max(least, times * q) and not any((a[s + p:s + n] == a[s:s + n - p]).all() for p in range(1, q)):
                out.append((int(s), n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least,times", [(24, 3), (1, 3), (7, 3), (24, 4)])
def test_runs_match_brute_force(least, times):
    rng = random.Random(least * 10 + times)
    for _ in range(200):
        k, words = rng.choice([1, 2, 3, 5, 50]), []
        for _ in range(rng.randint(0, 6)):
            words += [rng.randrange(k) for _ in range(rng.randint(1, 30))] * rng.choice([1, 1, 2, 3, 4, 7, 12])
        if words and rng.random() < 0.3:
            words[rng.randrange(len(words))] = -1
        assert pr.word_runs(words, least, times) == brute_runs(words, least, times)


def test_links_of_the_automaton_are_not_rebuilt_by_marking():
    rng = random.Random(3)
    prose = [rng.randrange(10_000) for _ in range(3000)]
    assert pr.periodic_stretches(np.array(prose)) == []
    planted = prose[:1000] + prose[1000:1400] * 5 + prose[1400:]
    (start, end), = pr.periodic_stretches(np.array(planted))
    assert start <= 1000 and end >= 3000
    assert pr.word_runs(planted) == [(1000, 2000, 400)]


def test_runs_of_edge_rows(spark):
    long = " ".join(f"w{k}" for k in range(40_000)) + " a b c" * 20_000
    texts = [None, "", " \t\n ", "one two", "x " * 24, "x " * 23, "x y " * 12 + "z", long, long]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "x " * 24)], "doc_id long, text string").withColumn("runs", F.lit(1))
    rows = docs.select("doc_id", "text", "runs", pr.periodic_runs(F.col("text")).alias("p")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, r.p)
    assert len(rows) == 10
    for k in (0, 1, 2):
        assert got[k].n_words == 0 and got[k].runs == [] and got[k].best is None and got[k].collapsed == ""
    assert got[3].collapsed == "one two" and got[3].runs == []
    assert [tuple(x) for x in got[4].runs] == [(0, 24, 1)] and got[4].collapsed == "x"
    assert got[5].runs == [] and got[None].collapsed == "x"
    assert [tuple(x) for x in got[6].runs] == [(0, 24, 2)] and got[6].collapsed == "x y z"
    assert [tuple(x) for x in got[7].runs] == [(40_000, 60_000, 3)] == [tuple(x) for x in got[8].runs]
    assert docs.where("false").select(pr.periodic_runs(F.col("text")).alias("p")).count() == 0
    with pytest.raises(ValueError):
        pr.periodic_runs(F.col("text"), times=2)


def test_the_most_periodic_run_breaks_ties_by_start_then_period():
    assert pr.most_periodic([]) is None
    assert pr.most_periodic([(9, 30, 3), (4, 40, 4), (4, 50, 5)]) == (4, 40, 4)
    assert pr.most_periodic([(0, 30, 3), (5, 31, 3)]) == (5, 31, 3)


def brute_codes(ids, x, parts, entries, rounds):
    width = x.shape[1] // parts
    split = x.reshape(len(x), parts, width)
    order = np.argsort(ids, kind="stable")[:entries]
    books = [split[order, p].copy() for p in range(parts)]
    for r in range(rounds + 1):
        d = [((split[:, p][:, None] - books[p][None]) ** 2).sum(2) for p in range(parts)]
        near = np.stack([q.argmin(1) for q in d], 1)
        if r == rounds:
            return near, sum(q.min(1) for q in d), books
        for p in range(parts):
            for e in np.unique(near[:, p]):
                members = split[near[:, p] == e, p]
                books[p][e] = members.sum(0) // len(members)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_cover_trees_assign_like_brute_force(spark, spread):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([centres[rng.integers(0, 12, 2500)] + spread * rng.normal(size=(2500, 16)), np.repeat(centres[:1], 700, 0)])
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist(), int(i) % 3 if i % 5 else None) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, label int").repartition(3)
    codes, books = vc.vector_codes(df, parts=4, entries=20, rounds=3)
    got = {r.vec_id: r for r in codes.collect()}
    near, error, expected = brute_codes(ids, np.floor(1024 * x).astype(np.int64), 4, 20, 3)
    assert (np.stack(expected) == books).all()
    for k, i in enumerate(ids.tolist()):
        assert got[i].code == near[k].tolist() and got[i].error == error[k]
    total = {}
    for k, i in enumerate(ids.tolist()):
        total[got[i].label] = total.get(got[i].label, 0) + int(error[k])
    assert all(r.label_error == total[r.label] for r in got.values())


def test_whole_subtrees_are_assigned():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-3, 4, (300, 8)), rng.integers(-3, 4, (300, 8)) + 5000])
    tree = vc.CoverTree.load(vc.CoverTree.build(x).dump(), 8)
    found = list(tree.walk(np.array([[0] * 8, [5000] * 8])))
    assert sum(len(n) for n, _ in found) < 10
    assert sum(int((tree.sums[tree.end[n], 0] - tree.sums[tree.start[n], 0]).sum()) for n, _ in found) == 600
    for node in range(len(tree.start)):
        members = tree.points[tree.start[node]:tree.end[node]]
        assert np.sqrt(((members - tree.points[tree.centre[node]]) ** 2).sum(1)).max() <= tree.radius[node] + 1e-6


def test_codes_of_edge_rows(spark):
    schema = "vec_id long, embedding array<float>, label string"
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, "a"), (2, [], "a"), (3, [1.0, None, 0.0, 0.0, 0.0], "a"), (4, [nan] * 5, "a"), (5, [inf] * 5, None), (6, [0.1, 0.2, 0.3, 0.4, 0.5], None),
        (6, [0.1, 0.2, 0.3, 0.4, 0.5], None), (None, [9.0, 9.0, 9.0, 9.0, 9.0], "b"), (7, [1.0, 2.0], "b"), (8, [1e30, 0.0, 0.0, 0.0, -1e30], "c"),
    ]
    df = spark.createDataFrame(rows, schema).withColumn("code", F.lit(1)).withColumn("ids", F.lit(2))
    codes, books = vc.vector_codes(df, entries=3)
    got = sorted(codes.collect(), key=lambda r: (r.vec_id is None, r.vec_id or 0))
    assert [r.vec_id for r in got] == [6, 6, 8, None]
    assert got[0] == got[1] and got[0].label is None and got[0].label_error == 2 * got[0].error
    assert books.shape == (4, 3, 2)
    codes, books = vc.vector_codes(df.where("false"))
    assert codes.collect() == [] and codes.columns == ["vec_id", "label", "code", "error", "label_error"]


def brute_links(rows, bar):
    def direction(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v, float) / np.sqrt((np.array(v, float) ** 2).sum())

    u = [direction(v) for _, v, _ in rows]
    links = [set() for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if u[a] is not None and u[b] is not None and rows[a][2] is not None and rows[a][2] == rows[b][2] and len(u[a]) == len(u[b]) and u[a] @ u[b] >= bar:
                links[a].add(b)
                links[b].add(a)
    return links


def test_embedding_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(260, 24))
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(base)]
    for k in range(240):  # near copies: chains, clusters around one vector, scaled and exact copies
        origin = base[k // 3 if k < 120 else 5]
        noise = 0 if k % 7 == 0 else rng.choice([0.02, 0.1, 0.25])
        rows.append((1000 + k, ((origin + noise * rng.normal(size=24)) * rng.uniform(0.5, 2)).tolist(), (k // 3 if k < 120 else 5) % 3))
    rng.shuffle(rows)
    rows = [(int(i), list(v), int(c)) for i, v, c in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: r for r in ed.embedding_duplicates(df, target_recall=1.0).collect()}
    links = brute_links(rows, ed.BAR)
    found = sum(r.n_links for r in got.values())
    assert all(got[r[0]].n_links <= len(x) for r, x in zip(rows, links))
    assert found >= 0.999 * sum(map(len, links))
    if found == sum(map(len, links)):
        component = list(range(len(rows)))
        for _ in rows:
            component = [min([component[a], *(component[b] for b in links[a])], key=lambda k: rows[k][0]) for a in range(len(rows))]
        assert all(got[r[0]].component_id == rows[c][0] for r, c in zip(rows, component))


def test_blocks_of_a_large_group_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    rows = [(k, (base[k % 40] + 0.15 * rng.normal(size=16)).tolist(), k % 2) for k in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    before = sorted(map(tuple, ed.embedding_duplicates(df).collect()))
    monkeypatch.setattr(ed, "BLOCK", 16)
    # fewer rows to a block give more coarse groups, so the index is the same only in its cells
    assert sorted(map(tuple, ed.embedding_duplicates(df).collect())) == before


def test_multi_sequence_traversal_visits_nearest_cells_first():
    rng = np.random.default_rng(3)
    sample = ed.directions(rng.normal(size=(400, 12)))
    index = ed.MultiIndex(sample, 8, 2, ed.BAR, 0.99)
    for d1, d2 in zip(*index.distances(sample[:50])):
        own, cells = index.visits(d1, d2)
        total = d1[:, None] + d2[None]
        expected = {(i, j) for i, j in zip(*np.nonzero(total <= total.min() + index.reach)) if (i, j) >= own}
        assert set(cells) == expected and cells[0] == own
        order = [d1[i] + d2[j] for i, j in cells]
        assert order == sorted(order)


def test_duplicates_of_edge_rows(spark):
    nan = float("nan")
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [nan, 1.0], 0), (5, [1.0, None], 0), (6, [1.0, 2.0], None), (7, [1.0, 2.0], 0), (7, [1.0, 2.0], 0),
        (8, [2.0, 4.0], 0), (9, [1.0, 2.0], 1), (None, [1.0, 2.0], 0), (10, [1.0, 2.0, 0.0], 0), (11, [1e-30, 2e-30], 0), (12, [-1.0, -2.0], 0), (None, [5.0, -1.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("leader", F.lit("x")).withColumn("n", F.lit(1))
    got = ed.embedding_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    for k in (1, 2, 3, 4, 5, 6, 9, 10, 12):
        assert by[k] == [(0, k, True)]
    assert by[7] == [(4, 7, True)] * 2 and by[8] == [(4, 7, False)] == by[11]
    assert sorted(by[None], key=str) == sorted([(4, 7, False), (0, None, False)], key=str)
    assert ed.embedding_duplicates(df.where("false")).collect() == []
