"""Boosted trees against a plain computation on a small table."""

import numpy as np
import pytest

from plumbtrace.plans import boosting


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(600, 4)), 2)
    y = ((x[:, 0] > 0.3).astype(int) + (x[:, 1] * x[:, 2] > 0)).astype(int)
    w = np.where(y == 2, 2.0, 1.0)
    return x, y, w


def frame(spark, data, parts):
    x, y, w = data
    return spark.createDataFrame([(k, a.tolist(), int(b), float(c)) for k, (a, b, c) in enumerate(zip(x, y, w))], "id long, x array<double>, y int, w double").repartition(parts)


def plain(bins, y, w, classes, rounds, depth, step, n_bins):
    """Every split of every node by trying all features and bins on the rows themselves; no draws."""
    K = 1 if classes == 2 else classes
    margin, losses = np.zeros((len(y), K)), []
    for _ in range(rounds):
        g, h, loss = boosting.gradients(margin, y, w)
        g, h = g / boosting.UNIT, h / boosting.UNIT
        losses.append(loss / w.sum())
        move = np.zeros_like(margin)

        def grow(rows, k, level):
            G, H, best = g[rows, k].sum(), h[rows, k].sum(), None
            for f in range(bins.shape[1]):
                for b in range(n_bins - 1):
                    left = rows[bins[rows, f] <= b]
                    gl, hl = g[left, k].sum(), h[left, k].sum()
                    if hl < 1 or H - hl < 1:
                        continue
                    gain = gl * gl / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G * G / (H + 1)
                    if best is None or gain > best[0] + 1e-12:
                        best = gain, f, b
            if level == depth or best is None or best[0] <= 1e-9:
                move[rows, k] = -step * G / (H + 1)
                return
            left = bins[rows, best[1]] <= best[2]
            grow(rows[left], k, level + 1)
            grow(rows[~left], k, level + 1)

        for k in range(K):
            grow(np.arange(len(y)), k, 0)
        margin += move
    return boosting.probabilities(margin), losses


@pytest.mark.parametrize("classes", [2, 3])
def test_splits_equal_a_search_over_all_rows(spark, data, classes):
    x, y, w = data
    y = np.minimum(y, classes - 1)
    model = boosting.fit_boosted(frame(spark, (x, y, w), 3), "x", 4, "y", classes, ["id"], "w", rounds=3, depth=3, row_share=1.0, column_share=1.0, bins=8)
    p, losses = plain(model.binned(x), y, w, classes, 3, 3, 0.1, 8)
    assert model.batch(x) == pytest.approx(p, abs=1e-9)
    assert model.losses == pytest.approx(losses, rel=1e-9)


def test_loss_falls_and_partitions_do_not_matter(spark, data, monkeypatch):
    monkeypatch.setattr(boosting, "STORE_EVERY", 3)
    runs = [boosting.fit_boosted(frame(spark, data, parts), "x", 4, "y", 3, ["id"], "w", rounds=8, depth=3, step=0.4, row_share=1.0, bins=16) for parts in (1, 5)]
    assert all(a > b for a, b in zip(runs[0].losses, runs[0].losses[1:]))
    for a, b in zip(runs[0].rounds, runs[1].rounds):
        assert (a.feature == b.feature).all() and (a.bin == b.bin).all() and a.value == pytest.approx(b.value)
    scored = runs[0].score(frame(spark, data, 2), "x", "p").collect()
    most = np.bincount(data[1]).max() / len(data[1])
    assert np.mean([int(np.argmax(r["p"])) == r["y"] for r in scored]) > most + 0.2
    assert all(sum(r["p"]) == pytest.approx(1) for r in scored)


def test_draws_take_their_share_and_depend_on_the_round():
    keys = np.arange(20_000, dtype="uint64")
    first, second = boosting.drawn(keys, 1, 0.8), boosting.drawn(keys, 2, 0.8)
    assert abs(first.mean() - 0.8) < 0.02 and abs((first & second).mean() - 0.64) < 0.02


def test_missing_and_constant_features(spark):
    rows = [(k, [float("nan") if k % 2 else 1.0, 5.0], k % 2) for k in range(60)]
    model = boosting.fit_boosted(spark.createDataFrame(rows, "id long, x array<double>, y int"), "x", 2, "y", 2, ["id"], rounds=4, depth=2, row_share=1.0, column_share=1.0, bins=4)
    p = model.batch(np.array([[np.nan, 5.0], [1.0, 5.0]]))
    assert p[0, 1] > 0.5 > p[1, 1]


def test_a_round_computes_its_gradients_once(spark, data):
    x, y, w = data
    model = boosting.BoostedModel(boosting.bin_edges(frame(spark, data, 2), "x", 4, 8), 3)
    blocks = boosting._packed(frame(spark, data, 2), "x", "y", "w", ["id"], model)
    last = boosting.Trees.empty(3, 2)
    last.value[1, 0] = 30.0
    row = boosting._begun(blocks, last, 4, 3, 5, 0.5).collect()
    g = np.concatenate([np.frombuffer(r["g"], "float64").reshape(3, -1) for r in row], axis=1)
    margin = np.concatenate([np.frombuffer(r["margin"], "float64").reshape(-1, 3) for r in row])
    label, weight = (np.concatenate([np.frombuffer(r[n], t) for r in row]) for n, t in (("label", "int32"), ("weight", "float64")))
    use = np.concatenate([boosting.drawn(np.frombuffer(r["key"], "uint64"), 5, 0.5) for r in row])
    assert (margin == [0.0, 30.0, 0.0]).all() and 200 < use.sum() < 400
    expected = boosting.gradients(margin, label, weight)[0]
    assert (g.T == expected * use[:, None]).all()
    # a sure and wrong margin: gradients without curvature count
    begun = boosting._begun(blocks, last, 4, 3, 5, 0.5)
    trees = boosting.Trees.empty(3, 2)
    sums = [boosting._level_sums(begun, tasks, trees, 0, 4, 8) for tasks in (1, 1000)]
    assert sums[0][0][0, 0][0][0].sum() * boosting.UNIT == (expected * use[:, None])[:, 0].sum()
    assert sums[0][1] == pytest.approx(sums[1][1])
    for key, (a, b) in sums[0][0].items():
        assert (a == sums[1][0][key][0]).all() and (b == sums[1][0][key][1]).all()
