"""Blocks of cells: equal rows once, draws row by row."""

import numpy as np
import pytest

from plumbtrace.plans import boosting, cells


def table(spark, copies, parts):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(150, 3)), 1)
    y = (x[:, 0] > 0.2).astype(int) + (x[:, 1] * x[:, 2] > 0)
    rows = [(k * 150 + i, x[i].tolist(), int(y[i]), 1.0 + float(y[i])) for k in range(copies) for i in range(150)]
    return spark.createDataFrame(rows, "id long, x array<double>, y int, w double").repartition(parts), x, y


def test_rows_that_agree_are_one_cell_and_are_drawn_one_by_one(spark, monkeypatch):
    df, x, y = table(spark, 12, 5)
    model = boosting.BoostedModel(boosting.bin_edges(df, "x", 3, 8), 3)
    blocks = boosting._packed(df, "x", "y", "w", ["id"], model)
    kept = blocks.collect()
    distinct = len(np.unique(np.column_stack([model.binned(x), y]), axis=0))
    # a cell is cut at most where tasks meet
    assert distinct <= sum(len(b["label"]) for b in kept) <= distinct + len(kept) and sum(len(b["key"]) for b in kept) == 1800
    begun = boosting._begun(boosting._ahead(blocks, [6, 7], 0.5), None, 3, 3, 7, 0.5).collect()
    hashes = np.concatenate([b["key"] for b in kept])
    assert sum(int(b["taken"][1].sum()) for b in begun) == boosting.drawn(hashes, 7, 0.5).sum()
    assert sum(b["total"] for b in begun) == pytest.approx(12 * (1.0 + y).sum())
    whole = sum(b["g"].sum(1) for b in begun)
    one = boosting.gradients(np.zeros((1800, 3)), np.concatenate([np.repeat(b["label"], cells.cell_rows(b)) for b in kept]), np.concatenate([np.repeat(b["weight"], cells.cell_rows(b)) for b in kept]))[0]
    assert (whole == (one * boosting.drawn(hashes, 7, 0.5)[:, None]).sum(0)).all()


@pytest.mark.parametrize("every", [1, 4, 50])
def test_trees_do_not_depend_on_cells(spark, monkeypatch, every):
    df, _, _ = table(spark, 6, 3)
    fit = lambda: boosting.fit_boosted(df, "x", 3, "y", 3, ["id"], "w", rounds=6, depth=3, bins=8)
    model = fit()
    monkeypatch.setattr(boosting, "STORE_EVERY", every)
    monkeypatch.setattr(boosting, "CELLS", 10)
    again = fit()
    assert again.losses == pytest.approx(model.losses, rel=1e-12)
    for a, b in zip(model.rounds, again.rounds):
        assert (a.feature == b.feature).all() and (a.bin == b.bin).all() and (a.value == b.value).all()


def test_rows_without_a_label_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0], None, 1.0), (2, [2.0], 1, 1.0)], "id long, x array<double>, y int, w double")
    model = boosting.BoostedModel([np.array([1.5])], 2)
    with pytest.raises(Exception, match="can't be trained on"):
        boosting._packed(df, "x", "y", "w", ["id"], model).collect()
