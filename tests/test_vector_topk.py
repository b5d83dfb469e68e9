"""Nearest vectors and quota draws against plain computations, on both sides of their limits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbtrace.operators import retrieval, splits


def table(spark, x, names):
    return spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, x)], "id string, v array<double>")


def plain(q, c, names, k, metric):
    s = np.round(retrieval.similarity(q, c, metric), 9)
    loss = s if metric == "l2" else -s
    return [[names[j] for j in sorted(range(len(c)), key=lambda j: (loss[i, j], names[j]))[:k]] for i in range(len(q))]


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_broadcast_and_grid_agree_with_plain_search(spark, monkeypatch, metric):
    rng = np.random.default_rng(4)
    c = rng.normal(size=(700, 6))
    c[100:160] = c[3]  # equal rows: ties go to the smaller key
    q = np.concatenate([rng.normal(size=(60, 6)), c[3:4]])
    names, asked = [f"c{k:04d}" for k in range(len(c))], [f"q{k:03d}" for k in range(len(q))]
    corpus, queries = table(spark, c, names).withColumnRenamed("id", "chunk"), table(spark, q, asked)
    corpus = corpus.unionByName(spark.createDataFrame([("none", None)], "chunk string, v array<double>"))
    expected = dict(zip(asked, plain(q, c, names, 4, metric)))

    def found():
        out = retrieval.vector_topk(queries, "id", "v", corpus, "chunk", "v", 4, metric).collect()
        got = {}
        for r in sorted(out, key=lambda r: r["rank"]):
            got.setdefault(r["id"], []).append(r["chunk"])
        return got

    assert found() == expected
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 8)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK_BYTES", 1000)
    monkeypatch.setattr(retrieval, "CORPUS_BLOCK_BYTES", 9000)
    assert found() == expected


def test_ten_and_five_thousand_queries_agree(spark):
    rng = np.random.default_rng(9)
    c, q = rng.normal(size=(300, 4)), rng.normal(size=(5000, 4))
    names = [f"c{k:03d}" for k in range(len(c))]
    corpus, many = table(spark, c, names).withColumnRenamed("id", "chunk"), table(spark, q, [f"q{k:04d}" for k in range(len(q))])
    few = many.where("id < 'q0010'")
    search = lambda x: {(r["id"], r["rank"], r["chunk"], r["score"]) for r in retrieval.vector_topk(x, "id", "v", corpus, "chunk", "v", 3, "dot").collect()}
    all_, some = search(many), search(few)
    assert len(all_) == 15_000 and some == {r for r in all_ if r[0] < "q0010"}


def test_no_queries_and_no_corpus_give_no_rows(spark):
    x = table(spark, np.ones((3, 2)), ["a", "b", "c"])
    for q, c in ((x.where("false"), x), (x, x.where("false"))):
        assert retrieval.vector_topk(q, "id", "v", c.withColumnRenamed("id", "chunk"), "chunk", "v").collect() == []


def test_draws_offer_a_query_to_every_engine(spark):
    # each query has both engines; quotas can only be filled if one engine's leftovers serve the other
    rows = spark.createDataFrame([(q, e, "all", q % 2) for q in range(4) for e in ("x", "y")], "q long, e string, cell string, level long")
    out = splits.quota_sample(rows, "q", "e", "cell", "level", {("all", "x"): 2, ("all", "y"): 2}, [0, 1], 1).collect()
    assert sorted(r["q"] for r in out) == [0, 1, 2, 3] and sorted(r["e"] for r in out) == ["x", "x", "y", "y"]


def test_impossible_quotas_differ_from_draws_that_were_not_found(spark):
    rows = spark.createDataFrame([(q, e, "all", 0) for q in range(3) for e in ("x", "y")], "q long, e string, cell string, level long")
    with pytest.raises(ValueError, match="no choice"):
        splits.quota_sample(rows, "q", "e", "cell", "level", {("all", "x"): 2, ("all", "y"): 2}, [0], 1)
    with pytest.raises(ValueError, match="though the quotas can be filled"):
        splits.quota_sample(rows, "q", "e", "cell", "level", {("all", "x"): 1, ("all", "y"): 2}, [0, 1], 1, seeds=20)
    assert splits.quotas_can_be_filled(rows, "q", "e", "cell", {("all", "x"): 1, ("all", "y"): 2})
    assert not splits.quotas_can_be_filled(rows.where(F.col("e") == "x"), "q", "e", "cell", {("all", "y"): 1})
