import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reviewlab.operators import vector_index as VI
from reviewlab.operators.retrieval import top_k


def table(spark, n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) + 1.5 * rng.normal(size=(20, dim))[np.arange(n) % 20]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def recall(spark, e, found, k):
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    true = {(r.query_id, r.vec_id) for r in top_k(q, e, k, "query_id", ("vec_id",), other_than_self=True).collect()}
    return len(true & {(r.query_id, r.vec_id) for r in found}) / len(true)


@pytest.mark.parametrize("cells", [10, 1000])
def test_recall_without_labels_and_share_of_codes_read(spark, cells, monkeypatch):
    monkeypatch.setattr(VI, "BLOCK", 500)
    e = table(spark, 4000)
    index = VI.build(e, cells=cells)
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = VI.search(q, index, 3).collect()
    assert len(found) == 600 and all(r.query_id != r.vec_id for r in found)
    assert recall(spark, e, found, 3) >= 0.9
    assert sum(len(r["keys"]) for r in index.blocks.collect()) == 4000  # every row is in the index
    few = VI.search(q, index, 3, probes=max(1, cells // 10)).collect()
    assert recall(spark, e, few, 3) >= 0.5


def test_vectors_read_are_few(spark):
    e = table(spark, 4000)
    index = VI.build(e, cells=32)
    q = e.where("vec_id = 40").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    assert VI.candidates(q, index, 32, VI.AGAIN * 3, True).count() == 60  # of 4,000, from all cells


def test_scores_from_tables_are_those_of_the_coded_rows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8))
    t = VI.Trained.of(x, 5)
    cell, codes = t.coded(VI._unit(x))
    rows = np.flatnonzero(cell == 2)
    back = t.cells[2] + np.concatenate([b[codes[rows, i]] for i, b in enumerate(t.books)], axis=1)
    q = rng.normal(size=(3, 8))
    assert t.scores(q, 2, codes[rows]) == pytest.approx(q @ back.T)
    assert np.abs(back - VI._unit(x)[rows]).mean() < 0.05


def test_empty_and_null_vectors(spark):
    e = table(spark, 30).unionAll(spark.createDataFrame([(100, None)], "vec_id long, embedding array<double>"))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = VI.search(q, VI.build(e), 3).collect()
    assert {r.query_id for r in found} == {0, 20} and len(found) == 6
    assert VI.search(q, VI.build(e.limit(0)), 3).collect() == []


def test_questions_are_copied_to_their_cells_in_bounded_pieces(monkeypatch):
    monkeypatch.setattr(VI, "COPIES", 10)
    rng = np.random.default_rng(2)
    for rows, cells in ((25, 3), (7, 10), (4, 33), (1, 1)):
        b = pd.DataFrame({"q": np.arange(rows), "v": list(rng.normal(size=(rows, 4)))})
        cell = np.stack([rng.permutation(50)[:cells] for _ in range(rows)])
        parts = list(VI.copies(b, cell))
        assert max(len(x) for x in parts) <= 10
        got = pd.concat(parts)
        assert sorted(zip(got["q"], got["cell"])) == sorted((i, c) for i in range(rows) for c in cell[i])
        assert all((v == b["v"][q]).all() for q, v in zip(got["q"], got["v"]))
