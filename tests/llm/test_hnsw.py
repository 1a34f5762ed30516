import duckdb
import numpy as np
import pytest

from reviewlab.llm import hnsw as H
from reviewlab.llm.queries import QUERIES


def clustered(seed, n, dim=16, groups=12, noise=0.08):
    rnd = np.random.default_rng(seed)
    centre = H.unit(rnd.normal(size=(groups, dim)))
    x = centre[rnd.integers(0, groups, n)] + noise * rnd.normal(size=(n, dim))
    x[n // 2:] = rnd.normal(size=(n - n // 2, dim))
    return x.astype(np.float32)


def brute(ids, x, labels, threshold=0.93):
    u = H.unit(x)
    near = (u @ u.T >= threshold) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(near, False)
    root = np.arange(len(ids))
    i, j = np.nonzero(near)
    rank = np.argsort(np.argsort(ids))
    parent = np.arange(len(ids))
    H.unite(parent, rank[i], rank[j])
    while not np.array_equal(parent[parent], parent):
        parent = parent[parent]
    least = np.sort(ids)[parent[rank]]
    return {int(a): (int(n), int(c)) for a, n, c in zip(ids, near.sum(axis=1), least)}, root


def test_graph_finds_neighbours():
    x = H.unit(clustered(3, 3000, 32))
    g = H.Graph(x)
    for table in g.layers:
        assert table.max() < len(x) and not (table == np.arange(len(x))[:, None]).any()
    ids, _ = g.nearest(x[:200].astype(np.float32), 64)
    true = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b[:32])) / 10 for a, b in zip(true.tolist(), ids.tolist())]) > 0.95


def test_search_widens_to_all_links():
    x = H.unit(clustered(4, 1500, 16, groups=2, noise=0.03))
    s = H.Search(H.Graph(x), x, 0.93)
    s.audit(x)
    i, _ = s.links(x)
    true = (x @ x.T >= 0.93).sum()
    assert len(i) >= 0.99 * true and len(i) <= true


@pytest.mark.parametrize("within", [True, False])
def test_audit_of_few_links(within):
    rnd = np.random.default_rng(7)
    x = H.unit(rnd.normal(size=(3000, 16)))
    q = x.copy() if within else H.unit(rnd.normal(size=(3000, 16)))
    pairs = rnd.permutation(3000)[:40].reshape(-1, 2)
    for a, b in pairs:
        q[b] = x[a] + 0.01 * rnd.normal(size=16)
        if within:
            x[b] = q[b] = H.unit(q[b:b + 1])[0]
    q = H.unit(q)

    class Blind:
        """Meets no vector but the query itself."""
        def nearest(self, some, beam):
            ids, sims = np.full((len(some), beam), -1), np.full((len(some), beam), -2.0)
            if within:
                ids[:, 0], sims[:, 0] = (some @ x.T.astype(np.float32)).argmax(axis=1), 1
            return ids, sims

    s = H.Search(Blind(), x, 0.97)
    s.audit(q, *[True] * within)
    i, j = s.links(q)
    found = set(zip(i.tolist(), j.tolist()))
    assert all((b, a) in found for a, b in pairs.tolist())


@pytest.mark.parametrize("shard", [16_384, 60])
def test_rows_and_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(H, "SHARD", shard)
    n = 300
    x = clustered(5, n)
    x[10] = x[11] = x[12]  # equal vectors
    labels = [i % 2 for i in range(n)]
    rows = [(i * 7 % 1000, [float(v) for v in x[i]], labels[i], "kept") for i in range(n)]
    odd = [(5001, None, 0, ""), (5002, [0.0] * 16, 0, ""), (5003, [float("nan")] * 16, 0, ""), (5004, rows[0][1], None, ""), (5005, [None] + rows[0][1][1:], 0, ""),
           (5006, [], 0, ""), (None, rows[0][1], 0, ""), (5007, [1.0, 0.0], 0, ""), (5008, [float("inf")] + [1.0] * 15, 1, "")]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, n_links string")
    got = H.near_vectors(vectors).collect()
    assert len(got) == n + len(odd)
    want, _ = brute(np.array([r[0] for r in rows]), x, labels)
    by = {r.vec_id: r for r in got}
    for key, (links, least) in want.items():
        assert (by[key].n_links, by[key].component_id, by[key].kept) == (links, least, key == least)
    for r in odd:
        assert by[r[0]].n_links == 0 and by[r[0]].component_id == r[0] and by[r[0]].kept
    if shard > 60:
        assert H.near_vectors(vectors.where("vec_id < 0")).count() == 0


def test_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    t = duckdb.sql(f"select vec_id, embedding, label from '{sf}/embeddings.parquet'").fetchall()
    want, _ = brute(np.array([r[0] for r in t]), np.array([r[1] for r in t], np.float32), [r[2] for r in t])
    got = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op7_embedding_dedup"](spark, sf).collect()}
    assert got == want
