import math

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from reviewlab.llm import negatives as H
from reviewlab.llm.queries import ORACLE, QUERIES


def expected(rows):
    """rows: (vec_id, vector, label), every pair compared."""
    kept = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        one = (i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v))
        if one not in kept:
            kept.append(one)
    out = []
    for a in kept:
        if a[0] % 100:
            continue
        others = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in kept if b != a and len(b[2]) == len(a[2]))
        for p, pid, _ in [o for o in others if o[2] == a[1]][:5]:
            fit = [o for o in others if o[2] != a[1] and 30 * -p <= 100 * -o[0] <= 90 * -p][:10]
            out += [(a[0], pid, n + 1, o[1], -p, -o[0]) for n, o in enumerate(fit)]
    return sorted(out)


def table(rows, path):
    pq.write_table(pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())),
                             "label": pa.array([r[2] for r in rows], pa.int32())}), path)


def vectors(seed=1, n=700, dim=8):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, dim))
    rows = []
    for i in range(n):
        v = centre[i % 6] + 0.4 * rng.normal(size=dim)
        rows.append((i, [float(x) for x in np.round(v / np.linalg.norm(v), 2)], int(rng.integers(0, 4))))  # rounded: many ties
    return rows


def test_against_all_pairs_and_sql(spark, tmp_path, monkeypatch):
    for name, value in (("SHARD", 60), ("BLOCK", 2), ("STRIDE", 16), ("PER_CENTRE", 2)):
        monkeypatch.setattr(H, name, value)
    rows = vectors()
    rows += [(900, rows[0][1], None), (1000, None, 1), (1001, [0.1] * 7 + [None], 1), (1002, [0.1] * 7 + [float("nan")], 1), (1003, [float("inf")] * 8, 1),
             (None, rows[3][1], 2), (1100, [0.0] * 8, 1), (1101, [0.0] * 8, 2), (1102, [0.0] * 8, 1), (1200, [], 1), (1201, [], 2), (1202, [], 1),
             (1300, [1.0, 0.0], 3), (1301, [0.9, 0.3], 3), (1302, [0.5, 0.3], 1)]
    rows += rows[100:140] + [(5000 + i, rows[200][1], 2) for i in range(30)] + [(200, rows[17][1], 3)]
    table(rows, tmp_path / "embeddings.parquet")
    got = sorted(tuple(r) for r in QUERIES["op12_hard_negatives"](spark, str(tmp_path)).collect())
    assert got == expected(rows) and len(got) > 200
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    assert sorted(con.execute(ORACLE["op12_hard_negatives"]).fetchall()) == got


def test_walk_is_certified_and_stops_early():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(40, 16))
    x = np.floor(256 * H.unit(np.repeat(centre, 250, axis=0) + 0.15 * rng.normal(size=(10_000, 16)))).astype(np.int64)
    ids = rng.permutation(len(x))
    a = x[:50]
    full = a @ x.T
    for low, high in ((H.LEAST + 1, 1 << 40), (20_000, 50_000)):
        of = np.arange(50)
        wish, cand, score, seen = H.walk(a, x, ids, lambda i, j: np.ones((len(i), len(j)), bool), of, np.full(50, low), np.full(50, high), 7)
        for i in range(50):
            want = [c for c in np.lexsort((ids, -full[i])) if low <= full[i, c] <= high][:7]
            assert cand[wish == i].tolist() == want and score[wish == i].tolist() == full[i, want].tolist()
        assert seen < 0.5 * full.size


def test_large_components_are_exact():
    a = np.array([[2 ** 30, 3, -5]])
    x = np.array([[2 ** 30, 1, 1], [2 ** 30, 1, 0]])
    assert H.scores_of(a, x).tolist() == [[2 ** 60 - 2, 2 ** 60 + 3]]


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 0.5], 1), (2, [0.5, 0.1], 2)], [(100, [0.5], 1)]])
def test_nothing_to_find(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("mark", H.F.lit(1)).withColumn("v", H.F.lit("x"))
    assert H.hard_negatives(df, H.F.col("vec_id") % 100 == 0).collect() == []
