import math
import random

import pytest

from reviewlab.operators import eda as E


def rows(spark, n=300):
    rnd = random.Random(4)
    return spark.createDataFrame([(i, i % 2, rnd.gauss(i % 2, 1.0), rnd.random()) for i in range(n)], "doc_id long, label int, a double, b double")


def test_bootstrap_interval_is_that_of_the_mean(spark):
    df = rows(spark)
    got = {(r.label, r.metric): r for r in E.submean_by_label(df, ["a", "b"]).collect()}
    assert len(got) == 4
    for r in got.values():
        half = 1.96 * r.std / math.sqrt(r.n)
        assert r.ci_low == pytest.approx(r["mean"] - half, abs=0.25 * half) and r.ci_high == pytest.approx(r["mean"] + half, abs=0.25 * half)
    again = {(r.label, r.metric): r for r in E.submean_by_label(df.repartition(7), ["a", "b"]).collect()}
    assert all(again[k].ci_low == pytest.approx(r.ci_low) for k, r in got.items())


def test_bootstrap_of_nulls_and_single_rows(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (2, 1, None), (3, 1, None), (4, None, 5.0)], "doc_id long, label int, a double")
    got = {r.label: r for r in E.mean_by_label(df, "a").collect()}
    assert (got[0].ci_low, got[0].ci_high, got[0].n) == (2.0, 2.0, 1) and got[None].ci_low == 5.0
    assert (got[1]["mean"], got[1].ci_low, got[1].n) == (None, None, 0)
    assert E.mean_by_label(df.limit(0), "a").collect() == []


def test_density_follows_the_kernel_and_has_area_one(spark):
    df = rows(spark)
    curves = {}
    for r in E.density_curves(df, ["a", "b"]).orderBy("point").collect():
        curves.setdefault((r.label, r.metric), []).append((r.x, r.density))
    assert len(curves) == 4 and all(len(c) == E.GRID for c in curves.values())
    own = [r.a for r in df.where("label = 1").collect()]
    mean = sum(own) / len(own)
    width = math.sqrt(sum((x - mean) ** 2 for x in own) / (len(own) - 1)) * len(own) ** -0.2
    for x, density in curves[1, "a"][::20]:
        exact = sum(math.exp(-0.5 * ((x - v) / width) ** 2) for v in own) / (len(own) * width * math.sqrt(2 * math.pi))
        assert density == pytest.approx(exact, abs=2e-3)
    for c in curves.values():
        assert sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(c, c[1:])) == pytest.approx(1, abs=0.01)
    assert E.density_curves(df.limit(1), ["a"]).collect() == []
