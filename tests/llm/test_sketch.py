import hashlib
import random
import re
import struct

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from reviewlab.llm import sketch as S
from reviewlab.llm.queries import QUERIES


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def shingles(text, words=5):
    toks = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", (text or "").lower()) if w]
    hs = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in toks]
    out = set()
    for i in range(max(1, len(hs) - words + 1) if hs else 0):
        h = 42
        for x in hs[i:i + words]:
            h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
        out.add(signed(h))
    return out


def likeness(a, b, k):
    u = sorted(a | b)[:k]
    return len(set(u) & a & b) / len(u) if u else 1.0


def test_sketch_merge_and_estimates(spark):
    rnd = random.Random(3)
    words = ["w%d" % i for i in range(4000)]
    a = [rnd.choice(words) for _ in range(3000)]
    b = a[1000:] + [rnd.choice(words) for _ in range(1500)]
    rows = [(1, " ".join(a), " ".join(b)), (2, "", None), (3, "One two", "one  two"), (4, "a b c d e f", "a b c d e"), (5, None, "x y"), (6, " \n", "")]
    df = spark.createDataFrame(rows, "id long, a string, b string").select("id", "a", "b", S.sketch(F.col("a")).alias("sa"), S.sketch(F.col("b")).alias("sb"))
    got = df.select("id", "sa", "sb", S.merge(F.col("sa"), F.col("sb")).alias("m"), S.resemblance(F.col("sa"), F.col("sb")).alias("r"),
                    S.containment(F.col("sa"), F.col("sb")).alias("c"), S.distinct_shingles(F.col("sa")).alias("n")).collect()
    for row, (_, x, y) in zip(sorted(got), rows):
        p, q = shingles(x), shingles(y)
        assert row.sa == sorted(p)[:S.K] and row.sb == sorted(q)[:S.K] and row.m == sorted(p | q)[:S.K]
        assert row.r == likeness(p, q, S.K)
        assert row.r == pytest.approx(len(p & q) / max(1, len(p | q)) if p | q else 1, abs=0.15)
        assert row.c == pytest.approx(len(p & q) / len(p) if p else 1, abs=0.2)
        assert row.n == pytest.approx(len(p), rel=0.3)
    parts = df.select("id", F.col("sa").alias("sketch")).unionAll(df.select("id", "sb")).unionAll(df.select("id", "sa"))
    assert {r.id: r.sketch for r in S.merge_parts(parts, ["id"]).collect()} == {r.id: r.m for r in got}


def check(rows, got):
    """rows in descending order of key, as the definition orders them."""
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, (key, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(text) // 3
        edited = text[:len(text) - n] + after[:n]
        r = by[key]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == likeness(shingles(text), shingles(edited), S.K)
        assert r.near_next == likeness(shingles(text), shingles(after), S.K)
        assert r.fingerprint == ",".join(map(str, sorted(shingles(text))[:S.K]))


def run(docs):
    return S.fingerprints(docs).select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                                       S.written_out(F.col("sketch")).alias("fingerprint"), "near_edited", "near_next")


def test_fixture_and_plan(spark):
    rows = [(9, "é" * 10), (7, None), (5, "a b c d e f g h"), (3, ""), (1, "one two three four five six seven"), (-4, "😀 x y z w")]
    docs = spark.createDataFrame([(k, t, "b", 1) for k, t in rows], "doc_id long, text string, b string, k int")
    df = run(docs)
    check(rows, df.collect())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
    check(rows[:1], run(docs.where("doc_id = 9")).collect())
    assert run(docs.where("doc_id = 99")).count() == 0
    twice = run(docs.where("doc_id = 5").unionAll(docs.where("doc_id = 5")).unionAll(spark.createDataFrame([(None, "n", "", 0)], docs.schema)))
    assert sorted((r.doc_id is None, r.near_next) for r in twice.collect()) == [(False, 0.0), (False, 1.0), (True, 0.0)]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' order by doc_id desc").fetchall()
    check(rows, QUERIES["op9_document_fingerprints"](spark, sf).collect())
