import random

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from reviewlab.llm import lines, passages
from reviewlab.llm import simhash as S
from reviewlab.llm.components import components
from reviewlab.llm.queries import QUERIES


def slow_simhash(text, words=4):
    toks = [w for w in (text or "").translate({i: i + 32 for i in range(65, 91)})
            .translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    sh = [" ".join(toks[i:i + words]) for i in range(max(1, len(toks) - words + 1))] if toks else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute(ids, fps, bits=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    u = sorted(set(fps))
    for i, a in enumerate(u):
        for b in u[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, f in zip(ids, fps):
        r = find(f)
        least[r] = min(i, least.get(r, i))
    return {i: least[find(f)] for i, f in zip(ids, fps)}


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One two", "a b c d", "A É b c d e", "x " * 300, "word%d " * 3])
def test_fingerprint_definition(text):
    got = S.simhash(None if text is None else text.encode())
    assert got & (2**64 - 1) == slow_simhash(text)


def test_fingerprint_blocks(monkeypatch):
    text = " ".join(str(i * i % 97) for i in range(1000))
    monkeypatch.setattr(S, "SHINGLES_AT_ONCE", 300)
    assert S.simhash(text.encode()) & (2**64 - 1) == slow_simhash(text)


@pytest.mark.parametrize("bits", range(0, 9))
def test_segments_cover(bits):
    seg = S.segments(bits)
    assert sum(w for _, w, _ in seg) == 64
    assert sum(2 if wild else 1 for *_, wild in seg) == bits + 1


@pytest.mark.parametrize("bits,limit", [(4, 128), (4, 1), (3, 2), (5, 1), (0, 1)])
def test_links_connect_like_all_pairs(spark, monkeypatch, bits, limit):
    monkeypatch.setattr(S, "PAIRWISE", limit)
    rnd = random.Random(bits)
    fps = []
    for _ in range(12):
        f = rnd.getrandbits(64)
        for _ in range(6):
            fps.append(f)
            for _ in range(rnd.randint(0, 4)):
                f ^= 1 << rnd.randrange(64)
    fps = [f - (1 << 64) if f >> 63 else f for f in set(fps)]
    want = brute(fps, [f & (2**64 - 1) for f in fps], bits)
    groups = S.near_groups(spark.createDataFrame([(f, f) for f in fps], "doc_id long, fp long"), max_bits=bits)
    assert {r.fp: r.component_id for r in groups.collect()} == want


def test_rows_nulls_ties_extra_columns(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, " ", None), (4, "a b c d e", "p"), (4, "a b c d e", "p"), (None, "A B C D E", "q"), (9, "zz yy", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = S.near_duplicates(docs).select("doc_id", "near.*").collect()
    assert len(got) == len(rows)
    assert sorted((r.component_id for r in got)) == [1, 1, 1, 4, 4, 4, 9]
    left = S.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 4, 9]
    assert S.one_of_each(docs.where("doc_id = -1")).count() == 0


def test_components_chain_and_empty(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}
    assert components(edges.where("u < 0")).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    fps = [slow_simhash(t) for _, t in rows]
    want = brute([i for i, _ in rows], fps)
    got = QUERIES["op1_simhash_dedup"](spark, sf).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for (i, _), f in zip(rows, fps)}


def test_no_join_sends_a_table_that_grows_to_the_driver(spark):
    """However small the planner takes it for: exploded signatures are sized like their fingerprints."""
    docs = spark.createDataFrame([(i, f"a line of some words {i % 7}\nand another one {i}") for i in range(40)], "doc_id long, text string")
    fps = spark.createDataFrame([(i * 7919,) for i in range(40)], "fp long")
    found = [S.links(fps), S.near_groups(fps.withColumn("doc_id", F.col("fp"))), S.near_duplicates(docs), lines.line_report(docs), lines.without_repeated_lines(docs),
             passages.passage_report(docs), passages.without_repeated_passages(docs)]
    for df in found:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        df.collect()
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
