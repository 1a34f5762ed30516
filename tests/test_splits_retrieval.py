import hashlib
import re
import time

import numpy as np
from pyspark.sql import functions as F

from reviewlab.operators import retrieval as RT
from reviewlab.operators import splits as SP
from reviewlab.operators.inference import softmax
from reviewlab.sources import tables as S

SF = "/root/testdata/sf0.001"


def test_folds_disjoint_and_stratified(spark):
    rev = S.scan_reviews(spark, SF)
    f = SP.stratified_folds(rev.select("doc_id", "label")).collect()
    assert len({r["doc_id"] for r in f}) == len(f) == rev.count()
    for lab in (0, 1):
        sizes = [sum(1 for r in f if r["label"] == lab and r["fold"] == k) for k in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_ranks_and_ids_are_dense_on_many_rows(spark):
    """With a payload column and a small range sample, as both branches must agree on the ranges."""
    spark.conf.set("spark.sql.execution.rangeExchange.sampleSizePerPartition", "2")
    try:
        n = 500_000
        df = (spark.range(n, numPartitions=16).select((F.col("id") * 7 - 1000).alias("doc_id"), (F.col("id") % 7 == 0).cast("int").alias("label"))
              .withColumn("payload", F.md5(F.col("doc_id").cast("string"))))
        ids = S.assign_row_id(df, "doc_id", "row_id")
        assert ids.agg(F.count_distinct("row_id"), F.min("row_id"), F.max("row_id")).first()[:] == (n, 0, n - 1)
        assert ids.where(F.col("doc_id") != F.col("row_id") * 7 - 1000).count() == 0
        folds = SP.stratified_folds(df).groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n")).collect()
        for lab in (0, 1):
            sizes = [r["n"] for r in folds if r["label"] == lab]
            assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
        ranks = SP.rank_within(df.withColumn("d", SP.draw("x")), ["label"], "d", ["doc_id"], "r")
        for r in ranks.groupBy("label").agg(F.count_distinct("r").alias("k"), F.max("r").alias("m"), F.count(F.lit(1)).alias("n")).collect():
            assert r["k"] == r["n"] == r["m"] + 1
    finally:
        spark.conf.unset("spark.sql.execution.rangeExchange.sampleSizePerPartition")


def test_row_ids_of_strings_nulls_and_no_rows(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("ü",), ("z",)], "k string")
    assert {r["k"]: r["row_id"] for r in S.assign_row_id(df, "k").collect()} == {None: 0, "a": 1, "b": 2, "z": 3, "ü": 4}
    assert S.assign_row_id(df.where("k = 'none'"), "k").count() == 0


def test_chunks_rebuild_text(spark):
    docs = S.load(spark, SF, "documents").select("doc_id", "text")
    ch = RT.chunk_documents(docs).collect()
    by = {}
    for r in ch:
        by.setdefault(r["doc_id"], []).append(r)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for d, rows in by.items():
        rows.sort(key=lambda r: r["chunk_no"])
        rebuilt = "".join(r["text"][: 800] if i < len(rows) - 1 else r["text"] for i, r in enumerate(rows))
        assert rebuilt == texts[d]
        assert all(len(r["text"]) <= 1000 for r in rows)


def test_softmax_sums_to_one(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([0.0, 0.0, 0.0],), ([1000.0, -1000.0, 0.0],)], "x array<double>")
    for r in df.select(softmax(F.col("x")).alias("p")).collect():
        assert abs(sum(r["p"]) - 1.0) < 1e-12


def test_blocked_top_k_equals_brute_force(spark, monkeypatch):
    e = S.load(spark, SF, "embeddings").repartition(3)
    monkeypatch.setattr(RT, "QUESTION_BLOCK", 64)
    monkeypatch.setattr(RT, "CHUNK_BLOCK", 50)
    got = RT.top_k_self(e).collect()
    rows = e.orderBy("vec_id").collect()
    ids = np.array([r["vec_id"] for r in rows])
    X = np.array([r["embedding"] for r in rows], dtype=np.float64)
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    S_ = X @ X.T
    np.fill_diagonal(S_, -np.inf)
    want = {}
    for i, q in enumerate(ids):
        order = sorted(range(len(ids)), key=lambda j: (-S_[i, j], ids[j]))[:3]
        want[int(q)] = [int(ids[j]) for j in order]
    have = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        have.setdefault(r["query_id"], []).append(r["vec_id"])
    assert have == want


def test_assign_row_id_dense_in_key_order(spark):
    df = spark.range(0, 5000, 3).select(F.col("id").alias("doc_id"))
    rows = sorted(S.assign_row_id(df, "doc_id", "row_id").collect(), key=lambda r: r["doc_id"])
    assert [r["row_id"] for r in rows] == list(range(len(rows)))


def test_recursive_chunks_bounded_and_cover_words(spark):
    docs = S.load(spark, SF, "documents").select("doc_id", "text")
    ch = RT.chunk_documents_recursive(docs).collect()
    assert all(len(r["text"]) <= 1000 for r in ch)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    words = {}
    for r in ch:
        words.setdefault(r["doc_id"], set()).update(r["text"].split())
    for d, t in texts.items():
        if t and t.strip():
            assert set(t.split()) <= words[d]


def test_holdout_shares_per_class_and_seed(spark):
    rev = S.scan_reviews(spark, SF).select("doc_id", "label")
    h = SP.stratified_holdout(rev, seeds=range(3)).collect()
    for s in range(3):
        for lab in (0, 1):
            rows = [r for r in h if r["seed"] == s and r["label"] == lab]
            n_val = sum(r["role"] == "validation" for r in rows)
            assert n_val == (len(rows) + 4) // 5          # every fifth row of the class, rounded up


def test_candidate_draws_stay_in_range(spark):
    from reviewlab.operators.selection import draw_candidates
    space = {"C": ("uniform", 0.1, 100.1), "g": ("loguniform", 1e-4, 1e-1), "d": ("int", 3, 9),
             "k": ("choice", ["linear", "rbf"])}
    rows = draw_candidates(spark, 50, space, 42).collect()
    assert len({r["candidate_id"] for r in rows}) == 50
    assert all(0.1 <= r["C"] <= 100.1 and 1e-4 <= r["g"] <= 1e-1 and 3 <= r["d"] <= 9 and r["k"] in ("linear", "rbf")
               for r in rows)
    again = draw_candidates(spark, 50, space, 42).collect()
    assert [tuple(r) for r in rows] == [tuple(r) for r in again]


def slow_chunks(text, size=60, overlap=15):
    """The chunking rule in plain Python."""
    def split(t, seps):
        if len(t) <= size:
            return [t]
        if not seps:
            return [t[i:i + size] for i in range(0, len(t), size)]
        parts = t.split(seps[0])
        out = []
        for i, p in enumerate(parts):
            p += seps[0] if i < len(parts) - 1 else ""
            out += split(p, seps[1:]) if len(p) > size else [p] if p else []
        return out
    chunks, cur = [], []
    for piece in split(text, ["\n\n", "\n", " "]):
        if cur and sum(map(len, cur)) + len(piece) > size:
            chunks.append("".join(cur).strip())
            tail = []
            for q in reversed(cur):
                if sum(map(len, tail)) + len(q) > overlap or sum(map(len, tail)) + len(q) + len(piece) > size:
                    break
                tail.insert(0, q)
            cur = tail
        cur.append(piece)
    return [c for c in [*chunks, "".join(cur).strip()] if c]


def test_recursive_chunks_by_the_plain_rule(spark):
    texts = ["", " ", "short", "one two three " * 20, "para one is here\n\npara two\nwith a line\n\n" * 6, "x" * 200, "word " + "y" * 130 + " end\n" * 3,
             "\n\n\n\n", "a\n" * 90]
    docs = spark.createDataFrame([(i, t, "m%d" % i) for i, t in enumerate(texts)] + [(99, None, "m")], "doc_id long, text string, meta string")
    got = {}
    for r in RT.chunk_documents_recursive(docs, size=60, overlap=15, carry=("meta",)).orderBy("doc_id", "chunk_no").collect():
        assert r["meta"] == "m%d" % r["doc_id"]
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {i: slow_chunks(t) for i, t in enumerate(texts) if slow_chunks(t)}


def test_recursive_chunks_grow_no_arrays_in_the_plan_and_are_trimmed_as_the_engine_does(spark):
    ends = ["\x85", "\u2028", " \x85", " \x85 ", "\n\u2029", "\u2029\n", "\xa0 ", "\r\n", "\x1c ", " \u2028\x85"]
    texts = [x + "a b" + y for x in ["", " \t", "\x85 ", "\x0b\x0c"] for y in ends] + ends
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    chunks = RT.chunk_documents_recursive(docs)
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "MapInArrow" in plan
    want = docs.select("doc_id", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text")).where("text <> ''")
    assert {(r.doc_id, r.text) for r in chunks.collect()} == {(r.doc_id, r.text) for r in want.collect()}


def test_long_text_is_packed_in_one_pass():
    text = "word " * 400_000
    began = time.process_time()
    chunks = RT._chunks_of(text, 1000, 100)
    assert time.process_time() - began < 20
    assert all(len(c) <= 1000 for c in chunks) and chunks[1].startswith("word word")


def test_embedding_hashes_each_distinct_word_once(spark):
    texts = ["the cat sat on The mat", "été naïve été", "", "  1 2 3", "a" * 300 + " b", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    out = RT.embed(df)
    assert "md5(" not in out._jdf.queryExecution().optimizedPlan().toString()
    codes = RT.WordCodes(64)
    for r in out.collect():
        v = np.zeros(64)
        for w in re.findall(r"[^\W\d_]+", (texts[r.i] or "").lower()):
            h, g = (int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in (w, "s:" + w))
            v[h % 64] += 1 if g % 2 == 0 else -1
            assert codes[w] == (h % 64 + 1) * (1 if g % 2 == 0 else -1)
        assert np.allclose(r.embedding, v / (np.linalg.norm(v) or 1))


def test_best_scores_are_those_of_a_whole_sort():
    rng = np.random.default_rng(3)
    for cols in (3, 200, 1000, 4097):
        S = rng.integers(0, 40, (50, cols)) / 8.0
        S[:, ::7] = -np.inf
        S[7] = -np.inf
        for odd in (False, True):
            if odd:
                S[3, 1] = S[5, :] = np.nan
            n = min(5, cols)
            least = np.sort(S, axis=1)[:, cols - n]
            want = np.nonzero((S >= least[:, None]) & (S > -np.inf))
            got = RT._best(S, 5)
            assert all((a == b).all() for a, b in zip(got, want))
