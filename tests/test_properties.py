import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewlab.operators import bayes as NB
from reviewlab.operators import retrieval as RT
from reviewlab.operators import text as TXT
from reviewlab.plans.oracle import stem_table
from reviewlab.sources import tables as S

SF = "/root/testdata/sf0.001"
SUFFIXES = ["", "s", "es", "ies", "ed", "ing", "eed", "ational", "ization", "fulness", "iveness", "ement",
            "ance", "ously", "ly", "y", "e", "ll", "at", "bl", "iz", "icate", "ness", "ion", "ical", "er"]
words = st.builds(lambda stem, sfx: stem + sfx,
                  st.text(alphabet="aeiouybcdlmnrstvzéü", min_size=1, max_size=9), st.sampled_from(SUFFIXES))


@settings(max_examples=3, deadline=None)
@given(st.lists(words, min_size=40, max_size=80, unique=True))
def test_stemmer_spark_equals_duckdb(spark, ws):
    got = {r["word"]: r["stem"] for r in TXT.stem(spark.createDataFrame([(w,) for w in ws], "word string"),
                                                   "word", "stem").collect()}
    vals = ", ".join("('" + w + "')" for w in ws)
    dk = dict(duckdb.connect().execute(f"SELECT o, stem FROM ({stem_table(f'SELECT w FROM (VALUES {vals}) t(w)')})").fetchall())
    assert got == dk


def test_nb_score_is_additive(spark):
    docs = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, label int")
    toks = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (2, 0, "b"), (2, 0, "c"), (3, 1, "a")],
                                 "doc_id long, label int, token string")
    model = NB.nb_train(docs, toks)
    w = {r["token"]: r["loglikelihood"] for r in model.collect()}
    prior = model.first()["logprior"]
    test = spark.createDataFrame([(9, 1)], "doc_id long, label int")
    tt = spark.createDataFrame([(9, "a"), (9, "c"), (9, "a"), (9, "zzz")], "doc_id long, token string")
    s = NB.nb_predict(test, tt, model).first()["score"]
    assert abs(s - (prior + 2 * w["a"] + w["c"])) < 1e-12


def test_one_class_training_prior_is_infinite(spark):
    docs = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, label int")
    toks = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "doc_id long, label int, token string")
    m = NB.nb_train(docs, toks).first()
    assert m["logprior"] == float("inf")


def test_approx_top_k_recall_and_whole_results(spark, tmp_path):
    e = S.load(spark, SF, "embeddings")
    index, cells = RT.build_index(e, str(tmp_path / "index"))
    q = e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r["query_id"], r["vec_id"]) for r in RT.top_k_self(e, e.where("vec_id % 5 = 0")).collect()}
    found = RT.top_k_approx(q, index, cells).collect()
    assert len(found) == 3 * q.count() == len({(r["query_id"], r["rank"]) for r in found})
    recall = sum((r["query_id"], r["vec_id"]) in exact for r in found) / len(exact)
    assert recall >= 0.9
    tiny = e.orderBy("vec_id").limit(5)
    index, cells = RT.build_index(tiny, str(tmp_path / "tiny"))
    few = RT.top_k_approx(tiny.select(F.col("vec_id").alias("query_id"), "embedding"), index, cells, probes=1).collect()
    assert len(few) == 15        # questions whose cells hold too few are answered from the whole index


def test_approx_top_k_recall_with_many_cells(spark, tmp_path):
    import numpy as np
    x = np.random.default_rng(4).normal(size=(600, 16))
    e = spark.createDataFrame([(i, v.tolist(), i % 24) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    index, cells = RT.build_index(e, str(tmp_path / "many"))
    asked = e.where("vec_id % 10 = 0")
    exact = {(r["query_id"], r["vec_id"]) for r in RT.top_k_self(e, asked).collect()}
    found = RT.top_k_approx(asked.select(F.col("vec_id").alias("query_id"), "embedding"), index, cells).collect()
    assert sum((r["query_id"], r["vec_id"]) in exact for r in found) >= 0.9 * len(exact)
