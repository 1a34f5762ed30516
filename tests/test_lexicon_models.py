import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from reviewlab.functions import constants as K
from reviewlab.operators import classifiers as CL
from reviewlab.operators import inference as INF
from reviewlab.operators import lexicon as LX
from reviewlab.operators import text as TXT

# by hand, with a valence of 2.0 for "like" and -2.0 for "awful"
SENTENCES = {
    "I like it": [2.0],
    "I don't like it": [-1.48],
    "part of like": [2.0],
    "kind of like": [2.0 - 0.293],
    "not , , , like": [-1.48],
    "very like": [2.293],
    "it is VERY like that": [2.0 + 0.293 + 0.733],
    "I LIKE it": [2.733],
    "VERY LIKE": [2.293],
    "really , truly like": [2.0 + 0.293 * 0.95],
    "never so like": [(2.0 + 0.293) * -0.74],
    "not , never like": [2.0 * 0.74 * 0.74],
    "like but awful": [1.0, -3.0],
    "very awful": [-2.293],
    "not a thing here like": [2.0],
    "wouldn\u2019t like": [-1.48],
}


def test_context_by_hand(spark):
    docs = spark.createDataFrame(list(enumerate(SENTENCES)) + [(99, None), (98, " ... ")], "doc_id long, text string")
    words = LX.raw_words(docs)
    stems = words.select(F.col("low").alias("word"), F.col("low").alias("stem")).distinct()
    lexicon = spark.createDataFrame([("like", 2.0), ("awful", -2.0)], "token string, valence double")
    got = {}
    for r in LX.context_valences(words, stems, lexicon).where("valence <> 0").orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append(r["valence"])
    for i, (text, want) in enumerate(SENTENCES.items()):
        assert got[i] == pytest.approx(want, abs=1e-6), text
    assert 98 not in got and 99 not in got


def test_document_score_uses_the_context(spark):
    docs = spark.createDataFrame([(1, "I like it"), (2, "I don't like it"), (3, "nothing")], "doc_id long, text string")
    words = LX.raw_words(docs)
    stems = words.select(F.col("low").alias("word"), F.col("low").alias("stem")).distinct()
    lexicon = spark.createDataFrame([("like", 2.0)], "token string, valence double")
    got = {r["doc_id"]: r["compound"] for r in LX.lexicon_score(docs, LX.context_valences(words, stems, lexicon)).collect()}
    assert got[1] == pytest.approx(2 / (4 + 15) ** 0.5, abs=1e-4) and got[2] < 0 and got[3] == 0


def test_batch_model_limit_failures_and_extremes(spark):
    factory = INF.weighted_words_factory({"good": 1.0, "bad": -1.0, "huge": 1e4}, limit=3, scale=1.0)
    rows = [(1, "good"), (2, "a b c good"), (3, "bad bad"), (4, None), (5, "huge")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in INF.batch_score(docs, factory).collect()}
    assert got[1]["roberta_compound"] == pytest.approx(2.0) and got[2]["roberta_compound"] == 0 and got[4]["roberta_compound"] == 0
    assert got[3]["roberta_compound"] == pytest.approx(-2 * 2 / 2 ** 0.5) and got[5]["roberta_compound"] == pytest.approx(2e4)

    def failing():
        model = factory()

        def predict(texts):
            if any("bad" in t for t in texts):
                raise ValueError("no")
            return model(texts)
        return predict
    safe = {r["doc_id"]: r for r in INF.batch_score_safe(docs, failing).collect()}
    assert safe[3]["error"] == "ValueError: no" and safe[3]["roberta_pos"] is None
    assert all(safe[k]["error"] is None and safe[k]["roberta_pos"] == pytest.approx(got[k]["roberta_pos"]) for k in (1, 2, 4, 5))


def separable(spark, n=150):
    rnd = random.Random(7)
    rows = []
    for i in range(n):
        y = int(rnd.random() < 0.7)
        x = [rnd.random() + (0.9 if y else 0.0), rnd.random(), rnd.random()]
        rows.append((i, y, i % 3, Vectors.dense(x)))
    return spark.createDataFrame(rows, ["doc_id", "label", "fold", "features"]).select("doc_id", F.col("label").cast("int"), F.col("fold").cast("int"), "features"), sum(r[1] for r in rows) / n


def test_families_beat_the_majority_and_candidates_differ(spark):
    data, majority = separable(spark)
    data = data.cache()
    gbt = spark.createDataFrame([(0, 5, 3, 0.3, 1.0, 1.0, 1, 0.5), (1, 5, 3, 0.3, 1.0, 1.0, 1, 1e6)],
                                "candidate_id int, n_estimators int, max_depth int, learning_rate double, subsample double, "
                                "colsample_bytree double, min_child_weight int, gamma double")
    a = [r["mean_accuracy"] for r in CL.gbt_random_search(data, gbt).orderBy("candidate_id").collect()]
    assert a[0] > majority + 0.1 and abs(a[1] - majority) < 0.02
    rf = spark.createDataFrame([(0, 10, 50, 2, "gini"), (1, 10, 30, 2, "gini"), (2, 1, 1, 10, "entropy")],
                               "candidate_id long, n_estimators int, max_depth int, min_samples_split int, criterion string")
    r = {x["candidate_id"]: x for x in CL.rf_random_search(data, rf).collect()}
    assert r[0]["mean_accuracy"] == r[1]["mean_accuracy"] > majority + 0.1 and (r[0]["max_depth"], r[0]["fitted_depth"]) == (50, 50)
    s = [x["mean_accuracy"] for x in CL.svm_linear_search(data, [(0, 10.0), (1, 1e-5)]).orderBy("candidate_id").collect()]
    assert s[0] > majority + 0.1 and s[0] != s[1]
    z = [x["mean_accuracy"] for x in CL.svm_rbf_approx(data, [(0, 50.0, 1.0)]).collect()]
    assert z[0] > majority + 0.1
    plain = data.select("doc_id", "label", "fold", vector_to_array("features")[0].alias("a"), vector_to_array("features")[1].alias("b"))
    lr = CL.lr_grid_search(plain, ("a", "b"), Cs=[1e-4, 1.0]).collect()
    assert len(lr) == 4 and max(r["mean_accuracy"] for r in lr) > majority + 0.1 and len({r["mean_accuracy"] for r in lr}) > 1


def test_raw_words_in_one_pass_keep_the_rule(spark):
    texts = ["...", " 'a' ", "don’t--stop", " x y ", "a b \U0001d400 été!", "x" * 3000 + "-" * 3000, "-" * 3000, "1st,2nd \t\n (x)", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    edge = r"^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$"
    want = docs.select("doc_id", F.expr(f"filter(transform(split(replace(coalesce(text, ''), '’', '\\''), '\\\\s+'), x -> regexp_replace(x, '{edge}', '')), x -> x <> '')").alias("w"))
    got = {r["doc_id"]: r["w"] for r in LX.word_lists(docs).collect()}
    assert got == {r["doc_id"]: r["w"] for r in want.collect()} and got[0] == [] and got[2] == ["don't--stop"]


def test_no_neighbours_pass_through_the_lexicon_join(spark):
    docs = spark.createDataFrame([(1, "I like it")], "doc_id long, text string")
    words = LX.raw_words(docs)
    stems = words.select(F.col("low").alias("word"), F.col("low").alias("stem")).distinct()
    df = LX.context_valences(words, stems, spark.createDataFrame([("like", 2.0)], "token string, valence double"))
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(plan) if "Join LeftOuter" in line)
    assert " AS p1" not in plan[join + 1] and " AS c3" not in plan[join + 1]
    assert plan[join + 2:] and not any("Aggregate" in line for line in plan[join:])     # stems are read, not made again
    s = LX.lexicon_score(docs, df).select("doc_id", "compound")
    plan = s._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(plan) if "Join LeftOuter" in line)
    assert "text#" not in plan[join].split("Join")[1] and "__amp" in plan[join + 1]       # the texts stay behind


def test_texts_of_one_row_group_are_spread_before_the_work_on_them(spark, tmp_path):
    rows = [(i, f"Word{i} is VERY good!!, isn't it? But {'' if i % 3 else 'w'}", "train") for i in range(64)] + [(100, None, "train"), (101, " ", "test")]
    spark.createDataFrame(rows, "doc_id long, text string, split string").coalesce(1).write.parquet(str(tmp_path / "one"))
    docs = spark.read.parquet(str(tmp_path / "one"))
    words = LX.raw_words(docs)
    plan = words._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Exchange hashpartitioning(doc_id", 1)
    assert "regexp_extract_all" in above and "regexp_extract_all" not in below
    got = {}
    for r in words.orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.word)
    assert got == {i: [f"Word{i}", "is", "VERY", "good", "isn't", "it", "But", *([] if i % 3 else ["w"])] for i in range(64)}
    long = TXT.corpus_tokens(docs, keep=("doc_id", "split"))
    assert len([f for f in long.inputFiles() if "raw-tokens" in f and f.endswith(".parquet")]) > 1
    amp = docs.select("doc_id", LX.punctuation_amplifier().alias("a")).where("doc_id in (1, 100)").orderBy("doc_id").collect()
    assert [round(r.a, 3) for r in amp] == [round(2 * K.EXCLAMATION_STEP, 3), 0.0]
