import math

from reviewlab.operators import bayes as NB


def test_tiny_corpus(spark):
    docs = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, label int")
    toks = spark.createDataFrame([(1, 1, "good"), (1, 1, "good"), (2, 1, "fine"), (3, 0, "bad"), (3, 0, "good")],
                                 "doc_id long, label int, token string")
    m = {r["token"]: r for r in NB.nb_train(docs, toks).collect()}
    # V = 3, N_pos = 3, N_neg = 2
    assert math.isclose(m["good"]["loglikelihood"], math.log(3 / 6) - math.log(2 / 5))
    assert math.isclose(m["bad"]["loglikelihood"], math.log(1 / 6) - math.log(2 / 5))
    assert math.isclose(m["good"]["logprior"], math.log(2) - math.log(1))
    test = spark.createDataFrame([(10, 1), (11, 0)], "doc_id long, label int")
    ttoks = spark.createDataFrame([(10, "good"), (10, "unseen"), (11, "bad")], "doc_id long, token string")
    s = {r["doc_id"]: r for r in NB.nb_predict(test, ttoks, NB.nb_train(docs, toks)).collect()}
    assert math.isclose(s[10]["score"], math.log(2) + math.log(3 / 6) - math.log(2 / 5))
    assert s[11]["prediction"] == (1 if math.log(2) + math.log(1 / 6) - math.log(2 / 5) > 0 else 0)


def test_score_exactly_zero_is_negative(spark):
    docs = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int")
    toks = spark.createDataFrame([(1, 1, "a"), (2, 0, "b")], "doc_id long, label int, token string")
    test = spark.createDataFrame([(3, 1)], "doc_id long, label int")
    out = NB.nb_predict(test, spark.createDataFrame([], "doc_id long, token string"), NB.nb_train(docs, toks)).first()
    assert out["score"] == 0.0 and out["prediction"] == 0
