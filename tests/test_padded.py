import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from reviewlab.operators import padded as PAD
from reviewlab.plans.catalog import REGISTRY

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def rows(n=700):
    rnd = random.Random(5)
    texts = [None, "", "é 中 <|endoftext|>", "x" * 3000] + ["".join(rnd.choices("abcde ", k=rnd.choice((1, 5, 40, 300)))) for _ in range(n)]
    return list(enumerate(texts)) + [(None, "abc"), (7, "abc")]


def test_batches_keep_the_budget_and_every_row():
    rnd = random.Random(1)
    for lengths in ([], [0, 0], [900], [rnd.randint(0, 60) for _ in range(500)]):
        got = list(PAD.batches_of(lengths, 256))
        assert sorted(i for b in got for i in b) == list(range(len(lengths)))
        assert all(len(b) == 1 or len(b) * max(1, *[lengths[i] for i in b]) <= 256 for b in got)


def test_scores_are_the_plain_ones_in_any_order(spark):
    def letters():                      # inside the test: workers don't import test modules
        return lambda texts: [[ord(c) % 50 for c in t] for t in texts]

    weights = {i: (i - 25) / 10 for i in range(48)}
    data, factory = rows(), PAD.weighted_subwords_factory(weights, 1.0)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    order = lambda rs: sorted(rs, key=str)
    want = []
    for k, t in data:
        ids = [ord(c) % 50 for c in t or ""][:512]
        s = sum(weights.get(i, 0.0) for i in ids) / max(1, len(ids)) ** 0.5
        want.append((k, round(2 * s, 6) + 0.0, len(ids)))
    for df in (docs.coalesce(1), docs.repartition(5), docs.orderBy(F.desc("doc_id"))):
        got = PAD.batch_score_padded(df, factory, letters, budget=2048, pool=300).collect()
        assert order((r["doc_id"], round(r["roberta_compound"], 6) + 0.0, r["n_tokens"]) for r in got) == order(want)
        assert all(abs(r["roberta_neg"] + r["roberta_neu"] + r["roberta_pos"] - 1) < 1e-12 and r["batch_tokens"] >= r["n_tokens"] for r in got)
    assert PAD.batch_score_padded(docs.limit(0), factory, letters).count() == 0


def test_limit_counts_subwords_of_the_library(spark):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(VOCABULARY)
    lib.encode_special_tokens = True
    data = rows(50)[:-2]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in PAD.subword_table(docs, PAD.subword_encoder(VOCABULARY)).collect()}
    assert got == {k: lib.encode(t or "", add_special_tokens=False).ids for k, t in data}


def test_weights_by_hand(spark):
    ids = spark.createDataFrame([(1, [1, 1, 2]), (0, [2]), (None, [3]), (1, None)], "label int, ids array<int>")
    got = {r["id"]: r["weight"] for r in PAD.subword_weights(ids).collect()}
    assert got == {1: pytest.approx(np.log(3 / 5) - np.log(1 / 3)), 2: pytest.approx(np.log(2 / 5) - np.log(2 / 3))}


def test_report_of_mixed_lengths(spark):
    factory = PAD.weighted_subwords_factory({1: 1.0})
    docs = spark.createDataFrame([(i, "a" * (5 if i % 2 else 400)) for i in range(512)], "doc_id long, text string").coalesce(1)
    scored = PAD.batch_score_padded(docs, factory, lambda: lambda texts: [[1] * len(t) for t in texts], budget=4000)
    r = PAD.padding_report(scored, scored.select("n_tokens", F.col("doc_id").alias("row_id"))).first()
    assert (r["texts"], r["tokens"], r["padded_before"]) == (512, 256 * 405, 512 * 400)
    assert r["tokens"] <= r["padded_after"] <= 1.03 * r["tokens"]     # one batch holds both lengths at most


def test_queries(spark):
    # nearly all texts of this table reach the limit of 512, so no order saves much there
    r = REGISTRY["batch_padding"](spark, SF_SMALL).first()
    assert r["tokens"] <= r["padded_after"] <= r["padded_before"] <= 512 * r["texts"]
    s = REGISTRY["batch_score_padded"](spark, SF_SMALL)
    assert s.count() == r["texts"] and s.where("(roberta_compound > 0) = (label = 1)").count() > 0.6 * r["texts"]


def test_scores_from_encoded_texts_are_those_of_the_texts(spark):
    import public_tokenizers
    encoder = PAD.subword_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", None, "one two three", "word " * 700, "é\u2028 <|endoftext|> 😀"]
    df = spark.createDataFrame([(i % 4, t, i % 2) for i, t in enumerate(texts)] + [(None, "no key", 1)], "doc_id long, text string, label int")
    ids = PAD.subword_table(df, encoder, carry=("label",))
    assert ids.columns == ["doc_id", "label", "ids"]
    weights = {r[0]: r[1] for r in PAD.subword_weights(ids).collect()}
    model = PAD.weighted_subwords_factory(weights)
    kept = [c for c in PAD.batch_score_padded(df, model, encoder).columns if c != "batch_tokens"]
    a, b = (sorted(map(str, PAD.batch_score_padded(x, model, e).select(*kept).collect())) for x, e in ((df, encoder), (ids, None)))
    assert a == b and len(a) == 6
