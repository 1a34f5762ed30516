import zlib

import numpy as np
import pytest

from reviewlab.llm import langid, quality
from reviewlab.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = QUERIES["op10_quality_classifier"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.97


def test_discriminant_by_hand():
    rnd = np.random.default_rng(0)
    means, covs = [np.zeros(2), np.ones(2)], [np.eye(2), np.array([[2.0, 0.5], [0.5, 1.0]])]
    m = quality.Model([np.log(0.3), np.log(0.7)], means, [np.linalg.inv(np.linalg.cholesky(c)) for c in covs], [np.log(np.linalg.det(c)) for c in covs])
    x = rnd.normal(size=(50, 2))
    logs = [np.log(p) - 0.5 * (np.log(np.linalg.det(c)) + np.einsum("ni,ij,nj->n", x - u, np.linalg.inv(c), x - u)) for p, u, c in zip((0.3, 0.7), means, covs)]
    assert m.score(x) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])))


def test_quality_odd_rows(spark):
    rows = [(1, None, 5.0), (2, "", 1.0), (3, "A | b | c ###", 2.0), (None, "text", 3.0), (3, "A | b | c ###", 2.0), (4, "plain words " * 40000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").withColumnRenamed("score", "stats")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 1), (None, 0)], "doc_id long, quality int")
    for some in (labels, labels.where("quality = 1"), labels.where("doc_id < 0")):
        got = quality.scored(quality.with_stats(docs, out="x"), quality.train(quality.with_stats(docs, out="x"), some, stats="x"), "x").collect()
        assert len(got) == len(rows) and all(0 <= r.quality_score <= 1 for r in got)
    none = quality.with_stats(docs.where("doc_id < 0"), out="x")
    assert quality.scored(none, quality.train(none, labels, stats="x"), "x").count() == 0
    assert all(len(quality.statistics(x)) == quality.N_STATS and np.isfinite(quality.statistics(x)).all() for x in (b"", b" ", b"\n", b"a", "é 漢".encode()))


def test_language_held_out(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op6_language_id"](spark, SF).collect()
    assert len(got) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in got if r.held_out]) > 0.97


def slow_kernel(x, y, alphabet):
    def grams(t):
        b = t.lower().encode()
        return {b[i:i + n] for n in langid.ORDERS for i in range(len(b) - n + 1)} & alphabet
    p, q = grams(x), grams(y)
    return len(p & q) / max(1e-9, (len(p) * len(q)) ** 0.5)


def test_kernel_by_hand():
    marks = ["the cat", "el gato ñ", "x"]
    alphabet = {m.encode()[i:i + n] for m in marks for n in langid.ORDERS for i in range(len(m.encode()) - n + 1)}
    sets = [np.unique(langid.codes(m)) for m in marks]
    grams = np.unique(np.concatenate(sets)).astype(np.int32)
    known = np.zeros((3, len(grams)), bool)
    for row, s in zip(known, sets):
        row[np.searchsorted(grams, s)] = True
    texts = ["The", "gato", "zzz", "", "the cat el gato " * 50]
    got = langid.kernel(texts, grams.tobytes(), np.packbits(known, axis=1).tobytes())
    assert got == pytest.approx(np.array([[slow_kernel(t, m, alphabet) for m in marks] for t in texts]), abs=1e-6)


def test_language_odd_rows(spark):
    rows = [(1, "hello there my friend", "en"), (2, "bonjour mon ami là", "fr"), (3, None, "en"), (4, "123 !!", "fr"), (None, "hello friend", None), (5, "", "de"), (2, "bonjour mon ami là", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in langid.predict(docs, model).collect()), key=lambda r: (r[0] is None, r))
    assert [(k, p) for k, p, _ in got] == [(1, "en"), (2, "fr"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (None, "en")]
    assert all(s == 0 for _, p, s in got if p == "und")
    assert langid.fit(docs.where("doc_id = 3")) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(docs.where("doc_id < 0"), model).count() == 0
