import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from reviewlab.llm import katz as K
from reviewlab.llm.queries import QUERIES

END = "\n"


def tokens(text):
    t = (text or "").translate({i: i + 32 for i in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w] + [END]


class Brute:
    def __init__(self, rows):
        train = [tokens(t) for k, t in rows if k is None or zlib.crc32(str(k).encode()) % 7 != 2]
        self.uni = Counter(w for t in train for w in t)
        self.bi = Counter((a, b) for t in train for a, b in zip([END] + t, t))
        self.total = sum(self.uni.values())
        self.ku, self.kb = (K.discounts(np.array([sum(c == r for c in x.values()) for r in range(1, K.TRUSTED + 2)])) for x in (self.uni, self.bi))
        self.unk = 1 - sum(self.d(c, self.ku) for c in self.uni.values()) / self.total if self.total else 1.0
        self.after = {}
        for (a, b), c in self.bi.items():
            self.after.setdefault(a, {})[b] = c

    def d(self, c, kept):
        return c * kept[c - 1] if c <= K.TRUSTED else c - (1 - kept[-1]) * K.TRUSTED

    def p1(self, w):
        return self.d(self.uni[w], self.ku) / self.total if w in self.uni else self.unk

    def p(self, a, w):
        seen = self.after.get(a)
        if not seen:
            return self.p1(w)
        if w in seen:
            return self.d(seen[w], self.kb) / self.uni[a]
        left = 1 - sum(self.d(c, self.kb) for c in seen.values()) / self.uni[a]
        return left / (1 - sum(map(self.p1, seen))) * self.p1(w)

    def row(self, k, text):
        t = tokens(text)
        v = len(self.uni)
        return (len(t), sum(w in self.uni for w in t), self.total, sum(math.log10((self.uni[w] + 1) / (self.total + v + 1)) for w in t),
                sum(math.log10(self.p(a, w)) for a, w in zip([END] + t, t)))


def compare(rows, got):
    model = Brute(rows)
    want = sorted((k is None, k or 0, *model.row(k, t)) for k, t in rows)
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert len(found) == len(want)
    for a, b in zip(found, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)
    return model


def test_discounts_are_proper():
    for counts in ([100, 40, 20, 12, 8, 6], [5, 0, 0, 0, 0, 0], [0] * 6, [1, 1, 1, 1, 1, 1], [3, 9, 27, 81, 3, 1]):
        kept = K.discounts(np.array(counts))
        assert (kept > 0).all() and (kept < 1).all()
        c = np.arange(1, 50)
        assert (K.discounted(c, kept) > 0).all() and (K.discounted(c, kept) < c).all()


def test_small_rows_and_normalisation(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_BYTES", 200)
    rows = [(i, "The cat sat on the mat and the dog%d ran" % (i % 5)) for i in range(30)]
    rows += [(2, None), (100, ""), (101, " \t"), (None, "a Null key"), (None, "unseen words here"), (7, "cat " * 400), (7, "cat " * 400)]
    docs = spark.createDataFrame([(k, t, 1.0, "x") for k, t in rows], "doc_id long, text string, score double, block string")
    model = compare(rows, K.score(docs).collect())
    for a in [END, "the", "cat", "nowhere"]:
        assert sum(model.p(a, w) for w in model.uni) + model.p(a, "\0none") == pytest.approx(1, abs=1e-12)
    assert K.score(docs.where("doc_id < 0")).count() == 0


def test_nothing_to_learn_from(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = K.score(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in got) and len(got) == len(held)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    got = QUERIES["op5_katz_scoring"](spark, sf).collect()
    compare(rows, got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
