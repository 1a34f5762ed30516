import hashlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from reviewlab.llm import winnow as N
from reviewlab.llm.queries import ORACLE, QUERIES


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def expected(text, items):
    w, hit, found = words(text), set(), set()
    for item, other in items:
        o = words(other)
        n = min(10, len(o))
        if item is None or not o:
            continue
        wins = {tuple(o[i:i + n]) for i in range(len(o) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i:i + n]) in wins:
                found.add(str(item))
                hit |= set(range(i, i + n))
    return len(w), len(hit), sorted(found)


def corpus():
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(40)] + ["Élan", "ß", "naïve", "日本"]

    def some(n):
        return [rnd.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(some(rnd.choice([3, 9, 10, 11, 25, 40])))) for i in range(30)] + [(40, "Alone"), (41, None), (42, ""), (None, "w1 w2"), (43, "--!"), (5, "second text of item five w9 w9 w9 w8 w7 w6 w5")]
    docs = [(i, " ".join(some(rnd.randrange(60)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, " .. "), (None, items[3][1]), (103, "alone"), (103, "ALONE, alone"), (104, "w1 " * 3000)]
    for i, (item, text) in enumerate(items):
        if text:
            docs.append((200 + i, " ".join(some(5)) + " -- " + text.upper().replace(" ", "  ;") + "\n" + " ".join(some(4))))
            w = text.split()
            docs.append((300 + i, " ".join(w[:9] + some(1) + w[9:])))
            docs.append((400 + i, " ".join(w[2:13])))
    docs += [docs[-2]] * 5
    return docs, items


def test_against_every_window(spark, tmp_path, monkeypatch):
    docs, items = corpus()
    monkeypatch.setattr(N, "BYTES_AT_ONCE", 300)
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, row int, hits string").repartition(3)
    b = spark.createDataFrame([(*r, 1) for r in items + items[:3]], "item_id long, text string, fp int")
    got = N.contaminated(d, b).collect()
    want = [(key, *expected(text, items)) for key, text in docs]
    assert sum(w[2] > 0 for w in want) > 40
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.items) for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_hit and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
        assert r.n_items == len(r["items"])
    pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame(items, columns=["item_id", "text"]).astype({"item_id": "Int64"}).to_parquet(tmp_path / "benchmark.parquet")
    rows = sorted((tuple(r) for r in QUERIES["op13_decontamination"](spark, str(tmp_path)).collect()), key=repr)
    assert rows == sorted(((k, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for k, n, h, i in want), key=repr)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    assert sorted(con.execute(ORACLE["op13_decontamination"]).fetchall(), key=repr) == rows


@pytest.mark.parametrize("n", range(1, 13))
def test_shared_span_shares_fingerprint(n):
    rnd = np.random.default_rng(n)
    a, b = (rnd.integers(0, 1 << 63, 200, dtype=np.uint64) for _ in range(2))
    b[50:50 + n] = a[120:120 + n]
    one, zero = np.zeros(200, np.int64), np.repeat([0, 1], 100)
    at, fa = N.fingerprints(a, one, n)
    bt, fb = N.fingerprints(b, one, n)
    assert fa[at == 120] == fb[bt == 50]
    assert set(N.fingerprints(a, zero, n)[0]) == {i for i in range(200 - n + 1) if zero[i] == zero[i + n - 1]}
    k, w = N.sizes(n)
    assert k + w - 1 == n and k > 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert N.contaminated(docs.limit(0), items).collect() == []
    assert {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in N.contaminated(docs, items.limit(0)).collect()} == {(1, 2, 0, ()), (2, 0, 0, ())}
    assert {(r.doc_id, r.n_hit) for r in N.contaminated(docs, items).collect()} == {(1, 2), (2, 0)}
