import math

from reviewlab.plans.catalog import REGISTRY
from reviewlab.plans import context


def test_tfidf_full_counts_tokens_once(spark, tmp_path, monkeypatch):
    """Fit and transform share one count; values follow the formula by hand."""
    words = ["apple", "river", "stone", "cloud", "tiger"]
    rows = [(i, " ".join(words[j] for j in range(5) if (i + j) % 3) + " apple" * (i % 2), "en", "s", 1) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    counted = []
    from reviewlab.operators import features
    monkeypatch.setattr(features, "term_counts", lambda *a, f=features.term_counts, **b: counted.append(1) or f(*a, **b))
    got = {(r["doc_id"], r["term"]): r["tfidf"] for r in REGISTRY["tfidf_full"](spark, str(tmp_path)).collect()}
    assert len(counted) == 1
    tokens = {}
    c = context.Ctx(spark, str(tmp_path))
    for r in c.tokens.collect():
        own = tokens.setdefault((r["doc_id"], r["split"]), {})
        own[r["token"]] = own.get(r["token"], 0) + 1
    train = [t for (_, s), t in tokens.items() if s == "train"]
    n = c.split("train").count()
    assert 0 < len(train) < len(tokens)
    idf = {t: math.log((n + 1) / (sum(t in own for own in train) + 1)) + 1 for own in train for t in own}
    want = {}
    for (doc, _), own in tokens.items():
        w = {t: x * idf[t] for t, x in own.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        want |= {(doc, t): round(x / norm, 6) for t, x in w.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
