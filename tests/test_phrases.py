import random

import pytest
from pyspark.sql import functions as F

from reviewlab.operators import lexicon as LX
from reviewlab.operators import phrases as PH

# by hand, with 2.0 for "like", -2.0 for "awful", -1.0 for "no" and the phrases below
PHRASES = [("kiss of death", -1.5), ("the bomb", 3.0), ("the bomb of", 1.0), ("like a", 0.5), ("like a a", None), ("", 4.0), (None, 4.0)]
SENTENCES = {
    "it is the bomb": [("the bomb", 2, 3.0)],
    "it is the bomb of bombs": [("the bomb of", 3, 1.0)],
    "a kiss of death indeed": [("kiss of death", 3, -1.5)],
    "kiss of like": [("like", 1, 2.0)],
    "not the bomb": [("the bomb", 2, 3.0 * -0.74)],
    "very Kiss Of Death": [("kiss of death", 3, -1.793)],
    "like a like a like": [("like a", 2, 0.5), ("like a", 2, 0.5), ("like", 1, 2.0)],
    "like but the bomb": [("like", 1, 1.0), ("the bomb", 2, 4.5)],
    "never so like": [("like", 1, (2.0 + 0.293) * 1.5)],
    "never this much like": [("like", 1, 2.0 * 1.25)],
    "never quite like": [("like", 1, (2.0 + 0.293) * -0.74)],
    "the least like": [("like", 1, -1.48)],
    "at least like": [("like", 1, 2.0)],
    "no like": [("like", 1, -1.48)],
    "no thing": [("no", 1, -1.0)],
    "no x or like": [("no", 1, -1.0), ("like", 1, -1.48)],
    "no x y like": [("no", 1, -1.0), ("like", 1, 2.0)],
    "I LIKE it": [("LIKE", 1, 2.733)],
    "the": [],
}


def fixtures(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "the bomb like"), (98, None), (97, " . ")], "doc_id long, text string")
    stems = LX.raw_words(docs).select(F.col("low").alias("word"), F.col("low").alias("stem")).distinct()
    lexicon = spark.createDataFrame([("like", 2.0), ("awful", -2.0), ("no", -1.0)], "token string, valence double")
    return docs, stems, lexicon, spark.createDataFrame(PHRASES, "phrase string, valence double")


def test_phrases_and_rules_by_hand(spark):
    got = {}
    for r in PH.phrase_valences(*fixtures(spark, SENTENCES)).where("valence <> 0").orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append((r["word"], r["n"], r["valence"]))
    assert got.pop(None) == [("like", 1, 2.0)]          # a row without a key has words only
    for i, (text, want) in enumerate(SENTENCES.items()):
        assert got.pop(i, []) == [(w, n, pytest.approx(v, abs=1e-6)) for w, n, v in want], text
    assert not got


def test_without_phrases_or_texts(spark):
    docs, stems, lexicon, phrases = fixtures(spark, ["I like the bomb"])
    only = PH.phrase_valences(docs, stems, lexicon, phrases.limit(0)).where("doc_id = 0").collect()
    assert sorted((r["pos"], r["word"], r["n"], r["valence"]) for r in only) == [(0, "I", 1, 0.0), (1, "like", 1, 2.0), (2, "the", 1, 0.0), (3, "bomb", 1, 0.0)]
    assert PH.phrase_valences(docs.limit(0), stems, lexicon, phrases).count() == 0


def test_matches_against_a_plain_walk(spark):
    rnd = random.Random(3)
    table = {" ".join(rnd.choices("abc", k=rnd.randint(1, 4))): float(rnd.randint(1, 9)) for _ in range(25)}
    texts = [" ".join(rnd.choices("abcd", k=rnd.randint(0, 60))) for _ in range(60)]
    want = set()
    for d, t in enumerate(texts):
        w, p = t.split(), 0
        while p < len(w):
            n = max((n for n in range(1, 5) if p + n <= len(w) and " ".join(w[p:p + n]) in table), default=0)
            if n:
                want.add((d, p, n, table[" ".join(w[p:p + n])]))
            p += n or 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    trie = PH.phrase_trie(spark.createDataFrame(list(table.items()), "phrase string, valence double"))
    depth = PH.depth_of(trie)
    got = PH.matches(LX.raw_words(docs, ahead=depth), trie, depth).select("doc_id", "pos", "n", "valence").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_induced_valences_by_hand(spark):
    runs = LX.raw_words(spark.createDataFrame([(1, "x y x y"), (2, "x y z"), (3, "x y"), (4, None)], "doc_id long, text string"), ahead=2)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (4, 1)], "doc_id long, label int")
    got = {r["phrase"]: r["valence"] for r in PH.induce_phrases(runs.join(labels, "doc_id"), (2, 3), 2).collect()}
    # pairs: x y 2/1, y x 1/0, y z 0/1 -> 3 in positive, 2 in negative, 3 kinds; triples are empty: runs have two words
    assert got == {"x y": 0.223}   # ln(3/6) - ln(2/5)


def test_rows_of_one_key_keep_their_own_phrases(spark):
    docs, stems, lexicon, phrases = fixtures(spark, [])
    docs = spark.createDataFrame([(1, "the bomb like"), (1, "it is like a x"), (1, "the bomb like")], "doc_id long, text string")
    stems = LX.raw_words(docs).select(F.col("low").alias("word"), F.col("low").alias("stem")).distinct()
    got = sorted((r["pos"], r["word"], r["n"]) for r in PH.phrase_valences(docs, stems, lexicon, phrases).where("valence <> 0").collect())
    assert got == [(0, "the bomb", 2), (0, "the bomb", 2), (2, "like", 1), (2, "like", 1), (2, "like a", 2)]


def test_texts_are_cut_into_units_once(spark):
    docs, stems, lexicon, phrases = fixtures(spark, ["no like the bomb"])
    df = PH.phrase_valences(docs, stems, lexicon, phrases)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") + plan.count("split(") == 1 and "Join LeftAnti" not in plan


def test_rare_phrases_count_in_the_totals_only(spark):
    runs = spark.createDataFrame([(1, ["a", "b"]), (1, ["a", "b"]), (0, ["a", "c"]), (0, ["d", "e"]), (1, ["f"])], "label int, run array<string>")
    assert [tuple(r) for r in PH.induce_phrases(runs, (2,), 2).collect()] == [("a b", 1.099)]   # ln(3/5) - ln(1/5): 3 kinds, 2 and 2 occurrences
