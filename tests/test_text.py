import duckdb
from pyspark.sql import functions as F

from reviewlab.functions import text as TX
from reviewlab.functions.dialect import DUCK, SPARK
from reviewlab.operators import text as TXT
from reviewlab.plans.oracle import stem_table

# Published examples of Porter (1980)
PORTER = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat",
    "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor",
    "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
    "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit",
    "rational": "ration", "valenci": "valenc", "hesitanci": "hesit", "digitizer": "digit",
    "conformabli": "conform", "radicalli": "radic", "differentli": "differ", "vileli": "vile",
    "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic", "operator": "oper",
    "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous",
    "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic",
    "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr",
    "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer",
    "airliner": "airlin", "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens",
    "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend",
    "adoption": "adopt", "homologou": "homolog", "communism": "commun", "activate": "activ",
    "angulariti": "angular", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
    "generalizations": "gener", "oscillators": "oscil", "is": "is", "as": "as",
}


def test_porter_published_examples_spark(spark):
    df = spark.createDataFrame([(w,) for w in PORTER], "word string")
    got = {r["word"]: r["stem"] for r in TXT.stem(df, "word", "stem").collect()}
    bad = {w: (got[w], e) for w, e in PORTER.items() if got[w] != e}
    assert not bad


def test_porter_same_rules_in_duckdb():
    con = duckdb.connect()
    words = ", ".join("('" + w + "')" for w in PORTER)
    rows = con.execute(f"SELECT o, stem FROM ({stem_table(f'SELECT w FROM (VALUES {words}) t(w)')})").fetchall()
    assert {o: s for o, s in rows} == PORTER


def test_cleaning_rows(spark):
    rows = [(1, "see https://x.org/a?b=1 film"), (2, "#great movie"), (3, "abc123def 42"),
            (4, "(wow) ''quoted''"), (5, "the and of it"), (6, ""), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: list(r["t"]) for r in df.select("doc_id", F.expr(TX.kept_tokens_sql(SPARK, "text")).alias("t")).collect()}
    assert out[1] == ["see", "film"]
    assert out[2] == ["great", "movie"]
    assert out[3] == ["abcdef"]
    assert out[4] == ["wow", "quoted"]
    assert out[5] == [] and out[6] == [] and out[7] == []


def test_tokenizer_same_in_duckdb(spark):
    text = "Ça va? Don't stop—the 3 films (2019) were \"great\"!"
    sp = spark.createDataFrame([(text,)], "text string").select(F.expr(TX.tokenize_sql(SPARK, "text"))).first()[0]
    dk = duckdb.connect().execute(f"SELECT {TX.tokenize_sql(DUCK, 'x')} FROM (SELECT ? AS x)", [text]).fetchone()[0]
    assert list(sp) == list(dk)


def test_preprocess_keeps_empty_documents(spark):
    df = spark.createDataFrame([(1, "the of and"), (2, "Running dogs ran")], "doc_id long, text string")
    out = {r["doc_id"]: (r["processed_text"], r["token_count"]) for r in TXT.preprocess_corpus(df).collect()}
    assert out[1] == ("", 0)
    assert out[2] == ("run dog ran", 3)
