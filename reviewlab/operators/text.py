"""Corpus preprocessing: clean, tokenize, filter, stem, reassemble.

All steps are expressions evaluated inside the JVM.  The stemmer runs on
the long form (one row per token) where its projections are compiled by
whole-stage codegen; arrays are rebuilt with a per-document aggregate that
needs no exchange when the input is hash-partitioned by doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as TX
from ..functions.dialect import SPARK
from ..functions.porter import stem_column_stages
from ..session import spread, written


def strip_urls(df: DataFrame, col: str = "text", out: str = "text") -> DataFrame:
    return df.withColumn(out, F.regexp_replace(F.col(col), K.URL_PATTERN, ""))


def strip_hash_sign(df: DataFrame, col: str = "text", out: str = "text") -> DataFrame:
    return df.withColumn(out, F.regexp_replace(F.col(col), K.HASH_SIGN_PATTERN, ""))


def strip_numbers(df: DataFrame, col: str = "text", out: str = "text") -> DataFrame:
    return df.withColumn(out, F.regexp_replace(F.col(col), K.NUMBER_PATTERN, ""))


def clean_text(df: DataFrame, col: str = "text", out: str = "clean_text") -> DataFrame:
    return df.withColumn(out, F.expr(TX.clean_sql(SPARK, col)))


def tokenize(df: DataFrame, col: str = "text", out: str = "tokens") -> DataFrame:
    """Cleaned, lower-cased tokens: letter runs or single other signs."""
    return df.withColumn(out, F.expr(TX.tokenize_sql(SPARK, col)))


def explode_tokens(df: DataFrame, col: str = "tokens", keep=("doc_id",)) -> DataFrame:
    """Long form (keys..., pos, token); pos is 0-based."""
    return df.select(*keep, F.posexplode(F.col(col)).alias("pos", "token"))


def remove_stopwords(long: DataFrame, col: str = "token") -> DataFrame:
    """Drop stop words; the fixed 179-word list becomes a hash-set predicate."""
    return long.where(~F.col(col).isin(K.STOPWORDS_EN))


def remove_punctuation(long: DataFrame, col: str = "token") -> DataFrame:
    """Drop tokens that are a contiguous run of the 32 punctuation signs."""
    return long.where(~F.lit(K.PUNCTUATION).contains(F.col(col)))


def stem(df: DataFrame, col: str = "token", out: str = "token") -> DataFrame:
    """Porter stem of a string column, as successive JVM projections."""
    keep = [c for c in df.columns if c != out or out == col]
    keep = [c for c in keep if not c.startswith("__st_")]
    for stage in stem_column_stages(SPARK, col):
        df = df.select(*keep, *[F.expr(v).alias(k) for k, v in stage.items()])
    # A one-element generator ends the chain: predicates on the stem (for
    # example the not-null filter a join infers) stop here instead of being
    # rewritten through every stemming projection.
    rest = [c for c in keep if c != out]
    return df.select(*rest, F.explode(F.array(F.col("stem"))).alias(out))


def stem_vocabulary(long: DataFrame, col: str = "token") -> DataFrame:
    """Distinct words and their stems (stemmed once per distinct word).

    The distinct vocabulary is small in bytes, so adaptive execution would
    coalesce it into one or two partitions; an explicit round-robin spread
    keeps the CPU-heavy stemming on every core.
    """
    parts = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    voc = long.select(F.col(col).alias("word")).distinct().repartition(parts)
    return stem(voc, "word", "stem")


def kept_tokens(df: DataFrame, text_col: str = "text", keep=("doc_id",)) -> DataFrame:
    """Long form of the tokens that survive stop-word and punctuation rules."""
    return df.select(*keep, F.posexplode(F.expr(TX.kept_tokens_sql(SPARK, text_col))).alias("pos", "raw"))


def corpus_tokens(df: DataFrame, text_col: str = "text", keep=("doc_id",), stems: DataFrame | None = None) -> DataFrame:
    """Long form (keep..., pos, token) of the fully preprocessed corpus.

    Texts are spread over all tasks.  The raw tokens are written once and read by both the vocabulary and the
    join.  Each distinct word is stemmed once and joined back on the word;
    the planner sees the written stem table's size and broadcasts it where
    that is under the threshold, else hot words are split by AQE.  With
    ``stems`` (word, stem) of an earlier run only new words are stemmed.
    """
    raw = written(kept_tokens(spread(df, keep[0], text_col), text_col, keep), "raw-tokens")
    if stems is None:
        table = written(stem_vocabulary(raw, "raw"), "stems")
    else:
        new = raw.select(F.col("raw").alias("word")).distinct().join(stems, "word", "left_anti")
        table = stems.select("word", "stem").unionByName(written(stem_vocabulary(new, "word"), "stems"))
    return (raw.join(table, raw["raw"] == table["word"])
            .select(*keep, "pos", F.col("stem").alias("token")))


def preprocess_corpus(df: DataFrame, text_col: str = "text", keep=("doc_id",)) -> DataFrame:
    """(keys..., tokens, processed_text, token_count) per document.

    Documents without surviving tokens keep an empty list.
    """
    return assemble_corpus(df, corpus_tokens(df, text_col, keep), keep)


def assemble_corpus(df: DataFrame, long: DataFrame, keep=("doc_id",)) -> DataFrame:
    """Rebuild ordered token arrays from the long form.

    Grouping and the join back use the document key alone (the other keys
    depend on it), so the long side is exchanged once, by that key, and the
    join reuses that partitioning.
    """
    key = keep[0]
    arrays = (long.groupBy(key)
              .agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("__pt"))
              .select(key, F.col("__pt.token").alias("tokens")))
    base = df.select(*keep)
    out = base.join(arrays, key, "left")
    toks = F.coalesce(F.col("tokens"), F.array().cast("array<string>"))
    return out.select(*keep, toks.alias("tokens"),
                      F.array_join(toks, " ").alias("processed_text"),
                      F.size(toks).cast("bigint").alias("token_count"))


def vocabulary(long: DataFrame, col: str = "token") -> DataFrame:
    """Distinct tokens with term frequency and document frequency."""
    per_doc = long.groupBy("doc_id", col).agg(F.count(F.lit(1)).alias("__n"))
    return (per_doc.groupBy(col)
            .agg(F.sum("__n").cast("bigint").alias("term_freq"),
                 F.count(F.lit(1)).cast("bigint").alias("doc_freq")))


def word_count(df: DataFrame, col: str = "text", out: str = "length") -> DataFrame:
    return df.withColumn(out, F.expr(TX.word_count_sql(SPARK, col)))
