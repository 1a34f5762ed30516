"""Feature tables: scaling, TF-IDF (vectorizer-compatible formula), chi-square.

TF-IDF is kept in long form (doc_id, term, tfidf): the weight of a term is
tf * (ln((1 + n) / (1 + df)) + 1), rows are L2-normalised per document over
the vocabulary, and a capped vocabulary keeps the k most frequent terms
(ties by term).  Terms are tokens of at least two characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def term_counts(tokens: DataFrame, keys=("doc_id",)) -> DataFrame:
    """(keys..., term, tf) for tokens of two or more characters."""
    return (tokens.where(F.length("token") >= 2)
            .groupBy(*keys, F.col("token").alias("term"))
            .agg(F.count(F.lit(1)).cast("double").alias("tf")))


def tfidf_fit(fit_docs: DataFrame, fit_tf: DataFrame, k: int | None = None) -> DataFrame:
    """(term, df, idf) over the fit documents; top-k terms by corpus frequency.

    The capped vocabulary is a TakeOrderedAndProject: each partition keeps
    its k best and one task merges partitions x k rows.
    """
    n = fit_docs.agg(F.count(F.lit(1))).scalar()
    stats = fit_tf.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))
    if k is not None:
        stats = stats.orderBy(F.col("cf").desc(), F.col("term")).limit(k)
    return stats.select("term", "df", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def tfidf_transform(tf: DataFrame, idf: DataFrame, keys=("doc_id",), bounded: bool = False) -> DataFrame:
    """(keys..., term, tfidf), L2-normalised per document.

    ``bounded`` marks an idf table of proven size (a top-k vocabulary) that
    is broadcast; an uncapped vocabulary is left to the planner and AQE.
    """
    side = F.broadcast(idf.select("term", "idf")) if bounded else idf.select("term", "idf")
    w = tf.join(side, "term").withColumn("__w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("__w") * F.col("__w")).over(Window.partitionBy(*keys)))
    return w.select(*keys, "term", (F.col("__w") / norm).alias("tfidf"))


def standard_scale(fit: DataFrame, apply_to: DataFrame, cols) -> DataFrame:
    """z-scores with the fit rows' mean and population standard deviation."""
    moments = fit.agg(F.struct(*[f(c).alias(f"{n}_{c}") for c in cols
                                 for n, f in (("m", F.avg), ("s", F.stddev_pop))]).alias("st")).scalar()
    return apply_to.withColumns({f"z_{c}": F.when(
        moments.getField(f"s_{c}") > 0, (F.col(c) - moments.getField(f"m_{c}")) / moments.getField(f"s_{c}")).otherwise(F.lit(0.0))
        for c in cols})


def chi2_scores(doc_terms: DataFrame, docs: DataFrame, label_col: str = "label") -> DataFrame:
    """Chi-square of term presence against a 0/1 label over the documents.

    doc_terms: (doc_id, term) distinct presence rows joined to labels;
    docs: (doc_id, label) of all documents (also those without terms).
    """
    tot = docs.agg(F.struct(F.count(F.lit(1)).alias("n"),
                            F.count_if(F.col(label_col) == 1).alias("n1")).alias("t")).scalar()
    per = doc_terms.groupBy("term").agg(F.count_if(F.col(label_col) == 1).alias("a"),
                                        F.count_if(F.col(label_col) == 0).alias("b"))
    n, n1 = tot.getField("n").cast("double"), tot.getField("n1").cast("double")
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    c, d = n1 - a, (n - n1) - b
    den = (a + b) * (c + d) * (a + c) * (b + d)
    chi2 = F.when(den > 0, n * (a * d - b * c) * (a * d - b * c) / den).otherwise(F.lit(0.0))
    return per.select("term", F.round(chi2, 9).alias("chi2"))


def select_top(scores: DataFrame, k: int, col: str = "chi2") -> DataFrame:
    """k best terms (ties by term) with their 1-based rank."""
    top = scores.orderBy(F.col(col).desc(), F.col("term")).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col(col).desc(), F.col("term"))))
