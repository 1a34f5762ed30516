"""Token/label counts, the two count features, and add-one log-odds Naive Bayes.

Totals (N_pos, N_neg, V, D_pos, D_neg) are scalar subqueries: Spark runs
them as one-row aggregates and inlines the value, so there is no join
against a totals table.  Weights are joined to tokens on the token key;
frequent tokens are hot keys, which AQE's skew-join split handles, and
token rows are pre-aggregated per document before that join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def safe_log(x):
    """Natural log with ln(0) = -inf (Spark's log returns null there)."""
    x = x.cast("double")
    return F.when(x > 0, F.log(x)).otherwise(F.lit(float("-inf")))


def token_label_freqs(tokens: DataFrame, label_col: str = "label", token_col: str = "token") -> DataFrame:
    """(token, n_pos, n_neg): occurrences of each token in positive / negative documents."""
    y = F.col(label_col)
    return (tokens.groupBy(token_col)
            .agg(F.count_if(y == 1).cast("bigint").alias("n_pos"),
                 F.count_if(y == 0).cast("bigint").alias("n_neg")))


def doc_token_counts(tokens: DataFrame, keys=("doc_id",), token_col: str = "token") -> DataFrame:
    """(keys..., token, n): repeats of a token inside one document."""
    return tokens.groupBy(*keys, token_col).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def token_label_features(docs: DataFrame, tokens: DataFrame, freqs: DataFrame,
                         keys=("doc_id",)) -> DataFrame:
    """Per document: tlc_pos = sum of n_pos over its tokens, tlc_neg likewise.

    Token repeats count each time; unknown tokens add 0; documents without
    tokens get (0, 0).
    """
    per_doc = doc_token_counts(tokens, keys)
    sums = (per_doc.join(freqs, "token")
            .groupBy(*keys)
            .agg(F.sum(F.col("n") * F.col("n_pos")).alias("tlc_pos"),
                 F.sum(F.col("n") * F.col("n_neg")).alias("tlc_neg")))
    return (docs.join(sums, list(keys), "left")
            .withColumn("tlc_pos", F.coalesce(F.col("tlc_pos"), F.lit(0)).cast("double"))
            .withColumn("tlc_neg", F.coalesce(F.col("tlc_neg"), F.lit(0)).cast("double")))


def nb_prior(train_docs: DataFrame, label_col: str = "label") -> DataFrame:
    """One row: logprior = ln(D_pos) - ln(D_neg), from the document counts alone."""
    y = F.col(label_col)
    return train_docs.agg((safe_log(F.count_if(y == 1)) - safe_log(F.count_if(y == 0))).alias("logprior"))


def nb_train(train_docs: DataFrame, train_tokens: DataFrame, label_col: str = "label") -> DataFrame:
    """(token, n_pos, n_neg, loglikelihood, logprior).

    loglikelihood = ln((n_pos+1)/(N_pos+V)) - ln((n_neg+1)/(N_neg+V)),
    logprior = ln(D_pos) - ln(D_neg) (not smoothed).
    """
    freqs = token_label_freqs(train_tokens, label_col)
    tot = freqs.agg(F.struct(F.sum("n_pos").alias("N_pos"), F.sum("n_neg").alias("N_neg"),
                             F.count(F.lit(1)).alias("V")).alias("t")).scalar()
    prior = nb_prior(train_docs, label_col).scalar()
    V = tot.getField("V")
    ll = (F.log((F.col("n_pos") + 1) / (tot.getField("N_pos") + V))
          - F.log((F.col("n_neg") + 1) / (tot.getField("N_neg") + V)))
    return freqs.select("token", "n_pos", "n_neg", ll.alias("loglikelihood"), prior.alias("logprior"))


def nb_predict(docs: DataFrame, tokens: DataFrame, model: DataFrame, keys=("doc_id",), prior: DataFrame | None = None) -> DataFrame:
    """score = logprior + sum of loglikelihoods of the document's tokens
    (repeats counted, unknown tokens 0); prediction = score > 0.  The one-row
    ``prior`` (nb_prior) saves reading the model for its constant column."""
    prior = (model.agg(F.max("logprior")) if prior is None else prior).scalar()
    per_doc = doc_token_counts(tokens, keys)
    sums = (per_doc.join(model.select("token", "loglikelihood"), "token")
            .groupBy(*keys).agg(F.sum(F.col("n") * F.col("loglikelihood")).alias("__s")))
    score = prior + F.coalesce(F.col("__s"), F.lit(0.0))
    return (docs.join(sums, list(keys), "left")
            .withColumn("score", score)
            .withColumn("prediction", (F.col("score") > 0).cast("int"))
            .drop("__s"))
