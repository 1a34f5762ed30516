"""Batch scoring with caller-supplied models, and the math around logits.

Models never run row at a time: texts reach Python in Arrow batches of a
fixed size and the model is built once per Python worker by a factory.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions import text as TX

SCORE_STRUCT = T.StructType([
    T.StructField("neg", T.DoubleType()), T.StructField("neu", T.DoubleType()),
    T.StructField("pos", T.DoubleType()), T.StructField("compound", T.DoubleType())])


def truncate_tokens(tokens: Column, n: int = K.TRUNCATE_TOKENS) -> Column:
    return F.slice(tokens, 1, n)


def softmax(logits: Column) -> Column:
    """exp(x - max) / sum, on an array column, inside the JVM."""
    m = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / s)


def log_softmax(logits: Column) -> Column:
    m = F.array_max(logits)
    lse = m + F.log(F.aggregate(F.transform(logits, lambda x: F.exp(x - m)), F.lit(0.0), lambda a, x: a + x))
    return F.transform(logits, lambda x: x - lse)


def log_odds_from_logits(logits: Column, pos: int = 2, neg: int = 0) -> Column:
    """ln(p_pos) - ln(p_neg) without underflow: a difference of log-softmax terms."""
    ls = log_softmax(logits)
    return ls[pos] - ls[neg]


def argmax(arr: Column) -> Column:
    """0-based index of the first largest element."""
    return F.array_position(arr, F.array_max(arr)) - 1


# --------------------------------------------------------------- models
def weighted_words_factory(weights: dict[str, float], limit: int = K.TRUNCATE_TOKENS, scale: float = K.BATCH_SCALE):
    """A text classifier from word weights (a bounded vocabulary): logits (-s, 0, s) with
    s = scale * (sum of the weights of the text's first `limit` words) / sqrt(words read).
    Returns a factory that builds the predict function once per Python worker."""
    def make():
        import regex
        word = regex.compile(TX.WORD_PATTERN)

        def predict(texts) -> np.ndarray:
            s = np.zeros(len(texts))
            for i, t in enumerate(texts):
                words = word.findall((t or "").lower())[:limit]
                s[i] = scale * sum(weights.get(w, 0.0) for w in words) / max(1, len(words)) ** 0.5
            return np.stack([-s, np.zeros(len(texts)), s], axis=1)
        return predict
    return make


def _scores(logits: np.ndarray) -> np.ndarray:
    """Columns neg, neu, pos and compound = ln(pos) - ln(neg), without underflow."""
    z = logits - logits.max(axis=1, keepdims=True)
    e = np.exp(z)
    return np.column_stack([e / e.sum(axis=1, keepdims=True), logits[:, 2] - logits[:, 0]])


def batch_score(df: DataFrame, factory: Callable, text_col: str = "text", batch_size: int = K.SCORE_BATCH_SIZE,
                prefix: str = "roberta_") -> DataFrame:
    """Three-class probabilities and compound = ln(pos) - ln(neg) per row,
    through ``predict_batch_udf`` (Arrow batches of ``batch_size``).  factory()
    gives a function from texts to logits, which applies its own input limit."""
    from pyspark.ml.functions import predict_batch_udf

    def make_predict_fn():
        model = factory()

        def predict(texts: np.ndarray) -> dict:
            p = _scores(np.asarray(model(texts), dtype=float))
            return dict(zip(("neg", "neu", "pos", "compound"), p.T))
        return predict

    udf = predict_batch_udf(make_predict_fn, return_type=SCORE_STRUCT, batch_size=batch_size)
    s = udf(F.coalesce(F.col(text_col), F.lit("")))
    return df.withColumn("__s", s).select(
        *[c for c in df.columns],
        *[F.col(f"__s.{k}").alias(prefix + k) for k in ("neg", "neu", "pos", "compound")])


def batch_score_safe(df: DataFrame, factory: Callable, key: str = "doc_id", text_col: str = "text",
                     batch_size: int = K.SCORE_BATCH_SIZE, prefix: str = "roberta_") -> DataFrame:
    """Like ``batch_score`` but a failing batch is retried in halves; rows
    that still fail keep null scores and the error text.  Rows are keyed by
    ``key``, never by position."""
    key_type = df.schema[key].dataType.simpleString()
    schema = (f"{key} {key_type}, {prefix}neg double, {prefix}neu double, {prefix}pos double, "
              f"{prefix}compound double, error string")

    def run(it):
        model = factory()

        def score(keys, texts):
            try:
                p = _scores(np.asarray(model(texts), dtype=float))
                return [(k, *map(float, x), None) for k, x in zip(keys, p)]
            except Exception as e:  # noqa: BLE001
                if len(texts) == 1:
                    return [(keys[0], None, None, None, None, f"{type(e).__name__}: {e}")]
                h = len(texts) // 2
                return score(keys[:h], texts[:h]) + score(keys[h:], texts[h:])

        for pdf in it:
            out = []
            for i in range(0, len(pdf), batch_size):
                part = pdf.iloc[i:i + batch_size]
                out.extend(score(part[key].to_numpy(), part[text_col].fillna("").to_numpy()))
            yield pd.DataFrame(out, columns=[key, prefix + "neg", prefix + "neu", prefix + "pos",
                                             prefix + "compound", "error"])
    return df.select(key, text_col).mapInPandas(run, schema)


def pipeline_label(df: DataFrame, factory: Callable, text_col: str = "text",
                   batch_size: int = K.SCORE_BATCH_SIZE) -> DataFrame:
    """Two-way verdict per row: label 'POSITIVE' / 'NEGATIVE' and its
    probability, from the positive and negative classes of the model."""
    s = batch_score(df, factory, text_col, batch_size, prefix="__v_")
    pos, neg = F.col("__v_pos"), F.col("__v_neg")
    p = pos / (pos + neg)
    return s.select(*df.columns,
                    F.when(p > 0.5, F.lit("POSITIVE")).otherwise(F.lit("NEGATIVE")).alias("verdict"),
                    F.greatest(p, 1 - p).alias("confidence"))
