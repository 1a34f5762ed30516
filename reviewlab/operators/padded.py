"""Batch scoring in padded batches of like length, with a limit in subwords.

A model that reads padded batches pays for the longest text of each.  Inside a partition, texts
are sorted by length in pools of a fixed number of rows and cut into batches of a fixed number of
padded tokens, so little of a batch is padding; answers carry their row's key.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from .inference import _scores

#: Rows sorted together; a task holds their ids (at most max_tokens each), never its partition.
POOL_ROWS = 4096
#: Rows times longest row of a batch.
TOKEN_BUDGET = 16384
#: Characters (and a text) that the library holds its own records of at once.
ENCODED_AT_ONCE = 1 << 18
#: Rows whose whole ids are held at once.
ROWS_AT_ONCE = 64


def subword_encoder(path: str) -> Callable:
    """A factory of the function from texts to their lists of ids, by a file of the tokenizers library
    (its own truncation and padding off, no special tokens; strings of special tokens are ordinary text)."""
    def make():
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        t.encode_special_tokens = True

        def encode(texts):
            out, part, size = [], [], 0
            for x in texts:
                part.append(x)
                size += len(x)
                if size >= ENCODED_AT_ONCE:
                    out += [e.ids for e in t.encode_batch_fast(part, add_special_tokens=False)]
                    part, size = [], 0
            return out + [e.ids for e in t.encode_batch_fast(part, add_special_tokens=False)]
        return encode
    return make


def subword_table(df: DataFrame, encoder: Callable, key: str = "doc_id", text_col: str = "text", carry=()) -> DataFrame:
    """(key, carry..., ids): the subwords of each whole text, null as an empty one."""
    kept = [key, *carry]
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in kept]).add("ids", T.ArrayType(T.IntegerType()))

    def run(it):
        encode = encoder()
        for rows in (b.slice(i, ROWS_AT_ONCE) for b in it for i in range(0, b.num_rows, ROWS_AT_ONCE)):
            ids = pa.array(encode(rows.column(len(kept)).to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], ids], [*kept, "ids"])
    return df.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("__text")).mapInArrow(run, schema)


def batches_of(lengths: list[int], budget: int = TOKEN_BUDGET) -> Iterator[list[int]]:
    """Places of the rows of each batch: by length, ties by place, rows times longest at most the
    budget (a longer row is a batch alone); a row without tokens counts as one."""
    batch: list[int] = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        if batch and (len(batch) + 1) * max(1, lengths[i]) > budget:
            yield batch
            batch = []
        batch.append(i)
    if batch:
        yield batch


def padded(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids filled with 0 to the longest row, and which of them are a text's own."""
    lengths = np.array([len(x) for x in ids])
    own = np.arange(max(1, lengths.max())) < lengths[:, None]
    out = np.zeros(own.shape, np.int64)
    out[own] = np.concatenate(ids)
    return out, own


def batch_score_padded(df: DataFrame, factory: Callable, encoder: Callable | None, key: str = "doc_id", text_col: str = "text",
                       max_tokens: int = K.TRUNCATE_TOKENS, budget: int = TOKEN_BUDGET, pool: int = POOL_ROWS,
                       prefix: str = "roberta_") -> DataFrame:
    """(key, neg, neu, pos, compound with the prefix, n_tokens, batch_tokens) per row.

    encoder() gives a function from texts to lists of ids, of which the first ``max_tokens`` are
    read (n_tokens); without it, df has the lists in a column ids (`subword_table`).  factory() gives one from padded ids and their mask to logits.  batch_tokens is
    the width of the batch that a row was in, so its sum is what the model read.  A null text is an
    empty one; keys may be null or repeated, each row has its answer; an empty table has none.
    Scores don't depend on the order of rows as long as the model reads no more than the mask allows.
    """
    names = [key, *[prefix + k for k in ("neg", "neu", "pos", "compound")], "n_tokens", "batch_tokens"]
    schema = (f"`{key}` {df.schema[key].dataType.simpleString()}, "
              + ", ".join(f"`{c}` double" for c in names[1:5]) + ", n_tokens long, batch_tokens long")

    def run(it):
        encode, model = encoder and encoder(), factory()

        def answers(keys, ids):
            keys = pa.concat_arrays(keys)
            for rows in batches_of([len(x) for x in ids], budget):
                x, own = padded([ids[i] for i in rows])
                scores = _scores(np.asarray(model(x, own), dtype=float))
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(rows)), *[pa.array(scores[:, j]) for j in range(4)],
                     pa.array(own.sum(axis=1)), pa.array(np.full(len(rows), own.shape[1]))], names)

        keys, ids = [], []
        for batch in it:
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(i, ROWS_AT_ONCE)
                keys.append(part.column(0))
                if encode is None:
                    lists = part.column(1)
                    ids += [np.array(lists[i].values[:max_tokens], np.int32) for i in range(len(lists))]
                else:
                    ids += [np.array(x[:max_tokens], np.int32) for x in encode(part.column(1).to_pylist())]
                if len(ids) >= pool:
                    yield from answers(keys, ids)
                    keys, ids = [], []
        if ids:
            yield from answers(keys, ids)

    read = F.col("ids") if encoder is None else F.coalesce(F.col(text_col), F.lit(""))
    return df.select(key, read.alias("__read")).mapInArrow(run, schema)


def subword_weights(ids: DataFrame, label_col: str = "label") -> DataFrame:
    """(id, weight): add-one log-odds of each subword's occurrences in positive and negative texts.

    ids: label and ids.  Rows with other labels than 0 and 1 count nowhere."""
    y = F.col(label_col)
    counts = (ids.where(y.isin(0, 1)).select(y.alias("y"), F.explode("ids").alias("id")).groupBy("id")
              .agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q")))
    totals = counts.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"), F.count(F.lit(1)).alias("v"))
    odds = F.log((F.col("p") + 1) / (F.col("tp") + F.col("v"))) - F.log((F.col("q") + 1) / (F.col("tq") + F.col("v")))
    # totals: one row
    return counts.join(F.broadcast(totals)).select("id", odds.alias("weight"))


def weighted_subwords_factory(weights: dict[int, float], scale: float = K.BATCH_SCALE) -> Callable:
    """Logits (-s, 0, s) with s = scale * (sum of the weights of a row's ids) / sqrt(their number),
    by a table over the vocabulary; an unknown id weighs nothing."""
    def make():
        table = np.zeros(1 + max(weights, default=0))
        table[list(weights)] = list(weights.values())

        def predict(ids, own):
            known = own & (ids < len(table))
            s = np.where(known, table[np.where(known, ids, 0)], 0.0).sum(axis=1)
            s = scale * s / np.sqrt(np.maximum(1, own.sum(axis=1)))
            return np.stack([-s, np.zeros(len(s)), s], axis=1)
        return predict
    return make


def padding_report(scored: DataFrame, in_order: DataFrame, batch_size: int = K.SCORE_BATCH_SIZE) -> DataFrame:
    """One row: texts, tokens, padded_before (tokens read in batches of ``batch_size`` rows in the
    order of row_id), padded_after (in the batches that ``scored`` was made of).

    in_order: row_id from 0 without gaps, and n_tokens.
    """
    before = (in_order.groupBy(F.floor(F.col("row_id") / batch_size).alias("b"))
              .agg((F.max("n_tokens") * F.count(F.lit(1))).alias("read")).agg(F.sum("read").alias("padded_before")))
    after = scored.agg(F.count(F.lit(1)).alias("texts"), F.sum("n_tokens").alias("tokens"), F.sum("batch_tokens").alias("padded_after"))
    return after.join(F.broadcast(before))
