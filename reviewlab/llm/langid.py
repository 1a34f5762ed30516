"""Language identification with blended-spectrum n-gram presence kernels."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lengths of the byte n-grams whose presence the kernel compares.
ORDERS = (1, 2, 3)
#: Bound of the labelled rows used to fit, in all and for each language.
FIT_ROWS, FIT_ROWS_EACH = 12_000, 800
#: Bound of the landmarks, in all and for each language.
LANDMARKS, LANDMARKS_EACH = 512, 24
#: Landmarks are taken from texts up to this length while there are any.
LANDMARK_CHARS = 20_000
RIDGE = 1e-3
#: Texts per matrix product.
ROWS = 64

UNDETERMINED = "und"


def codes(text: str) -> np.ndarray:
    """Numbers of all n-grams of the lower-cased text's bytes, repeats included."""
    b = np.frombuffer(text.lower().encode(), np.uint8).astype(np.int32)
    out, base, code = [], 0, np.zeros(len(b), np.int32)
    for n in range(1, max(ORDERS) + 1):
        code = (code[: len(b) - n + 1] << 8) | b[n - 1:] if len(b) >= n else b[:0]
        if n in ORDERS:
            out.append(code + base)
        base += 256 ** n
    return np.concatenate(out)


@dataclass(frozen=True)
class Model:
    """langs; alphabet: codes of the landmarks' n-grams; landmarks: their presence (m x alphabet);
    weights (m x langs): kernel values to scores, the Nyström map folded in."""

    langs: tuple
    alphabet: bytes
    landmarks: bytes
    weights: bytes


@lru_cache(maxsize=2)
def unfolded(alphabet: bytes, landmarks: bytes) -> tuple:
    grams = np.frombuffer(alphabet, np.int32)
    place = np.full(sum(256 ** n for n in range(1, max(ORDERS) + 1)), -1, np.int32)
    place[grams] = np.arange(len(grams), dtype=np.int32)
    known = np.unpackbits(np.frombuffer(landmarks, np.uint8)).reshape(-1, -(-len(grams) // 8) * 8)[:, : len(grams)].astype(np.float32)
    return place, known, np.sqrt(known.sum(axis=1))


def kernel(texts: list[str], alphabet: bytes, landmarks: bytes) -> np.ndarray:
    """Normalised kernel of texts with landmarks: shared n-grams of the alphabet over the
    geometric mean of both counts; whole texts, ROWS at a time in one matrix product."""
    place, known, norm = unfolded(alphabet, landmarks)
    out = np.zeros((len(texts), len(known)), np.float32)
    for s in range(0, len(texts), ROWS):
        some = texts[s:s + ROWS]
        present = np.zeros((len(some), known.shape[1] + 1), np.float32)
        for row, text in zip(present, some):
            row[place[codes(text)]] = 1  # unknown n-grams fall on the last column
        present = present[:, :-1]
        out[s:s + ROWS] = present @ known.T / np.maximum(1e-9, np.sqrt(present.sum(axis=1))[:, None] * norm)
    return out


def sample(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """At most FIT_ROWS_EACH documents a language, by the hash of their key."""
    ids = docs.where(F.col(text).rlike(r"\p{L}") & F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("lang"), (F.length(text) > LANDMARK_CHARS).alias("long"), F.xxhash64(key).alias("h"))
    each = Window.partitionBy("lang").orderBy("h", "k")
    return ids.withColumn("n", F.row_number().over(each)).where(F.col("n") <= FIT_ROWS_EACH)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """One-versus-rest kernel ridge regression on a Nyström map, from a bounded sample.

    The sample holds up to FIT_ROWS_EACH documents of each language and FIT_ROWS in all,
    chosen by the hash of the key; landmarks are its first documents of each language.
    Null texts, texts without letters and null languages are left out; None if nothing is left.
    """
    spark = docs.sparkSession
    chosen = sample(docs, key, text, lang).collect()
    langs = sorted({r.lang for r in chosen})
    if not langs:
        return None
    each, marks = max(1, FIT_ROWS // len(langs)), max(1, LANDMARKS // len(langs))
    rank, picked = {}, []
    for r in sorted(chosen, key=lambda r: (r.long, r.n)):
        rank[r.lang] = rank.get(r.lang, 0) + 1
        if rank[r.lang] <= each:
            picked.append((r.k, r.lang, rank[r.lang] <= min(marks, LANDMARKS_EACH)))
    own_rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    rows = own_rows.join(F.broadcast(spark.createDataFrame(picked, "picked long, of string, mark boolean")), F.col("k") == F.col("picked")).where("l = of")
    texts = [r[0] for r in rows.where("mark").select("t").collect()]
    sets = [np.unique(codes(t)) for t in texts]
    grams = np.unique(np.concatenate(sets)).astype(np.int32)
    known = np.zeros((len(sets), len(grams)), bool)
    for row, s in zip(known, sets):
        row[np.searchsorted(grams, s)] = True
    alphabet, landmarks = grams.tobytes(), np.packbits(known, axis=1).tobytes()

    def features(batches):
        for batch in batches:
            k = kernel(batch.column(0).to_pylist(), alphabet, landmarks)
            yield pa.RecordBatch.from_arrays([pa.array(list(k), pa.list_(pa.float32())), batch.column(1)], names=["k", "lang"])

    sampled = rows.select("t", F.col("of").alias("l")).mapInArrow(features, "k array<float>, lang string").toPandas()
    k = np.stack(sampled["k"].to_numpy()).astype(np.float64)
    bits = known.astype(np.float64)
    own = bits @ bits.T / np.sqrt(np.outer(bits.sum(axis=1), bits.sum(axis=1)))
    value, vector = np.linalg.eigh(own)
    good = value > 1e-8 * value.max()
    root = vector[:, good] / np.sqrt(value[good])  # Nyström: kernel values to features
    phi = np.c_[k @ root, np.ones(len(k))]
    y = np.where(sampled["lang"].to_numpy()[:, None] == np.array(langs, dtype=object)[None, :], 1.0, -1.0)
    # rows weigh so that each language has the same say
    weight = 1 / np.maximum(1, (y > 0).sum(axis=0))[(y > 0).argmax(axis=1)]
    gram = phi.T @ (phi * weight[:, None]) + RIDGE * np.eye(phi.shape[1]) * weight.sum() / len(phi)
    solved = np.linalg.solve(gram, phi.T @ (y * weight[:, None]))
    return Model(tuple(langs), alphabet, landmarks, np.vstack([root @ solved[:-1], solved[-1:]]).tobytes())


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of each row: the language with the highest score, of equals the
    first by name, and (1 + that score) / 2 held within 0 and 1.

    Null texts and texts without letters, or any text without a model, get `und` and 0.
    """
    def task(batches):
        weights = np.frombuffer(model.weights).reshape(-1, len(model.langs)) if model else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            known = [i for i, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
            pred, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            if known:
                k = kernel([texts[i] for i in known], model.alphabet, model.landmarks)
                values = k @ weights[:-1] + weights[-1]
                for i, best, value in zip(known, values.argmax(axis=1).tolist(), values.max(axis=1).tolist()):
                    pred[i], score[i] = model.langs[best], min(1.0, max(0.0, (1 + value) / 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["k", "lang_pred", "score"])

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(task, "k long, lang_pred string, score double").withColumnRenamed("k", key)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))
