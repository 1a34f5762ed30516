"""Trained inverted file with product-quantised residuals.

Cells and codebooks are trained on a bounded sample; every vector is stored as its cell and one
byte per subspace.  A question reads the codes of its nearest cells, scores them by table
look-ups, and the best few are ranked again by their vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..session import written
from .retrieval import _unit, top_k

#: Vectors that cells and codes are trained on at most, cells at most, codes of a subspace, rounds of k-means.
SAMPLE, CELLS, CODES, ROUNDS = 16_384, 1024, 256, 8
#: Dimensions of a subspace.
WIDTH = 4
#: Coded rows, and questions, that meet in a task.
BLOCK, QUESTIONS = 65_536, 1024
#: Copies of questions, one for each cell to read, that are made at once.
COPIES = 4096
#: Candidates ranked by their vectors, per wanted row.
AGAIN = 20
#: Share of the exact nearest that an audit of so many questions must find before its number of cells is taken.
RECALL, AUDITED = 0.95, 256


def clustered(x: np.ndarray, number: int) -> np.ndarray:
    """Centres by Lloyd's rounds; begun with rows spread over the (hash-ordered) sample, empty ones stay."""
    c = x[np.linspace(0, len(x) - 1, min(number, len(x))).astype(int)].copy()
    for _ in range(ROUNDS):
        near = nearest(x, c, 1)[:, 0]
        size = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n nearest centres of each row, nearest first."""
    out = np.empty((len(x), min(n, len(c))), np.int64)
    for s in range(0, len(x), 4096):
        far = (c * c).sum(axis=1) - 2 * x[s:s + 4096] @ c.T
        out[s:s + 4096] = np.argsort(far, axis=1, kind="stable")[:, :n]
    return out


@dataclass
class Trained:
    """Cells, and a codebook per subspace of the residuals: a few megabytes, whatever the table's size."""

    cells: np.ndarray
    books: list

    @classmethod
    def of(cls, vectors: np.ndarray, cells: int) -> "Trained":
        x = _unit(vectors)
        centre = clustered(x, cells)
        rest = x - centre[nearest(x, centre, 1)[:, 0]]
        return cls(centre, [clustered(rest[:, d:d + WIDTH], CODES) for d in range(0, x.shape[1], WIDTH)])

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(x, self.cells, 1)[:, 0]
        rest = x - self.cells[cell]
        return cell, np.stack([nearest(rest[:, i * WIDTH:(i + 1) * WIDTH], b, 1)[:, 0] for i, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def scores(self, questions: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Inner products with the coded rows of a cell, from tables of a product per code."""
        out = np.repeat((questions @ self.cells[cell])[:, None], len(codes), axis=1)
        for i, b in enumerate(self.books):
            out += (questions[:, i * WIDTH:(i + 1) * WIDTH] @ b.T)[:, codes[:, i]]
        return out


@dataclass
class Index:
    trained: Trained
    blocks: DataFrame       # (cell, block, blocks, key list, codes)
    vectors: DataFrame      # (key, vector), unit
    key: str


def build(table: DataFrame, key: str = "vec_id", vec: str = "embedding", cells: int | None = None) -> Index:
    """Index of all rows with a vector; needs no labels.  Equal lengths are required, an empty table has no cells."""
    vectors = written(table.where(F.col(vec).isNotNull()).select(F.col(key), F.col(vec).cast("array<double>").alias("v")), "index-vectors")
    sample = vectors.orderBy(F.xxhash64(key, F.lit("train")), key).limit(SAMPLE).select("v").collect()
    n = vectors.count()
    trained = Trained.of(np.array([r[0] for r in sample], float), cells or max(1, min(CELLS, int(math.sqrt(n))))) if n else None
    kind = table.schema[key].dataType.simpleString()

    def code(batches):
        for b in batches:
            if len(b):
                cell, codes = trained.coded(_unit(np.stack(b["v"].to_numpy())))
                yield pd.DataFrame({"key": b[key], "cell": cell.astype(np.int32), "code": [c.tobytes() for c in codes]})
    coded = written(vectors.mapInPandas(code, f"key {kind}, cell int, code binary"), "index-codes")
    sizes = coded.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = coded.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))

    def pack(k: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key", kind="stable")
        return pd.DataFrame({"cell": [k[0]], "block": [k[1]], "blocks": [int(part["blocks"].iloc[0])], "keys": [part["key"].tolist()], "codes": [b"".join(part["code"])]})
    blocks = dealt.groupBy("cell", "block").applyInPandas(pack, f"cell int, block int, blocks int, keys array<{kind}>, codes binary")
    return Index(trained, written(blocks, "index-blocks"), vectors, key)


def copies(b: pd.DataFrame, cell: np.ndarray) -> Iterator[pd.DataFrame]:
    """A row of b (q, v) for each of its cells, at most COPIES rows at once however many cells are read."""
    some = max(1, COPIES // cell.shape[1])
    for s in range(0, len(b), some):
        for t in range(0, cell.shape[1], COPIES):
            part, of = b.iloc[s:s + some], cell[s:s + some, t:t + COPIES]
            yield pd.DataFrame({"q": np.repeat(part["q"].to_numpy(), of.shape[1]), "v": np.repeat(part["v"].to_numpy(), of.shape[1]), "cell": of.reshape(-1).astype(np.int32)})


def candidates(questions: DataFrame, index: Index, probes: int, wanted: int, itself: bool) -> DataFrame:
    """(q, key): the `wanted` best rows of each question's nearest cells by their codes.

    questions: (q, v), unit vectors.  Questions are grouped by cell, a group and a block of the cell's codes meet in a task.
    """
    trained = index.trained
    q_kind, kind = questions.schema["q"].dataType.simpleString(), index.vectors.schema[index.key].dataType.simpleString()

    def probed(batches):
        for b in batches:
            if len(b):
                cell = nearest(np.stack(b["v"].to_numpy()), trained.cells, probes)
                yield from copies(b, cell)
    asked = questions.mapInPandas(probed, f"q {q_kind}, v array<double>, cell int")
    groups = max(1, math.ceil(questions.count() / QUESTIONS))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int")).join(index.blocks.select("cell", "blocks").distinct(), "cell")
    left = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    right = index.blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def scored(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(ours) or not len(theirs):
            return pd.DataFrame(columns=["q", "key", "score"])
        keys = np.array(list(theirs["keys"].iloc[0]), dtype=object)
        codes = np.frombuffer(theirs["codes"].iloc[0], np.uint8).reshape(len(keys), -1)
        q, x, out = ours["q"].to_numpy(dtype=object), np.stack(ours["v"].to_numpy()), []
        for s in range(0, len(q), 64):
            score = trained.scores(x[s:s + 64], int(theirs["cell"].iloc[0]), codes)
            if itself:
                score[q[s:s + 64, None] == keys[None, :]] = -np.inf
            n = min(wanted, score.shape[1])
            i = np.repeat(np.arange(len(score)), n)
            j = np.argpartition(-score, n - 1, axis=1)[:, :n].reshape(-1)
            out.append(pd.DataFrame({"q": q[s + i], "key": keys[j], "score": score[i, j]}))
        return pd.concat(out)
    found = left.groupBy("cell", "block", "part").cogroup(right.groupBy("cell", "block", "part")).applyInPandas(scored, f"q {q_kind}, key {kind}, score double")
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "key"))
    return found.where(F.col("score") > float("-inf")).withColumn("n", best).where(F.col("n") <= wanted).select("q", "key")


def ranked(questions: DataFrame, index: Index, probes: int, k: int, itself: bool) -> DataFrame:
    some = candidates(questions, index, probes, AGAIN * k, itself).join(questions, "q").join(index.vectors.select(F.col(index.key).alias("key"), F.col("v").alias("x")), "key")

    def exact(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"q": b["q"], "key": b["key"], "score": (np.stack(b["v"].to_numpy()) * _unit(np.stack(b["x"].to_numpy()))).sum(axis=1)})
    schema = f"q {questions.schema['q'].dataType.simpleString()}, key {index.vectors.schema[index.key].dataType.simpleString()}, score double"
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "key"))
    return some.mapInPandas(exact, schema).withColumn("rank", place).where(F.col("rank") <= k)


def search(queries: DataFrame, index: Index, k: int = K.TOP_K, q_key: str = "query_id", vec: str = "embedding", other_than_self: bool = True,
           probes: int | None = None) -> DataFrame:
    """(q_key, rank, key, score): about the k nearest rows (cosine) of each question.

    Without `probes` the number of cells read is doubled, from one in 64 of them, until an audit of AUDITED questions (by
    hash) finds RECALL of their exact nearest; read whole, the index still ranks by codes first.  Fewer than k rows come back only
    where the cells read hold fewer.  Questions without a vector find nothing.
    """
    def unit(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"q": b["q"], "v": list(_unit(np.stack(b["v"].to_numpy())))})
    kind = queries.schema[q_key].dataType.simpleString()
    asked = queries.where(F.col(vec).isNotNull()).select(F.col(q_key).alias("q"), F.col(vec).cast("array<double>").alias("v"))
    asked = written(asked.mapInPandas(unit, f"q {kind}, v array<double>"), "index-questions")
    if index.trained is None:
        return asked.select(F.col("q").alias(q_key), F.lit(0).alias("rank"), F.lit(None).cast(index.vectors.schema[index.key].dataType).alias(index.key), F.lit(0.0).alias("score")).limit(0)
    cells = len(index.trained.cells)
    if probes is None:
        some = written(asked.orderBy(F.xxhash64("q", F.lit("audit")), "q").limit(AUDITED), "audited")
        true = written(top_k(some, index.vectors, k, "q", (index.key,), "v", other_than_self=other_than_self).select("q", F.col(index.key).alias("key")), "audit-exact")
        due, probes = true.count(), max(1, cells // 64)
        while probes < cells and ranked(some, index, probes, k, other_than_self).select("q", "key").join(true, ["q", "key"]).count() < RECALL * due:
            probes = min(cells, 2 * probes)
    return ranked(asked, index, probes, k, other_than_self).select(F.col("q").alias(q_key), "rank", F.col("key").alias(index.key), "score")
