"""Hard negatives by exact search over candidate lists that clusters of anchors share.

Anchors are clustered by angle.  For one cluster, centre c and widest angle t
between c and a member, no member a scores above |a| |x| cos(max(0, angle(x, c) - t))
with a candidate x.  Candidates are sorted by that bound once for the cluster and
every member walks down the list until what is left cannot enter its result.
The list of a cluster is cut into bounded shards, each walked in a task of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import packed, unpacked
from .store import written

#: Rows of a shard of candidates, and anchors of one cluster that meet it in a task.
SHARD, BLOCK = 16_384, 1024
#: Candidates of a list compared at a time.
STRIDE = 512
#: Anchors that centres are fitted on (by hash), anchors a centre at least, and centres at most.
SAMPLE, PER_CENTRE, CENTRES = 4096, 64, 256
LEAST = np.iinfo(np.int64).min


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def centres(x: np.ndarray, number: int, rounds: int = 8) -> np.ndarray:
    """Directions by spherical k-means from the first rows."""
    x = unit(x)
    c = x[:number].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where((total != 0).any(axis=1, keepdims=True), unit(total), c)
    return c


def scores_of(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products, as floats where their sums fit 53 bits."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1]
    if top < 2 ** 53:
        return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ x.astype(np.int64).T


class List:
    """A cluster's candidates in the order of their bound."""

    def __init__(self, anchors: np.ndarray, x: np.ndarray):
        a = unit(anchors)
        centre = unit(a.sum(axis=0, keepdims=True))[0]
        size = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        widest = np.arccos(np.clip(a @ centre, -1, 1)).max(initial=0) if centre.any() else np.pi
        angle = np.arccos(np.clip(unit(x) @ centre, -1, 1))
        bound = size * np.cos(np.maximum(0, angle - widest))
        self.order = np.argsort(-bound, kind="stable")
        self.bound = bound[self.order]
        self.reach = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1))
        self.slack = 1e-7 * self.reach * size.max(initial=0) + 1e-6  # of rounding

    def beyond(self, at: int, of: np.ndarray) -> np.ndarray:
        """What members `of` score at most from place `at` on."""
        return self.reach[of] * self.bound[at] + self.slack[of]


def walk(anchors: np.ndarray, x: np.ndarray, ids: np.ndarray, fits, of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
    """For each wish the k best candidates with low <= score <= high: (wish, candidate, score), and candidates compared.

    A wish is one of an anchor's (of: its number).  fits(wishes, candidates) tells which may be taken.  Higher scores come first, ties by
    smaller id.  A wish ends once its k-th score, or its low, is above all that is left.
    """
    shared = List(anchors, x)
    wishes = np.flatnonzero(low <= high)
    found = [np.empty(0, np.int64)] * 3
    kth = np.full(len(of), LEAST)
    seen = 0
    for at in range(0, len(x), STRIDE):
        top = shared.beyond(at, of[wishes])
        wishes = wishes[(top >= low[wishes]) & (top >= kth[wishes])]
        if not len(wishes):
            break
        some = shared.order[at:at + STRIDE]
        members, place = np.unique(of[wishes], return_inverse=True)
        seen += len(members) * len(some)
        score = scores_of(anchors[members], x[some])[place]
        good = (score >= np.maximum(low, kth)[wishes][:, None]) & (score <= high[wishes][:, None]) & fits(wishes, some)
        score = np.where(good, score, LEAST)
        if len(some) > k:  # no more than k of a stride (and ties) can enter
            good &= score >= np.partition(score, len(some) - k, axis=1)[:, len(some) - k][:, None]
        i, j = np.nonzero(good)
        if len(i):
            new = (wishes[i], some[j], score[i, j])
            wish, cand, value = (np.concatenate(p) for p in zip(found, new))
            order = np.lexsort((ids[cand], -value, wish))
            wish, cand, value = wish[order], cand[order], value[order]
            rank = np.arange(len(wish)) - np.searchsorted(wish, wish)
            kth[wish[rank == k - 1]] = value[rank == k - 1]
            found = [wish[rank < k], cand[rank < k], value[rank < k]]
    return *found, seen


def tight(x: np.ndarray) -> np.ndarray:
    top = int(np.abs(x).max(initial=0)) if x.min(initial=0) > LEAST else 2 ** 62
    return x.astype(np.int16 if top < 2 ** 15 else np.int32 if top < 2 ** 31 else np.int64)


def dealt(rows: DataFrame, group: list[str], size: int) -> DataFrame:
    """rows (with a column cluster) with number, in [0, total) within the group: of blocks of one cluster and about size rows."""
    per = rows.groupBy(*group, "cluster").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))
    per = (per.withColumn("from", F.coalesce(F.sum("parts").over(W.partitionBy(*group).orderBy("cluster").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
           .withColumn("total", F.sum("parts").over(W.partitionBy(*group))))
    part = F.pmod(F.xxhash64("mark", F.lit("deal")), "parts")
    return rows.join(per, [*group, "cluster"]).withColumn("number", (F.col("from") + part).cast("int")).withColumn("total", F.col("total").cast("int"))


def blocks_of(rows: DataFrame, group: list[str], size: int, wishes: bool = False) -> DataFrame:
    """(*group, number, total, data): rows packed by block, written."""
    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        v = tight(np.stack(part["v"].to_numpy()).astype(np.int64))
        extra = []
        if wishes:
            size = part["positives"].map(len).to_numpy(np.int64)
            flat = [p for own in part["positives"] for p in own]
            extra = [size, np.array([p["id"] for p in flat], np.int64), np.array([p["score"] for p in flat], np.int64)]
        data = packed(part["id"].to_numpy(np.int64), part["mark"].to_numpy(np.int64), part["label"].to_numpy(np.int64), v.reshape(-1), *extra)
        return pd.DataFrame([[*key, int(part["total"].iloc[0]), data]], columns=[*group, "number", "total", "data"])
    kinds = ", ".join(f"{g} {rows.schema[g].dataType.simpleString()}" for g in group)
    return written(dealt(rows, group, size).groupBy(*group, "number").applyInPandas(pack, f"{kinds}, number int, total int, data binary"), "blocks")


def met(blocks: DataFrame, shards: DataFrame, group: list[str], meet, schema: str) -> DataFrame:
    """meet(blocks' row, shards' row) for each block and shard of a group, a pair a task's group."""
    ours, theirs = (t.groupBy(*group).agg(F.max("total").alias("others")) for t in (shards, blocks))
    left = blocks.join(ours, group).select(*group, F.col("number").alias("b"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("s"), "data")
    right = shards.join(theirs, group).select(*group, F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("b"), F.col("number").alias("s"), "data")
    names = [f.split()[0] for f in schema.split(", ")]

    def pair(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(ours) or not len(theirs):
            return pd.DataFrame(columns=names)
        return pd.DataFrame(dict(zip(names, meet(unpacked(ours["data"].iloc[0]), unpacked(theirs["data"].iloc[0])))))
    keys = [*group, "b", "s"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pair, schema)


def best_positives(k: int):
    """Each anchor's k best other rows of a shard of its label."""
    def meet(block, shard):
        aid, mark, _, a, *_ = block
        ids, marks, _, x = shard
        a, x = a.reshape(len(aid), -1), x.reshape(len(ids), -1)
        every = np.arange(len(aid))
        wish, cand, score, _ = walk(a, x, ids, lambda i, j: mark[i][:, None] != marks[j][None, :], every,
                                    np.full(len(aid), LEAST + 1), np.full(len(aid), np.iinfo(np.int64).max), k)
        return mark[wish], ids[cand], marks[cand], score
    return meet


def best_negatives(k: int, least: int, most: int):
    """For each anchor and positive the k best rows of a shard with another label and a score within shares of the positive's."""
    def meet(block, shard):
        aid, mark, label, a, size, pid, pscore = block
        ids, marks, labels, x = shard
        a, x = a.reshape(len(aid), -1), x.reshape(len(ids), -1)
        of = np.repeat(np.arange(len(aid)), size)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        wish, cand, score, _ = walk(a, x, ids, lambda i, j: label[of[i]][:, None] != labels[j][None, :], of,
                                    -(-least * pscore // 100), most * pscore // 100, k)
        return mark[of[wish]], aid[of[wish]], nth[wish], pid[wish], pscore[wish], ids[cand], marks[cand], score
    return meet


def quantised(vectors: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """(id, label, v, dim, mark) of the rows that take part, equal ones once; mark tells rows apart."""
    kind = vectors.schema[label].dataType.simpleString()
    code = F.col(label).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(F.col(label))
    base = vectors.where(F.col(label).isNotNull()).select(F.col(key).cast("long").alias("id"), code.alias("label"), F.col(vector).cast("array<double>").alias("v"))
    good = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    base = base.where(good).select("id", "label", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("long")).alias("v"))
    return base.groupBy("id", "label", "v").agg(F.first(F.size("v")).alias("dim")).withColumn("mark", F.xxhash64("id", "label", "v"))


def hard_negatives(vectors: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                   positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchor: condition on the key column (named as key).  Components become floor(scale * x); a score is the
    integer inner product with the anchor.  An anchor's positives are its best other rows of the same label, its negatives for each of them the
    best rows of other labels whose score is within [least, most] percent of the positive's.  Higher scores come first, ties
    by smaller key.

    The search is exact: a list is left only when the bound certifies that nothing below can enter.
    Rows with a null key, label or vector or with null or non-finite components take no part; equal rows count once, different rows of
    one key are rows of their own.  Only vectors of equal length are compared; empty and zero vectors score 0.  An empty table or one without
    anchors gives no rows; other columns are ignored, whatever their names.

    Centres are fitted on at most SAMPLE anchors; they order the search and change no result.  Positives are looked for in the shards
    of the label, negatives in all.  What passes between tasks are blocks of rows and k candidates per wish and shard.
    """
    rows = written(quantised(vectors, key, vector, label, scale), "quantised")
    chosen = rows.where(F.col("id").isNotNull()).withColumnRenamed("id", key).where(anchor).withColumnRenamed(key, "id")
    sample = chosen.orderBy(F.xxhash64("mark", F.lit("sample")), "mark").limit(SAMPLE).select("dim", "v").collect()
    total = chosen.count()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r["dim"], []).append(r["v"])
    wanted = max(1, min(CENTRES, total // PER_CENTRE))
    fitted = {d: centres(np.array(x, np.float64), min(wanted, len(x))) for d, x in by_dim.items() if d}

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series([int((fitted[len(x)] @ unit(np.asarray(x)[None])[0]).argmax()) if len(x) in fitted else 0 for x in v], dtype="int32")

    anchors = written(chosen.withColumn("cluster", nearest("v")), "anchors")
    plain = rows.withColumn("cluster", F.lit(0))
    own_labels = anchors.select("label", "dim").distinct()
    near = met(blocks_of(anchors, ["label", "dim"], BLOCK), blocks_of(plain.join(own_labels, ["label", "dim"], "left_semi"), ["label", "dim"], SHARD),
               ["label", "dim"], best_positives(positives), "mark long, id long, other long, score long")
    best = near.withColumn("rank", F.row_number().over(W.partitionBy("mark").orderBy(F.desc("score"), "id", "other"))).where(F.col("rank") <= positives)
    wishes = best.groupBy("mark").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))  # at most `positives` each
    asked = written(anchors.join(wishes, "mark"), "wishes")
    far = met(blocks_of(asked, ["dim"], BLOCK, wishes=True), blocks_of(plain, ["dim"], SHARD), ["dim"], best_negatives(negatives, least, most),
              "mark long, anchor_id long, nth long, positive_id long, positive_score long, negative_id long, other long, negative_score long")
    place = F.row_number().over(W.partitionBy("mark", "anchor_id", "nth").orderBy(F.desc("negative_score"), "negative_id", "other"))
    return (far.withColumn("rank", place.cast("int")).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
