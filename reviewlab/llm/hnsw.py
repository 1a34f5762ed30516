"""Embedding near-dedup with hierarchical navigable small-world graphs, one per shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import packed, unpacked
from .components import components
from .store import written

#: Vectors in a shard at most (about); a label with more has several shards.
SHARD = 16_384
#: Links of a node in the upper layers; the lowest has twice as many.
LINKS = 12
#: Beam width while building, and the first one while searching.
BUILD_BEAM, BEAM = 48, 48
#: Nodes that a search opens at a time, and nodes inserted or queried together.
OPENED, TOGETHER = 4, 256
#: Queries audited at a time, the links that an audit must see and the share of them it must find.
AUDITED, ENOUGH, RECALL = 128, 500, 0.99
#: Beams double up to this width; wider searches compare with the whole shard.
WIDEST = 256


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Graph:
    """Layers of nodes linked to near ones; built and searched many nodes at a time."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray] | None = None):
        """vectors: unit rows.  layers: per layer a table of links (row of each node, -1: none), lowest first."""
        self.x, self.layers = np.ascontiguousarray(vectors, np.float32), layers
        if layers is None:
            self.build()

    def build(self) -> None:
        # rows come in random order (by hash), so every LINKS-th one is a random draw of the next
        # layer; row 0 is in all of them and every walk's entry
        n, depth = len(self.x), 1
        while LINKS ** depth < n:
            depth += 1
        self.layers = [np.full((n, LINKS * (2 if level == 0 else 1)), -1, np.int32) for level in range(depth)]
        done = 1
        while done < n:
            batch = np.arange(done, min(n, done + min(TOGETHER, done)))
            self.insert(batch, done)
            done = int(batch[-1]) + 1

    def insert(self, batch: np.ndarray, done: int) -> None:
        """Link a batch to the nodes before it and, as they come at once, to each other."""
        entry = np.zeros((len(batch), 1), np.int32)
        for level in range(len(self.layers) - 1, -1, -1):
            step = LINKS ** level
            rows = batch % step == 0
            if step >= done and level:
                # nothing but node 0 is there yet: every node of the batch may link to it and its mates
                found, sims = entry[:, :1], np.einsum("bd,bd->b", self.x[batch], self.x[entry[:, 0]])[:, None]
            else:
                found, sims = self.search(self.x[batch], entry, level, BUILD_BEAM if rows.any() else 1)
            if rows.any():
                own = batch[rows]
                mates = self.x[own] @ self.x[own].T
                np.fill_diagonal(mates, -2)
                near = np.argsort(-mates, axis=1)[:, :LINKS]
                ids = np.hstack([found[rows], own[near]])
                value = np.hstack([sims[rows], np.take_along_axis(mates, near, 1)])
                value[ids < 0] = -2
                ids = np.where(value <= -2, -1, ids)
                self.link(level, own, ids, value)
            entry = found
            if level and not rows.all():
                entry = found[:, :4]

    def diverse(self, ids: np.ndarray, value: np.ndarray, width: int) -> np.ndarray:
        """Up to width of each row's candidates: those nearer to the node than to any one taken
        before, then the nearest of the others."""
        order = np.argsort(-value, axis=1, kind="stable")
        ids, value = np.take_along_axis(ids, order, 1), np.take_along_axis(value, order, 1)
        b, c = ids.shape
        x = self.x[ids]
        among = x @ x.transpose(0, 2, 1)
        taken, count = np.zeros((b, c), bool), np.zeros(b, np.int32)
        repeat = np.zeros((b, c), bool)
        for t in range(c):
            closest = np.where(taken, among[:, t], -3).max(axis=1)
            repeat[:, t] = (ids[:, :t] == ids[:, t:t + 1]).any(axis=1)
            ok = (ids[:, t] >= 0) & ~repeat[:, t] & (value[:, t] > closest) & (count < width)
            taken[:, t] = ok
            count += ok
        rank = np.where(taken, 0, np.where((ids >= 0) & ~repeat, 1, 2))
        first = np.argsort(rank, axis=1, kind="stable")[:, :width]
        out = np.where(np.take_along_axis(rank, first, 1) < 2, np.take_along_axis(ids, first, 1), -1)
        return np.pad(out, ((0, 0), (0, max(0, width - out.shape[1]))), constant_values=-1)

    def link(self, level: int, nodes: np.ndarray, ids: np.ndarray, value: np.ndarray) -> None:
        table = self.layers[level]
        chosen = self.diverse(ids, value, LINKS)
        table[nodes, :LINKS] = chosen
        source, target = np.repeat(nodes, LINKS), chosen.reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        place = np.arange(len(target)) - np.searchsorted(target, target)
        for r in range(0, int(place.max(initial=-1)) + 1, 8):
            now = (place >= r) & (place < r + 8)
            hubs, at = np.unique(target[now], return_inverse=True)
            more = np.full((len(hubs), 8), -1, np.int32)
            more[at, place[now] - r] = source[now]
            cand = np.hstack([table[hubs], more])
            sims = np.einsum("bcd,bd->bc", self.x[cand], self.x[hubs])
            sims[(cand < 0) | (cand == hubs[:, None])] = -2
            table[hubs] = self.diverse(np.where(sims <= -2, -1, cand), sims, table.shape[1])

    def search(self, q: np.ndarray, entry: np.ndarray, level: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and similarities of the best `beam` nodes that a best-first walk of one layer meets, -1 where it met fewer."""
        table, b = self.layers[level], len(q)
        seen = np.zeros((b, len(self.x) + 1), bool)  # the last column takes missing nodes
        seen[:, -1] = True
        row = np.arange(b)[:, None]
        ids = np.full((b, beam), -1, np.int32)
        sims = np.full((b, beam), -2, np.float32)
        open_ = np.zeros((b, beam), bool)

        def add(act, new):
            fresh_ = ~seen[act[:, None], new]
            new = np.where(fresh_, new, -1)
            # the same node twice in a row counts once
            order = np.argsort(new, axis=1, kind="stable")
            new = np.take_along_axis(new, order, 1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            seen[act[:, None], new] = True
            s = np.einsum("bcd,bd->bc", self.x[new], q[act])
            s[new < 0] = -2
            both = np.hstack([sims[act], s])
            keep = np.argpartition(-both, beam - 1, axis=1)[:, :beam] if both.shape[1] > beam else np.argsort(-both, axis=1)
            ids[act] = np.take_along_axis(np.hstack([ids[act], new]), keep, 1)
            sims[act] = np.take_along_axis(both, keep, 1)
            open_[act] = np.take_along_axis(np.hstack([open_[act], new >= 0]), keep, 1) & (ids[act] >= 0)

        act = np.arange(b)
        add(act, entry.astype(np.int32))
        while True:
            act = act[open_[act].any(axis=1)]
            if not len(act):
                break
            w = min(OPENED, beam)
            rank = np.where(open_[act], sims[act], -3)
            best = np.argpartition(-rank, w - 1, axis=1)[:, :w]
            valid = np.take_along_axis(rank, best, 1) > -3
            nodes = np.where(valid, np.take_along_axis(ids[act], best, 1), -1)
            open_[act[:, None], best] = False
            near = np.where(nodes[:, :, None] >= 0, table[nodes], -1).reshape(len(act), -1)
            add(act, near)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def nearest(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.zeros((len(q), 1), np.int32)
        for level in range(len(self.layers) - 1, 0, -1):
            entry = self.search(q, entry, level, 4)[0]
        return self.search(q, entry, 0, beam)


class Search:
    """All links of queries into a shard: beams widen until an audit passes, and for each query
    until its last hit lies below the threshold; beyond WIDEST the whole shard is compared."""

    def __init__(self, graph: Graph, x: np.ndarray, threshold: float):
        self.graph, self.x, self.threshold, self.beam = graph, x, threshold, BEAM

    def whole(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = [np.nonzero(q[i:i + TOGETHER] @ self.x.T >= self.threshold) for i in range(0, len(q), TOGETHER)]
        return (np.concatenate([o[0] + i * TOGETHER for i, o in enumerate(out)] or [np.zeros(0, int)]), np.concatenate([o[1] for o in out] or [np.zeros(0, int)]))

    def links(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of every link found, cosines checked in double precision."""
        queries, nodes, left, beam = [], [], np.arange(len(q)), self.beam
        while len(left):
            if beam > WIDEST or beam >= len(self.x):
                a, b = self.whole(q[left])
                queries.append(left[a])
                nodes.append(b)
                break
            ids, sims = self.graph.nearest(q[left].astype(np.float32), beam)
            full = (ids[:, -1] >= 0) & (sims[:, -1] >= self.threshold - 1e-3)
            a, b = np.nonzero((ids >= 0) & (sims >= self.threshold - 1e-3) & ~full[:, None])
            i, j = left[a], ids[a, b]
            ok = np.einsum("nd,nd->n", q[i], self.x[j]) >= self.threshold
            queries.append(i[ok])
            nodes.append(j[ok].astype(np.int64))
            left, beam = left[full], beam * 2
        return np.concatenate(queries or [np.zeros(0, int)]), np.concatenate(nodes or [np.zeros(0, int)])

    def audit(self, q: np.ndarray, within: bool = False) -> None:
        """Widen until the links of audited queries are found.  AUDITED queries at a time, in random
        order, are compared with the whole shard until ENOUGH links are seen; if a quarter of the
        queries have fewer, all are compared.  Within the shard (the queries are its
        vectors) a vector's match with itself is no link."""
        order, at, true = np.random.default_rng(0).permutation(len(q)), 0, 0

        def counted(found: tuple, own: np.ndarray) -> int:
            return int((own[found[0]] != found[1]).sum()) if within else len(found[0])

        while true < ENOUGH and at < max(len(q) // 4, min(len(q), AUDITED)):
            own = order[at:at + AUDITED]
            true += counted(self.whole(q[own]), own)
            at += len(own)
        own = order[:at]
        if true < ENOUGH:
            self.beam = 2 * WIDEST
        while self.beam <= WIDEST and counted(self.links(q[own]), own) < RECALL * true:
            self.beam *= 2


def unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i and j in place; each node points to a smaller one or itself."""
    while True:
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93) -> DataFrame:
    """(key, n_links, component_id, kept), one row per input row.

    Rows link if their labels are equal and not null, their vectors have the same length and
    their cosine is at least the threshold.  Null, zero, empty, null-holding and
    non-finite vectors and null keys link with nothing and keep their own key as component.
    Equal vectors are searched for once and count as often as they occur.

    1. Each label is cut into shards by the hash of the key; a task builds each shard's graph,
    written to the shared folder.  2. Every two shards of a label meet in one task, in which
    the second's vectors query the first's graph.  A task passes on a count per vector and a
    forest of the links, never the links.  3. The forests' components.
    """
    spark = vectors.sparkSession
    of = F.col(vector).cast("array<double>")
    base = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), of.alias("v"))
    good = (F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0)
            & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    base = base.withColumn("ok", F.coalesce(good, F.lit(False)))
    same = written(base.where("ok").groupBy("label", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "vectors")
    shards = same.groupBy("label", F.size("v").alias("dim")).agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"))
    dealt = same.withColumn("dim", F.size("v")).join(shards, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("id"), "shards").cast("int"))

    def build(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.iloc[np.argsort(rows["mixed"].to_numpy(), kind="stable")]
        x = unit(np.stack(rows["v"].to_numpy()))
        graph = Graph(x)
        return pd.DataFrame({"label": [k[0]], "dim": [k[1]], "shard": [k[2]], "shards": [int(rows["shards"].iloc[0])], "graph": [packed(
            rows["id"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), x.reshape(-1), len(graph.layers), *[t.reshape(-1) for t in graph.layers])]})

    kind = vectors.schema[label].dataType.simpleString()
    index = written(dealt.withColumn("mixed", F.xxhash64("id", F.lit("order"))).groupBy("label", "dim", "shard")
                    .applyInPandas(build, f"label {kind}, dim int, shard int, shards int, graph binary"), "graphs")

    def opened(data: bytes, dim: int):
        ids, n, x, depth, *tables = unpacked(data)
        return ids, n, x.reshape(-1, dim), [t.reshape(len(ids), -1) for t in tables]

    def meet(k: tuple, ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        ids, n, x, layers = opened(ours["graph"].iloc[0], k[1])
        within = k[2] == k[3]
        search = Search(Graph(x, layers), x, threshold)
        qids, qn, q = (ids, n, x) if within else opened(theirs["graph"].iloc[0], k[1])[:3]
        search.audit(q, within)
        every = np.concatenate([ids] if within else [ids, qids])
        order = np.argsort(every, kind="stable")  # the smallest id of a set is its root
        rank = np.empty(len(every), np.int64)
        rank[order] = np.arange(len(every))
        count, parent = np.zeros(len(every), np.int64), np.arange(len(every))
        shift = 0 if within else len(ids)
        weight = np.concatenate([n] if within else [n, qn])
        for s in range(0, len(q), 1024):
            i, j = search.links(q[s:s + 1024])
            i = i + s + shift
            if within:
                i, j = i[i != j], j[i != j]
            np.add.at(count, i, weight[j])
            if not within:
                np.add.at(count, j, weight[i])
            unite(parent, rank[i], rank[j])
        every, count = every[order], count[order]
        linked = np.flatnonzero(count)
        return pd.DataFrame({"id": every[linked], "n_links": count[linked], "root": every[parent[linked]]})

    left = index.select("label", "dim", F.col("shard").alias("a"), F.explode(F.sequence("shard", F.col("shards") - 1)).alias("b"), "graph")
    right = index.select("label", "dim", F.explode(F.sequence(F.lit(0), "shard")).alias("a"), F.col("shard").alias("b"), F.when(F.col("a") < F.col("b"), F.col("graph")).alias("graph"))
    met = written(left.groupBy("label", "dim", "a", "b").cogroup(right.groupBy("label", "dim", "a", "b"))
                  .applyInPandas(meet, "id long, n_links long, root long"), "links")
    roots = components(met.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")))
    links = met.groupBy("id").agg(F.sum("n_links").alias("far"))
    of_rep = (same.select("label", "v", F.col("id").alias("rep"), "n").join(links, F.col("rep") == links.id, "left").drop("id")
              .join(roots, F.col("rep") == F.col("node"), "left"))
    # links found one way only inside a shard may be missed the other way; both ends count what they found
    return (base.join(of_rep, ["label", "v"], "left")
            .select(F.col("id").alias(key),
                    F.when(F.col("ok"), F.coalesce("far", F.lit(0)) + F.col("n") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("ok"), F.coalesce("root", "rep")).otherwise(F.col("id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True))))
