"""Connected components by alternating large and small stars, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, fingerprint_of, growing, written


def large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it sees."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    low = written(low, "lowest")  # on its own, so that the join can split a node with very many edges
    return both.join(growing(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every node hands itself and its smaller neighbours to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(growing(low), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.select("u", F.col("m").alias("v")).unionAll(moved).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) of every node that an edge touches and that isn't its own root.

    root is the smallest node reachable; a node absent from the result is its
    own root.  Loops and repeated edges change nothing, nulls are ignored, no
    edges give no rows.  The two steps are repeated until the edges stand still
    (logarithmically many rounds), each round written to the shared folder.
    """
    e = (edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
         .where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col("u") != F.col("v"))).distinct()
         if (u, v) != ("u", "v") else
         edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    e = written(e, "edges")
    mark = fingerprint_of(e)
    while mark[0]:
        handed = large_star(e)
        e = written(small_star(handed), "edges")
        discard(handed)  # the edges before and their lowest nodes
        now = fingerprint_of(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
