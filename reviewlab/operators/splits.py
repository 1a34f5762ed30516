"""Seeded shuffles, train/test split, stratified folds and hold-outs.

Every random choice is a keyed md5 draw, so Spark and SQL agree and reruns
are stable.  Ranks inside a class are computed without a one-partition
window: rows are counted per range of the draw, and the counts (a table of
ranges x classes) become offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.dialect import SPARK
from ..sources.tables import dense_rank_by, partitions, with_split


def draw(seed, key: str = "doc_id"):
    """md5 draw as a bigint in [0, 2^32)."""
    return F.expr(SPARK.hex8(f"concat('{seed}:', CAST({key} AS STRING))"))


def shuffle_rows(df: DataFrame, seed: int = K.SHUFFLE_SEED, key: str = "doc_id") -> DataFrame:
    """Rows in a seeded random order: sort by (draw, key)."""
    return df.withColumn("shuffle_key", draw(seed, key)).orderBy("shuffle_key", key)


def train_test_split(df: DataFrame, seed: int = K.SHUFFLE_SEED) -> DataFrame:
    return with_split(df, seed)


def rank_within(df: DataFrame, group_cols, draw_col: str, tie_cols, out: str = "rank") -> DataFrame:
    """0-based rank of each row inside its group, by a draw in [0, 2^32) and then tie_cols.

    The draw is uniform, so its leading part spreads even a group that holds
    most rows over as many ranges as there are shuffle partitions.
    """
    parts = partitions(df.sparkSession)
    part = F.floor(F.col(draw_col) * parts / float(1 << 32)).cast("int")
    return dense_rank_by(df, part, group_cols, [draw_col, *tie_cols], out)


def stratified_folds(train: DataFrame, k: int = K.N_FOLDS, seed: int = K.SHUFFLE_SEED,
                     label_col: str = "label", key: str = "doc_id") -> DataFrame:
    """fold = (rank inside the class by a keyed draw) mod k: class shares
    of any two folds differ by at most one row."""
    d = train.withColumn("__d", draw(f"fold{seed}", key))
    r = rank_within(d, [label_col], "__d", [key], "__r")
    return r.withColumn("fold", (F.col("__r") % k).cast("int")).drop("__d", "__r")


def stratified_holdout(train: DataFrame, seeds=range(K.N_FOLDS), label_col: str = "label",
                       key: str = "doc_id", test_share_buckets: int = 5) -> DataFrame:
    """Repeated stratified 80/20 hold-outs; seed s ranks each class by its
    own draw and sends every fifth row to validation."""
    seeds = [int(s) for s in seeds]
    allp = (train.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
            .withColumn("__d", F.expr(SPARK.hex8("concat('holdout', CAST(seed AS STRING), ':', CAST(" + key + " AS STRING))"))))
    r = rank_within(allp, ["seed", label_col], "__d", [key], "__r")
    return r.withColumn("role", F.when(F.col("__r") % test_share_buckets == 0, F.lit("validation"))
                        .otherwise(F.lit("fit"))).drop("__d", "__r")
