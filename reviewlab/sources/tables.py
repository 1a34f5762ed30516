"""Scans, splits and sinks of the review tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.dialect import SPARK, keyed_bucket, keyed_unit

SCHEMAS = {
    "documents": T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType())]),
    "labels": T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
        T.StructField("toxic", T.IntegerType())]),
    "conversations": T.StructType([
        T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]),
    "embeddings": T.StructType([
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType())]),
    "benchmark": T.StructType([
        T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())]),
    "pages": T.StructType([
        T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType())]),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan with an explicit schema (no inference)."""
    r = spark.read
    if name in SCHEMAS:
        r = r.schema(SCHEMAS[name])
    return r.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scan_reviews(spark: SparkSession, sf_dir: str, label_col: str = "quality", how: str = "inner") -> DataFrame:
    """Documents joined to their label, keyed by doc_id; how='left' keeps
    the unlabelled ones with a null label."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = load(spark, sf_dir, "labels").select("doc_id", F.col(label_col).alias("label"))
    return docs.join(labels, "doc_id", how)


def split_expr(seed: int = K.SHUFFLE_SEED, buckets: int = K.TEST_BUCKETS) -> Column:
    """'test' for one keyed-hash bucket of five, else 'train' (80/20, no sort)."""
    b = F.expr(keyed_bucket(SPARK, seed, "doc_id", buckets))
    return F.when(b == 0, F.lit("test")).otherwise(F.lit("train"))


def with_split(reviews: DataFrame, seed: int = K.SHUFFLE_SEED) -> DataFrame:
    return reviews.withColumn("split", split_expr(seed))


def list_splits(reviews: DataFrame) -> DataFrame:
    return (with_split(reviews).groupBy("split")
            .agg(F.count(F.lit(1)).alias("n_rows")))


def select_split(reviews: DataFrame, name: str) -> DataFrame:
    return with_split(reviews).where(F.col("split") == name)


def concat_splits(*splits: DataFrame) -> DataFrame:
    out = splits[0]
    for s in splits[1:]:
        out = out.unionByName(s)
    return out


BORDER_SAMPLE = 100     # values looked at per range when borders are chosen


def range_number(df: DataFrame, col: str, ranges: int) -> Column:
    """Number of the key range each value of col falls in (nulls in 0), never falling as the value rises.

    The borders come from a bounded sample (the values with the smallest
    hashes, BORDER_SAMPLE a range) collected once, so every reader of the
    expression sees the same ones.
    """
    c = F.col(col)
    sample = (df.select(c).where(c.isNotNull()).orderBy(F.xxhash64(c)).limit(BORDER_SAMPLE * ranges)
              .orderBy(c).collect())
    step = max(1, len(sample) // ranges)
    borders = [r[0] for r in sample[step::step]]
    if not borders:
        return F.lit(0)
    limits = F.array(*[F.lit(b).cast(df.schema[col].dataType) for b in borders])
    return F.when(c.isNull(), F.lit(0)).otherwise(F.size(F.filter(limits, lambda b: b <= c)))


def dense_rank_by(df: DataFrame, part: Column, group_cols, order_cols, out: str) -> DataFrame:
    """0-based row number inside each group in the order of order_cols.

    part numbers the rows' ranges and is a function of the row alone, so the
    rows and the counts per range, which become the ranges' offsets, agree
    whatever plan each of them gets.  No task holds more than one range.
    """
    group_cols, order_cols = list(group_cols), list(order_cols)
    keyed = df.withColumn("__part", part)
    # the rank inside a range: ties in all order columns are told apart once, by the window
    local = keyed.withColumn("__local", F.row_number().over(Window.partitionBy("__part", *group_cols).orderBy(*order_cols)) - 1)
    counts = keyed.groupBy("__part", *group_cols).agg(F.count(F.lit(1)).alias("__n"))
    before = (Window.partitionBy(*group_cols) if group_cols else Window.partitionBy(F.lit(0))).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("__part").alias("__p"), *[F.col(g).alias(f"__g_{g}") for g in group_cols],
                            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    on = [F.col("__part") == F.col("__p")] + [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in group_cols]
    joined = local.join(offsets, on)
    return (joined.withColumn(out, (F.col("__off") + F.col("__local")).cast("bigint"))
            .drop("__part", "__local", "__off", "__p", *[f"__g_{g}" for g in group_cols]))


def assign_row_id(df: DataFrame, order_col: str = "doc_id", id_col: str = "row_id") -> DataFrame:
    """Dense 0-based row ids in key order (nulls first) without a single-partition window."""
    return dense_rank_by(df, range_number(df, order_col, partitions(df.sparkSession)), [], [order_col], id_col)


def preview_rows(df: DataFrame, n: int = 5, order_col: str = "doc_id") -> DataFrame:
    """The first n rows in key order (a top-n, not a full sort)."""
    return df.orderBy(order_col).limit(n)


def sample_order(seed: int | str, key: str = "doc_id") -> Column:
    return F.expr(keyed_unit(SPARK, seed, key))


def sample_n(df: DataFrame, n: int = K.SAMPLE_N, seed: int = K.SEARCH_SEED, key: str = "doc_id") -> DataFrame:
    """n rows drawn without replacement by a keyed hash: the n smallest draws."""
    return (df.withColumn("__u", sample_order(seed, key))
            .orderBy("__u", key).limit(n).drop("__u"))


def load_documents(df: DataFrame, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, content, metadata map of every other column as strings)."""
    others = [c for c in df.columns if c not in (text_col,)]
    names = F.array(*[F.lit(c) for c in others])
    values = F.array(*[F.col(c).cast("string") for c in others])
    return df.select(key, F.col(text_col).alias("content"),
                     F.map_from_arrays(names, values).alias("metadata"))


def write_vector_table(df: DataFrame, path: str, bucket_col: str = "bucket") -> DataFrame:
    """Persist chunk vectors partitioned by bucket and read them back."""
    df.write.mode("overwrite").partitionBy(bucket_col).parquet(path)
    return df.sparkSession.read.parquet(path)
