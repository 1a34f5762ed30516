"""Descriptive aggregates: missing values, label counts, summaries, histograms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_counts(df: DataFrame, cols=None) -> DataFrame:
    """One row: number of nulls per column (n_missing_<col>)."""
    cols = cols or df.columns
    return df.agg(*[F.count_if(F.col(c).isNull()).cast("bigint").alias(f"n_missing_{c}") for c in cols])


def handle_missing(df: DataFrame, label_col: str = "label", text_col: str = "text") -> DataFrame:
    """Drop rows without a label, fill missing text with ''."""
    return df.na.drop(subset=[label_col]).na.fill({text_col: ""})


def encode_label(df: DataFrame, col: str, positive: str = "POSITIVE", out: str = "label") -> DataFrame:
    """String verdict -> 0/1 (1 iff equal to the positive name)."""
    return df.withColumn(out, (F.upper(F.col(col)) == F.lit(positive.upper())).cast("int"))


def filter_by_label(df: DataFrame, value: int, col: str = "label") -> DataFrame:
    return df.where(F.col(col) == value)


def label_distribution(df: DataFrame, col: str = "label") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(col)


def describe(df: DataFrame, col: str) -> DataFrame:
    """count, mean, sample std, min, quartiles, max of one numeric column.

    Quartiles are exact (linear interpolation).  Spark's exact percentile
    keeps one counter per distinct value, so for integer lengths its state
    is bounded by the largest length, not by the number of rows.
    """
    q = F.percentile(F.col(col).cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (df.agg(F.count(col).cast("bigint").alias("count"),
                   F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
                   F.min(col).cast("double").alias("min"), q.alias("__q"),
                   F.max(col).cast("double").alias("max"))
            .select("count", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min",
                    F.round(F.col("__q")[0], 6).alias("q25"), F.round(F.col("__q")[1], 6).alias("q50"),
                    F.round(F.col("__q")[2], 6).alias("q75"), "max"))


def histogram(df: DataFrame, col: str, bins: int = 100) -> DataFrame:
    """Equal-width histogram over [min, max] with every bin listed.

    (bin, bin_lo, bin_hi, n); the last bin is closed on the right; when
    all values are equal everything falls into bin 0.
    """
    x = F.col(col).cast("double")
    spark = df.sparkSession
    ends = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("e")).scalar()
    lo, width = ends.getField("lo"), ends.getField("hi") - ends.getField("lo")
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((x - lo) * bins / width), F.lit(bins - 1))).cast("int")
    counts = df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin",
                    F.round(lo + F.col("bin") * width / bins, 6).alias("bin_lo"),
                    F.round(lo + (F.col("bin") + 1) * width / bins, 6).alias("bin_hi"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))


#: A Poisson(1) weight counts those that 16 uniform bits reach (cumulative probabilities times 2^16).
POISSON_16 = [24109, 48219, 60273, 64291, 65296, 65497, 65531]
REPLICATES = 1000
DRAWS = 8       # weights that one md5 holds


def bootstrap_intervals(df: DataFrame, value_cols, group: str, key: str = "doc_id", replicates: int = REPLICATES) -> DataFrame:
    """(group, metric, ci_low, ci_high): the middle 95 % of the means of Poisson bootstrap replicates.

    A row's weight in a replicate comes from a hash of (key, replicate), so no row is copied and
    replicates are sums that add up over partitions: a row makes replicates / DRAWS partial sums,
    what is shuffled is one row per group and hash.  Null values are left out.
    """
    cols = list(value_cols)
    drawn = df.select(group, *[F.col(c).cast("double").alias(c) for c in cols], F.col(key).cast("string").alias("__key"),
                      F.explode(F.sequence(F.lit(0), F.lit(replicates // DRAWS - 1))).alias("__block"))
    code = F.md5(F.concat(F.lit("boot:"), F.coalesce("__key", F.lit("")), F.lit(":"), F.col("__block").cast("string")))
    bits = drawn.withColumn("__h", code).select(group, *cols, "__block", *[F.conv(F.substring("__h", 4 * j + 1, 4), 16, 10).cast("int").alias(f"__x{j}") for j in range(DRAWS)])
    weighed = bits.select(group, *cols, "__block", *[sum([(F.col(f"__x{j}") >= t).cast("int") for t in POISSON_16], F.lit(0)).alias(f"__w{j}") for j in range(DRAWS)])
    sums = weighed.groupBy(group, "__block").agg(*[f for j in range(DRAWS) for i, c in enumerate(cols) for f in (
        F.sum(F.when(F.col(c).isNotNull(), F.col(f"__w{j}"))).alias(f"__n{j}_{i}"), F.sum(F.col(f"__w{j}") * F.col(c)).alias(f"__s{j}_{i}"))])
    means = F.array(*[F.struct(F.lit(c).alias("metric"), F.try_divide(F.col(f"__s{j}_{i}"), F.col(f"__n{j}_{i}")).alias("mean")) for j in range(DRAWS) for i, c in enumerate(cols)])
    each = sums.select(F.col(group).alias("__group"), F.explode(means).alias("m"))
    return each.groupBy("__group", F.col("m.metric").alias("__metric")).agg(F.expr("percentile(m.mean, array(0.025, 0.975))").alias("__ci"))


def submean_by_label(df: DataFrame, value_cols, label_col: str = "label", key: str = "doc_id") -> DataFrame:
    """Mean of several score columns per label with its bootstrap interval (the bar plots' data):
    (label, metric, mean, std, n, ci_low, ci_high)."""
    long = df.unpivot([label_col], list(value_cols), "metric", "value")
    g = long.groupBy(label_col, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                              F.count("value").cast("bigint").alias("n"))
    ci = bootstrap_intervals(df, value_cols, label_col, key)
    return (g.join(ci, g[label_col].eqNullSafe(ci["__group"]) & (g.metric == ci["__metric"]), "left")
            .select(label_col, "metric", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n",
                    F.round(F.col("__ci")[0], 6).alias("ci_low"), F.round(F.col("__ci")[1], 6).alias("ci_high")))


def mean_by_label(df: DataFrame, value_col: str, label_col: str = "label", key: str = "doc_id") -> DataFrame:
    """The same for one column, without its name."""
    return submean_by_label(df, [value_col], label_col, key).drop("metric")


GRID = 200      # points of a density curve
CUT = 3         # bandwidths that it goes beyond the data
LEAST_SPREAD = 1e-4     # standard deviation from which scores have a curve


def density_curves(df: DataFrame, cols, label_col: str = "label", grid: int = GRID) -> DataFrame:
    """Gaussian kernel densities of score columns per label, each of area 1: (label, metric, point, x, density).

    The bandwidth is Scott's, from one aggregate of (label, metric).  Rows are shared linearly
    between the two grid points around them (one pass, a sum per point), and the kernel is
    applied to the points instead of the rows.  Groups of one value, or nearly, have no curve.
    """
    long = df.unpivot([label_col], list(cols), "metric", "value").where(F.col("value").isNotNull())
    stats = long.groupBy(label_col, "metric").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("value").alias("std"), F.min("value").alias("lo"), F.max("value").alias("hi")).where(F.col("std") > LEAST_SPREAD)
    width = F.col("std") * F.pow(F.col("n"), F.lit(-0.2))
    stats = (stats.withColumn("width", width).withColumn("start", F.col("lo") - CUT * F.col("width"))
             .withColumn("step", (F.col("hi") - F.col("lo") + 2 * CUT * F.col("width")) / (grid - 1)))
    placed = long.join(stats, [label_col, "metric"]).withColumn("p", (F.col("value") - F.col("start")) / F.col("step")).withColumn("b", F.floor("p"))
    share = F.array(F.struct(F.col("b").alias("point"), (F.col("b") + 1 - F.col("p")).alias("w")), F.struct((F.col("b") + 1).alias("point"), (F.col("p") - F.col("b")).alias("w")))
    mass = placed.select(label_col, "metric", "n", "width", "start", "step", F.explode(share).alias("s")).groupBy(label_col, "metric", "n", "width", "start", "step", "s.point").agg(F.sum("s.w").alias("w"))
    near = mass.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    z = (F.col("at") - F.col("point")) * F.col("step") / F.col("width")
    curve = near.groupBy(label_col, "metric", "n", "width", "start", "step", "at").agg(F.sum(F.col("w") * F.exp(-0.5 * z * z)).alias("k"))
    return curve.select(label_col, "metric", F.col("at").cast("int").alias("point"), F.round(F.col("start") + F.col("at") * F.col("step"), 6).alias("x"),
                        F.round(F.col("k") / (F.col("n") * F.col("width") * math.sqrt(2 * math.pi)), 4).alias("density"))


def pair_correlations(df: DataFrame, cols, label_col: str = "label") -> DataFrame:
    """Pearson correlation of every pair of score columns, per label."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    agg = df.groupBy(label_col).agg(*[F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"{a}__{b}") for a, b in pairs])
    long = agg.unpivot([label_col], [f"{a}__{b}" for a, b in pairs], "pair", "corr")
    return long.select(label_col, F.split("pair", "__")[0].alias("var_x"), F.split("pair", "__")[1].alias("var_y"),
                       F.round("corr", 6).alias("corr"))


def pair_grid(df: DataFrame, cols, label_col: str = "label", bins: int = 10) -> DataFrame:
    """Data of a pair plot of scores in [0, 1]: per label and pair of columns the counts of the
    cells of a bins x bins grid with the pair's correlation, and for a column with itself its
    histogram.  (label, var_x, var_y, bin_x, bin_y, n, corr); empty cells are not listed."""
    def cell(c):
        return F.least(F.floor(F.col(c) * bins), F.lit(bins - 1)).cast("int")
    pairs = F.array(*[F.struct(F.lit(a).alias("var_x"), F.lit(b).alias("var_y"), cell(a).alias("bin_x"), cell(b).alias("bin_y"))
                      for i, a in enumerate(cols) for b in cols[i:]])
    counts = (df.select(label_col, F.explode(pairs).alias("p")).select(label_col, "p.*")
              .groupBy(label_col, "var_x", "var_y", "bin_x", "bin_y").agg(F.count(F.lit(1)).cast("bigint").alias("n")))
    return counts.join(pair_correlations(df, cols, label_col), [label_col, "var_x", "var_y"], "left")
