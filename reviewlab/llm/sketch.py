"""Bottom-k sketches of word-shingle hashes, DataFrame operations only.

A sketch is the sorted array of the k smallest distinct shingle hashes of a
text.  Sketches of parts merge into the sketch of their union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import partitions

K = 128
#: Range buckets per shuffle partition in `successors`.
BUCKETS = 4


def shingles(text: Column, words: int = 5) -> Column:
    """Hashes of all runs of `words` words (runs without white space, lower-cased); a shorter
    text is one shingle, an empty or null one has none."""
    w = F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != ""), lambda x: F.xxhash64(x))
    # the array is bound to a lambda's variable, or each use would split the text again
    runs = F.transform(F.array(w), lambda h: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(h) - words, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(words)])))
    return F.when(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "^[ \\t\\n\\x0B\\f\\r]+$", "")) != "", F.element_at(runs, 1)).otherwise(F.array().cast("array<bigint>"))


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, words: int = 5, k: int = K) -> Column:
    return bottom_k(shingles(text, words), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two parts."""
    return bottom_k(F.concat(a, b), k)


def merge_parts(parts: DataFrame, keys: list[str], col: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per key over any number of parts: each task passes on at most k hashes a key.

    Keys all of whose parts are empty or null get an empty sketch.
    """
    hashes = parts.select(*keys, F.explode(col).alias("__h")).distinct()
    least = hashes.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("__h"))).where(F.col("__n") <= k)
    merged = least.groupBy(*keys).agg(F.sort_array(F.collect_list("__h")).alias("__s"))
    named = parts.select(*keys).distinct()
    on = [named[c].eqNullSafe(merged[c]) for c in keys]
    return named.join(merged, on, "left").select(*[named[c] for c in keys], F.coalesce("__s", F.array().cast("array<bigint>")).alias(col))


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else from where the k-th hash lies."""
    share = (F.element_at(s, -1).cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise(F.lit(k - 1.0) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1; 1 for two empty ones."""
    union = bottom_k(F.concat(a, b), k)
    common = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(common / F.greatest(F.size(union), F.lit(1)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; 1 for an empty a."""
    j, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j / (1 + j) * (na + nb) / na))


def written_out(s: Column) -> Column:
    """A sketch as text: its hashes in order."""
    return F.array_join(s.cast("array<string>"), ",")


def successors(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, k: int = K) -> DataFrame:
    """(key, text, sketch, next_text, next_sketch): each document and the one after it in
    descending key order, the first after the last.

    Null keys come last, equal keys in descending text order; a lone document follows
    itself.  Rows are dealt to key ranges of about equal size, the neighbour inside a range
    comes from a window over it, and each range's last row takes the next range's first.
    """
    spark = docs.sparkSession
    n = BUCKETS * partitions(spark)
    lowest = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(lowest)).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    bounds = rows.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 100 * n)).first()[0]
    bounds = sorted(set(bounds or []))
    limits = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    bucket = F.size(F.filter(limits, lambda b: b < F.col("k")))
    # at most n rows: the ranges that hold anything, and the key of each one's first row
    tops = sorted(tuple(r) for r in rows.groupBy(bucket.alias("b")).agg(F.max("k")).collect())
    ranged = rows.withColumn("b", bucket).repartition(F.col("b")).withColumn("s", sketch(F.col("t"), words, k))
    order = Window.partitionBy("b").orderBy(F.desc("k"), F.desc("t"))
    inside = ranged.withColumns({"nt": F.lead("t").over(order), "ns": F.lead("s").over(order)})
    pairs = [(b, tops[i - 1][1]) for i, (b, _) in enumerate(tops)]
    values = ", ".join(f"({b}, {'CAST(-9223372036854775808 AS BIGINT)' if top == lowest else f'{top}L'})" for b, top in pairs) or "(-1, 0L)"
    firsts = (rows.join(F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS v(to, top)")), F.col("k") == F.col("top"))
              .groupBy("to").agg(F.max("t").alias("ft")).withColumn("fs", sketch(F.col("ft"), words, k)))
    return (inside.join(firsts, F.col("b") == F.col("to"), "left")
            .select(F.when(F.col("k") != lowest, F.col("k")).alias(key), F.col("t").alias("text"), F.col("s").alias("sketch"),
                    F.coalesce("nt", "ft").alias("next_text"), F.coalesce("ns", "fs").alias("next_sketch")))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, k: int = K) -> DataFrame:
    """Per document its length, its sketch, an edited text (the last third replaced by the next
    document's beginning) with its sketch, and the estimated likeness of both neighbours.

    Null texts count as empty.
    """
    near = successors(docs, key, text, words, k)
    cut = F.floor(F.length("text") / 3).cast("int")
    edited = near.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.substring("next_text", F.lit(1), cut)))
    both = edited.withColumn("edited_sketch", sketch(F.col("edited"), words, k))
    return both.select(key, F.length("text").cast("long").alias("n_chars"), "edited", "sketch", "edited_sketch",
                       resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
                       resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
                       containment(F.col("sketch"), F.col("edited_sketch"), k).alias("kept_share"),
                       distinct_shingles(F.col("sketch"), k).alias("distinct_shingles"))
