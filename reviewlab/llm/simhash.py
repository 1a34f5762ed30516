"""SimHash near-dedup: deletion-variant signatures, equality join, exact verification."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import fresh, growing, written

BITS = 64
SEED = 42
#: Shingles turned into bits at a time, so that memory doesn't follow the text's length.
SHINGLES_AT_ONCE = 1 << 16
#: Fingerprints under one signature up to which they are compared pair by pair; larger
#: groups go through `ball_links`, which finds the same links without pairs.
PAIRWISE = 128


def simhash(data: bytes | None, words: int = 4) -> int:
    """Fingerprint of UTF-8 text as a signed 64-bit number; 0 for null or no word.

    Words are runs without ASCII white space, A-Z lower-cased; a shingle is
    `words` words joined by a space (fewer words: all of them), repeats included.
    """
    tokens = (data or b"").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[: max(1, len(tokens) - words + 1)], ends[min(words, len(tokens)) - 1:]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        digests = b"".join([xxhash.xxh64_digest(joined[s:e], SEED) for s, e in
                            zip(starts[at:at + SHINGLES_AT_ONCE].tolist(), ends[at:at + SHINGLES_AT_ONCE].tolist())])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8)).view(np.uint64).reshape(-1, 8)
        # eight counters of a byte each in a number: 255 rows fit before one overflows
        ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0).view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts)).view(">i8")[0])


def fingerprint(text: Column, words: int = 4) -> Column:
    """Column of signed 64-bit fingerprints."""
    @F.pandas_udf("long")
    def of(data: pd.Series) -> pd.Series:
        return pd.Series([simhash(x, words) for x in data], dtype="int64")
    return of(text.cast("binary"))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def segments(max_bits: int) -> list[tuple[int, int, bool]]:
    """(shift, width, with wildcard) of the segments.

    A wildcard segment tolerates one differing bit, a plain one none.  With
    tolerances t, two fingerprints that differ in more than t bits in every
    segment differ in sum(t + 1) bits at least, so sum(t + 1) = max_bits + 1
    makes sure that some segment agrees.  Plain segments may be shorter, as
    they have one signature instead of one per bit.
    """
    wild, plain = (max_bits + 1) // 2, (max_bits + 1) % 2
    narrow = max(1, BITS // (wild + 1) - 3) if plain and wild else BITS if plain else 0
    sizes = [(narrow, False)] * plain
    rest = BITS - narrow * plain
    sizes += [(rest // wild + (i < rest % wild), True) for i in range(wild)] if wild else []
    out, shift = [], 0
    for width, wildcard in sizes:
        out.append((shift, width, wildcard))
        shift += width
    return out


def signatures(fp: Column, max_bits: int) -> Column:
    """Array of all signatures: hashes of (number, the segment's bits without the wildcard)."""
    kept = []
    for shift, width, wildcard in segments(max_bits):
        part = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1 if width < BITS else -1).cast("long"))
        kept += [part.bitwiseAND(F.lit(~(1 << bit)).cast("long")) for bit in range(width)] if wildcard else [part]
    return F.array(*[F.xxhash64(F.lit(i), x) for i, x in enumerate(kept)])


def differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def ball_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links (u, v) that connect whatever is at most max_bits apart, without pairs.

    Two fingerprints at distance d <= max_bits share a point within d//2 bits
    of one and d - d//2 of the other.  Each point links all fingerprints around
    it to the smallest one within max_bits//2, which is a true link by the
    triangle inequality.  Rows per fingerprint are fixed, whatever the group's size.
    """
    near, far = max_bits // 2, (max_bits + 1) // 2
    around = fps.select("fp", F.lit(-1).alias("last"), F.lit(0).alias("r"), F.col("fp").alias("point"))
    ring = around
    for r in range(1, far + 1):
        ring = (ring.where("last < 63").select("fp", F.explode(F.sequence(F.col("last") + 1, F.lit(63))).alias("last"), F.lit(r).alias("r"), "point")
                .select("fp", "last", "r", F.col("point").bitwiseXOR(F.expr("shiftleft(1L, last)")).alias("point")))
        around = around.unionAll(ring)
    hub = (around.groupBy("point").agg(F.min(F.when(F.col("r") <= near, F.col("fp"))).alias("hub"), F.count(F.lit(1)).alias("n"))
           .where("n > 1 and hub is not null").select("point", "hub"))
    return around.select("fp", "point").join(growing(hub), "point").where("fp <> hub").select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct()


def links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp): all pairs within max_bits, or
    as many as connect the same ones where more than PAIRWISE share a signature."""
    index = fps.select("fp", F.explode(signatures(F.col("fp"), max_bits)).alias("sig"))
    crowded = written(index.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PAIRWISE).select("sig"), "crowded")
    small = index.join(growing(crowded), "sig", "left_anti")
    pairs = (small.select(F.col("fp").alias("u"), "sig").join(growing(small.select(F.col("fp").alias("v"), "sig")), "sig")
             .where((F.col("u") < F.col("v")) & (differing("u", "v") <= max_bits)).select("u", "v").distinct())
    many = index.join(growing(crowded), "sig", "left_semi").select("fp").distinct()
    return pairs.unionAll(ball_links(many, max_bits))


def near_groups(rows: DataFrame, key: str = "doc_id", fp: str = "fp", max_bits: int = 4) -> DataFrame:
    """(fp, grp, component_id) of every distinct fingerprint.

    grp is the smallest fingerprint reachable over links of at most max_bits,
    component_id the smallest key among all rows of the group (null if all
    keys are null).  Null fingerprints are left out; an empty table gives none.
    """
    fps = written(rows.where(F.col(fp).isNotNull()).groupBy(F.col(fp).alias("fp")).agg(F.min(key).alias("first")), "fingerprints")
    roots = components(links(fps.select("fp"), max_bits))
    grouped = (fps.join(growing(roots), fps.fp == roots.node, "left")
               .select("fp", "first", F.coalesce("root", "fp").alias("grp")))
    least = grouped.groupBy("grp").agg(F.min("first").alias("component_id"))
    return grouped.select("fp", "grp").join(growing(least), "grp").select("fp", "grp", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, max_bits: int = 4,
                    out: str = "near", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (default: all) and a struct column `out` (fingerprint as 16
    hex digits, grp, component_id), one row per input row.

    Equal, empty and null texts meet like any other (the last two at fingerprint
    zero); rows without a key belong to a group but never name it.
    """
    keep = docs.columns if keep is None else keep
    fp, of = fresh(*docs.columns), fresh(*docs.columns)
    hashed = written(docs.select(*keep, fingerprint(docs[text], words).alias(fp)), "hashed")
    groups = near_groups(hashed, key, fp, max_bits)
    return (hashed.join(growing(groups.select(F.col("fp").alias(of), F.struct(hex_of(F.col("fp")).alias("fingerprint"), "grp", "component_id").alias(out))),
                        F.col(fp) == F.col(of), "left")
            .select(*[hashed[c] for c in keep], out))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, max_bits: int = 4) -> DataFrame:
    """docs with one row left of each group: the one with the smallest key."""
    out, grp = fresh(*docs.columns), fresh(*docs.columns)
    near = near_duplicates(docs, key, text, words, max_bits, out)
    kept = near.where(F.col(key).eqNullSafe(F.col(out)["component_id"])).withColumn(grp, F.col(out)["grp"])
    return kept.dropDuplicates([grp]).select(*docs.columns)
