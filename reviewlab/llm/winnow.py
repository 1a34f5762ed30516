"""Benchmark decontamination by winnowing.

A k-gram's hash is kept if it is the least of w neighbouring k-grams, the
rightmost of equals.  Two texts that share n = k + w - 1 words in a row share the
w k-grams of that span, hence the kept one: each window of n words has its
fingerprint in common with each equal window.  Fingerprints of documents and
benchmark are joined and each match is extended to its whole window, word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import written

#: Words of a window.
WINDOW = 10
#: Bytes of text that are hashed at once.
BYTES_AT_ONCE = 1 << 20
#: Bits of the filter of the benchmark's fingerprints, whatever the benchmark's size: 4 MB.
FILTER_BITS = 25
#: Fingerprints that a task passes on at once.
PASS_ON = 20_000

_LETTERS = np.zeros(256, np.uint8)  # a byte's lower-case form if it belongs to words, else 0
for _b in range(256):
    if _b >= 0x80 or chr(_b).isascii() and chr(_b).isalnum():
        _LETTERS[_b] = ord(chr(_b).lower()) if _b < 0x80 else _b
_BASE = np.uint64(0x9E3779B97F4A7C15)


def sizes(n: int) -> tuple[int, int]:
    """(k, w) for windows of n words."""
    w = 1 + n // 3
    return n - w + 1, w


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_in(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words in bytes mapped by _LETTERS."""
    inside = np.zeros(len(letters) + 2, np.int8)
    inside[1:-1] = letters != 0
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # a run of words of bounded bytes at a time
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BYTES_AT_ONCE, "right")))
        s, size = starts[at:to], ends[at:to] - starts[at:to]
        first = np.cumsum(size) - size
        power = np.full(int(size.max()), _BASE).cumprod(dtype=np.uint64)
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        value = letters[np.repeat(s, size) + place].astype(np.uint64) * power[place]
        hashes[at:to] = np.add.reduceat(value, first)
        at = to
    return starts, ends, mixed(hashes + np.uint64(1))


def fingerprints(words: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, fingerprint) of each window of n words that lies in one text.

    words: hashes of all words, of: number of each word's text, ascending.
    """
    k, w = sizes(n)
    last = len(words) - n + 1
    if last <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    gram = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        gram = (gram + words[i:i + len(gram)]) * _BASE
    gram = mixed(gram)
    least = gram[:last].copy()
    for i in range(1, w):
        np.minimum(least, gram[i:i + last], out=least)
    starts = np.flatnonzero(of[:last] == of[n - 1:])
    return starts, mixed(least[starts] + np.uint64(n))


def texts_of(column: pa.Array):
    """Runs of texts of bounded bytes: (first row, number of rows, their bytes with a space after each, ends)."""
    data = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset:data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2], np.uint8) if data.buffers()[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(data):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BYTES_AT_ONCE, "right")) - 1)
        size = np.diff(offsets[at:to + 1])
        ends = np.cumsum(size + 1)
        out = np.zeros(int(ends[-1]), np.uint8)
        spaces = np.zeros(len(out), bool)
        spaces[ends - 1] = True
        out[~spaces] = raw[offsets[at]:offsets[to]]
        yield at, to - at, _LETTERS[out], ends
        at = to


def scanner(lengths: list[int], allowed=None):
    """Of each text its words' number and its windows that pass the filter, as (length, fingerprint, start, window).

    allowed: broadcast bits of fingerprints, or none to pass all.
    """
    def scan(batches):
        bits = None if allowed is None else np.unpackbits(np.frombuffer(allowed.value, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            rest = batch.drop_columns(["text"])
            for first, rows, letters, text_ends in texts_of(batch.column("text")):
                starts, ends, words = words_in(letters)
                of = np.searchsorted(text_ends, starts, "right")
                n_words = np.bincount(of, minlength=rows)
                found = [[] for _ in range(rows)]
                whole = letters.tobytes()
                for n in lengths:
                    at, fp = fingerprints(words, of, n)
                    if bits is not None:
                        near = bits[(fp >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
                        at, fp = at[near], fp[near]
                    begun = np.searchsorted(of, np.arange(rows), "left")
                    for a, f, doc in zip(at.tolist(), fp.view(np.int64).tolist(), of[at].tolist()):
                        window = whole[starts[a]:ends[a + n - 1]].translate(_SPACES)
                        found[doc].append({"n": n, "fp": f, "start": a - int(begun[doc]), "window": b" ".join(window.split())})
                yield from passed_on(rest.slice(first, rows), n_words, found)
    return scan


_SPACES = bytes(b if b else 32 for b in range(256))
_HIT = pa.list_(pa.struct([("n", pa.int32()), ("fp", pa.int64()), ("start", pa.int64()), ("window", pa.binary())]))
HITS = "array<struct<n:int,fp:bigint,start:bigint,window:binary>>"


def passed_on(rest: pa.RecordBatch, n_words: np.ndarray, found: list):
    """Batches of bounded size of the texts' other columns, word numbers and windows."""
    cut, held = 0, 0
    for i in range(len(found)):
        held += len(found[i])
        if held >= PASS_ON or i == len(found) - 1:
            part = rest.slice(cut, i + 1 - cut)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n_words[cut:i + 1], pa.int64()), pa.array(found[cut:i + 1], _HIT)],
                                             names=[*part.schema.names, "n_words", "hits"])
            cut, held = i + 1, 0


def scanned(texts: DataFrame, keys: str, lengths: list[int], allowed=None) -> DataFrame:
    return texts.mapInArrow(scanner(lengths, allowed), f"{keys}, n_words long, hits {HITS}")


def filter_of(windows: DataFrame) -> bytes:
    """Bits of the fingerprints' leading FILTER_BITS: a fixed size, put together by Spark."""
    bit = F.shiftrightunsigned("fp", 64 - FILTER_BITS)
    size = 1 << FILTER_BITS >> 3
    out = bytearray(size)
    maps = windows.select(bit.alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit + 1))").alias("bits"))
    for row in maps.collect():  # 4 KB each, at most 2^25 bits in all
        at = (row["bucket"] - 1) * len(row["bits"])
        out[at:at + len(row["bits"])] = row["bits"]
    return bytes(out[:size])


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_hit, n_items, items, spans): a row per document, in which benchmark words occur.

    Words are runs of letters a-z (A-Z lower-cased), digits and non-ASCII characters.  A benchmark item's windows are its
    runs of `window` words, or all its words if it has fewer.  items: the ids (as sorted text) of items with an
    occurring window, spans: the words covered, as (start, end) from 0, end excluded, touching ones joined; n_hit counts them.

    Documents' fingerprints pass a filter of fixed size made of the benchmark's (a bit per hash prefix); what is left, a share
    that follows the matches, is joined by fingerprint and window.  Documents with the same set of windows share one list of items,
    so copies of a contaminated text do not multiply its items.

    A null text has no words.  Null or repeated keys: each row is reported by itself.  Items with a null or empty text or a null id are
    ignored; repeated items count once.  An empty benchmark hits nothing, empty documents give no rows.
    Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    count = scanned(items, "item string", [])
    lengths = sorted({min(window, r[0]) for r in count.where("n_words > 0").select(F.least("n_words", F.lit(window))).distinct().collect()})
    whole = scanned(items, "item string", sorted({*lengths, window}))
    # an item of fewer words than a window is one window: that of its own length
    own = (whole.select("item", F.least("n_words", F.lit(window)).alias("due"), F.explode("hits").alias("h")).where("h.n = due")
           .select("item", "h.fp", "h.window").distinct())
    own = written(own, "benchmark-windows")
    allowed = spark.sparkContext.broadcast(filter_of(own))

    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc"), F.col(text).cast("string").alias("text"))
    seen = written(scanned(base, f"row long, doc {kind}", lengths, allowed), "document-windows")
    near = seen.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.n", "h.fp", "h.start", "h.window")
    windows = own.select("fp", "window").distinct()
    hits = written(near.join(windows, ["fp", "window"]).select("row", "start", "n", F.xxhash64("window", F.lit("id")).alias("w"), "fp"), "window-hits")

    reach = F.max(F.col("start") + F.col("n")).over(W.partitionBy("row").orderBy("start", "n").rowsBetween(W.unboundedPreceding, -1))
    span = hits.select("row", "start", (F.col("start") + F.col("n")).alias("end"), reach.alias("reach"))
    span = span.withColumn("part", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(W.partitionBy("row").orderBy("start", "end")))
    spans = (span.groupBy("row", "part").agg(F.min("start").alias("start"), F.max("end").alias("end")).groupBy("row")
             .agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")))

    # a document's set of windows, and the items of each distinct set
    sets = hits.select("row", "fp", "w").distinct()
    by_row = written(sets.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("fp", "w")).alias("a"), F.bit_xor(F.xxhash64("w", "fp")).alias("b")), "window-sets")
    first = by_row.groupBy("n", "a", "b").agg(F.min("row").alias("row"))
    of_set = (sets.join(first, "row").join(own.select("item", "fp", F.xxhash64("window", F.lit("id")).alias("w")), ["fp", "w"])
              .groupBy("n", "a", "b").agg(F.sort_array(F.collect_set("item")).alias("items")))
    listed = by_row.join(of_set, ["n", "a", "b"]).select("row", "items")
    return (seen.select("row", "doc", "n_words").join(spans, "row", "left").join(listed, "row", "left")
            .select(F.col("doc").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans")))
