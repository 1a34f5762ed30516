"""Packed messages between blocks of documents and the parts of a key space.

A block is a run of documents of one input partition, a part a hash range of
keys.  Each block sends each part one row with all the keys it has there,
compressed; a part merges them (a key that every document holds arrives once a
block) and answers with one row per block, in the order it was asked.
"""

from __future__ import annotations

import marshal

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

#: Bytes of text after which a task closes a block.
BLOCK_BYTES = 32 << 20
#: What a message to a part holds.
ASKED = "part int, block long, data binary"


def packed(*values) -> bytes:
    """Numbers arrays, strings, bytes, lists and numbers as one compressed value."""
    flat = [("a", x.dtype.str, x.tobytes()) if isinstance(x, np.ndarray) else ("o", x) for x in values]
    return zstandard.ZstdCompressor(level=1).compress(marshal.dumps(flat))


def unpacked(data: bytes) -> list:
    flat = marshal.loads(zstandard.ZstdDecompressor().decompress(data))
    return [np.frombuffer(x[2], x[1]) if x[0] == "a" else x[1] for x in flat]


def planes(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers as byte planes, lowest first: equal high bytes then compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).reshape(-1)


def unplaned(x: np.ndarray, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    return np.ascontiguousarray(x.reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype)


def sorted_keys(x: np.ndarray) -> np.ndarray:
    """Sorted 64-bit keys as the planes of their differences."""
    return planes(np.diff(x, prepend=np.uint64(0)))


def keys_of(x: np.ndarray) -> np.ndarray:
    return np.cumsum(unplaned(x, np.uint64), dtype=np.uint64)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Part of each 64-bit key: by its upper half, so sorted keys have sorted parts."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins and ends in sorted keys."""
    return np.searchsorted(part_of(keys, parts), np.arange(parts + 1, dtype=np.uint64))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of two."""
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x632BE59BD9B4E019))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def asked(blocks: DataFrame, schema: str, of_block) -> DataFrame:
    """Messages to the parts: of_block(block's row) gives (part, packed keys and values)."""
    def task(batches):
        for batch in batches:
            for row in batch.to_pylist():
                some = []
                for part, data in of_block(row):
                    some.append((part, row["block"], data))
                    if len(some) == 16:
                        yield messages(some)
                        some = []
                if some:
                    yield messages(some)
    return blocks.mapInArrow(task, schema)


def messages(rows: list) -> pa.RecordBatch:
    part, block, data = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block, pa.int64()), pa.array(data, pa.binary())], names=["part", "block", "data"])


def sliced(keys: np.ndarray, parts: int, *values: np.ndarray):
    """(part, message) of sorted keys and what goes with them."""
    ends = cuts(keys, parts)
    for part in np.flatnonzero(np.diff(ends)).tolist():
        s, e = ends[part], ends[part + 1]
        yield part, packed(sorted_keys(keys[s:e]), *[planes(v[s:e]) for v in values])


def merged(rows: pd.DataFrame) -> tuple:
    """A part's messages in the order of blocks: (blocks, ends, values' messages, number of each key, which block has it first)."""
    rows = rows.sort_values("block")
    got = [unpacked(x) for x in rows["data"]]
    keys = [keys_of(g[0]) for g in got]
    ends = np.cumsum([0, *map(len, keys)])
    _, first, number = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return rows["block"].tolist(), ends, got, number, first
