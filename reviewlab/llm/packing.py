"""Sum-of-squares online packing of documents into training sequences."""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: A task holds back the ids that its open windows lack, to fill them at the end, but no more than these and a document.
RESERVE = 1 << 19
#: Sequences a task may number; its own number stands above these bits.
SEQUENCE_BITS = 40


class Levels:
    """Open windows by fill level, and the sum-of-squares rule over how many there are."""

    def __init__(self, size: int):
        self.size, self.count, self.open = size, np.zeros(size + 1, np.int64), [[] for _ in range(size + 1)]

    def place(self, length: int) -> int:
        """Level of the window that takes `length`: the one after which the sum of squared
        counts of partially filled windows is least; of equals the fullest; 0 is a new one."""
        upto = self.size - length
        before, after = self.count[: upto + 1], self.count[length:]
        change = 2 * after + 1 - 2 * before + 1
        change[0] -= 1 - 2 * before[0]  # a new window leaves no level
        change[-1] -= 2 * after[-1] + 1  # a full one stands at none
        if upto == 0:
            return 0
        change[1:][before[1:] == 0] = np.iinfo(np.int64).max
        return upto - int(np.argmin(change[::-1]))

    def take(self, level: int) -> int:
        self.count[level] -= 1
        return self.open[level].pop()

    def put(self, level: int, window: int) -> None:
        if level < self.size:
            self.count[level] += 1
            self.open[level].append(window)


class Packer:
    """Packs one task's documents.  A document of `size` ids or more fills windows of its own
    first; what is left goes whole to the level that the rule names."""

    def __init__(self, size: int, first: int):
        self.size, self.next, self.levels, self.rows, self.held, self.kept = size, first, Levels(size), [], deque(), 0
        self.lack, self.level = 0, None  # ids that the open windows lack; where the first held document's rest goes

    def lacking(self, level: int) -> int:
        return self.size - level if level & (level - 1) else 0  # powers of two need no padding

    def window(self) -> int:
        self.next += 1
        return self.next - 1

    def piece(self, doc, start: int, length: int, window: int, offset: int) -> None:
        key, ids, total = doc
        self.rows.append((key, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), total, window, offset))

    def add(self, key, ids: bytes) -> None:
        self.held.append((key, memoryview(ids), len(ids) // 4))
        self.kept += len(ids) // 4
        while self.held:
            total, rest = self.held[0][2], self.held[0][2] % self.size
            if self.level is None:
                self.level = self.levels.place(rest) if rest else 0
            lack = self.lack - self.lacking(self.level) + self.lacking((self.level + rest) % self.size)
            if self.kept - total < min(lack, RESERVE):
                break
            self.settle(self.held.popleft(), self.level)
            self.lack, self.level = lack, None

    def settle(self, doc, level: int) -> None:
        total = doc[2]
        self.kept -= total
        full = total - total % self.size
        for start in range(0, full, self.size):
            self.piece(doc, start, self.size, self.window(), 0)
        if rest := total - full:
            window = self.levels.take(level) if level else self.window()
            self.piece(doc, full, rest, window, level)
            self.levels.put(level + rest, window)

    def finish(self) -> None:
        """Cut the held documents so that they fill the open windows, fullest first, and then
        new ones; what is left at the end makes sequences of powers of two, which need no padding."""
        gaps = deque((level, w) for level in range(self.size - 1, 0, -1) if level & (level - 1) for w in self.levels.open[level])
        left = self.kept
        room, offset, window = 0, 0, 0
        while self.held:
            doc = self.held.popleft()
            start = 0
            while start < doc[2]:
                if not room:
                    if gaps and self.size - gaps[0][0] <= left:
                        offset, window = gaps.popleft()
                        room = self.size - offset
                    else:
                        gaps.clear()  # the others lack more than is left
                        offset, window, room = 0, self.window(), min(self.size, 1 << (left.bit_length() - 1))
                n = min(room, doc[2] - start)
                self.piece(doc, start, n, window, offset)
                start, offset, room, left = start + n, offset + n, room - n, left - n


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then end_id (null text counts as empty: end_id
    alone).  Each input partition is packed on its own, so nothing is shuffled
    and memory is bounded by RESERVE ids, one document and one Arrow batch; sequence ids hold
    the partition's number.  Rows with a null or repeated key are packed like
    any other; an empty table gives no rows.  `size` must be a power of two.
    """
    if size & (size - 1) or size < 2:
        raise ValueError("size must be a power of two")

    def task(batches):
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        packer = Packer(size, TaskContext.get().partitionId() << SEQUENCE_BITS)

        def out():
            rows, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(k, encode(t.as_py()) + end)
                if len(packer.rows) >= 10_000:
                    yield out()
        packer.finish()
        yield out()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(task, SCHEMA)
