"""Byte-level BPE over a distinct-word table: each distinct word is encoded once."""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import packed, planes, unpacked, unplaned
from .store import partitions
from .tokens import pieces_of, words_of

#: Characters of text in a block of documents, a block's share of a task's memory.
BLOCK_CHARS = 5 << 20


@lru_cache
def tokenizer(path: str):
    """This worker's tokenizer of a file, on the task's own thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache
def pieces(path: str) -> list[bytes]:
    return pieces_of(path)


class Numbers(dict):
    """word -> its number in the block, in order of first use."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def marked(text: str | None) -> list[str]:
    """The text's words; each lacks the space before it, and the first, which has none, gets one
    too many instead, as the others never begin with a space."""
    if not text:
        return []
    words = words_of(text)
    words[0] = " " + words[0]
    return words


def plain(word: str) -> str:
    return word[1:] if word[0] == " " else " " + word


def blocks_of(batches):
    """(block, documents as (key, text)) of one task: BLOCK_CHARS of text a block, or one text."""
    block, rows, held = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows.append((k, t.as_py()))
            held += len(rows[-1][1] or "") + 1
            if held >= BLOCK_CHARS:
                yield block, rows
                block, rows, held = block + 1, [], 0
    if rows:
        yield block, rows


def shared_out(words, parts: int) -> tuple[list[str], np.ndarray, int]:
    """A block's distinct words in order, the part that answers for each, and a checksum of them."""
    ordered = sorted(words)
    part = np.fromiter((xxhash.xxh32_intdigest(w) for w in ordered), np.uint32, len(ordered)) % np.uint32(parts)
    return ordered, part.astype(np.uint16 if parts < 1 << 16 else np.uint32), xxhash.xxh64_intdigest("\n".join(ordered)) >> 1


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>), one row per input row, as the tokenizers file encodes the whole
    text without adding special tokens; null and empty texts have no ids.

    1. Tasks split their documents into words; each block of documents sends its distinct words to
    hash parts, which merge them and encode each distinct word once.  2. Tasks split the documents
    again into positions in the block's word table; the answers meet their block, and the ids are
    joined back by position.  Repeated keys stay separate rows; no rows give none.

    docs is read twice and must give the same rows in the same tasks, as a table does; blocks
    that differ are noticed by a checksum and end the job.  That costs less than keeping the texts' positions.
    """
    parts = partitions(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))

    def requests(batches):
        for block, some in blocks_of(batches):
            words = set()
            for _, t in some:
                words.update(marked(t))
            if not words:
                continue
            ordered, part, check = shared_out(words, parts)
            place = np.argsort(part, kind="stable")
            out = [(int(part[at[0]]), block, packed([ordered[i] for i in at.tolist()]), check)
                   for at in np.split(place, np.flatnonzero(np.diff(part[place])) + 1)]
            for i in range(0, len(out), 16):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i:i + 16]), (pa.int32(), pa.int64(), pa.binary(), pa.int64()))], names=["part", "block", "words", "check"])

    def answers(key: tuple, asked: pd.DataFrame) -> pd.DataFrame:
        lists = [unpacked(x)[0] for x in asked["words"]]
        distinct = sorted(set().union(*lists))
        ids = {}
        for i in range(0, len(distinct), 2_000):
            some = distinct[i:i + 2_000]
            for w, e in zip(some, tokenizer(path).encode_batch([plain(w) for w in some], add_special_tokens=False)):
                ids[w] = np.array(e.ids, "<u4").tobytes()

        def answer(words):
            found = [ids[w] for w in words]
            return packed(np.array([len(x) // 4 for x in found], np.uint8 if max(map(len, found)) < 1024 else "<u4"), planes(np.frombuffer(b"".join(found), "<u4")))
        return pd.DataFrame({"block": asked["block"], "part": key[0], "ids": [answer(w) for w in lists], "check": asked["check"]})

    def positions(batches):
        for block, some in blocks_of(batches):
            numbers, places, sizes = Numbers(), [], []
            for _, t in some:
                words = marked(t)
                places.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                sizes.append(len(words))
            at = np.concatenate(places)
            listed = list(numbers)
            del numbers, places
            ordered, part, check = shared_out(listed, parts)
            # frequent words get small numbers, which compress well
            often = np.argsort(-np.bincount(at, minlength=len(listed)), kind="stable")
            rank = np.empty(len(listed), np.uint32)
            rank[often] = np.arange(len(listed), dtype=np.uint32)
            index = {w: i for i, w in enumerate(ordered)}
            order = np.fromiter((index[listed[i]] for i in often.tolist()), np.uint32, len(listed))
            body = packed([k for k, _ in some], np.array(sizes, "<u4"), planes(part), part.dtype.str, planes(order), planes(rank[at]))
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([body]), pa.array([check])], names=["block", "body", "check"])

    def joined(key: tuple, block: pd.DataFrame, answered: pd.DataFrame) -> pd.DataFrame:
        keys, sizes, part, kind, order, places = unpacked(block["body"].iloc[0])
        part = unplaned(part, kind)
        if len(answered) and (answered["check"] != block["check"].iloc[0]).any() or len(part) and not len(answered):
            raise RuntimeError("the documents differed when they were read again; write them to a table first")
        found = [b""] * len(part)
        for p, answer in zip(answered["part"], answered["ids"]):
            size, flat = unpacked(answer)
            flat = unplaned(flat, "<u4").tobytes()
            end = list(accumulate(size.tolist(), initial=0))
            for i, s, e in zip(np.flatnonzero(part == p).tolist(), end, end[1:]):
                found[i] = flat[4 * s:4 * e]
        ids = [found[i] for i in unplaned(order, np.uint32).tolist()]
        places, out, s = unplaned(places, np.uint32), [], 0
        for n in sizes.tolist():
            out.append(np.frombuffer(b"".join([ids[i] for i in places[s:s + n].tolist()]), "<i4"))
            s += n
        return pd.DataFrame({"k": pd.array(keys, "Int64"), "ids": out})

    asked = rows.mapInArrow(requests, "part int, block long, words binary, check long")
    answered = asked.groupBy("part").applyInPandas(answers, "block long, part int, ids binary, check long")
    blocks = rows.mapInArrow(positions, "block long, body binary, check long")
    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(joined, "k long, ids array<int>").withColumnRenamed("k", key)


def decode(ids: Column, path: str) -> Column:
    """Text of an array of ids, special tokens included: ids joined to the vocabulary's table of
    pieces (bounded by the vocabulary), the bytes read as UTF-8, malformed ones replaced."""
    @F.pandas_udf("string")
    def of(rows: pd.Series) -> pd.Series:
        piece = pieces(path)
        return pd.Series([None if x is None else b"".join([piece[i] for i in x.tolist()]).decode("utf-8", "replace") for x in rows], dtype="object")
    return of(ids)
