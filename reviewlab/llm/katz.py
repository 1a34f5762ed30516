"""Katz backoff language model: Good-Turing discounted bigram and word counts with exactly
normalised backoff weights.

Counts are merged by hash parts of the n-grams' 64-bit hashes and every block of documents
gets back those of its own n-grams, so no table is held whole anywhere.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ASKED, BLOCK_BYTES, asked, keys_of, merged, mixed, packed, planes, sliced, sorted_keys, unpacked, unplaned
from .store import partitions, written

#: Counts up to which Good-Turing's estimate is used; larger ones lose as much as this one.
TRUSTED = 5
#: The word that ends each text, and stands before its first: no word is white space.
END = b"\n"
MODULUS, HELD_OUT = 7, 2


def is_held_out(key) -> bool:
    return key is not None and zlib.crc32(str(key).encode()) % MODULUS == HELD_OUT


def discounts(of_counts: np.ndarray) -> np.ndarray:
    """Share kept of counts 1 to TRUSTED, from how many n-grams have each count 1 to TRUSTED + 1.

    Good-Turing with Katz's correction where the counts allow it, else the loss of half a count.
    """
    n, k = of_counts.astype(float), TRUSTED
    r = np.arange(1, k + 1)
    kept = 1 - 0.5 / r
    if (n > 0).all() and (k + 1) * n[k] < n[0]:
        common = (k + 1) * n[k] / n[0]
        turing = ((r + 1) * n[1:] / (r * n[:-1]) - common) / (1 - common)
        fine = (turing > 0.01) & (turing < 0.999)
        kept = np.where(fine, turing, kept)
    return kept


def discounted(counts: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Discounted counts; a count above TRUSTED loses what TRUSTED loses, so that every context
    can back off."""
    c = counts.astype(np.float64)
    loss = np.r_[0, (1 - kept) * np.arange(1, TRUSTED + 1)]
    return c - loss[np.minimum(counts, TRUSTED).astype(np.int64)]


class Block:
    """A block's documents as numbers of its distinct words, the words as sorted hashes."""

    def __init__(self, body: bytes):
        self.keys, self.size, rank, hashes, places = unpacked(body)
        self.hash = keys_of(hashes)
        # rank: place by frequency -> place by hash
        self.at = unplaned(rank, np.uint32)[unplaned(places, np.uint32)]
        self.held = np.array([is_held_out(k) for k in self.keys])
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        self.trains = ~self.held[self.doc]
        self.end = int(np.searchsorted(self.hash, np.uint64(xxhash.xxh64_intdigest(END))))
        # the word before each one; END at a text's start, as after the text before
        self.before = np.r_[np.uint32(self.end), self.at[:-1]]

    def words(self) -> np.ndarray:
        """Training count of each word."""
        return np.bincount(self.at[self.trains], minlength=len(self.hash))

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes of the distinct bigrams, where each first occurs, and each occurrence's number."""
        return np.unique(mixed(self.hash[self.before], self.hash[self.at]), return_index=True, return_inverse=True)


def split_blocks(docs: DataFrame) -> DataFrame:
    def task(batches):
        first, block = TaskContext.get().partitionId() << 32, 0
        numbers, keys, size, places, held = {}, [], [], [], 0

        def out():
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), np.uint64, len(numbers))
            at = np.concatenate(places)
            order = np.argsort(hashes, kind="stable")
            often = np.argsort(-np.bincount(at, minlength=len(hashes)), kind="stable")
            by_often, by_hash = np.empty(len(hashes), np.uint32), np.empty(len(hashes), np.uint32)
            by_often[often] = np.arange(len(hashes), dtype=np.uint32)
            by_hash[order] = np.arange(len(hashes), dtype=np.uint32)
            body = packed(keys, np.array(size, "<u4"), planes(by_hash[often]), sorted_keys(hashes[order]), planes(by_often[at]))
            return pa.RecordBatch.from_arrays([pa.array([first + block], pa.int64()), pa.array([body])], names=["block", "body"])

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (t.as_py() or b"").lower().split()
                words.append(END)
                for w in words:
                    if w not in numbers:
                        numbers[w] = len(numbers)
                places.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                keys.append(k)
                size.append(len(words))
                held += 8 * len(words)
                if held >= BLOCK_BYTES:
                    yield out()
                    block, numbers, keys, size, places, held = block + 1, {}, [], [], [], 0
        if keys:
            yield out()

    return docs.mapInArrow(task, "block long, body binary")


ANSWERS = "kind int, block long, part int, data binary, seen array<long>"


def count_answers(kind: int):
    """Sum the counts of each key over the blocks and answer each block; with bigrams, also which
    block has a key first.  seen: how many keys have counts 1 to TRUSTED + 1, any count, and their sum."""
    def task(part: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        blocks, ends, got, number, first = merged(rows)
        own = np.concatenate([unplaned(g[1], np.uint32) for g in got])
        total = np.bincount(number, weights=own, minlength=len(first)).astype(np.int64)
        owner = np.zeros(len(number), np.uint8)
        owner[first] = 1
        seen = [*np.bincount(np.minimum(total, TRUSTED + 2), minlength=TRUSTED + 3)[1:TRUSTED + 2].tolist(), int((total > 0).sum()), int(total.sum())]
        out = []
        for i, block in enumerate(blocks):
            s, e = ends[i], ends[i + 1]
            out.append((kind, block, part[0], packed(planes(total[number[s:e]].astype(np.uint64)), np.packbits(owner[s:e])), seen if i == 0 else None))
        return pd.DataFrame(out, columns=["kind", "block", "part", "data", "seen"])
    return task


def counted(requests: DataFrame, kind: int, name: str) -> tuple[DataFrame, np.ndarray]:
    """The written answers, and the sums of what the parts have seen (one small row)."""
    answers = written(requests.groupBy("part").applyInPandas(count_answers(kind), ANSWERS), name)
    sums = answers.where("seen is not null").agg(*[F.sum(F.col("seen")[i]) for i in range(TRUSTED + 3)]).first()
    return answers, np.array([x or 0 for x in sums], np.int64)


def answered(rows: pd.DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and owner marks of a block's sorted keys, from the parts in order."""
    mine = rows[rows["kind"] == kind].sort_values("part")
    got = [unpacked(x) for x in mine["data"]]
    counts = [unplaned(g[0], np.uint64).astype(np.int64) for g in got]
    return np.concatenate(counts), np.concatenate([np.unpackbits(g[1])[: len(c)] for g, c in zip(got, counts)]).astype(bool)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    Null texts count as empty (one token, the end).  Rows with a null key train;
    repeated rows count as often as they occur.  An empty table gives no rows.
    score is log10 of the text's probability: a seen bigram has its discounted count over the
    context's; else the context's backoff weight times the word's own probability, which is
    its discounted count over all or, if it never occurs in training, the mass left by all others.
    """
    parts = partitions(docs.sparkSession)
    blocks = written(split_blocks(docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("binary").alias("t"))), "lm-blocks")

    def ask_words(row):
        block = Block(row["body"])
        return sliced(block.hash, parts, block.words().astype(np.uint32))

    def ask_bigrams(row):
        block = Block(row["body"])
        keys, _, number = block.bigrams()
        return sliced(keys, parts, np.bincount(number[block.trains], minlength=len(keys)).astype(np.uint32))

    words, seen = counted(asked(blocks, ASKED, ask_words), 1, "lm-words")
    pairs, seen_pairs = counted(asked(blocks, ASKED, ask_bigrams), 2, "lm-bigrams")
    kept, kept_pairs = discounts(seen[:TRUSTED + 1]), discounts(seen_pairs[:TRUSTED + 1])
    kinds, total = int(seen[-2]), int(seen[-1])
    few = seen[:TRUSTED]
    lost = float((few * (1 - kept) * np.arange(1, TRUSTED + 1)).sum() + (1 - kept[-1]) * TRUSTED * (kinds - few.sum()))
    unknown = lost / total if total else 1.0

    def alone(counts):
        """Probability of words by themselves."""
        return np.where(counts > 0, discounted(counts, kept) / max(1, total), unknown)

    def contexts(k: tuple, block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """Per document what needs no backoff weight, the unseen bigrams' contexts, and the
        block's share of what each context's seen followers take."""
        b = Block(block["body"].iloc[0])
        count, _ = answered(answers, 1)
        keys, first, number = b.bigrams()
        pair, owned = answered(answers, 2)
        p = alone(count)
        left, right = b.before[first], b.at[first]
        share = discounted(pair, kept_pairs) / np.maximum(1, count[left])
        mine = owned & (pair > 0)
        taken = np.bincount(left[mine], weights=share[mine], minlength=len(count))
        alike = np.bincount(left[mine], weights=p[right[mine]], minlength=len(count))
        is_seen = (pair > 0)[number]
        with np.errstate(divide="ignore"):
            value = np.where(is_seen, np.log10(np.where(pair > 0, share, 1))[number], np.log10(p)[b.at])
        docs_of = len(b.size)
        known = count[b.at] > 0
        base = np.log10((count[b.at] + 1) / (total + kinds + 1))
        # a context that training lacks backs off with weight 1
        open_ = ~is_seen & (count[b.before] > 0)
        sums = [np.bincount(b.doc, weights=x, minlength=docs_of) for x in (known, base, value)]
        body = packed(b.keys, b.size, b.held, *sums, b.doc[open_].astype(np.uint32), planes(b.before[open_]))
        rows = [(-1, body)] + list(sliced(b.hash, parts, taken, alike))
        return pd.DataFrame({"part": np.array([r[0] for r in rows], np.int32), "block": k[0], "data": [r[1] for r in rows]})

    def weights(part: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        blocks_, ends, got, number, first = merged(rows)
        taken, alike = (np.bincount(number, weights=np.concatenate([unplaned(g[i], np.float64) for g in got]), minlength=len(first)) for i in (1, 2))
        alpha = np.log10(np.maximum(1 - taken, 1e-300) / np.maximum(1 - alike, 1e-300))
        return pd.DataFrame({"block": blocks_, "part": part[0], "data": [packed(alpha[number[ends[i]:ends[i + 1]]]) for i in range(len(blocks_))]})

    def final(k: tuple, body: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        keys, size, held, known, base, value, doc, before = unpacked(body["data"].iloc[0])
        alpha = np.concatenate([unpacked(x)[0] for x in answers.sort_values("part")["data"]])
        before = unplaned(before, np.uint32)
        value = value + np.bincount(doc, weights=alpha[before], minlength=len(keys))
        return pd.DataFrame({"k": pd.array(keys, "Int64"), "held_out": held.astype(bool), "n_tokens": size.astype(np.int64), "n_known": known.astype(np.int64),
                             "train_tokens": total, "base_score": base, "score": value})

    answers = words.unionAll(pairs).drop("seen")
    opened = written(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(contexts, ASKED), "lm-contexts")
    alphas = opened.where("part >= 0").groupBy("part").applyInPandas(weights, "block long, part int, data binary")
    return (opened.where("part < 0").groupBy("block").cogroup(alphas.groupBy("block"))
            .applyInPandas(final, "k long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
            .withColumnRenamed("k", key))
