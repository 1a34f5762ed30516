import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reviewlab.llm import bpe, packing
from reviewlab.llm.queries import QUERIES
from reviewlab.llm.tokens import Encoder, pieces_of, vocabulary_path, words_of

PATH = vocabulary_path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)
ENC = Encoder(PATH)
ODD = ["", " ", "a", " a", "a ", "a  b", "a \n b", "\n\n a\tb", "it's  <|endoftext|> x<|endoftext|>", "x <|endoftext|>\n y", "\x00b \x00b b", "日本 語", "é è　x", "\x1c \x1d a b", "a\x85 b \x85c", "1 22 333 !!!", "'s 's", "​ ​", "a﻿ b", "😀 😀😀"]


def ids(t):
    return TOK.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_encoder_is_the_library(text):
    assert np.frombuffer(ENC(text), "<u4").tolist() == ids(text)
    assert b"".join(pieces_of(PATH)[i] for i in ids(text)).decode("utf-8", "replace") == TOK.decode(ids(text), skip_special_tokens=False) == text


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t　\x1c'sa1é!"), st.characters(codec="utf-8")), max_size=40))
def test_encoder_on_any_text(text):
    assert np.frombuffer(ENC(text), "<u4").tolist() == ids(text)
    if text:
        head, *tail = words_of(text)
        assert head + "".join(" " + w for w in tail) == text
        assert sum((ids(bpe.plain(w)) for w in bpe.marked(text)), []) == ids(text)


def test_whole_texts_are_encoded_without_a_cache_of_words(monkeypatch):
    from reviewlab.llm import tokens
    monkeypatch.setattr(tokens, "words_of", None)
    enc = Encoder(PATH)
    for text in [*ODD, "a " * 5000 + "<|endoftext|>" + " " * 3000 + "<|endoftext| >", "".join(f"w{i} " for i in range(5000))]:
        assert np.frombuffer(enc(text), "<u4").tolist() == ids(text)
    assert not any(isinstance(x, dict) and x for x in vars(enc).values())


def test_bpe_rows(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 50)
    rows = [(i, t, 0) for i, t in enumerate(ODD)] + [(None, "null key", 0), (3, None, 0), (1, "x y " * 500, 0), (1, "x y " * 500, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.encode(docs, PATH).select("doc_id", "ids", bpe.decode(F.col("ids"), PATH).alias("text")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, list(r.ids), r.text) for r in got), key=key) == sorted(((i, ids(t), t or "") for i, t, _ in rows), key=key)
    assert bpe.encode(docs.where("doc_id < 0"), PATH).count() == 0


def check_packing(rows, texts, size=1024):
    """Every id in exactly one piece, gapless sequences, right checksums; returns the padding."""
    of, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for key, text in texts.items():
        want = np.array(ids(text) + [0], "<u4")
        at = 0
        for r in sorted(of[key], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(want[at:at + r.length].tobytes())
            at += r.length
        assert at == len(want)
    padding = 0
    for pieces in seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size
        padding += size - at if at & (at - 1) else 0
    return padding


def test_levels_rule():
    levels = packing.Levels(8)
    for level, n in ((3, 2), (5, 1)):
        for w in range(n):
            levels.put(level, w)
    for length in range(1, 8):
        def after(level):
            c = levels.count.copy()
            if level:
                c[level] -= 1
            if level + length < 8:
                c[level + length] += 1
            return (c ** 2).sum()
        allowed = [x for x in range(8 - length + 1) if x == 0 or levels.count[x]]
        best = min(map(after, allowed))
        assert levels.place(length) == max(x for x in allowed if after(x) == best)


def test_packing_small_windows(spark, monkeypatch):
    monkeypatch.setattr(packing, "RESERVE", 64)
    texts = {i: " ".join(["word"] * (i * 7 % 53)) for i in range(300)} | {900: None, 901: "", 902: "a b " * 2000}
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, start int").repartition(3)
    rows = packing.pack(docs, PATH, size=32).collect()
    assert check_packing(rows, texts, 32) <= 0.02 * sum(len(ids(t)) + 1 for t in texts.values())
    assert packing.pack(docs.where("doc_id < 0"), PATH).count() == 0


def test_small_tasks_keep_documents_whole():
    rnd = np.random.default_rng(1)
    for low, high, n in ((100, 300, 200), (200, 900, 100), (20, 1500, 400)):
        packer = packing.Packer(1024, 0)
        for i in range(n):
            packer.add(i, np.zeros(rnd.integers(low, high), "<u4").tobytes())
        packer.finish()
        whole, short, filled = set(), set(), defaultdict(int)
        for key, _, length, _, total, window, _ in packer.rows:
            filled[window] += length
            short |= {key} if total < 1024 else set()
            whole |= {key} if total < 1024 and length == total else set()
        assert len(whole) >= 0.85 * len(short)
        assert all(x == 1024 or not x & (x - 1) for x in filled.values())


def test_queries_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())
    rows = QUERIES["op3_pack_sequences"](spark, sf).collect()
    assert check_packing(rows, texts) == 0
    for r in QUERIES["op2_bpe_roundtrip"](spark, sf).collect():
        want = ids(texts[r.doc_id])
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
