import os
import random

import numpy as np
import pytest

from rows import awkward, with_extras
from sparquill.llm import bpe

VOCABULARY = os.environ.get("BPE_VOCABULARY", bpe.VOCABULARY)
SCHEMA = "doc_id long, text string"


def texts():
    r = random.Random(4)
    out = ["", " ", "\n\n  x", "aaaaaaaaaaaaaaaaa", "don't we'll I'm", "naïve café \U0001f600\U0001f600", "ÀÉ 中文字 العربية", "x = {'a': 1}\t\r\n\r\n", "<|endoftext|>", "\u0000\u0001\x7f﻿ 　", "1234567890" * 9]
    alphabet = "abcdefgh   \n\t.,!éüß中\U0001f600'0123456789ABZ"
    out += ["".join(r.choice(alphabet) for _ in range(r.randint(1, 200))) for _ in range(200)]
    out += ["the " * 500 + "ththththth" * 40, "a" * 3000, "ab" * 2001]
    return out


def test_equals_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    given = texts()
    want = [e.ids for e in t.encode_batch(given, add_special_tokens=False)]
    merges = bpe.load(VOCABULARY)
    ids, counts = bpe.encode_texts(given, merges)
    ends = np.cumsum(counts)
    for text, w, lo, hi in zip(given, want, ends - counts, ends, strict=True):
        assert ids[lo:hi].tolist() == w, text[:60]
        assert bpe.decode_bytes(ids[lo:hi], merges).decode() == text


def test_round_trip(spark):
    rows = list(enumerate(texts())) + awkward()
    df = with_extras(spark.createDataFrame(rows, SCHEMA))
    out = bpe.encode(df, VOCABULARY)
    assert out.columns == ["doc_id", "token_ids", "n_tokens", "exact"]
    got = out.collect()
    assert len(got) == len(rows) and all(r["exact"] and r["n_tokens"] == len(r["token_ids"]) for r in got)
    back = bpe.decode(out, VOCABULARY).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(i), t or "") for i, t in rows)


def test_chunks_of_a_few_bytes(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 100)
    rows = list(enumerate(texts()[:60]))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    small = {r["doc_id"]: r["token_ids"] for r in bpe.encode(df, VOCABULARY).collect()}
    monkeypatch.undo()
    assert small == {r["doc_id"]: r["token_ids"] for r in bpe.encode(df, VOCABULARY).collect()} and len(small) == 60


def test_decoding_null_and_broken(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [int(bpe.load(VOCABULARY).of_byte[0xC3])])], "doc_id long, token_ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(df, VOCABULARY).collect()} == {1: None, 2: "", 3: "�"}


def test_empty(spark):
    assert bpe.encode(spark.createDataFrame([], SCHEMA), VOCABULARY).count() == 0
