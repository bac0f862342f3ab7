"""Encoding and decoding by pieces, against the sentencepiece library on whole texts."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


ODD = ["", " ", "  a  b ", "▁", "▁▁x ▁", "<s> </s> <unk> <0x41>", "a\x00b\n\tc", "ﬁ Ａ é é", "日本語 テキスト 🙂🙃", "1234567 12 3", " " * 40 + "x", "a" * 3000, "ab" * 2000 + " " * 333, "﻿​\xa0z"]


def test_odd_texts(library):
    vocabulary = pieces.Vocabulary(PATH)
    ids, border = vocabulary.encode(ODD)
    rows = [ids[a:b].tolist() for a, b in zip(border[:-1], border[1:], strict=True)]
    assert rows == [library.encode(t, add_eos=True) for t in ODD]
    assert vocabulary.decode(ids.astype(np.int64), border) == [library.decode(r) for r in rows]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("  ▁theinrs12\n"), st.characters(exclude_categories=["Cs"]))), max_size=4))
def test_any_text(texts):
    vocabulary = pieces.vocabulary(PATH)
    ids, border = vocabulary.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(border[:-1], border[1:], strict=True)] == [vocabulary.library.encode(t, add_eos=True) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999)), max_size=12), max_size=4))
def test_any_ids(rows):
    vocabulary = pieces.vocabulary(PATH)
    border = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    assert vocabulary.decode(np.array([x for r in rows for x in r], np.int64), border) == [vocabulary.library.decode(r) for r in rows]


def test_both_agendas_are_one():
    vocabulary, rng = pieces.vocabulary(PATH), random.Random(4)
    for _ in range(500):
        chunk = "▁" + "".join(rng.choice("theinrsoaé") for _ in range(rng.randint(0, 60)))
        assert vocabulary._short(chunk) == vocabulary._long(chunk)


def test_memory_is_bounded_and_results_are_not(monkeypatch, library):
    monkeypatch.setattr(pieces, "KNOWN_CHARS", 50)
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 40)
    rng, vocabulary = random.Random(1), pieces.Vocabulary(PATH)
    texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    ids, border = vocabulary.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(border[:-1], border[1:], strict=True)] == [library.encode(t, add_eos=True) for t in texts]
    assert len(vocabulary.code) < 100


def test_awkward_rows(spark):
    rows = [(1, None), (None, "a b"), (None, None), (2, "x"), (2, "x"), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("clash").alias("ids"), F.lit("kept").alias("code"))
    out = pieces.decode(pieces.encode(docs, PATH), PATH).collect()
    assert sorted((str(r["doc_id"]), r["ids"], r["text"], r["code"]) for r in out) == sorted((str(i), pieces.vocabulary(PATH).library.encode(t or "", add_eos=True), t or "", "kept") for i, t in rows)
    assert pieces.decode(pieces.encode(docs.limit(0), PATH), PATH).count() == 0


def test_query(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for r in docs:
        ids = library.encode(r["text"] or "", add_eos=True)
        want.add((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    got = queries.QUERIES["op12_sentencepiece"](spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert len(got) == len(docs) and set(map(tuple, got)) == want
