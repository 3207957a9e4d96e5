"""Piece encoding in parts: long words, long texts, slices of ids, the check column, vocabularies at their limits."""

import random

import numpy as np
import pytest
import sentencepiece

from lanwatch.llm import pieces

RNG = random.Random(3)
MODEL = pieces.default_model()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_a_word_beyond_the_index_equals_the_library(library):
    vocab = pieces.vocabulary(MODEL)
    for letters in ("etaoinshrdlu", "a", "ab", "é日x", "0123456789abcdef"):
        word = "".join(RNG.choices(letters, k=pieces.INDEX_BYTES + 5000))
        ids, at = pieces.Encoder(vocab).encode([f"one {word}", word])
        want = [library.encode(f"one {word}"), library.encode(word)]
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want


def test_ten_megabytes_without_a_space_give_the_text_back():
    vocab = pieces.vocabulary(MODEL)
    text = "".join(RNG.choices("etaoin 0xé".replace(" ", ""), k=10_000_000))
    ids, at = pieces.Encoder(vocab).encode([text])
    assert pieces._text(vocab.raw(ids, at)[0]) == text


def test_long_texts_are_encoded_in_parts(library, monkeypatch):
    monkeypatch.setattr(pieces, "SLICE_BYTES", 50)
    vocab = pieces.vocabulary(MODEL)
    for text in ("  two  spaces " * 40, "x" * 500, " " * 300, "a" + " " * 300 + "b", "日本 " * 100):
        assert pieces.Encoder(vocab).encode([text])[0].tolist() == library.encode(text)


def test_cache_starts_anew(library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 3)
    encoder = pieces.Encoder(pieces.vocabulary(MODEL))
    for text in ("one two three four five", "one six", "seven one two"):
        assert encoder.encode([text])[0].tolist() == library.encode(text)
    assert len(encoder.known) <= 3 + 5


def test_decode_in_slices_with_nulls_and_unknown_ids(spark, monkeypatch, library):
    texts = ["some words", None, "", "ünï ▁ çöde", "x" * 50]
    rows = [(i, t, library.encode(t) if t is not None else None) for i, t in enumerate(texts)] + [(9, "", [-5, 10 ** 6, None])]
    df = spark.createDataFrame(rows, "id long, text string, ids array<int>").coalesce(1)
    monkeypatch.setattr(pieces, "SLICE_IDS", 4)
    got = {r.id: r.decoded for r in pieces.decode(df, MODEL, "ids").collect()}
    assert got == {0: texts[0], 1: None, 2: "", 3: texts[3].replace(pieces.SPACE, " "), 4: texts[4], 9: ""}
    assert pieces.decode(df.where("false"), MODEL, "ids").count() == 0


def test_check_tells_of_the_round_trip(spark):
    df = spark.createDataFrame([(1, "plain", "x"), (2, None, "x"), (3, "a▁b", "x"), (4, "tab\tline\n\x00", "x")], "id long, text string, ok string")
    got = pieces.encode(df, MODEL, check="ok")
    assert got.columns == ["id", "text", "ok", "piece_ids", "ok_"]
    assert all(r.ok_ for r in got.collect()) and pieces.encode(df.where("false"), MODEL, check="ok").count() == 0


def test_raw_of_no_lists():
    assert pieces.vocabulary(MODEL).raw(np.empty(0, np.int64), np.array([0])) == []
