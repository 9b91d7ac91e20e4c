import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cellsieve.llm import token_codes as C

from .conftest import plain, texts_of

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, (1 << 32) - 1)), max_size=1500), st.data())
@settings(max_examples=60, deadline=None)
def test_codes_round_trip(ids, data):
    codes = C.Codes(C.encode_codes(np.array(ids, np.uint32)))
    assert len(codes) == len(ids)
    assert codes.slice(0, len(ids)).tolist() == ids
    if ids:
        a = data.draw(st.integers(0, len(ids)))
        b = data.draw(st.integers(0, len(ids)))
        assert codes.slice(a, b).tolist() == ids[a:b]
        at = data.draw(st.integers(0, len(ids) - 1))
        assert codes[at] == ids[at]


def test_codes_reject_other_bytes():
    with pytest.raises(ValueError):
        C.Codes(b"nope" * 10)
    with pytest.raises(IndexError):
        C.Codes(C.encode_codes(np.array([1], np.uint32)))[1]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def whole(tokenizer, text):
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_words_equal_whole_texts(tokenizer, documents, monkeypatch):
    monkeypatch.setattr(C, "REMEMBERED", 50)  # forget often
    encode = C.Encoder(PATH)
    rng = random.Random(4)
    assert encode.direct and encode.direct_bytes
    letters = "aAéÉñßÿÀÞ÷×.,;:!?'’ \n\t01²x́‍ \x1c\x85  <|>%$ſİΣς한ᄒ字🙂﻿"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(1500)]
    texts += ["dogs' x''s a'll' it's$$$ É*** é_- 5% ÜBER### a\u0301!! é'd", "###a ### 1. a1!"]
    texts += ["<|startoftext|> a", "<|STARTOFTEXT|>", "x<|endoftext|>.", "it's I'M. DON'T!", "é. É! İ?", "w" * 300 + "."]
    # capitals whose mark composes with the small letter only
    pairs = ["H\u0331", "T\u0308", "W\u030a", "Y\u030a", "J\u030c"]
    texts += [*pairs, *[f"x{p}Y {p}. A{p}B, {p.lower()}" for p in pairs], " ".join(pairs)]
    texts += [t for _, t in texts_of(documents) if t is not None]
    while texts:
        some, texts = texts[:7], texts[7:]
        assert [i.tobytes() for i in encode(pa.array(some))] == [whole(tokenizer, t) for t in some]


def expected(tokenizer, rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = whole(tokenizer, text or "") + (2).to_bytes(4, "little")
        out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return sorted(out, key=repr)


def test_documents(tokenizer, documents, monkeypatch):
    monkeypatch.setattr(C, "SEGMENT_IDS", 5000)
    rows = sorted(texts_of(documents))
    got = C.stored_codes(documents, PATH)
    assert plain(got, "doc_id", "start", "n_tokens", "ids_crc32") == expected(tokenizer, rows)


def test_edges(tokenizer, build):
    got = C.stored_codes(build(), PATH)
    found = sorted((tuple(r) for r in got.select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    assert len(found) == build().count()
    assert [r[0] for r in found] == [0, *np.cumsum([r[2] for r in found])[:-1].tolist()]  # without gaps
    ids = [r[1] for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = {(i, n, c) for i, _, n, c in expected(tokenizer, texts_of(build()))}
    assert {(r[1], r[2], r[3]) for r in found} == want
    assert C.stored_codes(build([]), PATH).count() == 0


def test_segments_are_addressable(spark, documents, tokenizer, tmp_path):
    C.write_codes(documents, PATH, str(tmp_path / "codes"))
    row = spark.read.parquet(str(tmp_path / "codes")).orderBy("part", "segment").first()
    codes = C.Codes(bytes(row["codes"]))
    text = documents.where(f"doc_id = {row['doc_ids'][1]}").first()["text"]
    begin = row["lengths"][0]
    ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
    assert [codes[begin + k] for k in range(len(ids))] == ids
