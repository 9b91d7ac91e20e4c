import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from cellsieve.llm import byte_bpe as B

from .conftest import plain, texts_of

PATH = P.path("byte_bpe_multi_50k.tiktoken")
COLUMNS = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@pytest.fixture(scope="module")
def code():
    return B.Coder(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library(code):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=code.ranks, special_tokens={})


def some_texts(seed):
    rng = random.Random(seed)
    alphabets = [
        "aAéÉñß.,;:!?'’ \n\t01²x́‍ \x1c\x85  <|>%$ſİΣς한ᄒ字🙂﻿͸\U000e0fff", "a", "ab", " ", " \n", "'s t", "'sllve ", "!'s", "字的一是了",
        "0123456789", "=", "-=", "xyz ", "ทดสอบภาษา", "the of and in ", "\U0001f600\U0001f468‍"]
    out = []
    for _ in range(400):
        text = ""
        for _ in range(rng.randint(1, 4)):
            text += "".join(rng.choices(rng.choice(alphabets), k=rng.randint(0, 90)))
        out.append(text)
    return [*out, "", "<|endoftext|>", "a" * 700, " " * 700 + "x", "don't" * 90, "!" * 300 + "'s" + "b" * 300]


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 40])
def test_halves_equal_the_library(code, library, leaf, monkeypatch):
    monkeypatch.setattr(code, "leaf", leaf)
    monkeypatch.setattr(B, "NEAR", leaf)  # long matches are joined by their ids
    for text in some_texts(leaf):
        ids = code.encode(text)
        assert ids.tolist() == library.encode_ordinary(text), text
        assert code.decode(ids).decode() == text


def test_any_cut(code, library, monkeypatch):
    monkeypatch.setattr(code, "leaf", 1)
    monkeypatch.setattr(B, "NEAR", 1)
    for text in ["internationalisation" * 3, "a" * 70, "  \n   \n x", "!!!!'s'll 12345a", " " * 40 + "字" * 20 + "。字"]:
        for cut in range(len(text) + 1):
            left, right = (np.array(library.encode_ordinary(t), np.uint32) for t in (text[:cut], text[cut:]))
            assert code.join(text, 0, cut, len(text), left, right).tolist() == library.encode_ordinary(text)


def test_compatible_neighbours_decide(code):
    """A row of ids is what merging gives exactly when all neighbours are compatible."""
    rng = random.Random(5)
    good = 0
    for _ in range(3000):
        raw = "".join(rng.choices("etaoinsz", k=rng.randint(2, 9))).encode()
        ids, at = [], 0
        while at < len(raw):  # any way of cutting the bytes into ids
            sizes = [n for n in range(1, 5) if raw[at:at + n] in code.ranks and at + n <= len(raw)]
            size = rng.choice(sizes)
            ids.append(code.ranks[raw[at:at + size]])
            at += size
        if len(ids) > 1:
            fits = all(code.fits(a, b) for a, b in zip(ids, ids[1:]))
            assert fits == (code.merged(raw) == ids)
            good += fits
    assert good > 20


def expected(library, rows):
    out = []
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        out.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_documents(library, documents):
    assert plain(B.round_trip(documents, PATH, P.PATTERN), *COLUMNS) == expected(library, texts_of(documents))


@pytest.mark.parametrize("part", [B.PART, 1000])
def test_edges(library, build, monkeypatch, part):
    """Also with texts dealt in parts, in two rounds of joins."""
    monkeypatch.setattr(B, "PART", part)
    docs = build()
    assert plain(B.round_trip(docs, PATH, P.PATTERN), *COLUMNS) == expected(library, texts_of(docs))
    back = B.decoded(B.encoded(docs, PATH, P.PATTERN), PATH, P.PATTERN)
    assert plain(back, "doc_id", "text") == sorted(((d, t or "") for d, t in texts_of(docs)), key=repr)
    assert B.round_trip(build([]), PATH, P.PATTERN).count() == 0
