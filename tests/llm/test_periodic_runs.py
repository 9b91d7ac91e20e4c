import hashlib
import random
import zlib

import numpy as np
import pytest

from cellsieve.llm import periodic_runs as R

from .conftest import plain, texts_of

COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def by_definition(words):
    """(start, length, period) of all runs, from every stretch of words."""
    n, out = len(words), []

    def keeps(a, b, q):
        return all(words[i] == words[i + q] for i in range(a, b - q))

    for a in range(n):
        for b in range(a + 12, n + 1):
            q = next(q for q in range(1, b - a + 1) if keeps(a, b, q))
            if b - a >= 2 * q and not (a and keeps(a - 1, b, q)) and not (b < n and keeps(a, b + 1, q)):
                out.append((a, b - a, q))
    return sorted(out)


def by_period(words):
    """The same, period by period."""
    n, least = len(words), {}
    for q in range(1, n // 2 + 1):
        a = 0
        while a + q < n:
            b = a
            while b + q < n and words[b] == words[b + q]:
                b += 1
            if b - a >= q and b + q - a >= 12:
                least.setdefault((a, b + q - a), q)
            a = max(b, a) + 1
    return sorted((a, size, q) for (a, size), q in least.items())


def expected(rows):
    out = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        n = len(words)
        h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
        if n and h is not None and h % 10 == 0:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = by_period(words)
        dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(((-m, s, q) for s, m, q in runs), default=None)
        shown = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        out.append((doc_id, len(runs), *shown,
                    hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
                    hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest()))
    return sorted(out, key=repr)


def repetitive(rng, n, letters):
    words = []
    while len(words) < n:
        if rng.random() < 0.5:
            words += rng.choices(letters, k=rng.randint(1, 20))
        else:
            part = rng.choices(letters, k=rng.randint(1, 40))
            words += (part * 6)[:rng.randint(len(part), 6 * len(part))]
    return [w.encode() for w in words[:n]]


def finished(codes):
    return sorted((a, b - a, q) for q, a, b in R.found_in(codes) if b - a >= max(12, 2 * q))


def test_definitions_agree():
    rng = random.Random(1)
    for _ in range(40):
        words = repetitive(rng, rng.randint(0, 45), "ab")
        assert by_period(words) == by_definition(words)


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "abcdefghijklmnopqrst"])
@pytest.mark.parametrize("span", [1, 3, 32])
def test_tiles_find_all_runs(monkeypatch, letters, span):
    monkeypatch.setattr(R, "SPAN", span)
    rng = random.Random(span)
    for n in [0, 1, 11, 12, 13, 24, *[rng.randint(30, 900) for _ in range(25)]]:
        words = repetitive(rng, n, letters)
        assert finished(R.numbers(words)) == by_period(words)


def test_fibonacci_words():
    a, b = "a", "ab"
    while len(b) < 700:
        a, b = b, b + a
    words = [c.encode() for c in b]
    assert finished(R.numbers(words)) == by_period(words)


def test_planting():
    words = [b"w%d" % i for i in range(50)]
    hit = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)
    assert R.planted(words, hit) != words and len(R.planted(words, hit)) == 50
    assert R.planted(words, None) == words and R.planted([], hit) == []


@pytest.mark.parametrize("long", [R.LONG, 30])
def test_documents(documents, monkeypatch, long):
    """Also with the tiles of most texts dealt to other tasks."""
    monkeypatch.setattr(R, "LONG", long)
    got = plain(R.collapsed_report(documents), *COLUMNS)
    assert got == expected(texts_of(documents))
    assert any(r[1] > 0 for r in got)


@pytest.mark.parametrize("long", [R.LONG, 0])
def test_edges(build, monkeypatch, long):
    monkeypatch.setattr(R, "LONG", long)
    monkeypatch.setattr(R, "SPAN", 4 if long == 0 else R.SPAN)
    docs = build([*[(i, t if t is None else t[:30_000], s) for i, t, s in build().select("doc_id", "text", "source").collect()],
                  (20, "a b c d e f g " * 3, "s"), (21, "x " * 3000, "s"), (22, "one two " * 5, "s")])
    assert plain(R.collapsed_report(docs), *COLUMNS) == expected(texts_of(docs))
    found = {(r["doc_id"], r["start"], r["length"], r["period"]) for r in R.periodic_runs(docs).collect()}
    assert {(20, 0, 21, 7), (21, 0, 3000, 1)} <= found and not any(r[0] == 22 for r in found)
    assert R.collapsed_report(build([])).count() == 0 and R.periodic_runs(build([])).count() == 0


def test_z_function():
    rng = np.random.default_rng(3)
    for _ in range(200):
        word = rng.integers(0, 2, 40).tolist()
        z = R.z_function(word, 30)
        for i in range(1, 30):
            size = 0
            while i + size < 40 and word[size] == word[i + size]:
                size += 1
            assert z[i] == size
