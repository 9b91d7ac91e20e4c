import hashlib
import random

import numpy as np
import pytest

from cellsieve.llm import suffix_dedup as S

from .conftest import plain, texts_of

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def padded(raw):
    return np.frombuffer(raw + bytes(S.LENGTH + 16), np.uint8)


@pytest.mark.parametrize("letters", [b"a", b"ab", b"abc", bytes(range(255, 0, -1)), b"zyxwvutsrqponmlkjihgfedcba"])
def test_two_stage_sort(letters):
    rng = random.Random(len(letters))
    raw = bytes(rng.choices(letters, k=400)) * 2 + letters * 3
    wanted = np.zeros(len(raw) + S.LENGTH + 16, bool)
    some = rng.sample(range(len(raw)), len(raw) // 2)
    wanted[some] = True
    full = padded(raw)
    order = S.sort_suffixes(full, wanted).tolist()
    cut = [bytes(full[i:i + S.LENGTH]) for i in order]
    assert sorted(order) == sorted(some) and cut == sorted(cut)
    prefixes = S.common_prefixes(full, np.array(order))
    for k in range(1, len(order)):
        want = next((j for j, (x, y) in enumerate(zip(cut[k - 1], cut[k])) if x != y), S.LENGTH)
        assert prefixes[k] == want


def test_contexts_cover_every_string_once():
    rng = random.Random(5)
    texts = [bytes(rng.choices(b"ab ", k=n)) for n in (0, 99, 100, 101, 700)] + [b"a" * 500]
    ends = np.cumsum([len(t) for t in texts])
    doc, start, n, offset, anchor, _ = S.contexts(np.frombuffer(b"".join(texts), np.uint8), ends)
    strings = {(d, s) for d, a, m in zip(doc, start, n) for s in range(a, a + m)}
    assert len(strings) == n.sum() and strings == {(d, s) for d, t in enumerate(texts) for s in range(len(t) - 99)}
    of = {}  # equal strings have equal anchors at equal places
    for d, a, m, p, h in zip(doc, start, n, offset, anchor):
        for s in range(a, a + m):
            assert of.setdefault(texts[d][s:s + 100], (a + p - s, h)) == (a + p - s, h)


def expected(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - 99):
            if raw[s:s + 100] in seen:
                gone[s:s + 100] = True
            seen.add(raw[s:s + 100])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[doc_id, text] = (doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted((out[r] for r in rows), key=repr)


def mutated(seed, n=40):
    """Few passages, cut, joined and changed at random."""
    rng = random.Random(seed)
    passages = ["".join(rng.choices("abc äé\n", k=rng.randint(60, 400))) for _ in range(6)]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(passages)[rng.randint(0, 30):rng.randint(100, 400)] for _ in range(rng.randint(0, 5)))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(text))
            text = text[:at] + rng.choice("xyz") + text[at + 1:]
        rows.append((i, text, "s"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [S.HOT, 1])
def test_against_brute_force(build, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "SLICE", 3000)
    rows = mutated(hot) + [(100, "ab" * 300, "s"), (101, "ab" * 120 + "c" * 300, "s"), (102, "c" * 250, "s")]
    docs = build(rows, 5)
    assert plain(S.without_repeats(docs), *COLUMNS) == expected([(i, t) for i, t, _ in rows])


def test_shuffled_texts(build, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_ITEMS", 0)
    rows = mutated(9)
    got = S.without_repeats(build(rows), with_text=True)
    assert plain(got, *COLUMNS) == expected([(i, t) for i, t, _ in rows])
    for r in got.collect():
        assert hashlib.sha256(bytes(r["kept_text"])).hexdigest() == r["kept_sha256"]


def test_edges(build):
    from .conftest import EDGES

    # the ids that two texts share hold no repeated strings, so the order of these texts does not matter
    docs = build([*EDGES, (20, "long " * 60, "s"), (20, "long " * 60, "s"), (21, "long " * 50, "s")])
    assert plain(S.without_repeats(docs), *COLUMNS) == expected(texts_of(docs))
    assert S.without_repeats(build([])).count() == 0


@pytest.mark.parametrize("partitions", [1, 4])
def test_twins(build, partitions):
    rng = random.Random(3)
    text = "".join(rng.choices("abc def", k=700))
    rows = [(20, text, "s")] * 3 + [(21, text[100:500], "s")] * 2 + [(22, "x" + text, "s"), (30, "z" * 99, "s")]
    docs = build(rows, 4)
    docs = docs.coalesce(1) if partitions == 1 else docs
    assert plain(S.without_repeats(docs), *COLUMNS) == expected([(i, t) for i, t, _ in rows])


@pytest.mark.parametrize("items", [S.BROADCAST_ITEMS, 0])
def test_no_task_holds_a_hot_string(build, monkeypatch, items):
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdef ", k=300))
    rows = [(i, "".join(rng.choices("ghijkl ", k=150)) + passage + "".join(rng.choices("mnopqr ", k=150)), "s")
            for i in range(200)]
    monkeypatch.setattr(S, "HOT", 20)
    monkeypatch.setattr(S, "BROADCAST_ITEMS", items)
    plainly = S._sorted_slices

    def bounded(batches):  # nested, so that it goes to the workers as it is
        held = {}

        def seen():
            for batch in batches:
                for key in batch.column("key").to_pylist():
                    held[key] = held.get(key, 0) + 1
                    if held[key] > 40:  # two sides of 20 contexts
                        raise ValueError("a key holds more rows than HOT contexts have")
                yield batch

        yield from plainly(seen())

    monkeypatch.setattr(S, "_sorted_slices", bounded)
    assert plain(S.without_repeats(build(rows)), *COLUMNS) == expected([(i, t) for i, t, _ in rows])


def test_chunks(monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 64)
    test_contexts_cover_every_string_once()
