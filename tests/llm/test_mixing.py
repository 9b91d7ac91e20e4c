import random

import pytest

from cellsieve.llm import mixing as X

from .conftest import plain, texts_of


def by_hand(seats, votes, caps):
    out = [0] * len(votes)
    for _ in range(min(seats, sum(c for v, c in zip(votes, caps) if v > 0))):
        best = max((i for i in range(len(votes)) if out[i] < caps[i] and votes[i] > 0), key=lambda i: (votes[i] / (2 * out[i] + 1), -i))
        out[best] += 1
    return out


def test_sainte_lague():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(0, 7)
        votes = [rng.choice([0, 1, 1, 5, 12.5, 1000, rng.random()]) for _ in range(n)]
        caps = [rng.randint(0, 60) for _ in range(n)]
        seats = rng.randint(0, 150)
        assert X.sainte_lague(seats, votes, caps) == by_hand(seats, votes, caps)
    assert X.sainte_lague(10**12, [3, 1], [10**13] * 2) == [75 * 10**10, 25 * 10**10]
    assert X.sainte_lague(7, [53, 24, 23], [9] * 3) == [3, 2, 2]


def test_targets():
    assert X.targets([100, 100, 100], [5, 2, 1]) == [200.0, 2 * 250 / 3, 250 / 3]
    assert X.targets([0, 0], [5, 2]) == [0.0, 0.0]
    got = X.targets([1, 1000, 10], [5, 2, 1])
    assert got[0] == 2 and got[2] == 20 and abs(sum(got) - 1.5 * 1011) < 1e-9


def word_count(text):
    return len((text or "").encode().split())


def check(docs):
    rows = texts_of(docs)
    sources = {}
    for r in docs.select("source", "text").collect():
        sources[r["source"]] = sources.get(r["source"], 0) + word_count(r["text"])
    names = sorted(sources, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, X.targets([sources[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    got = X.taken_report(docs).collect()
    assert sorted(((r["doc_id"], r["size"]) for r in got), key=repr) == sorted(((i, word_count(t)) for i, t in rows), key=repr)
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source_size"], r["target"]] = taken.get((r["source_size"], r["target"]), 0) + r["taken"]
    wanted = {}
    for s in names:
        key = sources[s], goal[s]
        wanted[key] = wanted.get(key, 0) + 1
    assert set(taken) == set(wanted)
    for (_, target), n in taken.items():
        assert abs(n / wanted[_, target] - target) <= 3 * X.BLOCK_WORDS
    return got


def test_documents(documents, build):
    for docs in (documents, build()):
        first = check(docs)
        again = X.taken_report(docs.repartition(7)).collect()
        assert sorted(map(repr, first)) == sorted(map(repr, again))
    assert X.taken_report(build([])).count() == 0


@pytest.mark.parametrize("block", [1, X.BLOCK_WORDS, 1000])
def test_texts_follow_the_report(documents, build, block):
    for docs in (documents, build()):
        report = {}
        for r in X.taken_report(docs, block).collect():
            report[r["doc_id"]] = report.get(r["doc_id"], 0) + r["taken"]
        mixed = X.mixed_texts(docs, block)
        assert mixed.schema.simpleString() == docs.schema.simpleString()
        found = {}
        originals = {}
        for i, t in texts_of(docs):
            originals.setdefault(i, []).append(t)
        for r in mixed.collect():
            found[r["doc_id"]] = found.get(r["doc_id"], 0) + word_count(r["text"])
            assert any(r["text"] in (t or "") for t in originals[r["doc_id"]])
            assert r["n_chars"] == len(r["text"])
        assert found == {i: n for i, n in report.items() if n}
    assert X.mixed_texts(build([]), block).count() == 0


def test_seed_matters(documents):
    a, b = plain(X.taken_report(documents), "doc_id", "taken"), plain(X.taken_report(documents, seed="other"), "doc_id", "taken")
    assert a != b


def test_pieces():
    raw = "a  bb\tc dd\n".encode()
    assert X._pieces(raw, 4, [(0, 4, 2)]) == [raw, raw]
    assert X._pieces(raw, 4, [(0, 4, 1), (1, 3, 1)]) == [raw, b"bb\tc"]
    assert sorted(X._pieces(raw, 4, [(0, 1, 1), (3, 4, 1)])) == [b"a", b"dd"]
