import random

import numpy as np
import pytest

from cellsieve.llm import graph
from cellsieve.llm import minhash_dedup as N
from cellsieve.llm.graph import components

from .conftest import plain, texts_of


def shingles(text, size):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1)) or frozenset([tuple(words)])


def expected(rows, size, percent=80):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and (
                    100 * len(a & b) >= percent * len(a | b)):
                parent[root(i)] = root(j)
    order = lambda d: (d is None, d or 0)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d, key=order)
    return sorted(((d, len(s), least[root(i)] if s else d, (least[root(i)] if s else d) == d)
                   for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def copies(seed, groups=6, each=14):
    """Groups of graded copies: many pairs lie close to the threshold."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(groups):
        base = rng.choices(words, k=rng.randint(25, 90))
        for _ in range(each):
            text = list(base)
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text), "s"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block", [(1, 400), (2, 3)])
def test_against_all_pairs(build, monkeypatch, seed, block):
    monkeypatch.setattr(N, "BLOCK_NODES", block)
    rows = copies(seed)
    got = N.near_duplicates(build(rows), shingle=4)
    assert plain(got, *COLUMNS) == expected([(i, t) for i, t, _ in rows], 4)


@pytest.mark.parametrize("longer,block", [(2000, 2000), (200, 30)])
def test_short_pair_among_longer_texts(build, monkeypatch, longer, block):
    monkeypatch.setattr(N, "BLOCK_SIGNED", block, raising=False)
    rng = random.Random(7)
    own = iter(range(1 << 30))
    passage = [f"p{i}" for i in range(104)]

    def around(n):
        return " ".join(passage + [f"o{next(own)}" for _ in range(n)])

    # similarity 100 : 120 of the pair; longer texts, too long to be like it, with smaller ids are the centres of their buckets
    rows = [(i, around(rng.randint(40, 45)), "s") for i in range(longer)] + [(9000, around(10), "s"), (9001, around(10), "s")]
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(build(rows)).collect()}
    assert got == {i: 9000 if i == 9001 else i for i, _, _ in rows}


@pytest.mark.parametrize("copies_", [500, 2000])
def test_rows_grow_with_a_group_of_copies(spark, monkeypatch, copies_):
    """Graded copies of one text: what is listed and dealt stays within a constant times the nodes."""
    rng = random.Random(copies_)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(copies_):
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(80)] = f"c{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    counted = {"met": 0, "refused": 0, "dealt": 0}
    write, deal = N.write_table, N._dealt

    def writing(df, name, *path):
        out = write(df, name, *path)
        if name in counted:
            counted[name] += out.count()
        return out

    def dealing(*given):
        out = write(deal(*given), "dealt")
        counted["dealt"] = max(counted["dealt"], out.count())
        return out

    monkeypatch.setattr(N, "write_table", writing)
    monkeypatch.setattr(N, "_dealt", dealing)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert N.near_duplicates(docs, shingle=4).count() == copies_
    assert counted["dealt"] <= 6 * copies_ and counted["met"] <= 10 * copies_ and counted["refused"] <= 5 * copies_, counted


def test_bands_keep_what_can_be_alike(spark, monkeypatch):
    """Every pair of different components that sizes allow meets in one task, at least one of them outside the main one."""
    monkeypatch.setattr(N, "BROADCAST_ROWS", 0)
    rng = random.Random(9)
    rows = [(1, i, 0 if i % 3 else i, rng.choice([8, 10, 12, 15, 20, 25, 100, 125]), 10) for i in range(120)]
    dealt = N._dealt(spark.createDataFrame(rows, "cluster long, node long, comp long, n long, bytes long"), 80, 7, 1000).collect()
    met = {}
    for r in dealt:
        met.setdefault(r["task"], []).append(r)
    pairs = set()
    for task in met.values():
        assert len(task) < 60
        for a in task:
            for b in task:
                if (a["own"] and not a["is_main"]) or (a["other"] and not b["other"]):
                    pairs.add(frozenset((a["node"], b["node"])))
    for _, a, ca, na, _ in rows:
        for _, b, cb, nb, _ in rows:
            if ca != cb and 5 * min(na, nb) >= 4 * max(na, nb):
                assert frozenset((a, b)) in pairs


def test_near_forest_equals_pairs():
    rng = np.random.default_rng(2)
    sigs = np.where(rng.random((40, 120)) < 0.8, 1, rng.integers(2, 1 << 20, (40, 120))).astype(np.int32)
    sizes, comp = rng.integers(80, 120, 40), rng.integers(0, 12, 40)
    rest = rng.random(40) < 0.5
    links = N.near_forest(sizes, sigs, comp, rest, True, 80)
    assert links and all(comp[a] != comp[b] for a, b in links)
    parent = {int(c): int(c) for c in comp}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def near(i, j):
        agree = int((sigs[i] == sigs[j]).sum())
        return agree >= 96 - 6 * 19.2 ** 0.5 and 5 * min(sizes[i], sizes[j]) >= 4 * max(sizes[i], sizes[j])

    for a, b in links:
        assert near(a, b) and root(int(comp[a])) != root(int(comp[b]))
        parent[root(int(comp[a]))] = root(int(comp[b]))
    for i in np.flatnonzero(rest):
        for j in range(40):
            if near(i, j):
                assert root(int(comp[i])) == root(int(comp[j]))


def test_documents(documents):
    assert plain(N.near_duplicates(documents, shingle=4), *COLUMNS) == expected(texts_of(documents), 4)


@pytest.mark.parametrize("limit", [N.BROADCAST_ROWS, 0])
def test_edges(build, monkeypatch, limit):
    monkeypatch.setattr(N, "BROADCAST_ROWS", limit)
    docs = build()
    assert plain(N.near_duplicates(docs), *COLUMNS) == expected(texts_of(docs), 5)
    left = N.one_of_each(docs)
    assert left.columns == docs.columns
    # one of the rows 5, 5, 7 and 8 stays, and all others
    ids = sorted((r["doc_id"] for r in left.collect()), key=repr)
    assert ids == sorted([None, None, 1, 2, 3, 4, 5, 6, 6, -9, 10, 1 << 62], key=repr)
    assert N.near_duplicates(build([])).count() == 0 and N.one_of_each(build([])).count() == 0


def test_forest_equals_pairs():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 30, 25)).astype(np.uint64) for _ in range(40)]
    comp = np.arange(40)
    links = N.forest(sets, comp, np.ones(40, bool), True, 60)
    parent = list(range(40))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert N.alike(sets[a], sets[b], 60)
        assert root(a) != root(b)  # no cycle
        parent[root(a)] = root(b)
    for i in range(40):
        for j in range(i):
            if N.alike(sets[i], sets[j], 60):
                assert root(i) == root(j)


def test_short_keys_miss_little():
    share = 0.8 ** N.ROWS
    assert 1 - (1 - (1 - share) ** N.TABLES) ** 2 < 2e-6


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(45)]
    edges += [(500, 500 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {x: root(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


@pytest.mark.parametrize("few", [0, 10**6])
def test_rounds_of_components(spark, monkeypatch, few):
    """Rounds end with the one that has made stars of all edges; none is run to see that nothing changes."""
    written = []
    monkeypatch.setattr(graph, "BROADCAST_EDGES", few)
    monkeypatch.setattr(graph, "write_table", lambda df, name, *at: written.append(name) or N.write_table(df, name, *at))

    def run(edges, **how):
        written.clear()
        table = spark.createDataFrame(edges, "x long, y long")
        return {r["node"]: r["root"] for r in components(table, "x", "y", **how).collect()}

    star = [(k, 3) for k in range(4, 40)]
    assert run(star + star) == {k: 3 for k in range(3, 40)} and written == ["large-star", "components", "roots"]
    assert run(star, own=False) == {k: 3 for k in range(4, 40)} and written == ["large-star", "components"]
    # 9 has two centres, of which none is tied to another node
    assert run([(1, 9), (2, 9), (2, 8), (8, 8)]) == {1: 1, 2: 1, 8: 1, 9: 1}
    rng = random.Random(5)
    pairs = [(a, b) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(260)) if a != b]
    least = {x: x for pair in pairs for x in pair}
    for _ in least:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    assert run(pairs) == least
