"""Near-duplicate detection by MinHash with tensored banding.

Two collections of ``TABLES`` short keys, each from ``ROWS`` minima, stand for ``TABLES`` squared
tables: the key of table (i, j) is the pair of the i-th key of the first collection and the j-th of the second. With
16 + 16 short keys of 3 minima, 96 minima do the work of 256 tables of 6, that is of 1,536. Two texts of
similarity 0.8 miss all tables with a probability of 1.2e-6 for the default of 20 + 20.

1. Documents become sets of hashed shingles and minima; documents with equal sets become one node.
2. Short keys that only one node has cannot be half of a shared pair and are dropped before pairs are formed, so the
   quadratic number of keys is paid only by documents with a possible partner.
3. In each table's bucket all nodes are tied to the smallest one (a star, never all pairs). Ties whose sizes differ too
   much or whose minima agree too seldom for the similarity asked for (six standard deviations below it) are dropped.
   The others give clusters. A bucket may hold several clusters: its centre can be a longer text with a passage
   that shorter ones share. What a centre refuses is tied to the smallest refused node of its bucket, in rounds over rows that
   shrink. Clusters that still meet in a bucket are one *super-cluster*; there the nodes outside the largest cluster are
   compared with those of all other clusters by size and minima, once per super-cluster and not once per bucket.
   So two nodes of one bucket that pass are in one cluster, whatever the centre is.
4. Ties are verified on the full sets; verified ties give components. A cluster may hold several: two nodes can be alike
   without either being alike to the centre. There the nodes outside the largest component are compared with all nodes of
   the other components of their cluster, on full sets. So no link is lost to the choice of centres.

Comparisons run in blocks of bounded size. Blocks hold nodes of one band of set sizes, and only bands that can be alike meet.
Groups of copies cost linear work: equal sets are one node, and nodes that a star has linked are not
compared again; a node takes part in as many tasks as there are blocks of unlinked nodes in its own and the neighbouring bands, and
the linked ones are not unlinked. What is quadratic is only the number of nodes of one (super-)cluster that are not linked.

Defined results: null or empty texts have no shingles and are linked with nothing; fewer words than a shingle
are one shingle; null ids sort after all others; rows with equal ids and texts are linked like any copies; an empty table gives
an empty result; only ``doc_id`` and ``text`` are read by ``near_duplicates``, ``one_of_each`` keeps all other columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsieve.llm.base import in_arrow, raw_texts
from cellsieve.llm.graph import BROADCAST_EDGES, components
from cellsieve.scratch import write_table

SHINGLE = 5
PERCENT = 80
TABLES = 20
ROWS = 3
REMEMBERED = 200_000
#: Nodes and bytes of text in a block of an exact comparison.
BLOCK_NODES = 400
BLOCK_BYTES = 4_000_000
#: Nodes in a block of a comparison of minima.
BLOCK_SIGNED = 2_000
#: A side of a join is broadcast up to this many rows of two numbers, about 50 MB.
BROADCAST_ROWS = 1_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingles:
    """Distinct hashed shingles of a text, sorted."""

    def __init__(self, words: int) -> None:
        self.words = words
        self.known: dict[bytes, int] = {}
        self.odd = np.random.default_rng(11).integers(1, 1 << 63, max(words, 1), dtype=np.uint64) | np.uint64(1)

    def __call__(self, raw: bytes) -> np.ndarray:
        words = raw.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        hashes = np.array(
            [known[w] if w in known else known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words], np.uint64)
        n = len(hashes) - self.words + 1
        if n <= 0:
            # one shingle; its length is part of it
            whole = hashlib.blake2b(hashes.tobytes() + bytes([len(hashes)]), digest_size=8).digest()
            return np.frombuffer(whole, np.uint64).copy()
        mixed = np.zeros(n, np.uint64)
        for k in range(self.words):
            mixed += hashes[k:k + n] * self.odd[k]
        mixed ^= mixed >> np.uint64(31)
        mixed *= _MIX
        mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signed(docs: DataFrame, shingle: int, minima: int) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n``, a digest of the set in two numbers, and the minima."""
    odd = np.random.default_rng(13).integers(1, 1 << 63, minima, dtype=np.uint64) | np.uint64(1)
    shingles = Shingles(shingle)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, first, second, found = [], [], [], []
        for raw in raw_texts(batch.column("text")):
            s = shingles(raw)
            sizes.append(len(s))
            a, b = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
            first.append(a)
            second.append(b)
            if len(s):
                least = np.full(minima, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(s), 4096):  # bounded memory for very long texts
                    least = np.minimum(least, (s[None, at:at + 4096] * odd[:, None]).min(axis=1))
                found.append((least >> np.uint64(32)).astype(np.uint32).view(np.int32))
        values = np.concatenate(found) if found else np.zeros(0, np.int32)
        offsets = np.concatenate([[0], np.cumsum([minima if n else 0 for n in sizes])]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()),
             pa.array(second, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))],
            ["doc_id", "text_hash", "n", "d1", "d2", "sig"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return in_arrow(given, work, "doc_id long, text_hash long, n long, d1 long, d2 long, sig array<int>")


def _short_keys(tables: int, rows: int) -> Column:
    """The ``2 * tables`` short keys of a node; the place is part of a key."""
    return F.array(*[
        F.xxhash64(F.lit(t), *[F.get("sig", F.lit(t * rows + k)) for k in range(rows)]) for t in range(2 * tables)])


def _halves(nodes: DataFrame, tables: int, rows: int) -> DataFrame:
    """The short keys of both collections that a node shares with others, as a work table."""
    short = nodes.select("node", F.posexplode(_short_keys(tables, rows)).alias("at", "short"))
    shared = short.groupBy("short").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select(
        F.col("short").alias("_short"))
    kept = short.join(shared, F.col("short") == F.col("_short"), "left_semi").groupBy("node").agg(
        F.collect_list(F.when(F.col("at") < tables, F.col("short"))).alias("left"),
        F.collect_list(F.when(F.col("at") >= tables, F.col("short"))).alias("right"))
    return write_table(kept.where((F.size("left") > 0) & (F.size("right") > 0)), "halves")


def _keys(halves: DataFrame, *columns: str) -> DataFrame:
    """A row per node and table, with the bucket's ``key``."""
    return halves.select(*columns, F.explode("left").alias("_l"), "right").select(
        *columns, "_l", F.explode("right").alias("_r")).select(*columns, F.xxhash64("_l", "_r").alias("key"))


def _least(minima: int, percent: int) -> float:
    """Equal minima that two nodes alike have at least, but for six standard deviations."""
    return minima * percent / 100 - 6 * (minima * percent / 100 * (1 - percent / 100)) ** 0.5


def _near(ties: DataFrame, nodes: DataFrame, minima: int, percent: int) -> DataFrame:
    """The ties whose sizes and minima allow the similarity, as a work table."""
    ends = nodes.select("node", "n", "sig")
    a = ends.select(F.col("node").alias("_a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    b = ends.select(F.col("node").alias("_b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    agree = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    # few ties go to the nodes, so that one of the two joins shuffles nothing
    ties = write_table(ties, "tied")
    if ties.count() <= BROADCAST_EDGES:
        ties = F.broadcast(ties)
    near = (
        ties.join(a, F.col("centre") == F.col("_a")).join(b, F.col("node") == F.col("_b"))
        .where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        .where(agree >= F.lit(_least(minima, percent)))
    )
    return write_table(near.select("centre", "node"), "ties")


def _starred(rows: DataFrame) -> DataFrame:
    """``key``, ``node`` and ``centre`` of all rows of buckets with several nodes, but for the centres."""
    centres = rows.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where(
        "centre < last").select(F.col("key").alias("_key"), "centre")
    return rows.join(centres, F.col("key") == F.col("_key")).where("node <> centre").select("key", "node", "centre")


def _stars(halves: DataFrame, nodes: DataFrame, minima: int, percent: int) -> DataFrame:
    """``(centre, node)`` ties of all buckets, as a work table."""
    return _near(_starred(_keys(halves, "node")).select("centre", "node").distinct(), nodes, minima, percent)


def _verified(ties: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The ties whose full sets are alike."""
    a = texts.select(F.col("node").alias("_a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("_b"), F.col("text").alias("text_b"))
    pairs = ties.join(a, F.col("centre") == F.col("_a")).join(b, F.col("node") == F.col("_b")).select(
        "text_a", "text_b", "centre", "node")
    shingles = Shingles(shingle)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        last, held, keep = None, None, []
        for x, y in zip(raw_texts(batch.column(0)), raw_texts(batch.column(1))):
            if x != last:
                last, held = x, shingles(x)
            keep.append(alike(held, shingles(y), percent))
        return batch.select([2, 3]).filter(pa.array(keep, pa.bool_()))

    return write_table(in_arrow(pairs, work, "centre long, node long"), "links")


def forest(sets: list[np.ndarray], comp: np.ndarray, rest: np.ndarray, own: bool, percent: int) -> list[tuple[int, int]]:
    """Links between components: rows of ``rest`` against all rows, or without ``own`` against the others only.

    Intersections of all pairs come from products of 0/1 matrices over the shingles that occur twice. Links
    that would close a cycle are left out.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    of = np.repeat(np.arange(n), sizes)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    again = count[code] > 1
    of, code = of[again], code[again]
    code = np.unique(code, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    of, code = of[order], code[order]
    rows = np.flatnonzero(rest)
    both = np.zeros((len(rows), n), np.float32)
    width = 8192
    for start in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        lo, hi = np.searchsorted(code, [start, start + width])
        part = np.zeros((n, width), np.float32)
        part[of[lo:hi], code[lo:hi] - start] = 1
        both += part[rows] @ part.T
    union = sizes[rows][:, None] + sizes[None, :] - both
    return _acyclic(100 * both >= percent * union, comp, rows, own)


def near_forest(sizes: np.ndarray, sigs: np.ndarray, comp: np.ndarray, rest: np.ndarray, own: bool,
                percent: int) -> list[tuple[int, int]]:
    """As ``forest``, of nodes that may be alike by their sizes and minima."""
    rows = np.flatnonzero(rest)
    agree = np.zeros((len(rows), len(sizes)), np.int32)
    for minimum in sigs.T:
        agree += minimum[rows][:, None] == minimum[None, :]
    a, b = sizes[rows][:, None], sizes[None, :]
    near = (agree >= _least(sigs.shape[1], percent)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
    return _acyclic(near, comp, rows, own)


def _acyclic(linked: np.ndarray, comp: np.ndarray, rows: np.ndarray, own: bool) -> list[tuple[int, int]]:
    """Links of ``rows`` to other components that close no cycle."""
    linked &= comp[rows][:, None] != comp[None, :]
    if not own:
        linked[:, rows] = False
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked)):
        a, b = root(int(comp[rows[i]])), root(int(comp[j]))
        if a != b:
            parent[a] = b
            out.append((int(rows[i]), int(j)))
    return out


def _dealt(sized: DataFrame, percent: int, block_nodes: int, block_bytes: int) -> DataFrame:
    """Nodes of clusters with several components, once for each block comparison (``task``) they take part in.

    Of ``cluster``, ``node``, ``comp``, ``n`` (set size) and ``bytes``. A cluster that fits into a block is one task. Else its largest
    component (main) and the rest are cut into blocks by bands of set sizes, and every block of the rest meets itself and the other
    blocks of its own and the neighbouring bands. ``other`` marks the nodes that are compared with those not marked, in tasks
    that are not ``own``; those compare the nodes outside the main component with all.
    """
    per_comp = sized.groupBy("cluster", "comp").agg(F.count("*").alias("nodes"), F.sum("bytes").alias("bytes"))
    whole = write_table(per_comp.groupBy("cluster").agg(
        F.count("*").alias("comps"), F.max(F.struct("nodes", "bytes", "comp")).alias("main"),
        F.sum("nodes").alias("nodes"), F.sum("bytes").alias("bytes")).where("comps > 1").select(
        F.col("cluster").alias("_c"), F.col("main.comp").alias("_main"),
        ((F.col("nodes") <= block_nodes) & (F.col("bytes") <= block_bytes)).alias("fits")), "several")

    def small(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table

    # a little more than the ratio of sizes that can be alike, so that rounding loses none
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100.1 / percent))).cast("int")
    rows = sized.join(small(whole), F.col("cluster") == F.col("_c")).select(
        "cluster", "node", "comp", "bytes", "fits", (F.col("comp") == F.col("_main")).alias("is_main"), band.alias("band"))
    fitting = rows.where("fits").select(
        "cluster", "node", "comp", "is_main", F.lit("all").alias("task"), F.lit(True).alias("own"), F.lit(False).alias("other"))

    large = rows.where("not fits")
    blocks = F.greatest(F.ceil(F.count("*") / block_nodes), F.ceil(F.sum("bytes") / block_bytes)).cast("int")
    sizes = large.groupBy("cluster", "band", "is_main").agg(blocks.alias("blocks"))
    # blocks of the own and the neighbouring bands, at the row of every band
    near = sizes.select("cluster", "is_main", F.col("band").alias("of"), "blocks", F.explode(
        F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    plan = write_table(near.groupBy("cluster", "band").agg(F.collect_list(F.struct("is_main", "of", "blocks")).alias("near")).select(
        F.col("cluster").alias("_c"), F.col("band").alias("_b"), "near"), "plan")

    def name(is_main: Column, of: Column, nth: Column) -> Column:
        return F.concat_ws(":", F.when(is_main, "m").otherwise("r"), of, nth)

    own_blocks = F.filter("near", lambda x: (x["of"] == F.col("band")) & (x["is_main"] == F.col("is_main")))[0]["blocks"]
    placed = large.join(small(plan), (F.col("cluster") == F.col("_c")) & (F.col("band") == F.col("_b"))).withColumn(
        "block", name(F.col("is_main"), F.col("band"), F.pmod(F.xxhash64("node"), own_blocks)))
    # a main block meets blocks of the rest only
    partners = F.flatten(F.transform(
        F.filter("near", lambda x: ~(x["is_main"] & F.col("is_main"))),
        lambda x: F.transform(F.sequence(F.lit(0), x["blocks"] - 1), lambda k: name(x["is_main"], x["of"], k))))
    met = placed.withColumn("partner", F.explode(partners))
    return fitting.unionByName(met.select(
        "cluster", "node", "comp", "is_main",
        F.concat_ws("|", F.least("block", "partner"), F.greatest("block", "partner")).alias("task"),
        (F.col("block") == F.col("partner")).alias("own"), (F.col("block") > F.col("partner")).alias("other")))


def _rounds(met: DataFrame, nodes: DataFrame, minima: int, percent: int) -> list[DataFrame]:
    """Ties of the clusters that a bucket's centre has refused to the smallest of them, each by its smallest node there.

    A round drops each bucket's centre and what is tied to it. Rounds go on while they drop at least half of the rows; what
    is left then is compared in super-clusters.
    """
    first = met.groupBy("key").agg(F.min(F.struct("node", "comp")).alias("first")).select(
        F.col("key").alias("_key"), F.col("first.comp").alias("_comp"))
    rows = write_table(met.join(first, F.col("key") == F.col("_key")).where("comp <> _comp").select("key", "node"), "refused")
    left, found = rows.count(), []
    while left:
        starred = _starred(rows)
        tied = _near(starred.select("centre", "node").distinct(), nodes, minima, percent)
        if tied.isEmpty():
            break
        found.append(tied)
        passed = tied.select(F.col("centre").alias("_a"), F.col("node").alias("_b"))
        rows = write_table(starred.join(
            passed, (F.col("centre") == F.col("_a")) & (F.col("node") == F.col("_b")), "left_anti").select("key", "node"), "refused")
        before, left = left, rows.count()
        if 2 * left > before:
            break
    return found


def _across_clusters(halves: DataFrame, ties: DataFrame, nodes: DataFrame, minima: int, percent: int) -> DataFrame:
    """``ties``, and ties that join the clusters of a bucket where its star has left several."""
    def with_comp(rows: DataFrame, roots: DataFrame, *columns: str) -> DataFrame:
        side = F.broadcast(roots) if roots.count() <= BROADCAST_EDGES else roots
        return rows.join(side.select(F.col("node").alias("_n"), "root"), F.col("node") == F.col("_n"), "left").select(
            "node", F.coalesce("root", "node").alias("comp"), *columns)

    def small(table: DataFrame, rows: int | None = None) -> DataFrame:
        return F.broadcast(table) if (table.count() if rows is None else rows) <= BROADCAST_ROWS else table

    roots = components(ties, "centre", "node", own=False)
    placed = _keys(with_comp(halves, roots, "left", "right"), "node", "comp")
    # the star has compared the nodes of a bucket of two; of buckets with the same nodes one is enough
    digest = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"d{k}") for k in range(2)]
    mixed = placed.groupBy("key").agg(
        F.count("*").alias("nodes"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), *digest
    ).where("nodes > 2 and lo < hi")
    mixed = write_table(mixed.groupBy("nodes", "d0", "d1").agg(F.min("key").alias("_key")).select("_key"), "mixed")
    rows = mixed.count()
    if not rows:
        return ties
    # a row per bucket and cluster, with the cluster's smallest node there: combined before buckets are looked up, so that
    # a large cluster is a row of each task and not its nodes (a semi-join would be moved below the aggregation)
    met = write_table(placed.groupBy("key", "comp").agg(F.min("node").alias("node")).join(
        small(mixed, rows), F.col("key") == F.col("_key")).drop("_key"), "met")
    found = _rounds(met, nodes, minima, percent)
    for more in found:
        ties = ties.unionByName(more)
    if found:
        # a cluster is named by one of its nodes
        roots = components(ties, "centre", "node", own=False)
        met = write_table(with_comp(met.select("key", F.col("comp").alias("node")), roots, "key").select("key", "comp"), "met")

    # clusters that meet in a bucket, by a star over clusters
    least = met.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select(
        F.col("key").alias("_key"), "lo")
    meet = write_table(met.join(least, F.col("key") == F.col("_key")).where("comp <> lo").select("lo", "comp").distinct(), "meet")
    supers = components(meet, "lo", "comp").select(F.col("node").alias("_comp"), F.col("root").alias("cluster"))
    sized = write_table(with_comp(halves, roots).join(small(supers), F.col("comp") == F.col("_comp")).join(
        nodes.select(F.col("node").alias("_n"), "n"), F.col("node") == F.col("_n")).select(
        "cluster", "node", "comp", "n", F.lit(4 * minima).cast("long").alias("bytes")), "placed")
    dealt = _dealt(sized, percent, BLOCK_SIGNED, 4 * minima * BLOCK_SIGNED).join(
        nodes.select(F.col("node").alias("_t"), "n", "sig"), F.col("node") == F.col("_t")).select(
        "cluster", "task", "node", "comp", "is_main", "own", "other", "n", "sig")

    def compare(table: pa.Table) -> pa.Table:
        node, comp, sizes = [table.column(c).to_numpy() for c in ("node", "comp", "n")]
        sigs = table.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, minima)
        own = table.column("own")[0].as_py()
        rest = ~table.column("is_main").to_numpy() if own else table.column("other").to_numpy()
        found = near_forest(sizes, sigs, comp, rest, own, percent)
        return pa.table({"centre": pa.array([node[a] for a, _ in found], pa.int64()),
                         "node": pa.array([node[b] for _, b in found], pa.int64())})

    more = dealt.groupBy("cluster", "task").applyInArrow(compare, "centre long, node long").distinct()
    return ties.unionByName(write_table(more, "ties"))


def _between_components(
        ties: DataFrame, links: DataFrame, texts: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links between nodes of one cluster that stars have left in different components, and these components' stars."""
    # one run for both graphs: even numbers for ties, odd ones for links
    both = ties.select((F.col("centre") * 2).alias("a"), (F.col("node") * 2).alias("b")).unionByName(
        links.select((F.col("centre") * 2 + 1).alias("a"), (F.col("node") * 2 + 1).alias("b")))
    roots = components(both, "a", "b").select(
        (F.col("node") % 2).alias("of"), F.shiftright("node", 1).alias("node"), F.shiftright("root", 1).alias("root"))
    cluster = roots.where("of = 0").select(F.col("node"), F.col("root").alias("cluster"))
    comp = roots.where("of = 1").select(F.col("node").alias("_n"), F.col("root").alias("comp"))
    placed = cluster.join(comp, F.col("node") == F.col("_n"), "left").select(
        "node", "cluster", F.coalesce("comp", "node").alias("comp"))
    sized = write_table(placed.join(
        texts.select(F.col("node").alias("_t"), "n", F.octet_length("text").cast("long").alias("bytes")),
        F.col("node") == F.col("_t")).drop("_t"), "placed")
    dealt = _dealt(sized, percent, BLOCK_NODES, BLOCK_BYTES)
    dealt = dealt.join(texts.select(F.col("node").alias("_t"), "text"), F.col("node") == F.col("_t")).select(
        "cluster", "task", "node", "comp", "is_main", "own", "other", "text")
    shingles = Shingles(shingle)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(t.encode()) for t in frame["text"]]
        comp, node, own = frame["comp"].to_numpy(), frame["node"].to_numpy(), bool(frame["own"].iloc[0])
        rest = ~frame["is_main"].to_numpy(bool) if own else frame["other"].to_numpy(bool)
        found = forest(sets, comp, rest, own, percent)
        return pd.DataFrame({"centre": [node[a] for a, _ in found], "node": [node[b] for _, b in found]}, dtype="int64")

    stars = roots.where("of = 1 and node <> root").select(F.col("root").alias("centre"), "node")
    return write_table(dealt.groupBy("cluster", "task").applyInPandas(compare, "centre long, node long"), "links"), stars


def _report(docs: DataFrame, shingle: int, percent: int, tables: int, rows: int) -> DataFrame:
    """Every document with its set size, its component's first document and that one's text hash."""
    all_ = write_table(signed(docs, shingle, 2 * tables * rows), "signed")
    classes = all_.where("n > 0").groupBy("d1", "d2").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("first"),
        F.first("n").alias("n"), F.first("sig").alias("sig"))
    # numbered in the order of ids, so that the smallest node of a bucket is the earliest document
    nodes = write_table(
        classes.orderBy("first").select(
            F.monotonically_increasing_id().alias("node"), "d1", "d2", F.col("first.doc_id").alias("doc_id"),
            F.col("first.text_hash").alias("text_hash"), "n", "sig"), "nodes")
    minima = 2 * tables * rows
    halves = _halves(nodes, tables, rows)
    ties = _across_clusters(halves, _stars(halves, nodes, minima, percent), nodes, minima, percent)
    tied = ties.select(F.col("centre").alias("node")).union(ties.select("node")).distinct()
    wanted = write_table(nodes.join(tied, "node").select(
        "node", "n", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "wanted")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # few documents have a tie; texts of the others stay where they are while the list is small
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = write_table(
        given.join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")))
        .groupBy("node").agg(F.first("n").alias("n"), F.first("text").alias("text")), "texts")
    links = _verified(ties, texts, shingle, percent)
    more, stars = _between_components(ties, links, texts, shingle, percent)
    if more.isEmpty():
        roots = stars.withColumnRenamed("centre", "root")
    else:
        roots = components(stars.unionByName(more), "centre", "node", own=False)
    named = nodes.select("node", "d1", "d2").join(roots, "node", "left").select(
        F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), F.coalesce("root", "node").alias("root"))
    # the root is the smallest node of its component, and nodes follow the ids
    smallest = nodes.select(
        F.col("node").alias("root"), F.col("doc_id").alias("first_id"), F.col("text_hash").alias("first_hash"))
    of_class = named.join(smallest, "root").drop("root")
    return all_.select("doc_id", "n", "d1", "d2", "text_hash").join(
        of_class, (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")), "left")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, tables: int = TABLES,
                    rows: int = ROWS) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every document."""
    component = F.when(F.col("n") > 0, F.col("first_id")).otherwise(F.col("doc_id"))
    return _report(docs, shingle, percent, tables, rows).select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, tables: int = TABLES,
                rows: int = ROWS) -> DataFrame:
    """The first document of each group and all documents without words, with all their columns.

    A row is known by its id and a hash of its text; of rows equal in both one stays.
    """
    report = _report(docs, shingle, percent, tables, rows).where("n > 0")
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    known = report.groupBy("doc_id", "text_hash").agg(
        F.first(is_first).alias("first"), F.count("*").alias("rows"))
    known = write_table(known.where("not first or rows > 1").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "first"), "known")

    def same(other: DataFrame) -> Column:
        # bound to its table: documents may have columns of any name
        return docs["doc_id"].cast("long").eqNullSafe(other["_id"]) & (F.xxhash64(docs["text"]) == other["_hash"])

    # what goes, and the rows that are there several times (normally none)
    some = known.select("_id", "_hash")
    rest = docs.join(F.broadcast(some) if known.count() <= BROADCAST_ROWS else some, same(some), "left_anti")
    repeated = known.where("first").select("_id", "_hash")
    if repeated.isEmpty():
        return rest
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row")
    one = docs.join(repeated, same(repeated)).select(repeated["_id"], repeated["_hash"], row)
    one = one.groupBy("_id", "_hash").agg(F.first("_row").alias("_row"))
    return rest.unionByName(one.select("_row.*"))
