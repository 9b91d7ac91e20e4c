"""Sharding by a hierarchical weighted hash tree.

Shards are leaves of a tree of regions, racks and shards, each with a weight. A document
descends from the root: at every level each child draws a hash of the document id and the
child's path, turned into an exponential variable and divided by the child's weight; the
smallest draw wins. A child's draw depends on nothing but the id, the path and the child's own
weight, so when a weight changes, documents move only into or out of the subtrees whose
weight changed. ``with_shard`` adds a shard as a region of its own: no other weight
changes, so documents move only into the new shard (the law ``key``).

Placement is a projection over the row, without shuffle. Only the numbering of documents inside
the shards shuffles, and it moves ids and hashes, not texts: documents are numbered inside 4096
hash cells per shard, and cells are numbered from their counts, so that no task holds a shard.

Defined results: a null text has size 1 and the checksum of no bytes; null ids all draw alike and share one
shard, as equal ids do, for the law looks at the id only; equal rows get different slots;
empty tables give empty results; only ``doc_id`` and ``text`` are read. The method has no groups:
copies of a text are placed by their own ids.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellsieve.scratch import write_table

#: Hexadecimal digits that name the cell of a shard in which a document is numbered; fixed, so that slots never depend
#: on settings.
CELL_DIGITS = 3


@dataclass(frozen=True)
class ShardTree:
    """region -> rack -> shard -> weight (positive). Region and rack names are free, shards are integers."""

    regions: Mapping[str, Mapping[str, Mapping[int, float]]] = field(default_factory=dict)

    @staticmethod
    def regular(regions: int, racks: int, shards: int) -> "ShardTree":
        """Equal weights; shards are numbered through."""
        return ShardTree({
            f"g{g}": {f"r{r}": {(g * racks + r) * shards + s: 1.0 for s in range(shards)} for r in range(racks)}
            for g in range(regions)
        })

    def with_shard(self, shard: int, weight: float = 1.0) -> "ShardTree":
        """The tree with one more shard, in a region of its own."""
        if shard in self.shards():
            raise ValueError(f"shard {shard} is there already")
        return ShardTree({**self.regions, f"g-{shard}": {"r0": {shard: weight}}})

    def shards(self) -> list[int]:
        return sorted(s for racks in self.regions.values() for leaves in racks.values() for s in leaves)


def unit_draw(key: Column, path: Column) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of id and path."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("/", key, path)), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def _children(tree: ShardTree) -> dict[str, list[tuple[str, float]]]:
    """The paths and weights below every inner node; the root's path is empty."""
    out: dict[str, list[tuple[str, float]]] = {"": []}
    for region, racks in tree.regions.items():
        out[region] = []
        for rack, leaves in racks.items():
            path = f"{region}/{rack}"
            out[path] = [(f"{path}/{shard}", float(weight)) for shard, weight in leaves.items()]
            out[region].append((path, sum(w for _, w in out[path])))
        out[""].append((region, sum(w for _, w in out[region])))
    if not all(out.values()):
        raise ValueError("a tree and its parts need at least one shard")
    if any(w <= 0 for children in out.values() for _, w in children):
        raise ValueError("weights must be positive")
    return out


def shard_of(doc_id: Column, tree: ShardTree, seed: str = "s0") -> Column:
    """The shard of a document: regions, then racks, then shards draw. Equal draws go to the smaller path."""
    key = F.concat_ws("/", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")))
    pairs = []
    for path, children in _children(tree).items():
        entries = [F.struct(F.lit(p).alias("path"), F.lit(w).alias("weight")) for p, w in children]
        pairs += [F.lit(path), F.array(*entries)]
    below = F.create_map(*pairs)

    def winner(path: Column) -> Column:
        draws = F.transform(
            F.element_at(below, path),
            lambda c: F.struct((-F.log(unit_draw(key, c["path"])) / c["weight"]).alias("draw"), c["path"].alias("path")))
        return F.array_min(draws)["path"]

    leaf = winner(winner(winner(F.lit(""))))
    return F.substring_index(leaf, "/", -1).cast("int")


def place(docs: DataFrame, tree: ShardTree, seed: str = "s0") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32`` and ``shard`` of every document, written to the shared folder.

    About 30 bytes a document; texts are read once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return write_table(docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(F.col("doc_id"), tree, seed).alias("shard"),
    ), "shards")


def with_slots(placed: DataFrame) -> DataFrame:
    """Adds ``slot``: the documents of a shard numbered from 0 without gaps.

    The order inside a shard is by hash cell, then id, checksum and size. Equal rows are counted per input partition
    before they are shuffled, and the counts are opened to rows again after the numbering, so that no task gets more
    equal rows than one partition held.
    """
    shown = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_crc32", "size")
    cell = F.substring(F.md5(shown), 1, CELL_DIGITS)
    rows = placed.withColumn("_cell", cell).withColumn("_part", F.spark_partition_id())
    equal = rows.groupBy(*placed.columns, "_cell", "_part").agg(F.count("*").alias("_n"))
    counts = rows.groupBy("shard", "_cell").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    # at most 4096 rows a shard
    bases = counts.select(
        F.col("shard").alias("_shard"), F.col("_cell").alias("_of"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("shard", "_cell").orderBy("doc_id", "text_crc32", "size", "_part").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    numbered = equal.withColumn("_end", F.sum("_n").over(within))
    based = numbered.join(F.broadcast(bases), (F.col("shard") == F.col("_shard")) & (F.col("_cell") == F.col("_of")))
    last = F.col("_base") + F.col("_end") - 1
    return based.select(*placed.columns, F.explode(F.sequence(last - F.col("_n") + 1, last)).alias("slot"))
