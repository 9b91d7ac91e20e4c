"""A Merkle manifest of documents, stored as parent-linked node rows and checked by a recursive query.

A leaf is the SHA-256 of a document's five fields. Within a language the leaves follow the ids; runs of ``FAN`` = 8
consecutive nodes become their common hash until one node, the language's subroot, is left. The subroots, in the order
of languages, become the root likewise.

1. Leaves are hashed while the documents are scanned; only hashes, ids and languages are sorted (by ranges, ties by the leaf, so
   a large language or many equal rows go to several tasks) and numbered by counts per range.
2. A node is known by the level and the number of its first leaf, so a node's parent, its place in the run (``slot``) and the
   runs of every level follow by arithmetic. Each level is one aggregation of at most eight rows a key.
3. A ``WITH RECURSIVE`` query climbs from the leaves to the root by the ``parent`` link. One row climbs for each run of leaves:
   their paths above are the same, so the siblings above are appended once a run and every leaf's own hash is folded
   beside them. The siblings inside the run are put in front afterwards.

Spark stops a recursive query after a million rows unless told otherwise; the limit is lifted while the climb is written, as its
depth is bounded by the tree.

Defined results: null fields count as ``-``, which no value gives; null ids come first in their language, null languages
before all others, and equal ids follow their leaves; rows equal in all five fields are leaves of their own; rows of null id are
never tampered with; an empty table has no rows and no root; other columns than the five are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellsieve.llm.base import LOWER, UPPER
from cellsieve.scratch import new_path, remove, write_table

FAN = 8
FAN_BITS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A table of languages is broadcast up to this many bytes.
BROADCAST_BYTES = 50_000_000
CAPITALS, SMALL = bytes(UPPER.tolist()).decode(), bytes(LOWER.tolist()).decode()


def leaf_text(**changed: Column) -> Column:
    """What is hashed of a document; ``changed`` takes the place of columns."""
    def field(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.concat(*[field(name) for name in FIELDS])


def digest(text: Column) -> Column:
    """SHA-256 in 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def joined_digest(digests: Column) -> Column:
    """SHA-256 of digests in a row, each written as hexadecimal text."""
    return digest(F.lower(F.hex(digests)))


def tampered_text() -> Column:
    """The text with A-Z lower-cased where 3 divides the checksum of the id, else the text itself."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    return F.when(hit, F.translate("text", CAPITALS, SMALL)).otherwise(F.col("text"))


def leaves_of(docs: DataFrame, tampered: Column) -> DataFrame:
    """``doc_id``, ``lang``, ``leaf`` and ``claim``, the leaf of the text that is held against the manifest."""
    differs = F.coalesce(tampered != F.col("text"), F.lit(False))
    leaf = digest(leaf_text())
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf.alias("leaf"),
        F.when(differs, digest(leaf_text(text=tampered))).alias("claim"), F.monotonically_increasing_id().alias("row"))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``at``, the place of a row in the order given, from 0: ranges are sorted apart and counted.

    The only window over all has one row per range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = write_table(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(
            "_tag", F.monotonically_increasing_id()), name)
    sizes = tagged.groupBy(F.shiftright("_tag", 33).alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    # as many rows as there are ranges
    return tagged.join(F.broadcast(bases), F.shiftright("_tag", 33) == F.col("_part")).withColumn(
        "at", F.col("_base") + F.col("_tag").bitwiseAND((1 << 33) - 1)).drop("_tag", "_part", "_base")


def height(leaves: Column) -> Column:
    """Levels above so many leaves."""
    bits = F.length(F.bin(leaves - 1))
    return F.when(leaves < 2, 0).otherwise(F.ceil(bits / FAN_BITS)).cast("int")


def _node(level: int, pos: Column) -> Column:
    """A node of a language's tree: the number of its first leaf and its level in one number."""
    return (F.col("start") + F.shiftleft(pos, FAN_BITS * level)) * 64 + level


def _top_node(level: int, pos: Column) -> Column:
    """A node above the subroots, as a negative number."""
    return -(pos * 64 + level) - 1


def _links(level: int, top_height: int) -> list[Column]:
    """``node``, ``parent`` and ``slot`` of nodes at ``pos`` of a language's tree."""
    up = F.shiftright("pos", FAN_BITS)
    below = F.col("height") > level
    above = _top_node(1, F.shiftright("nth", FAN_BITS)) if top_height else F.lit(None).cast("long")
    return [
        _node(level, F.col("pos")).alias("node"),
        F.when(below, _node(level + 1, up)).otherwise(above).alias("parent"),
        F.when(below, F.col("pos")).otherwise(F.col("nth")).bitwiseAND(FAN - 1).cast("int").alias("slot"),
    ]


def _children(hashes: Column) -> Column:
    """An array of at most eight hashes as one value."""
    return F.aggregate(hashes, F.lit(b""), lambda a, h: F.concat(a, h))


def _level_up(nodes: DataFrame, *keys: str) -> DataFrame:
    """The runs of a level as nodes of the next one, with ``pos``, ``children`` and ``hash``."""
    runs = nodes.groupBy(*keys, F.shiftright("pos", FAN_BITS).alias("pos")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("pos").alias("at"), "hash"))).alias("run"))
    return runs.withColumn("children", _children(F.col("run.hash"))).withColumn(
        "hash", joined_digest(F.col("children"))).drop("run")


@dataclass(frozen=True)
class Manifest:
    """The stored tree.

    ``runs``: the nodes above leaves (and leaves that are alone in their language) with ``members``, up to eight
    leaves; ``nodes``: all nodes above; ``subroots``: ``nth``, ``lang`` and ``hash`` of every language; ``root``: hexadecimal, None of
    no documents.
    """

    runs: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: str | None


def build(docs: DataFrame, tampered: Column | None = None) -> Manifest:
    """Hash, sort and fold the documents; ``tampered`` is the text that ``climb`` will hold against the tree."""
    spark = docs.sparkSession
    path = new_path(spark, "leaves")
    leaves = write_table(leaves_of(docs, F.col("text") if tampered is None else tampered), "leaves", path)
    # the row's number tells equal leaves apart, so that many of them go to several ranges
    order = [F.asc_nulls_first("lang"), F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("row")]
    placed = numbered(leaves, order, "places")
    remove(spark, path)
    per_lang = placed.groupBy("lang").agg(F.min("at").alias("start"), F.count("*").alias("leaves"))
    langs = write_table(numbered(per_lang, [F.asc("start")], "languages").select(
        "lang", "start", height(F.col("leaves")).alias("height"), F.col("at").alias("nth")), "languages")
    measured = langs.agg(F.count("*").alias("n"), F.max("height").alias("most"), F.sum(
        F.coalesce(F.octet_length("lang"), F.lit(0)) + 40).alias("bytes")).first()
    few = (measured["bytes"] or 0) <= BROADCAST_BYTES

    def small(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if few else table

    top_height = 0
    while FAN ** top_height < measured["n"]:
        top_height += 1

    side = langs.withColumnRenamed("lang", "_lang")
    at = placed.join(small(side), F.col("lang").eqNullSafe(F.col("_lang"))).select(
        "doc_id", "leaf", F.coalesce("claim", "leaf").alias("claim"), "start", "nth", "height",
        (F.col("at") - F.col("start")).alias("pos"))
    member = F.struct(F.col("pos").bitwiseAND(FAN - 1).cast("int").alias("slot"), "leaf", "claim", "doc_id")
    tree = ("start", "nth", "height")
    columns = ("node", "parent", "slot", "children", "hash", *tree, "pos")
    first = (
        at.where("height > 0").groupBy(*tree, F.shiftright("pos", FAN_BITS).alias("pos"))
        .agg(F.sort_array(F.collect_list(member)).alias("members"))
        .withColumn("children", _children(F.col("members.leaf"))).withColumn("hash", joined_digest(F.col("children")))
        .select("*", *_links(1, top_height)).select(*columns, "members"))
    alone = at.where("height = 0").select(
        *_links(0, top_height), F.lit(b"").alias("children"), F.col("leaf").alias("hash"), *tree, "pos",
        F.array(member).alias("members"))
    runs = write_table(first.unionByName(alone), "runs")

    level, levels = 1, []
    below = runs.drop("members").where("height > 1")
    while measured["most"] is not None and level < measured["most"]:
        level += 1
        now = write_table(_level_up(below, *tree).select("*", *_links(level, top_height)).select(*columns), "nodes")
        levels.append(now)
        below = now.where(F.col("height") > level)
    ends = [runs.where("height < 2").select("nth", "hash")]
    ends += [now.where(F.col("height") == k).select("nth", "hash") for k, now in enumerate(levels, 2)]
    subroots = ends[0]
    for more in ends[1:]:
        subroots = subroots.unionByName(more)
    subroots = write_table(subroots.join(small(side.select("_lang", F.col("nth").alias("_nth"))), F.col("nth") == F.col("_nth"))
                           .select("nth", F.col("_lang").alias("lang"), "hash"), "subroots")

    now = subroots.select(F.col("nth").alias("pos"), "hash")
    for level in range(1, top_height + 1):
        up = _top_node(level + 1, F.shiftright("pos", FAN_BITS)) if level < top_height else F.lit(None).cast("long")
        now = write_table(_level_up(now).select(
            _top_node(level, F.col("pos")).alias("node"), up.alias("parent"),
            F.col("pos").bitwiseAND(FAN - 1).cast("int").alias("slot"), "children", "hash", "pos"), "nodes")
        levels.append(now)
    top = now.select("hash").first()  # one row
    nodes = runs.select("node", "parent", "slot", "children").where(F.lit(False))
    for table in levels:
        nodes = nodes.unionByName(table.select("node", "parent", "slot", "children"))
    return Manifest(runs, nodes, subroots, None if top is None else bytes(top["hash"]).hex())


# Expressions of the recursive query. A run's children are 32 bytes each.
_BEFORE = "substring({0}.children, 1, 32 * {1}.slot)"
_AFTER = "substring({0}.children, 32 * {1}.slot + 33)"
_HASH = "unhex(sha2(lower(hex({0})), 256))"


def _with(node: str, place: str, value: str) -> str:
    """The hash of a node after ``value`` has taken the place of one of its children."""
    return _HASH.format(f"concat({_BEFORE.format(node, place)}, {value}, {_AFTER.format(node, place)})")


CLIMB = f"""
WITH RECURSIVE climb AS (
    SELECT node AS run, parent, slot, CAST('' AS BINARY) AS siblings, transform(members, m ->
        CASE WHEN length(r.children) = 0 THEN m.claim ELSE {_with('r', 'm', 'm.claim')} END) AS folded
    FROM {{runs}} r
    UNION ALL
    SELECT c.run, n.parent, n.slot,
        concat(c.siblings, {_BEFORE.format('n', 'c')}, {_AFTER.format('n', 'c')}),
        transform(c.folded, h -> {_with('n', 'c', 'h')})
    FROM climb c JOIN {{nodes}} n ON n.node = c.parent
)
SELECT run, siblings, folded FROM climb WHERE parent IS NULL"""


@contextmanager
def _unlimited_recursion(spark: SparkSession) -> Iterator[None]:
    keys = ("spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit")
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def climb(manifest: Manifest) -> DataFrame:
    """``run``, ``siblings`` above the run, and the root that each of its leaves' claims leads to (``folded``)."""
    spark = manifest.runs.sparkSession
    with _unlimited_recursion(spark):
        return write_table(spark.sql(CLIMB, runs=manifest.runs, nodes=manifest.nodes), "climb")


def proofs(manifest: Manifest) -> DataFrame:
    """``doc_id``, ``leaf``, ``nth``, ``siblings`` (32 bytes each, level by level) and ``folded_root`` of every document."""
    runs = manifest.runs.select("node", "children", "nth", "members")
    rows = climb(manifest).join(runs, F.col("run") == F.col("node")).select(
        "children", "siblings", "nth", F.explode(F.arrays_zip("members", "folded")).alias("of"))
    return rows.select(
        F.col("of.members.doc_id").alias("doc_id"), F.col("of.members.leaf").alias("leaf"), "nth",
        F.expr("concat(substring(children, 1, 32 * of.members.slot), substring(children, 32 * of.members.slot + 33), siblings)")
        .alias("siblings"), F.col("of.folded").alias("folded_root"))


def verified(docs: DataFrame) -> DataFrame:
    """The manifest's digests of every document, and whether its tampered text still leads to the root."""
    manifest = build(docs, tampered_text())
    subroots = manifest.subroots.select(F.col("nth").alias("_nth"), F.col("hash").alias("subroot"))
    if subroots.count() * 64 <= BROADCAST_BYTES:
        subroots = F.broadcast(subroots)
    shown = lambda c: F.lower(F.hex(c))
    root = F.lit(manifest.root).cast("string")
    return proofs(manifest).join(subroots, F.col("nth") == F.col("_nth")).select(
        "doc_id", shown("leaf").alias("leaf"), shown("subroot").alias("subroot"), root.alias("root"),
        F.sha2(shown("siblings"), 256).alias("proof_sha256"), shown("folded_root").alias("folded_root"),
        (shown("folded_root") == root).alias("verified"))
