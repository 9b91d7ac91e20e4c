"""Records of large JSON documents, found by all splits at once.

Spark reads a document as pieces that end in ``}``, so that every object ends with a piece and a large document has many
splits. Whether a piece starts inside a string depends on the quotes before it, and its depth on the brackets outside strings: both are
running sums, within a split and then over one row per split. Only pieces that touch the top of a document are looked at bracket by
bracket, to tell which list is open; most records start with a comma and a brace. Pieces of one record go to one key; records of a
single piece stay where they are.

The root of an object has depth 0; an array counts as the only list of an object around it, so that records are the objects that open
from depth 2 to depth 3 in either. Documents are UTF-8, and the keys that hold records are spelled without escapes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellsieve.scratch import write_table

ROOT_LIST = "["  # the list of a document that is an array
_NO_LIST = ""
_SPLIT = ("path", "start")
_BEFORE = (Window.unboundedPreceding, -1)
_UPTO = (Window.unboundedPreceding, Window.currentRow)

_STRING = r'"[^"]*+(?:"|$)'
_TOKENS = rf'({_STRING}|[\[\]{{}}]|[^"\[\]{{}}]++)'
_NEXT_RECORD = r"^(\s*,\s*)\{"


def _in_split():
    return Window.partitionBy(*_SPLIT).orderBy("line")


def _by_split():
    return Window.partitionBy("path").orderBy("start")


def _unescaped(value: Column) -> Column:
    """The text with every escaped character covered; nothing moves."""
    return F.regexp_replace(value, r"\\.", "__")


def _quotes(value: Column) -> Column:
    clean = _unescaped(value)
    return F.length(clean) - F.length(F.replace(clean, F.lit('"')))


def _shown(value: Column, inside: Column) -> Column:
    """The piece as it reads from outside of strings; what is left of a string is no key."""
    return F.concat(F.when(inside, F.lit('"}')).otherwise(F.lit("")), _unescaped(value))


def _running(value: str, window, rows) -> Column:
    return F.coalesce(F.sum(value).over(window.rowsBetween(*rows)), F.lit(0))


def _latest(value: Column, window, rows) -> Column:
    return F.last(value, ignorenulls=True).over(window.rowsBetween(*rows))


def _top(shown: Column, depth: Column, keys: Sequence[str]) -> Column:
    """What a piece does near the top: ``open``, the list it leaves open (null: as before), ``at``, the place of the brace
    that opens an object in a list, and ``lists``, the lists it opens among *keys*."""
    start = F.struct(
        depth.cast("int").alias("depth"), F.lit(ROOT_LIST).alias("key"), F.lit(None).cast("string").alias("open"),
        F.lit(-1).alias("at"), F.lit(0).alias("off"), F.array().cast("array<string>").alias("lists"))

    def step(state: Column, token: Column) -> Column:
        at_top, opens_list = state["depth"] == 1, (token == "[") & (state["depth"] == 1)
        is_string = token.startswith('"')
        turn = F.when(token.isin("[", "{"), 1).when(token == "]", -1).otherwise(0)
        leaves = (token == "{") & at_top | (token == "]") & (state["depth"] == 2)
        return F.struct(
            (state["depth"] + turn).cast("int").alias("depth"),
            F.when(at_top & is_string, F.substring(token, F.lit(2), F.length(token) - 2)).otherwise(state["key"]).alias("key"),
            F.when(opens_list, state["key"]).when(leaves, F.lit(_NO_LIST)).otherwise(state["open"]).alias("open"),
            F.when((token == "{") & (state["depth"] == 2), state["off"]).otherwise(state["at"]).alias("at"),
            (state["off"] + F.length(token)).cast("int").alias("off"),
            F.when(opens_list & state["key"].isin(*keys), F.array_union(state["lists"], F.array(state["key"])))
            .otherwise(state["lists"]).alias("lists"))

    return F.aggregate(F.regexp_extract_all(shown, F.lit(_TOKENS), F.lit(1)), start, step)


def _walked(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """All pieces with ``inside``, ``ends_inside``, ``delta`` (of depth) and ``sum``, that within the split so far."""
    pieces = spark.read.option("lineSep", "}").text(list(files)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value",
        _quotes(F.col("value")).alias("quotes"))
    entered = pieces.groupBy(*_SPLIT).agg(F.sum("quotes").alias("n")).select(
        F.col("path").alias("_path"), F.col("start").alias("_start"), _running("n", _by_split(), _BEFORE).alias("_quotes"))
    numbered = pieces.withColumn("line", F.monotonically_increasing_id())
    before = _running("quotes", _in_split(), _BEFORE)
    rows = numbered.withColumn("before", before).join(
        entered, (F.col("path") == F.col("_path")) & (F.col("start") == F.col("_start")))
    rows = rows.withColumn("inside", (F.col("before") + F.col("_quotes")) % 2 == 1)
    rows = rows.withColumn("ends_inside", (F.col("quotes") % 2 == 1) != F.col("inside"))
    outside = F.regexp_replace(_shown(F.col("value"), F.col("inside")), _STRING, "")

    def count(brackets: str) -> Column:
        return F.length(outside) - F.length(F.translate(outside, brackets, ""))

    delta = count("[{") - count("]}") - (~F.col("ends_inside")).cast("int")
    rows = rows.withColumn("delta", delta).withColumn("sum", F.sum("delta").over(_in_split().rowsBetween(*_UPTO)))
    return write_table(rows.select("path", "start", "line", "value", "inside", "ends_inside", "delta", "sum"), "json-pieces")


def _placed(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pieces with ``before`` and ``after`` (depths), ``regular`` and ``top``."""
    root = F.regexp_extract("value", r"^[\s\x{FEFF}]*([\[{])", 1)
    splits = pieces.groupBy(*_SPLIT).agg(F.sum("delta").alias("delta"), F.min_by(root, "line").alias("root"))
    splits = splits.select(
        F.col("path").alias("_path"), F.col("start").alias("_start"),
        F.first("root").over(_by_split().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("root"),
        _running("delta", _by_split(), _BEFORE).alias("_depth"))
    rows = pieces.join(splits, (F.col("path") == F.col("_path")) & (F.col("start") == F.col("_start"))).drop("_path", "_start")
    after = F.col("sum") + F.col("_depth") + (F.col("root") == "[").cast("int")
    rows = rows.withColumn("after", after).withColumn("before", F.col("after") - F.col("delta"))
    regular = ~F.col("inside") & (F.col("before") == 2) & F.col("value").rlike(_NEXT_RECORD)
    closing = F.length("value") - F.length(F.replace(F.col("value"), F.lit("]")))
    near = (F.col("before") < 3) | (F.col("before") - closing < 2)
    shown = _shown(F.col("value"), F.col("inside"))
    rows = rows.withColumn("regular", regular)
    top = F.when(~F.col("regular") & near, _top(shown, F.col("before"), [*keys, ROOT_LIST]))
    # the closing brace of the piece is no token
    return rows.withColumn("top", top).withColumn("open", F.when(
        F.col("top").isNotNull() & (F.col("after") < 2), F.lit(_NO_LIST)).otherwise(F.col("top.open")))


def json_records(spark: SparkSession, files: Sequence[str], keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """What the documents are, and their records.

    The first has one row per file: ``path``, ``layout`` (the first of *keys* under which a list stands, null for an array or a plain
    object, ``other`` else) and ``apart``, whether the records could be cut out: there is such a list, it holds objects only, and the
    brackets and quotes of the document fit. The second, of use for those files only, holds ``path``, ``start``, ``line`` (in order within the file) and
    ``record`` of the lists. A window holds the pieces of one split, or one row per split of a file; a group holds the pieces of one record.
    """
    placed = _placed(_walked(spark, files), keys)
    splits = placed.groupBy(*_SPLIT).agg(
        F.max_by("open", F.when(F.col("open").isNotNull(), F.col("line"))).alias("open"),
        F.array_distinct(F.flatten(F.collect_set("top.lists"))).alias("lists"),
        F.first("root").alias("root"), F.sum("delta").alias("delta"),
        F.max_by("ends_inside", "line").alias("ends_inside"))
    of_file = splits.groupBy("path").agg(
        F.array_distinct(F.flatten(F.collect_set("lists"))).alias("lists"), F.first("root").alias("root"),
        F.sum("delta").alias("depth"), F.max_by("ends_inside", "start").alias("ends_inside"))
    key = F.coalesce(*[F.when(F.array_contains("lists", k), F.lit(k)) for k in keys])
    # of an array the last piece has no closing brace, of an object it may have one
    whole = ~F.col("ends_inside") & (F.col("depth") + (F.col("root") == "[").cast("int")).isin(0, -1)
    of_file = write_table(of_file.select(
        "path", "root", F.when(F.col("root") == "[", F.lit(ROOT_LIST)).otherwise(key).alias("list"), whole.alias("whole")), "json-files")
    entries = splits.select("path", "start", F.coalesce(_latest(F.col("open"), _by_split(), _BEFORE), F.lit(_NO_LIST)).alias("entry"))
    entries = entries.join(of_file.where("list is not null").select("path", "list"), "path").select(
        F.col("path").alias("_path"), F.col("start").alias("_start"), "entry", "list")

    rows = placed.join(entries, (F.col("path") == F.col("_path")) & (F.col("start") == F.col("_start"))).select(
        "*", F.coalesce(_latest(F.col("open"), _in_split(), _UPTO), "entry").alias("now"),
        F.coalesce(_latest(F.col("open"), _in_split(), _BEFORE), "entry").alias("was"))
    shift = F.when(F.col("inside"), 2).otherwise(0)
    at = F.when(F.col("regular"), F.length(F.regexp_extract("value", _NEXT_RECORD, 1))).otherwise(F.col("top.at") - shift)
    opens = (F.col("now") == F.col("list")) & (F.col("after") >= 2) & F.coalesce(F.col("at") >= 0, F.lit(False))
    first_of_list = F.substring(F.col("value"), F.lit(1), F.col("at")).rlike(r"\[\s*$")
    plain_before = (F.col("was") == F.col("list")) & (F.col("before") == 2) & ~F.col("value").rlike(r"^\s*\]")
    plain_after = (F.col("now") == F.col("list")) & (F.col("after") == 2) & (F.col("before") < 3) & ~F.col("opens")
    odd = ~F.col("regular") & (plain_before | F.col("opens") & ~first_of_list) | plain_after
    rows = write_table(rows.withColumn("at", at).withColumn("opens", opens).withColumn("odd", odd).where(
        (F.col("now") == F.col("list")) & ((F.col("before") >= 3) | F.col("opens")) | F.col("odd")).select(
        "path", "start", "line", "opens", "odd", (F.col("after") == 2).alias("ends"),
        F.when(F.col("opens"), F.substr(F.col("value"), F.col("at") + 1)).otherwise(F.col("value")).alias("value")), "json-marked")

    found = rows.groupBy("path").agg(F.bool_or("odd").alias("odd"), F.count_if("opens").alias("n"))
    layout = F.when(F.col("root") == "", F.lit("other")).otherwise(F.nullif("list", F.lit(ROOT_LIST)))
    apart = F.col("whole") & F.coalesce(~F.col("odd") & (F.col("n") > 0), F.lit(False))
    told = of_file.join(found, "path", "left").select("path", layout.alias("layout"), apart.alias("apart"))

    alone = rows.where("opens and ends").select("path", "start", "line", F.concat("value", F.lit("}")).alias("record"))
    last = rows.groupBy(*_SPLIT).agg(F.max(F.when(F.col("opens"), F.col("line"))).alias("last"))
    left_open = last.select(
        F.col("path").alias("_path"), F.col("start").alias("_start"), _latest(F.col("last"), _by_split(), _BEFORE).alias("left_open"))
    several = rows.withColumn("first", _latest(F.when(F.col("opens"), F.col("line")), _in_split(), _UPTO)).where(
        "not (opens and ends)").join(left_open, (F.col("path") == F.col("_path")) & (F.col("start") == F.col("_start")))
    joined = several.groupBy("path", F.coalesce("first", "left_open").alias("line")).agg(
        F.sort_array(F.collect_list(F.struct("start", "line", "value"))).alias("pieces")).select(
        "path", F.col("pieces")[0]["start"].alias("start"), "line",
        F.concat(F.array_join(F.col("pieces.value"), "}"), F.lit("}")).alias("record"))
    return told, alone.unionByName(joined)
