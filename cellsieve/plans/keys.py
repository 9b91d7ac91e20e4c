"""Uniqueness of columns and column sets.

All keyed rules share one count: rows per 64-bit hash of (rule, key), combined
map-side so that a frequent key costs one row per task, without the rows' identity.
Hashes seen more than once are written down, so that their number is known before
any identity is moved. Equal hashes only choose the way; keys decide.

* Few repeated keys are broadcast, and only their rows are brought together, or
  none if some of the keys have many rows;
* otherwise every row is moved once, to the others of its key, but for the keys
  with very many rows, whose list is bounded: these are folded map-side and their
  first rows broadcast. No reducer ever receives the rows of a very frequent key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellsieve import codes
from cellsieve.functions.text import composite_key, norm_key, null_token_set
from cellsieve.plans.cells import (
    ROW,
    ColumnPlan,
    empty_issues,
    is_filled,
    plan_columns,
    row_column,
    spec_cells,
    statistics_value,
    table_columns,
)
from cellsieve.scratch import write_table
from cellsieve.spec import DatasetSpec

# Up to this many repeated keys are broadcast. A key is at most
# KEY_DIGEST_BYTES + 1 bytes, so with its first row this is about 100 MB.
BROADCAST_KEYS = 1_000_000

# While repeated keys are few, rows of a key are brought together up to this many;
# if any key has more, the first rows are folded map-side and broadcast.
OFTEN_ROWS = 1_000

# A key on more rows than this is matched by broadcast in any case. At most
# total_rows / HOT_KEY_ROWS keys qualify: 10^11 rows give 10^5, about 20 MB.
HOT_KEY_ROWS = 1_000_000


@dataclass(frozen=True)
class KeyRule:
    """One uniqueness rule; ids follow emission order."""

    id: int
    columns: tuple[str, ...]
    plan: ColumnPlan | None = None  # set for a single-column rule


def key_rules(
    df: DataFrame, spec: DatasetSpec, row_key: str | Sequence[str]
) -> tuple[list[KeyRule], list[KeyRule]]:
    """Single-column and composite rules that apply to the table's columns."""
    singles = [
        KeyRule(p.pos, (p.spec.name,), p)
        for p in plan_columns(df, spec, row_key)
        if p.spec.rules.get("unique", False)
    ]
    present = table_columns(df, row_key)
    composites = []
    for number, rule in enumerate(spec.unique_together):
        columns = tuple(c for c in rule.columns if c in present)
        if len(columns) >= 2:
            composites.append(KeyRule(len(present) + number, columns))
    return singles, composites


def key_candidates(
    df: DataFrame,
    spec: DatasetSpec,
    row_key: str | Sequence[str],
    singles: Sequence[KeyRule],
    composites: Sequence[KeyRule],
) -> DataFrame:
    """One row per (rule, row) that takes part: ``rule, key, row, raw, num``."""
    tokens = null_token_set(spec.null_values)
    parts: list[DataFrame] = []
    if singles:
        plans = [r.plan for r in singles]
        cells = spec_cells(df, spec, plans, row_key)
        entry = F.struct(
            F.get(F.array(*[F.lit(r.id) for r in singles]), F.col("cell")).alias("rule"),
            composite_key([F.col("low")]).alias("key"),
            F.col("raw"),
            statistics_value(plans).alias("num"),
        )
        takes_part = (F.col("mask") == 0) & is_filled(tokens)
        parts.append(cells.select(ROW, F.inline(F.when(takes_part, F.array(entry)))))
    if composites:
        columns = sorted({c for r in composites for c in r.columns})
        names = {c: f"key_{i}" for i, c in enumerate(columns)}
        keyed = df.select(
            row_column(row_key).alias(ROW),
            *[norm_key(F.col(f"`{c}`")).alias(n) for c, n in names.items()],
        )
        entries = []
        for rule in composites:
            cells = [F.col(names[c]) for c in rule.columns]
            blank = cells[0].isin(*tokens)
            for cell in cells[1:]:
                blank = blank & cell.isin(*tokens)
            entries.append(
                F.when(
                    ~blank,
                    F.struct(
                        F.lit(rule.id).alias("rule"),
                        composite_key(cells).alias("key"),
                        F.lit(None).cast("string").alias("raw"),
                        F.lit(None).cast("double").alias("num"),
                    ),
                )
            )
        parts.append(keyed.select(ROW, F.inline(F.array(*entries))))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.where(F.col("key").isNotNull())


def fold_keys(candidates: DataFrame) -> DataFrame:
    """Per (rule, key): first row, number of rows and the key's number."""
    return candidates.groupBy("rule", "key").agg(
        F.min(ROW).alias("first"), F.count("*").alias("n"), F.min("num").alias("num")
    )


def duplicates(
    candidates: DataFrame,
    broadcast_keys: int = BROADCAST_KEYS,
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Candidates that repeat an earlier row's key, with that first row.

    Rows without a row key come last. Of several rows that share key and row key all but one are repeats, each
    reported under their common row key: none is dropped.
    """
    hashed = candidates.withColumn("hash", F.xxhash64("rule", "key"))
    counts = hashed.groupBy("hash").agg(F.count("*").alias("n"))
    repeated = write_table(counts.where("n > 1"), "repeated-keys")

    def rows_of(hashes: DataFrame, how: str = "left_semi") -> DataFrame:
        return hashed.join(F.broadcast(hashes.select("hash")), "hash", how).drop("hash")

    if repeated.count() <= broadcast_keys:
        often = repeated.where(F.col("n") > min(OFTEN_ROWS, hot_rows))
        return _by_rank(rows_of(repeated)) if often.isEmpty() else _by_broadcast(rows_of(repeated))
    hot = repeated.where(F.col("n") > hot_rows)
    if hot.isEmpty():
        return _by_rank(candidates)
    return _by_broadcast(rows_of(hot)).unionByName(_by_rank(rows_of(hot, "left_anti")))


def _by_rank(candidates: DataFrame) -> DataFrame:
    """Repeats by bringing the rows of each key together: every row is moved once."""
    ranked = Window.partitionBy("rule", "key").orderBy(F.col(ROW).asc_nulls_last(), "raw", "num")
    return candidates.select(
        "*", F.row_number().over(ranked).alias("_nth"), F.first(ROW).over(ranked).alias("first")
    ).where("_nth > 1").drop("_nth")


def _by_broadcast(candidates: DataFrame) -> DataFrame:
    """Repeats by broadcasting the first row of each key: no row is moved."""
    firsts = write_table(fold_keys(candidates).select("rule", "key", "first"), "first-rows")
    return _repeats(candidates.join(F.broadcast(firsts), ["rule", "key"]))


def _repeats(found: DataFrame) -> DataFrame:
    is_first = F.col(ROW).eqNullSafe(F.col("first"))
    # normally one row per key, combined map-side
    shared = found.where(is_first).groupBy("rule", "key").agg(
        F.count("*").alias("_rows"), F.first(ROW).alias(ROW), F.min("raw").alias("raw"), F.min("num").alias("num"),
        F.first("first").alias("first"))
    again = shared.where("_rows > 1").withColumn("_nth", F.explode(F.sequence(F.lit(2).cast("long"), F.col("_rows"))))
    return found.where(~is_first).unionByName(again.select(*found.columns))


def duplicate_issues(
    found: DataFrame,
    singles: Sequence[KeyRule],
    composites: Sequence[KeyRule],
    positions: dict[str, int],
) -> DataFrame:
    """Issue rows of duplicates: one per single rule, one per composite column."""
    def issue(column, code, message, phase, rule_id):
        return F.struct(
            F.lit(column).alias("column"),
            F.lit(code).alias("code"),
            message.alias("message"),
            F.lit(phase).alias("phase"),
            F.lit(rule_id).alias("rule_id"),
            F.lit(positions[column]).alias("col_pos"),
        )

    entries = None
    for rule in [*singles, *composites]:
        if rule.plan is not None:
            text = F.concat(F.lit("Duplicate value '"), F.col("raw"), F.lit("'"))
            made = [issue(rule.columns[0], codes.UNIQUE_VIOLATED, text, 0, 0)]
        else:
            text = F.concat(
                F.lit(f"Composite key ({', '.join(rule.columns)}) duplicates row "),
                F.col("first").cast("string"),
            )
            made = [
                issue(c, codes.UNIQUE_TOGETHER_VIOLATED, text, 1, rule.id) for c in rule.columns
            ]
        matches = F.col("rule") == rule.id
        entries = (
            F.when(matches, F.array(*made)) if entries is None else entries.when(matches, F.array(*made))
        )
    return found.select(ROW, F.posexplode(entries).alias("rule_pos", "i")).select(
        ROW, "i.column", "i.code", "i.message", "i.phase", "i.rule_id", "i.col_pos", "rule_pos"
    )


def key_issues(
    df: DataFrame,
    spec: DatasetSpec,
    row_key: str | Sequence[str] = ROW,
    broadcast_keys: int = BROADCAST_KEYS,
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """UNIQUE_VIOLATED and UNIQUE_TOGETHER_VIOLATED issues of a table."""
    if df.isStreaming:
        raise ValueError("uniqueness needs a batch table")
    singles, composites = key_rules(df, spec, row_key)
    if not singles and not composites:
        return empty_issues(df, row_key)
    candidates = key_candidates(df, spec, row_key, singles, composites)
    found = duplicates(candidates, broadcast_keys, hot_rows)
    positions = {c: i for i, c in enumerate(table_columns(df, row_key))}
    return duplicate_issues(found, singles, composites, positions)
