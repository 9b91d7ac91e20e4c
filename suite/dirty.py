"""Dirty text views of the clean tables, in SQL both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsieve import ColumnSpec, DatasetSpec

ORDERS_SQL = """
SELECT o_orderkey AS row_key,
  CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 19 = 0 THEN ' N/A '
       WHEN o_orderkey % 23 = 0 THEN '1e3' WHEN o_orderkey % 29 = 0 THEN concat('+', k)
       WHEN o_orderkey % 31 = 0 THEN concat('  ', k, ' ') WHEN o_orderkey % 37 = 0 THEN '4'
       ELSE k END AS order_id,
  CASE WHEN o_orderkey % 13 = 0 THEN lower(o_orderstatus) WHEN o_orderkey % 41 = 0 THEN 'X'
       ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 11 = 0 THEN 'abc' WHEN o_orderkey % 43 = 0 THEN '1d'
       WHEN o_orderkey % 47 = 0 THEN '1e309' WHEN o_orderkey % 53 = 0 THEN '--'
       ELSE CAST(o_totalprice AS STRING) END AS total_price,
  CASE WHEN o_orderkey % 7 = 0 THEN concat(substr(d, 9, 2), '.', substr(d, 6, 2), '.', substr(d, 1, 4))
       WHEN o_orderkey % 59 = 0 THEN '2023-02-29' WHEN o_orderkey % 61 = 0 THEN '2000-1-5'
       ELSE substr(d, 1, 10) END AS order_date,
  CASE WHEN o_orderkey % 67 = 0 THEN NULL WHEN o_orderkey % 71 = 0 THEN concat(o_orderpriority, '!!')
       ELSE o_orderpriority END AS priority,
  CASE o_orderkey % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'NO' WHEN 2 THEN '1' WHEN 3 THEN 'Y'
       WHEN 4 THEN 'null' ELSE 'False' END AS flag
FROM (SELECT *, CAST(o_orderkey AS STRING) AS k, CAST(o_orderdate AS STRING) AS d FROM orders) t
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = ORDERS_SQL.replace("FROM orders", "FROM {orders}")
    return spark.sql(sql, orders=table(spark, sf_dir, "orders"))


def text_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean orders as text, keyed by ``row_key``."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("row_key"), *[F.col(c).cast("string").alias(c) for c in orders.columns]
    )


FORMATS = ["%Y-%m-%d", "%d.%m.%Y"]

ORDERS_COLUMNS = (
    ColumnSpec("order_id", "integer", True, False, {"unique": True, "max": 14000}),
    ColumnSpec("status", "enum", rules={"allowed": ["F", "O"], "not_in": ["o"]}),
    ColumnSpec("total_price", "number", rules={"min": 2000, "max": 400000}),
    ColumnSpec(
        "order_date",
        "date",
        rules={"formats": FORMATS, "min_date": "1995-06-01", "max_date": "2001-01-01"},
    ),
    ColumnSpec("priority", "string", required=True, rules={"regex": "[1-5]-[A-Z ]+", "max_len": 12}),
    ColumnSpec("flag", "boolean"),
)
ORDERS_SPEC = DatasetSpec.of(*ORDERS_COLUMNS, unique_together=[("status", "order_date")])
CELL_SPEC = DatasetSpec.of(
    ColumnSpec("order_id", "integer", True, False, {"max": 14000}), *ORDERS_COLUMNS[1:]
)
ORDERS_NAMES = [c.name for c in ORDERS_COLUMNS]

# --- the same checks as SQL -------------------------------------------------

NULLS = "('', 'na', 'n/a', 'null', '-', '--')"

STRIPPED = f"""d AS ({ORDERS_SQL}),
s AS (SELECT row_key, coalesce(order_id, '') AS r0, trim(coalesce(order_id, '')) AS t0,
  trim(coalesce(status, '')) AS t1, trim(coalesce(total_price, '')) AS t2,
  trim(coalesce(order_date, '')) AS t3, trim(coalesce(priority, '')) AS t4,
  trim(coalesce(flag, '')) AS t5 FROM d),
v AS (SELECT *, TRY_CAST(replace(t0, '+', '') AS BIGINT) AS i0,
  regexp_full_match(t0, '[+-]?[0-9]+') AS ok0,
  CASE WHEN regexp_full_match(t2, '[0-9.eE+-]+') AND t2 <> '1e309' THEN TRY_CAST(t2 AS DOUBLE) END AS f2,
  coalesce(try_strptime(t3, '%Y-%m-%d'), try_strptime(t3, '%d.%m.%Y')) AS d3
  FROM s)"""


def found(row, column, code, message, where, pos, bit, phase=0, rule=0, source="v") -> str:
    return (
        f"SELECT {row} AS \"row\", '{column}' AS \"column\", '{code}' AS code, {message} AS message, "
        f"{phase} AS phase, {rule} AS rule_id, {pos} AS col_pos, {bit} AS rule_pos "
        f"FROM {source} WHERE {where}"
    )


def _null(t):
    return f"lower({t}) IN {NULLS}"


CHECKS = {
    "order_id_empty": found("row_key", "order_id", "REQUIRED_EMPTY", "'Required field is empty'", _null("t0"), 0, 0),
    "order_id_type": found("row_key", "order_id", "TYPE_MISMATCH",
        "concat('Expected integer, got ''', t0, '''')", f"NOT {_null('t0')} AND NOT ok0", 0, 1),
    "order_id_max": found("row_key", "order_id", "MAX_VIOLATED",
        "concat('Value ', CAST(i0 AS VARCHAR), ' > max 14000')", "ok0 AND i0 > 14000", 0, 7),
    "status_enum": found("row_key", "status", "ENUM_NOT_ALLOWED",
        "concat('''', t1, ''' not in allowed values: [''F'', ''O'']')",
        f"NOT {_null('t1')} AND lower(t1) NOT IN ('f', 'o')", 1, 1),
    "status_not_in": found("row_key", "status", "NOT_IN_VIOLATED",
        "concat('''', t1, ''' is in the blocklist')", "lower(t1) = 'o'", 1, 8),
    "price_type": found("row_key", "total_price", "TYPE_MISMATCH",
        "concat('Expected number, got ''', t2, '''')", f"NOT {_null('t2')} AND f2 IS NULL", 2, 1),
    "price_min": found("row_key", "total_price", "MIN_VIOLATED",
        "concat('Value ', t2, ' < min 2000')", "f2 < 2000", 2, 6),
    "price_max": found("row_key", "total_price", "MAX_VIOLATED",
        "concat('Value ', t2, ' > max 400000')", "f2 > 400000", 2, 7),
    "date_parse": found("row_key", "order_date", "DATE_PARSE_FAILED",
        "'Expected format(s): %Y-%m-%d, %d.%m.%Y'", f"NOT {_null('t3')} AND d3 IS NULL", 3, 1),
    "date_min": found("row_key", "order_date", "MIN_VIOLATED",
        "concat('Date ', strftime(d3, '%Y-%m-%d'), ' is before minimum 1995-06-01')",
        "d3 < TIMESTAMP '1995-06-01'", 3, 6),
    "date_max": found("row_key", "order_date", "MAX_VIOLATED",
        "concat('Date ', strftime(d3, '%Y-%m-%d'), ' is after maximum 2001-01-01')",
        "d3 > TIMESTAMP '2001-01-01'", 3, 7),
    "priority_empty": found("row_key", "priority", "REQUIRED_EMPTY", "'Required field is empty'", _null("t4"), 4, 0),
    "priority_regex": found("row_key", "priority", "REGEX_MISMATCH",
        "'Value does not match pattern [1-5]-[A-Z ]+'",
        f"NOT {_null('t4')} AND NOT regexp_full_match(t4, '[1-5]-[A-Z ]+')", 4, 3),
    "priority_len": found("row_key", "priority", "MAX_LEN_VIOLATED",
        "concat('Length ', CAST(length(t4) AS VARCHAR), ' > max 12')",
        f"NOT {_null('t4')} AND length(t4) > 12", 4, 5),
    "flag_type": found("row_key", "flag", "TYPE_MISMATCH",
        "concat('Expected boolean (true/false/yes/no/1/0), got ''', t5, '''')",
        f"NOT {_null('t5')} AND lower(t5) NOT IN ('true', 'false', 'yes', 'no', '1', '0')", 5, 1),
}

# Later occurrences of a key; the first row of each is carried along.
KEYED = f"""u AS (SELECT *, min(row_key) OVER (PARTITION BY lower(t0)) AS first FROM v
  WHERE ok0 AND i0 <= 14000),
c AS (SELECT *, min(row_key) OVER (PARTITION BY lower(t1), lower(t3)) AS first FROM v
  WHERE NOT ({_null('t1')} AND {_null('t3')}))"""

UNIQUE = found("row_key", "order_id", "UNIQUE_VIOLATED",
    "concat('Duplicate value ''', r0, '''')", "row_key > first", 0, 0, source="u")
TOGETHER = " UNION ALL ".join(
    found("row_key", name, "UNIQUE_TOGETHER_VIOLATED",
        "concat('Composite key (status, order_date) duplicates row ', CAST(first AS VARCHAR))",
        "row_key > first", pos, i, phase=1, rule=6, source="c")
    for i, (name, pos) in enumerate((("status", 1), ("order_date", 3)))
)


def sql(body: str, *names: str, keyed: bool = True) -> str:
    """*body* over the CTEs ``d, s, v`` and ``issues`` (all checks by default)."""
    selects = [CHECKS[n] for n in names] if names else list(CHECKS.values())
    parts = [STRIPPED]
    if keyed and not names:
        parts.append(KEYED)
        selects += [UNIQUE, TOGETHER]
    parts.append("issues AS (" + " UNION ALL ".join(selects) + ")")
    return "WITH " + ",\n".join(parts) + "\n" + body


ISSUES = 'SELECT "row", "column", code, message FROM issues'
