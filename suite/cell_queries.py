"""Cell functions and checks, one query each."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellsieve import ColumnSpec, DatasetSpec, cell_issues
from cellsieve.functions import dates, numbers, registry, text
from cellsieve.functions.text import PY_WHITESPACE
from cellsieve.operators.infer import match_rate
from cellsieve.spec import Template, bind_spec, manual_spec
from suite.dirty import (
    CELL_SPEC,
    CHECKS,
    FORMATS,
    ISSUES,
    NULLS,
    ORDERS_NAMES,
    ORDERS_SQL,
    STRIPPED,
    dirty_orders,
    sql,
    table,
)
from suite.registry import query

ISSUE = ["row", "column", "code", "message"]

# Whitespace as SQL, and a text wrapped in some of it.
WS = "concat(" + ", ".join(f"chr({ord(c)})" for c in PY_WHITESPACE) + ")"
PADDED = "concat(chr(9), chr(160), ' ', text, chr(8195), chr(28), chr(10))"


def padded(column="text"):
    return F.concat(F.lit("\t\xa0 "), F.col(column), F.lit(" \x1c\n"))


@query(
    "py_strip",
    f"SELECT doc_id, md5(trim({PADDED}, {WS})) AS digest, length(trim({PADDED}, {WS})) AS size FROM documents",
)
def py_strip(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", text.py_strip(padded()).alias("t"))
    return docs.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("size"))


@query("is_null_token", sql(f"SELECT row_key, lower(t2) IN {NULLS} AS price_null, lower(t5) IN {NULLS} AS flag_null FROM v", keyed=False))
def is_null_token(spark, sf):
    def null(name):
        return text.is_null_token(text.py_strip(text.safe_str(F.col(name)))).alias
    d = dirty_orders(spark, sf)
    return d.select("row_key", null("total_price")("price_null"), null("flag")("flag_null"))


def one(column, kind="string", required=False, **rules):
    return DatasetSpec.of(ColumnSpec(column, kind, required=required, rules=rules))


def orders_check(name, spec, *checks):
    @query(name, sql(ISSUES, *checks))
    def run(spark, sf):
        return cell_issues(dirty_orders(spark, sf), spec, "row_key").select(*ISSUE)


orders_check("check_required", one("priority", required=True), "priority_empty")
orders_check("check_integer", one("order_id", "integer"), "order_id_type")
orders_check("check_number", one("total_price", "number"), "price_type")
orders_check("check_boolean", one("flag", "boolean"), "flag_type")
orders_check("check_date", one("order_date", "date", formats=FORMATS), "date_parse")
orders_check("check_enum", one("status", "enum", allowed=["F", "O"]), "status_enum")
orders_check("check_regex", one("priority", regex="[1-5]-[A-Z ]+"), "priority_regex")
orders_check("check_max_len", one("priority", max_len=12), "priority_len")
orders_check("check_min", one("total_price", "number", min=2000), "price_type", "price_min")
orders_check("check_max", one("order_id", "integer", max=14000), "order_id_type", "order_id_max")
orders_check(
    "check_min_date", one("order_date", "date", formats=FORMATS, min_date="1995-06-01"), "date_parse", "date_min"
)
orders_check(
    "check_max_date", one("order_date", "date", formats=FORMATS, max_date="2001-01-01"), "date_parse", "date_max"
)
orders_check("check_not_in", one("status", not_in=["o"]), "status_not_in")
orders_check("check_cell", CELL_SPEC, *CHECKS)


@query("issue_message", sql("SELECT code, message, count(*) AS n FROM issues GROUP BY ALL", *CHECKS))
def issue_message(spark, sf):
    issues = cell_issues(dirty_orders(spark, sf), CELL_SPEC, "row_key")
    return issues.groupBy("code", "message").agg(F.count("*").alias("n"))


MOMENT = """CASE event_type WHEN 'click' THEN strftime(ts, '%d/%m/%Y %H:%M') WHEN 'error' THEN strftime(ts, '%Y-%m-%d')
  ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END"""


def event_moments(spark, sf):
    ts, kind = F.col("ts"), F.col("event_type")
    shown = (
        F.when(kind == "click", F.date_format(ts, "dd/MM/yyyy HH:mm"))
        .when(kind == "error", F.date_format(ts, "yyyy-MM-dd"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    )
    return table(spark, sf, "events").select("event_id", shown.alias("at"))


@query(
    "check_datetime",
    """SELECT event_id AS "row", 'at' AS "column", 'DATE_PARSE_FAILED' AS code,
    'Expected format(s): %Y-%m-%d %H:%M:%S, %d/%m/%Y %H:%M' AS message FROM events WHERE event_type = 'error'""",
)
def check_datetime(spark, sf):
    spec = one("at", "datetime", formats=["%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M"])
    return cell_issues(event_moments(spark, sf), spec, "event_id").select(*ISSUE)


@query(
    "any_format",
    f"""SELECT event_id, strftime(coalesce(try_strptime(a, '%Y-%m-%d %H:%M:%S'), try_strptime(a, '%d/%m/%Y %H:%M'),
    try_strptime(a, '%Y-%m-%d')), '%Y-%m-%d %H:%M:%S') AS parsed FROM (SELECT event_id, {MOMENT} AS a FROM events)""",
)
def any_format(spark, sf):
    formats = ["%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M", "%Y-%m-%d"]
    parsed = dates.any_format(F.col("at"), formats)
    return event_moments(spark, sf).select("event_id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query(
    "check_min_len",
    f"""SELECT doc_id AS "row", 'text' AS "column", 'MIN_LEN_VIOLATED' AS code,
    concat('Length ', CAST(length(t) AS VARCHAR), ' < min 600') AS message
    FROM (SELECT doc_id, trim(text, {WS}) AS t FROM documents)
    WHERE lower(t) NOT IN {NULLS} AND length(t) < 600""",
)
def check_min_len(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return cell_issues(docs, one("text", min_len=600), "doc_id").select(*ISSUE)


@query("norm_key", f"SELECT doc_id, md5(lower(trim({PADDED}, {WS}))) AS digest FROM documents")
def norm_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.norm_key(padded())).alias("digest"))


@query("normalize_column_name", "SELECT p_partkey, lower(trim(concat('  ', upper(p_name), ' '))) AS name FROM part")
def normalize_column_name(spark, sf):
    name = F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "))
    return table(spark, sf, "part").select("p_partkey", text.normalize_column_name(name).alias("name"))


@query(
    "slugify",
    r"""SELECT page_id, regexp_replace(lower(trim(regexp_replace(regexp_replace(strip_accents(url), '[^\x00-\x7F]', '', 'g'),
    '[^\w\s-]', '', 'g'))), '[-\s]+', '-', 'g') AS slug FROM pages""",
)
def slugify(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.slugify(F.col("url")).alias("slug"))


@query("safe_str", f"SELECT row_key, coalesce(priority, '') AS priority FROM ({ORDERS_SQL}) q")
def safe_str(spark, sf):
    return dirty_orders(spark, sf).select("row_key", text.safe_str(F.col("priority")).alias("priority"))


# A column whose format carries an offset, held against bounds without one: the
# comparison itself fails and the run goes on.
@query(
    "cell_error_guard",
    """SELECT o_orderkey AS "row", 'placed' AS "column",
    CASE WHEN o_orderstatus = 'P' THEN 'DATE_PARSE_FAILED' ELSE 'PARSE_ERROR' END AS code,
    CASE WHEN o_orderstatus = 'P' THEN 'Expected format(s): %Y-%m-%d%z'
    ELSE 'Internal error: can''t compare offset-naive and offset-aware datetimes' END AS message FROM orders""",
)
def cell_error_guard(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    zone = F.when(F.col("o_orderstatus") == "P", F.lit(" CET")).otherwise(F.lit("+0100"))
    placed = table(spark, sf, "orders").select("o_orderkey", F.concat(day, zone).alias("placed"))
    spec = one("placed", "date", formats=["%Y-%m-%d%z"], min_date="1996-01-01")
    return cell_issues(placed, spec, "o_orderkey").select(*ISSUE)


@query("match_rate", f"""WITH {STRIPPED} SELECT round(avg(CASE WHEN ok0 THEN 1.0 ELSE 0.0 END), 6) AS order_id,
    round(avg(CASE WHEN f2 IS NULL THEN 0.0 ELSE 1.0 END), 6) AS total_price,
    round(avg(CASE WHEN lower(t5) IN ('true', 'false', 'yes', 'no') THEN 1.0 ELSE 0.0 END), 6) AS flag FROM v""")
def rates(spark, sf):
    def stripped(name):
        return text.py_strip(text.safe_str(F.col(name)))
    return dirty_orders(spark, sf).agg(
        F.round(match_rate(numbers.is_integer(stripped("order_id"))), 6).alias("order_id"),
        F.round(match_rate(numbers.number_value(stripped("total_price")).isNotNull()), 6).alias("total_price"),
        F.round(match_rate(numbers.looks_boolean(stripped("flag"))), 6).alias("flag"),
    )


# --- specifications built in other ways -------------------------------------

TEMPLATE = Template(
    id="orders-v1",
    name="Orders",
    columns=(
        ColumnSpec("OrderNo", "integer", True, False, {"max": 14000}, aliases=("order id", " ORDER_ID ")),
        ColumnSpec("Status", "enum", rules={"allowed": ["F", "O"], "not_in": ["o"]}),
        ColumnSpec("Amount", "number", rules={"min": 2000, "max": 400000}, aliases=("Total_Price",)),
        ColumnSpec("Prio", "string", True, rules={"regex": "[1-5]-[A-Z ]+", "max_len": 12}),
    ),
)
BOUND = ["order_id_empty", "order_id_type", "order_id_max", "status_enum", "status_not_in",
         "price_type", "price_min", "price_max"]


@query("bind_spec", sql(ISSUES, *BOUND))
def bound(spark, sf):
    """Names and aliases; the unmatched required column is kept but absent."""
    spec = bind_spec(TEMPLATE, ORDERS_NAMES, force=True)
    return cell_issues(dirty_orders(spark, sf), spec, "row_key").select(*ISSUE)


@query("mapping_overrides", sql(ISSUES, *BOUND, "priority_empty", "priority_regex", "priority_len"))
def overridden(spark, sf):
    spec = bind_spec(TEMPLATE, ORDERS_NAMES, overrides={"Prio": "priority"})
    return cell_issues(dirty_orders(spark, sf), spec, "row_key").select(*ISSUE)


@query("manual_rules", sql(
    """SELECT "row", "column", code, replace(replace(message, 'min 2000', 'min 2000.0'), 'max 400000', 'max 400000.0') AS message
    FROM issues""", "order_id_empty", "order_id_type", "status_enum", "price_type", "price_min", "price_max",
    "date_parse", "priority_regex", "flag_type"))
def manual(spark, sf):
    spec = manual_spec(
        ORDERS_NAMES,
        types={"order_id": "integer", "status": "enum", "total_price": "number", "order_date": "date", "flag": "boolean"},
        empty={"order_id": "error"},
        options={
            "status": {"allowed": "F, O"},
            "total_price": {"min": "2000", "max": " 4e5"},
            "order_date": {"formats": "%Y-%m-%d, %d.%m.%Y"},
            "priority": {"regex": "[1-5]-[A-Z ]+"},
            "flag": {"min": "x"},
        },
    )
    return cell_issues(dirty_orders(spark, sf), spec, "row_key").select(*ISSUE)


# --- user rules and types ----------------------------------------------------

def _multiple_of(cell, n):
    wrong = F.pmod(cell.value, F.lit(n)) != 0
    return F.when(wrong, F.concat(F.lit("Value "), cell.value.cast("string"), F.lit(f" is no multiple of {n}")))


def _brand(value):
    number = F.regexp_extract(value, r"\ABrand#([0-9]+)\z", 1).try_cast("int")
    return F.struct(number.isNotNull().alias("ok"), number.alias("value"))


registry.register_rule("multiple_of", "NOT_A_MULTIPLE", _multiple_of)
registry.register_type("brand", _brand)


@query("register_rule", """SELECT p_partkey AS "row", 'p_size' AS "column", 'NOT_A_MULTIPLE' AS code,
    concat('Value ', CAST(p_size AS VARCHAR), ' is no multiple of 5') AS message FROM part WHERE p_size % 5 <> 0""")
def user_rule(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_brand")
    return cell_issues(part, one("p_size", "integer", multiple_of=5), "p_partkey").select(*ISSUE)


@query("register_type", """SELECT p_partkey AS "row", 'label' AS "column",
    CASE WHEN p_type = 'PROMO' THEN 'TYPE_MISMATCH' ELSE 'NOT_A_MULTIPLE' END AS code,
    CASE WHEN p_type = 'PROMO' THEN concat('Expected brand, got ''', p_type, '''')
    ELSE concat('Value ', replace(p_brand, 'Brand#', ''), ' is no multiple of 2') END AS message
    FROM part WHERE p_type = 'PROMO' OR CAST(replace(p_brand, 'Brand#', '') AS INTEGER) % 2 <> 0""")
def user_type(spark, sf):
    label = F.when(F.col("p_type") == "PROMO", F.col("p_type")).otherwise(F.col("p_brand"))
    part = table(spark, sf, "part").select("p_partkey", label.alias("label"))
    return cell_issues(part, one("label", "brand", multiple_of=2), "p_partkey").select(*ISSUE)
