"""Whole-table operators: keys, summaries, views, inference, matching, files."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellsieve import ColumnSpec, DatasetSpec, cell_issues, validate
from cellsieve.operators import infer, match, summary, tables, views
from cellsieve.plans.keys import key_issues
from cellsieve.plans.rowid import row_index
from cellsieve.plans.validate import all_issues, issue_order, union_issues
from cellsieve.scratch import new_path
from cellsieve.sinks import exports
from cellsieve.sinks.stored import save_issues, save_raw, save_run
from cellsieve.sources import csv_files, json_files, stored, xml_files
from cellsieve.sources.json_records import json_records
from cellsieve.streaming.checks import stream_issues, write_issues
from suite.dirty import (
    CELL_SPEC,
    CHECKS,
    ISSUES,
    NULLS,
    ORDERS_COLUMNS,
    ORDERS_NAMES,
    ORDERS_SPEC,
    dirty_orders,
    sql,
    table,
    text_orders,
)
from suite.registry import query

KEY = "row_key"
ISSUE = ["row", "column", "code", "message"]
ORDER = ["phase", "rule_id", "col_pos", "rule_pos"]


def run(spark, sf, spec=ORDERS_SPEC):
    orders = dirty_orders(spark, sf)
    return orders, all_issues(orders, spec, KEY)


# --- validation and keyed rules ----------------------------------------------

@query("validate", sql(ISSUES))
def whole_run(spark, sf):
    return validate(dirty_orders(spark, sf), ORDERS_SPEC, KEY).issues


@query("union_issues", sql('SELECT "column", code, phase, count(*) AS n FROM issues GROUP BY ALL'))
def union_of_issues(spark, sf):
    orders = dirty_orders(spark, sf)
    both = union_issues(cell_issues(orders, ORDERS_SPEC, KEY), key_issues(orders, ORDERS_SPEC, KEY))
    return both.groupBy("column", "code", "phase").agg(F.count("*").alias("n"))


@query("issue_order", sql(f'SELECT "row", "column", code, {", ".join(ORDER)} FROM issues'))
def ordered(spark, sf):
    return issue_order(run(spark, sf)[1]).select("row", "column", "code", *ORDER)


@query("unique", """SELECT p_partkey AS "row", 'p_name' AS "column", 'UNIQUE_VIOLATED' AS code,
    concat('Duplicate value ''', p_name, '''') AS message FROM
    (SELECT *, min(p_partkey) OVER (PARTITION BY p_name) AS first FROM part) WHERE p_partkey > first""")
def unique(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    spec = DatasetSpec.of(ColumnSpec("p_name", rules={"unique": True}))
    return key_issues(part, spec, "p_partkey").select(*ISSUE)


LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("unique_together", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, c.name AS "column"
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(LINE_KEY)}) AS rn FROM lineitem) q
    CROSS JOIN (VALUES ('l_orderkey'), ('l_linenumber')) c(name) WHERE rn > 1""")
def unique_together(spark, sf):
    """Rows of lineitem are identified by all their columns together."""
    spec = DatasetSpec.of(unique_together=[("l_orderkey", "l_linenumber")])
    found = key_issues(table(spark, sf, "lineitem"), spec, LINE_KEY)
    return found.select(*[f"row.{c}" for c in
        ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")], "column")


@query("validate_unvalidated", sql("""SELECT name AS "column", pos, coalesce(n, 0) AS invalid_count, total FROM
    (VALUES ('order_id', 0), ('status', 1), ('total_price', 2), ('order_date', 3), ('priority', 4), ('flag', 5)) c(name, pos)
    CROSS JOIN (SELECT count(*) AS total FROM v) LEFT JOIN (SELECT "column" AS name, count(DISTINCT "row") AS n
    FROM issues GROUP BY 1) USING (name)""", "order_id_empty", "order_id_type"))
def unvalidated(spark, sf):
    """Columns outside the specification, or flagged, count but are not checked."""
    spec = DatasetSpec.of(
        ColumnSpec("order_id", "integer", True, False), ColumnSpec("flag", "boolean", unvalidated=True)
    )
    done = validate(dirty_orders(spark, sf), spec, KEY)
    return done.column_summary.select("column", "pos", "invalid_count", "total")


# --- summaries ---------------------------------------------------------------

COUNTS = """(SELECT name AS "column", pos, coalesce(n, 0) AS invalid_count, total FROM
    (VALUES ('order_id', 0), ('status', 1), ('total_price', 2), ('order_date', 3), ('priority', 4), ('flag', 5)) c(name, pos)
    CROSS JOIN (SELECT count(*) AS total FROM v) t LEFT JOIN (SELECT "column" AS name, count(DISTINCT "row") AS n
    FROM issues GROUP BY 1) USING (name))"""


@query("column_invalid_counts", sql(f"SELECT * FROM {COUNTS}"))
def counts(spark, sf):
    return summary.column_invalid_counts(*run(spark, sf), KEY)


@query("invalid_count_by_col", sql(f'SELECT "column", invalid_count FROM {COUNTS} WHERE invalid_count > 0'))
def counts_by_column(spark, sf):
    return summary.invalid_count_by_col(summary.column_invalid_counts(*run(spark, sf), KEY))


@query("worst_column", sql(f'SELECT "column" AS worst_column FROM {COUNTS} ORDER BY invalid_count DESC, pos LIMIT 1'))
def worst(spark, sf):
    return summary.worst_column(summary.column_invalid_counts(*run(spark, sf), KEY))


@query("code_counts", sql('SELECT code, count(*) AS "count" FROM issues GROUP BY 1'))
def codes(spark, sf):
    return summary.code_counts(run(spark, sf)[1])


@query("distinct_codes", sql("SELECT DISTINCT code FROM issues"))
def code_list(spark, sf):
    return summary.distinct_codes(run(spark, sf)[1])


TOP = """(SELECT code, count(*) AS "count", min((phase, rule_id, CASE phase WHEN 0 THEN col_pos ELSE 0 END, "row", rule_pos)) AS seen
    FROM issues GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 5)"""


@query("top_issue_codes", sql(f'SELECT code, "count" FROM {TOP}'))
def top_codes(spark, sf):
    return summary.top_issue_codes(run(spark, sf)[1])


STATS = f"""(SELECT (SELECT count(*) FROM v) AS "rows", CAST(6 AS BIGINT) AS "columns", (SELECT 6 * count(*) FROM v) AS total_cells,
    (SELECT count(*) FROM (SELECT DISTINCT "row", "column" FROM issues)) AS invalid_cells,
    (SELECT count(DISTINCT "row") FROM issues) AS invalid_rows,
    (SELECT count(DISTINCT "column") FROM issues) AS invalid_columns,
    (SELECT "column" FROM {COUNTS} ORDER BY invalid_count DESC, pos LIMIT 1) AS worst_column,
    (SELECT string_agg(concat(code, '=', CAST("count" AS VARCHAR)), ', ' ORDER BY "count" DESC, seen) FROM {TOP}) AS top_codes)"""


@query("dataset_stats", sql(f"SELECT * FROM {STATS}"))
def stats(spark, sf):
    shown = F.transform("top_issue_codes", lambda x: F.concat(x["code"], F.lit("="), x["count"].cast("string")))
    # Several aggregates read the issues, so they are stored first.
    done = validate(dirty_orders(spark, sf), ORDERS_SPEC, KEY).store().stats
    return done.withColumn("top_codes", F.array_join(shown, ", ")).drop("top_issue_codes")


@query("invalid_cell_pct", sql(f"SELECT round(100 * invalid_cells / nullif(total_cells, 0), 1) AS invalid_cell_pct FROM {STATS}"))
def pct(spark, sf):
    return summary.invalid_cell_pct(validate(dirty_orders(spark, sf), ORDERS_SPEC, KEY).store().stats)


def _twice(value):
    """Six digits as the operator reports them, then four, in decimals."""
    return f"CAST(round(CAST(round({value}, 6) AS DECIMAL(28, 6)), 4) AS DOUBLE)"


def _numbers(name, pos, value, where):
    return f"""SELECT '{name}' AS "column", {pos} AS pos, count(x) AS "count", min(x) AS "min", max(x) AS "max",
    {_twice("avg(x)")} AS mean, {_twice("stddev_samp(x)")} AS std FROM (SELECT CAST({value} AS DOUBLE) AS x FROM {where})"""


@query("numeric_stats", sql(
    _numbers("order_id", 0, "i0", "u WHERE row_key = first") + " UNION ALL "
    + _numbers("total_price", 2, "f2", "v WHERE f2 BETWEEN 2000 AND 400000")))
def number_stats(spark, sf):
    found = summary.numeric_stats(dirty_orders(spark, sf), ORDERS_SPEC, KEY)
    return found.withColumn("mean", F.round("mean", 4)).withColumn("std", F.round("std", 4))


@query("one_pass_summary", f"""SELECT 'l_quantity' AS "column", count(*) FILTER (l_quantity > 45) AS invalid_count, count(*) AS total,
    {_twice("avg(l_quantity) FILTER (l_quantity <= 45)")} AS mean FROM lineitem UNION ALL
    SELECT 'l_returnflag', count(*) FILTER (l_returnflag = 'R'), count(*), NULL FROM lineitem UNION ALL
    SELECT 'l_shipdate', count(*) FILTER (l_shipdate < TIMESTAMP '1996-01-01'), count(*), NULL FROM lineitem UNION ALL
    SELECT 'l_tax', 0, count(*), NULL FROM lineitem""")
def one_pass(spark, sf):
    lines = table(spark, sf, "lineitem")
    df = lines.select(F.col("l_orderkey").alias("row"), *[F.col(c).cast("string").alias(c)
        for c in ("l_quantity", "l_returnflag", "l_shipdate", "l_tax")])
    spec = DatasetSpec.of(
        ColumnSpec("l_quantity", "number", rules={"max": 45}),
        ColumnSpec("l_returnflag", "enum", rules={"allowed": ["A", "N"]}),
        ColumnSpec("l_shipdate", "datetime", rules={"formats": ["%Y-%m-%d %H:%M:%S"], "min_date": "1996-01-01"}),
    )
    done = summary.one_pass_summary(df, spec)
    return done.select("column", "invalid_count", "total", F.round("numeric_stats.mean", 4).alias("mean"))


# --- views -------------------------------------------------------------------

ROWS = f"SELECT row_key, {', '.join(ORDERS_NAMES)} FROM d"


@query("rows_wrong", sql(f'{ROWS} WHERE row_key IN (SELECT "row" FROM issues)'))
def wrong(spark, sf):
    return views.rows_wrong(*run(spark, sf), KEY)


@query("rows_correct", sql(f'{ROWS} WHERE row_key NOT IN (SELECT "row" FROM issues)'))
def correct(spark, sf):
    return views.rows_correct(*run(spark, sf), KEY)


@query("rows_all", sql(ROWS))
def everything(spark, sf):
    return views.filter_rows(*run(spark, sf), "all", row_key=KEY)


@query("rows_with_code", sql(f"""{ROWS} WHERE row_key IN (SELECT "row" FROM issues WHERE code = 'MIN_VIOLATED')"""))
def with_code(spark, sf):
    return views.filter_rows(*run(spark, sf), "wrong_rows", "MIN_VIOLATED", KEY)


@query("filtered_row_count", sql("""SELECT count(DISTINCT "row") AS total FROM issues WHERE code = 'UNIQUE_VIOLATED'"""))
def filtered_count(spark, sf):
    return views.filtered_row_count(views.filter_rows(*run(spark, sf), "wrong_rows", "UNIQUE_VIOLATED", KEY))


@query("select_invalid_columns", sql("SELECT row_key, order_id, order_date FROM d",
                                     "order_id_type", "date_parse"))
def invalid_columns(spark, sf):
    orders = dirty_orders(spark, sf)
    spec = DatasetSpec.of(
        ColumnSpec("order_id", "integer"),
        ColumnSpec("order_date", "date", rules={"formats": ["%Y-%m-%d", "%d.%m.%Y"]}),
        ColumnSpec("status", "string"),
    )
    return views.select_invalid_columns(orders, all_issues(orders, spec, KEY), KEY)


FIRST = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "row", "column" ORDER BY phase, rule_id, rule_pos) AS rn
    FROM issues) WHERE rn = 1)"""


@query("first_issue_per_cell", sql(f'SELECT "row", "column", code, message FROM {FIRST}'))
def first_issue(spark, sf):
    return views.first_issue_per_cell(run(spark, sf)[1])


@query("issues_map", sql(f"""SELECT "row", string_agg(concat("column", '=', code), ', ' ORDER BY "column") AS errors
    FROM {FIRST} GROUP BY 1"""))
def as_map(spark, sf):
    entries = F.transform(F.map_entries("errors"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["code"]))
    return views.issues_map(run(spark, sf)[1]).select("row", F.array_join(F.array_sort(entries), ", ").alias("errors"))


CELLS = " UNION ALL ".join(
    f"SELECT row_key AS \"row\", {i} AS pos, '{c}' AS \"column\", coalesce({c}, '') AS v FROM d"
    for i, c in enumerate(ORDERS_NAMES)
)


@query("cells_with_errors", sql(f"""SELECT c."row", c.pos, c."column", c.v, f.code IS NOT NULL AS i, f.code AS c, f.message AS m
    FROM ({CELLS}) c LEFT JOIN {FIRST} f ON c."row" = f."row" AND c."column" = f."column\""""))
def cells(spark, sf):
    return views.cells_with_errors(*run(spark, sf), KEY)


NOTES = f"""(SELECT "row" AS row_key, string_agg(concat("column", '=', code, ': ', message), '; ' ORDER BY "column") AS notes
    FROM {FIRST} GROUP BY 1)"""
NOTED = f"SELECT d.row_key, d.status, coalesce(n.notes, '') AS notes FROM d LEFT JOIN {NOTES} n ON d.row_key = n.row_key"


def noted(rows):
    entries = F.transform(F.map_entries("notes"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select(KEY, "status", F.coalesce(F.array_join(F.array_sort(entries), "; "), F.lit("")).alias("notes"))


@query("annotate_rows", sql(NOTED))
def annotated(spark, sf):
    return noted(views.annotate_rows(*run(spark, sf), KEY))


@query("page", sql(f'{ROWS} WHERE row_key IN (SELECT "row" FROM issues) ORDER BY row_key LIMIT 200 OFFSET 300'))
def one_page(spark, sf):
    return views.page(views.rows_wrong(*run(spark, sf), KEY), 300, 500, KEY)


@query("display_index", sql("""SELECT row_key, row_number() OVER (ORDER BY row_key) + 40 AS idx FROM (SELECT row_key FROM d
    WHERE row_key NOT IN (SELECT "row" FROM issues) ORDER BY row_key LIMIT 25 OFFSET 40)"""))
def numbered_page(spark, sf):
    shown = views.display_index(views.rows_correct(*run(spark, sf), KEY), 40, 25, KEY)
    return shown.select(KEY, F.col("idx").cast("bigint").alias("idx"))


@query("preview", sql(f"{ROWS} ORDER BY row_key LIMIT 10", keyed=False))
def first_rows(spark, sf):
    return views.preview(dirty_orders(spark, sf), KEY)


# --- positions and inference -------------------------------------------------

@query("row_index", """SELECT row_number() OVER () - 1 AS "row", l_orderkey, l_linenumber, l_partkey FROM lineitem""")
def positions(spark, sf):
    return row_index(table(spark, sf, "lineitem")).select("row", "l_orderkey", "l_linenumber", "l_partkey")


TEXT_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def values(sources):
    """``row, pos, column, value`` of non-null cells, as SQL."""
    cells = " UNION ALL ".join(
        f"SELECT CAST({key} AS BIGINT) AS \"row\", {i} AS pos, '{c}' AS \"column\", trim(coalesce(CAST({c} AS VARCHAR), '')) AS value FROM {src}"
        for key, src, names in sources for i, c in enumerate(names)
    )
    return f"(SELECT * FROM ({cells}) WHERE lower(value) NOT IN {NULLS})"


def sampled(sources, n=500):
    return f"""(SELECT "row", pos, "column", value FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY "row") AS rn
    FROM {values(sources)}) WHERE rn <= {n})"""


DIRTY = [("row_key", "d", ORDERS_NAMES)]


@query("non_null_values", sql(f"SELECT * FROM {values(DIRTY)}", keyed=False))
def non_null(spark, sf):
    return infer.non_null_values(dirty_orders(spark, sf), KEY)


@query("inference_sample", sql(f"SELECT * FROM {sampled(DIRTY)}", keyed=False))
def sample(spark, sf):
    return infer.inference_sample(dirty_orders(spark, sf), KEY)


@query("enum_candidates", sql(f"""SELECT pos, "column", count(*) AS n, CAST(count(DISTINCT value) AS INTEGER) AS n_unique,
    string_agg(DISTINCT value, '|' ORDER BY value) AS "values" FROM {sampled(DIRTY)} GROUP BY 1, 2""", keyed=False))
def candidates(spark, sf):
    found = infer.enum_candidates(infer.inference_sample(dirty_orders(spark, sf), KEY))
    return found.withColumn("values", F.array_join("values", "|"))


def _rates_sql(sample_sql):
    """One rate per format, then the ladder."""
    formats = [*infer.DATETIME_FORMATS, *infer.DATE_FORMATS]
    rates = ", ".join(
        f"avg(CASE WHEN try_strptime(value, '{f}') IS NOT NULL THEN 1.0 ELSE 0.0 END) AS f{i}" for i, f in enumerate(formats)
    )
    times = " ".join(f"WHEN f{i} >= 0.95 THEN '{f}'" for i, f in enumerate(formats[:9]))
    days = " ".join(f"WHEN f{i + 9} >= 0.95 THEN '{f}'" for i, f in enumerate(formats[9:]))
    return f"""SELECT "column", pos, type, CASE type WHEN 'datetime' THEN m WHEN 'date' THEN dd END AS formats,
      CASE type WHEN 'enum' THEN vals END AS allowed FROM (SELECT *, CASE WHEN ints >= 0.95 THEN 'integer' WHEN nums >= 0.95 THEN 'number'
      WHEN m IS NOT NULL THEN 'datetime' WHEN dd IS NOT NULL THEN 'date' WHEN bools >= 0.95 THEN 'boolean'
      WHEN u <= 20 AND (n <= 100 OR u / n <= 0.1) THEN 'enum' ELSE 'string' END AS type
      FROM (SELECT *, CASE {times} END AS m, CASE {days} END AS dd FROM
      (SELECT "column", pos, count(*) AS n, count(DISTINCT value) AS u, string_agg(DISTINCT value, '|' ORDER BY value) AS vals,
        avg(CASE WHEN regexp_full_match(value, '[+-]?[0-9]+') THEN 1.0 ELSE 0.0 END) AS ints,
        avg(CASE WHEN regexp_full_match(value, '[0-9.eE+-]+') AND value <> '1e309' AND TRY_CAST(value AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS nums,
        avg(CASE WHEN lower(value) IN ('true', 'false', 'yes', 'no') THEN 1.0 ELSE 0.0 END) AS bools, {rates}
      FROM {sample_sql} GROUP BY 1, 2)))"""


CLEAN = [("o_orderkey", "orders", TEXT_COLUMNS)]


@query("infer_column_types", _rates_sql(sampled(CLEAN)))
def types(spark, sf):
    found = infer.infer_column_types(text_orders(spark, sf), KEY)
    return found.withColumn("formats", F.array_join("formats", "|")).withColumn("allowed", F.array_join("allowed", "|"))


# --- header checks and matching ----------------------------------------------

# Every brand and type of part is a data set whose columns are its part names,
# spelled in different ways; every type has a template made of the names of its
# small parts.
HEADERS = """(SELECT concat(p_brand, '/', p_type) AS dataset_id, p_partkey AS pos,
    CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(' ', p_name) ELSE p_name END AS name FROM part)"""
COLUMNS = """(SELECT p_type AS template_id, replace(p_name, ' ', '_') AS "column", min(p_size) % 2 = 1 AS required,
    p_name AS alias, min(p_partkey) AS col_pos FROM part GROUP BY p_type, p_name)"""
PAIRS = "(SELECT DISTINCT concat(p_brand, '/', p_type) AS dataset_id, p_type AS template_id FROM part)"


def catalog(spark, sf):
    part = table(spark, sf, "part")
    dataset = F.concat("p_brand", F.lit("/"), "p_type").alias("dataset_id")
    name = (
        F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name"))
        .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" "), "p_name"))
        .otherwise(F.col("p_name"))
    )
    headers = part.select(dataset, F.col("p_partkey").alias("pos"), name.alias("name"))
    columns = part.groupBy(F.col("p_type").alias("template_id"), "p_name").agg(
        (F.min("p_size") % 2 == 1).alias("required"), F.min("p_partkey").alias("col_pos")
    )
    named = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    both = F.array(
        F.struct(F.lit(0).alias("cand_pos"), named.alias("candidate")),
        F.struct(F.lit(1).alias("cand_pos"), F.col("p_name").alias("candidate")),
    )
    templates = columns.select("template_id", "col_pos", named.alias("column"), "required", F.inline(both))
    pairs = part.select(dataset, F.col("p_type").alias("template_id")).distinct()
    return headers, templates, pairs


BEST = f"""b AS (SELECT p.dataset_id, p.template_id, c."column", c.required, arg_max(h.name, h.pos) AS name
    FROM {PAIRS} p JOIN {COLUMNS} c ON p.template_id = c.template_id LEFT JOIN {HEADERS} h
    ON h.dataset_id = p.dataset_id AND lower(trim(h.name)) = c.alias GROUP BY 1, 2, 3, 4)"""


@query("match_schema_catalog", f"""WITH {BEST} SELECT dataset_id, template_id, 'matched' AS status, "column", name FROM b WHERE name IS NOT NULL
    UNION ALL SELECT dataset_id, template_id, 'unresolved', "column", NULL FROM b WHERE name IS NULL
    UNION ALL SELECT dataset_id, template_id, 'missing', "column", NULL FROM b WHERE name IS NULL AND required
    UNION ALL SELECT h.dataset_id, p.template_id, 'extra', NULL, h.name FROM {HEADERS} h JOIN {PAIRS} p ON h.dataset_id = p.dataset_id
    WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.dataset_id = h.dataset_id AND b.template_id = p.template_id AND b.name = h.name)""")
def matching(spark, sf):
    return match.match_schema_catalog(*catalog(spark, sf))


EXPECTED = f"""(SELECT p.dataset_id, c.alias AS "column", c.required FROM {PAIRS} p JOIN {COLUMNS} c ON p.template_id = c.template_id)"""


def expected(spark, sf):
    headers, templates, pairs = catalog(spark, sf)
    wanted = match.each_pair(pairs, templates.where("cand_pos = 1"))
    return headers, wanted.select("dataset_id", F.col("candidate").alias("column"), "required")


@query("missing_columns", f"""SELECT e.dataset_id, 'MISSING_COLUMN' AS code, e."column",
    concat('Required column ''', e."column", ''' is missing from the file') AS message FROM {EXPECTED} e
    WHERE e.required AND NOT EXISTS (SELECT 1 FROM {HEADERS} h WHERE h.dataset_id = e.dataset_id AND h.name = e."column")""")
def missing(spark, sf):
    return match.missing_columns(*expected(spark, sf))


@query("extra_columns", f"""SELECT h.dataset_id, 'EXTRA_COLUMN' AS code, h.name AS "column",
    concat('Unexpected column ''', h.name, ''' (strict mode)') AS message FROM {HEADERS} h
    WHERE NOT EXISTS (SELECT 1 FROM {EXPECTED} e WHERE h.dataset_id = e.dataset_id AND h.name = e."column")""")
def extra(spark, sf):
    return match.extra_columns(*expected(spark, sf))


# --- whole tables ------------------------------------------------------------

def as_text(name, columns):
    return f"SELECT {', '.join(f'''coalesce(CAST({c} AS VARCHAR), '') AS {c}''' for c in columns)} FROM {name}"


CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query("to_string_table", as_text("customer", CUSTOMER))
def to_text(spark, sf):
    return tables.to_string_table(table(spark, sf, "customer"))


@query("normalize_raw", """SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END AS priority,
    CASE o_orderstatus WHEN 'F' THEN '' WHEN 'O' THEN 'NA' ELSE ' nan' END AS status FROM orders""")
def normalized(spark, sf):
    orders = table(spark, sf, "orders")
    priority = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("None")).otherwise(F.col("o_orderpriority"))
    status = F.when(F.col("o_orderstatus") == "F", F.lit("<NA>")).when(
        F.col("o_orderstatus") == "O", F.lit("NA")).otherwise(F.lit(" nan"))
    raw = orders.select("o_orderkey", priority.alias(" priority "), status.alias("status\t"))
    return tables.normalize_raw(raw, keep=["o_orderkey"])


@query("dataset_profile", """SELECT count(*) AS "rows", 6 AS cols, 'p_partkey,p_name,p_brand,p_type,p_size,p_retailprice' AS "columns" FROM part""")
def profile(spark, sf):
    return tables.dataset_profile(table(spark, sf, "part")).withColumn("columns", F.array_join("columns", ","))


# --- files -------------------------------------------------------------------

@query("scan_csv", as_text("customer", CUSTOMER))
def from_csv(spark, sf):
    path = new_path(spark, "customer-csv")
    table(spark, sf, "customer").write.option("header", True).option("sep", ";").csv(path)
    return csv_files.scan_csv(spark, path)


SEPARATORS = {"AUTOMOBILE": ",", "BUILDING": ";", "FURNITURE": "\t", "HOUSEHOLD": "|", "MACHINERY": ";"}


@query("detect_csv_dialect", """SELECT c_mktsegment AS segment, CASE c_mktsegment WHEN 'MACHINERY' THEN 'latin-1' ELSE 'utf-8' END AS encoding,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN ',' WHEN 'FURNITURE' THEN 'tab' WHEN 'HOUSEHOLD' THEN '|' ELSE ';' END AS delimiter
    FROM customer GROUP BY ALL""")
def dialects(spark, sf):
    """One set of files per market segment, each in its own dialect."""
    root = new_path(spark, "segments")
    customers = table(spark, sf, "customer").withColumn("c_name", F.concat("c_name", F.lit("é")))
    for segment, sep in SEPARATORS.items():
        charset = "ISO-8859-1" if segment == "MACHINERY" else "UTF-8"
        part = customers.where(F.col("c_mktsegment") == segment).withColumn("of", F.col("c_mktsegment"))
        # a plain writer leaves a header for a first partition without rows: a file of another encoding than the segment's
        part.write.partitionBy("of").option("header", True).option("sep", sep).option("encoding", charset).csv(f"{root}/{segment}")
    found = csv_files.detect_csv_dialect(spark, f"{root}/*/of=*")
    return found.select(
        F.element_at(F.split("path", "/"), -3).alias("segment"),
        "encoding",
        F.when(F.col("delimiter") == "\t", F.lit("tab")).otherwise(F.col("delimiter")).alias("delimiter"),
    ).distinct()


@query("peek_rows", """SELECT 0 AS "row", 's_suppkey|s_name|s_nationkey|s_acctbal' AS cells UNION ALL
    SELECT CAST(row_number() OVER (ORDER BY s_suppkey) AS INTEGER), concat(s_suppkey, '|', s_name, '|', s_nationkey, '|', s_acctbal)
    FROM (SELECT * FROM supplier ORDER BY s_suppkey LIMIT 11)""")
def peeked(spark, sf):
    path = new_path(spark, "supplier-csv")
    table(spark, sf, "supplier").orderBy("s_suppkey").write.option("header", True).csv(path)
    first = sorted(spark.read.text(path).inputFiles())[0]
    return csv_files.peek_rows(spark, first).withColumn("cells", F.array_join("cells", "|"))


@query("scan_json", """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_acctbal AS VARCHAR) AS c_acctbal,
    CASE WHEN c_acctbal > 0 THEN 'True' ELSE 'False' END AS solvent,
    concat('{"nation":"', CAST(c_nationkey AS VARCHAR), '"}') AS home,
    CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS segment FROM customer""")
def from_json(spark, sf):
    path = new_path(spark, "customer-json")
    segment = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    table(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_acctbal", (F.col("c_acctbal") > 0).alias("solvent"),
        F.struct(F.col("c_nationkey").alias("nation")).alias("home"), segment.alias("segment"),
    ).write.json(path)
    return json_files.scan_json(spark, path, lines=True)


def customer_documents(spark, sf):
    """A folder of documents, one per market segment, of three layouts; no task holds a document."""
    path = new_path(spark, "customer-json")
    segment = F.col("c_mktsegment")
    record = F.to_json(F.struct(
        "c_custkey", "c_name", "c_acctbal", (F.col("c_acctbal") > 0).alias("solvent"),
        F.struct(F.col("c_nationkey").alias("nation"), F.array(F.struct(F.lit("}, {").alias("k"))).alias("data")).alias("home"),
        F.when(segment != "BUILDING", segment).alias("segment")))
    head = (
        F.when(segment == "BUILDING", F.lit("["))
        .when(segment == "MACHINERY", F.lit('{"about": {"rows": [{"k": 1}]}, "values": [{"k": 2}], "records": ['))
        .otherwise(F.lit('{"results": ["no records"], "data": ['))
    )
    tail = F.when(segment == "BUILDING", F.lit("]")).otherwise(F.lit('], "items": []}'))
    customers = table(spark, sf, "customer")
    first = customers.groupBy(segment.alias("_segment")).agg(F.min("c_custkey").alias("_first"))
    body = customers.join(first, segment == F.col("_segment")).select(
        segment, F.col("c_custkey").alias("at"), F.concat(F.when(F.col("c_custkey") > F.col("_first"), ", ").otherwise(head), record).alias("value"))
    ends = first.select(F.col("_segment").alias("c_mktsegment")).select("c_mktsegment", F.lit(None).cast("bigint").alias("at"), tail.alias("value"))
    body.unionByName(ends).repartition("c_mktsegment").sortWithinPartitions("c_mktsegment", F.asc_nulls_last("at")).select(
        "c_mktsegment", "value").write.partitionBy("c_mktsegment").text(path)
    return f"{path}/*"


JSON_CUSTOMERS = """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_acctbal AS VARCHAR) AS c_acctbal,
    CASE WHEN c_acctbal > 0 THEN 'True' ELSE 'False' END AS solvent,
    concat('{"nation":"', CAST(c_nationkey AS VARCHAR), '","data":[{"k":"}, {"}]}') AS home,
    CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS segment FROM customer"""


@query("scan_json_documents", JSON_CUSTOMERS)
def from_json_documents(spark, sf):
    columns = ["c_custkey", "c_name", "c_acctbal", "solvent", "home", "segment"]
    found = json_files.scan_json(spark, customer_documents(spark, sf), columns=columns)
    # the reader sorts the keys of nested objects by name
    home = F.regexp_replace("home", r'^\{("data":.*),("nation":"\d+")\}$', r"{$2,$1}")
    return found.withColumn("home", home)


@query("json_document_records", """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'array' WHEN 'MACHINERY' THEN 'records'
    ELSE 'data' END AS layout FROM customer""")
def json_document_records(spark, sf):
    """Records as all splits of the documents find them."""
    told, records = json_records(spark, [customer_documents(spark, sf)], json_files.WRAPPER_KEYS)
    return records.join(told.where("apart"), "path").select(
        F.from_json("record", "c_custkey long")["c_custkey"].alias("c_custkey"), F.coalesce("layout", F.lit("array")).alias("layout"))


@query("unwrap_json_column", """SELECT event_id, json_extract_string(props, '$.k') AS k FROM events UNION ALL
    SELECT event_id, CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'click'""")
def unwrapped(spark, sf):
    """Clicks hold two records under ``data``, errors one under ``rows``."""
    kind = F.col("event_type")
    second = F.concat(F.lit(', {"k": '), F.col("user_id").cast("string"), F.lit("}]}"))
    document = (
        F.when(kind == "click", F.concat(F.lit('{"data": ['), F.col("props"), second))
        .when(kind == "error", F.concat(F.lit('{"rows": ['), F.col("props"), F.lit("]}")))
        .otherwise(F.col("props"))
    )
    events = table(spark, sf, "events").select("event_id", document.alias("document"))
    return json_files.unwrap_json_column(events, "document", "k string", ["event_id"])


@query("json_unwrap_records", """SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id,
    CASE WHEN event_type = 'click' THEN 'True' ELSE 'False' END AS clicked FROM events UNION ALL
    SELECT CAST(event_id AS VARCHAR), '', '' FROM events WHERE event_type = 'click'""")
def unwrapped_objects(spark, sf):
    """Objects of one layout: a list of one record, of two for clicks, of which the second has one key only."""
    clicked = F.col("event_type") == "click"
    document = F.concat(
        F.lit('{"n": 1, "rows": ['), F.to_json(F.struct("event_id", "user_id", clicked.alias("clicked"))),
        F.when(clicked, F.concat(F.lit(", "), F.to_json(F.struct("event_id")))).otherwise(F.lit("")), F.lit("]}"))
    shape = "n {0}, rows array<struct<event_id: {0}, user_id: {0}, clicked: {1}>>"
    parsed = table(spark, sf, "events").select(F.from_json(document, shape.format("string", "string")).alias("_d")).select("_d.*")
    native = T._parse_datatype_string(shape.format("bigint", "boolean"))
    return json_files.json_unwrap_records(parsed, native, "rows")


@query("scan_xml", as_text("customer", CUSTOMER))
def from_xml(spark, sf):
    """One layout with the records below the root, one where the record's tag also stands at another path."""
    flat, deep = new_path(spark, "customer-xml"), new_path(spark, "archive-xml")
    customers, building = table(spark, sf, "customer"), F.col("c_mktsegment") == "BUILDING"
    customers.where(~building).write.format("xml").options(rootTag="customers", rowTag="customer").save(flat)
    blocks = customers.where(building).groupBy("c_nationkey", F.pmod(F.hash("c_custkey"), F.lit(64)).alias("block")).agg(
        F.struct(F.collect_list(F.struct(*CUSTOMER)).alias("customer")).alias("customers"), F.count("*").alias("n"))
    note = F.struct(F.concat(F.lit("listed: "), "n").alias("customer")).alias("note")
    blocks.select(note, "customers").write.format("xml").options(rootTag="archive", rowTag="block").save(deep)
    return xml_files.scan_xml(spark, flat).select(*CUSTOMER).unionByName(
        xml_files.scan_xml(spark, deep, "archive.block.customers.customer").select(*CUSTOMER))


@query("xml_children_to_columns", """SELECT CAST(p_partkey AS VARCHAR) AS "@id", p_name AS name, p_type AS tag FROM part""")
def xml_columns(spark, sf):
    """The key is an attribute; of two equally named children the last counts."""
    path = new_path(spark, "part-xml")
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("@id"), F.col("p_name").alias("name"), F.array("p_brand", "p_type").alias("tag")
    )
    part.write.format("xml").options(rootTag="parts", rowTag="part", attributePrefix="@").save(path)
    records = spark.read.format("xml").options(
        rowTag="part", attributePrefix="@", valueTag="_VALUE", ignoreNamespace="true", inferSchema="false").load(path)
    return xml_files.xml_children_to_columns(records)


@query("detect_xml_record_paths", """SELECT o_orderkey AS order_key, CASE o_orderstatus WHEN 'F' THEN 'order.lines.line'
    WHEN 'O' THEN 'order.item' ELSE 'order.key' END AS record_path,
    CAST(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 3 ELSE 2 END AS BIGINT) AS n_children FROM orders""")
def xml_paths(spark, sf):
    """One document per order, of a layout that depends on the order's status."""
    def tag(name, *inner):
        return F.concat(F.lit(f"<{name}>"), *inner, F.lit(f"</{name}>"))
    key, price = F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string")
    status = F.col("o_orderstatus")
    document = (
        F.when(status == "F", tag("order", tag("key", key), tag("lines", tag("line", price), tag("line", key))))
        .when(status == "O", tag("order", tag("item", key), tag("item", price), tag("item", tag("a", key), tag("a", key))))
        .otherwise(tag("order", tag("key", key), tag("price", tag("only", price))))
    )
    documents = table(spark, sf, "orders").select(key.alias("path"), F.encode(document, "UTF-8").alias("content"))
    found = xml_files.detect_xml_record_paths(documents)
    return found.select(F.col("path").cast("bigint").alias("order_key"), "record_path", "n_children")


@query("file_record_paths", """SELECT 'customers.customer' AS record_path, count(*) AS n_children FROM customer UNION ALL
    SELECT 'orders.order', count(*) FROM orders""")
def xml_file_paths(spark, sf):
    """Files of two layouts, large ones read by several tasks."""
    root = new_path(spark, "layouts")
    table(spark, sf, "customer").write.format("xml").options(rootTag="customers", rowTag="customer").save(f"{root}/a")
    table(spark, sf, "orders").write.format("xml").options(rootTag="orders", rowTag="order").save(f"{root}/b")
    found = xml_files.file_record_paths(spark, f"{root}/*")
    return found.groupBy("record_path").agg(F.sum("n_children").alias("n_children"))


@query("save_raw", as_text("supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]))
def raw_saved(spark, sf):
    root = new_path(spark, "raw")
    save_raw(table(spark, sf, "customer"), root, "b")
    save_raw(table(spark, sf, "supplier"), root, "a")
    return spark.read.parquet(f"{root}/dataset_id=a")


@query("scan_raw", as_text("nation", ["n_nationkey", "n_name", "n_regionkey"]))
def raw_scanned(spark, sf):
    root = new_path(spark, "raw")
    save_raw(table(spark, sf, "nation"), root, "0007")
    save_raw(table(spark, sf, "nation"), root, "7")
    return stored.scan_raw(spark, root, "7")


@query("save_issues", sql(ISSUES, *CHECKS))
def issues_saved(spark, sf):
    """A second run of a data set replaces its first."""
    root = new_path(spark, "issues")
    orders = dirty_orders(spark, sf)
    for spec in (DatasetSpec.of(ORDERS_COLUMNS[1]), CELL_SPEC):
        save_issues(all_issues(orders, spec, KEY), root, "orders")
    return spark.read.parquet(root).select(*ISSUE)


@query("load_issues", sql(ISSUES))
def issues_loaded(spark, sf):
    root = new_path(spark, "issues")
    orders, issues = run(spark, sf)
    save_issues(issues, root, "orders")
    save_issues(cell_issues(orders, CELL_SPEC, KEY), root, "other")
    return stored.load_issues(spark, root, "orders")


def stored_run(spark, sf):
    """The orders' run, stored beside another one and loaded again."""
    root = new_path(spark, "runs")
    orders = dirty_orders(spark, sf)
    save_run(validate(orders, DatasetSpec.of(ORDERS_COLUMNS[1]), KEY), root, "other")
    save_run(validate(orders, ORDERS_SPEC, KEY), root, "orders")
    return stored.load_run(spark, root, "orders")


@query("load_run_summary", sql(f"SELECT * FROM {COUNTS}"))
def run_summary_loaded(spark, sf):
    return stored_run(spark, sf)["column_summary"].select("column", "pos", "invalid_count", "total")


@query("load_run_stats", sql(f"SELECT * FROM {STATS}"))
def run_stats_loaded(spark, sf):
    shown = F.transform("top_issue_codes", lambda x: F.concat(x["code"], F.lit("="), x["count"].cast("string")))
    found = stored_run(spark, sf)["stats"]
    return found.withColumn("top_codes", F.array_join(shown, ", ")).drop("top_issue_codes")


def read_csv(spark, path):
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


@query("export_issues_csv", sql('SELECT CAST("row" AS VARCHAR) AS "row", "column", code, message FROM issues'))
def issues_exported(spark, sf):
    path = new_path(spark, "export")
    exports.export_issues_csv(run(spark, sf)[1], path)
    return read_csv(spark, path)


EXPORTED = ", ".join(["CAST(row_key AS VARCHAR) AS row_key", *[f"coalesce({c}, '') AS {c}" for c in ORDERS_NAMES]])


def read_rows(spark, path):
    return tables.to_string_table(read_csv(spark, path))


@query("export_wrong_rows", sql(f'SELECT {EXPORTED} FROM d WHERE row_key IN (SELECT "row" FROM issues)'))
def wrong_exported(spark, sf):
    path = new_path(spark, "export")
    exports.export_wrong_rows(*run(spark, sf), path, KEY)
    return read_rows(spark, path)


@query("export_valid_rows", sql(f'SELECT {EXPORTED} FROM d WHERE row_key NOT IN (SELECT "row" FROM issues)'))
def valid_exported(spark, sf):
    path = new_path(spark, "export")
    exports.export_valid_rows(*run(spark, sf), path, KEY)
    return read_rows(spark, path)


# --- streams -----------------------------------------------------------------

@query("stream_cell_issues", sql(ISSUES, *CHECKS))
def streamed(spark, sf):
    """The same cell checks over a stream of files equal the batch."""
    source, sink = new_path(spark, "stream-in"), new_path(spark, "stream-out")
    orders = dirty_orders(spark, sf)
    orders.write.parquet(source)
    stream = spark.readStream.schema(orders.schema).parquet(source)
    write_issues(stream, CELL_SPEC, sink, new_path(spark, "stream-state"), KEY).awaitTermination()
    return spark.read.schema(stream_issues(orders, CELL_SPEC, KEY).schema).parquet(sink).select(*ISSUE)
