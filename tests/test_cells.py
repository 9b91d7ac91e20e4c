"""One value, one column specification, the codes it yields."""

import pytest

from cellsieve import ColumnSpec, DatasetSpec, cell_issues
from cellsieve.functions import registry

REQ, TYPE, DATE = "REQUIRED_EMPTY", "TYPE_MISMATCH", "DATE_PARSE_FAILED"
REGEX, MINL, MAXL = "REGEX_MISMATCH", "MIN_LEN_VIOLATED", "MAX_LEN_VIOLATED"
MIN, MAX, ENUM, NOT_IN = "MIN_VIOLATED", "MAX_VIOLATED", "ENUM_NOT_ALLOWED", "NOT_IN_VIOLATED"


def col(kind, required=False, nullable=True, **rules):
    return ColumnSpec("v", kind, required, nullable, rules)


DAY = ["%Y-%m-%d"]
CASES = [
    # emptiness: every null token, whatever its case and blanks
    (col("string", True, False), {
        "oak": [], "nothing": [], "": [REQ], " ": [REQ], "\t \n": [REQ], "n/a": [REQ], "Null": [REQ], "NA ": [REQ],
        " nA": [REQ], "-": [REQ], " -- ": [REQ], "---": [], "nan": []}),
    (col("string"), {"": [], " -- ": [], "elm": []}),
    (col("string", nullable=False), {"NULL": [REQ], "ash": []}),
    # texts
    (col("string", min_len=2, max_len=5, regex="[a-f]+"), {
        "face": [], "a": [MINL], "facade": [MAXL], "fig": [REGEX], "x": [REGEX, MINL], "gggggg": [REGEX, MAXL]}),
    (col("text", min_len=2), {"é": [MINL], "né": [], "🌲": [MINL], "🌲🌳": []}),
    (col("text", max_len=2), {"  ab  ": [], "abc": [MAXL]}),
    (col("string", regex="(unclosed"), {"whatever": [], ")": []}),
    (col("string", min_len=0, max_len=2), {"q": [], "a🌲": [], "a🌲b": [MAXL]}),
    # integers
    (col("integer"), {
        "17": [], "-17": [], "+17": [], "-00": [], "\t17 ": [], "12_345": [], "123456789012345678901": [], "7" * 75: [],
        "17.": [TYPE], "17.0": [TYPE], "2e1": [TYPE], "0b1": [TYPE], "inf": [TYPE], "1_": [TYPE], "_17": [TYPE],
        "1__7": [TYPE], "+-1": [TYPE], "1 7": [TYPE], "7\x00": [TYPE], "2" * 4300: [], "2" * 4301: [TYPE]}),
    (col("integer", min=-3, max=40), {
        "-3": [], "40": [], "-4": [MIN], "41": [MAX], "8" * 33: [MAX], "-" + "8" * 33: [MIN], "N/A": []}),
    (col("integer", min=11, max=11), {"+011": [], "10": [MIN], "12": [MAX]}),
    (col("integer", min=1.5, max=3.5), {"1": [MIN], "2": [], "3": [], "4": [MAX]}),
    (col("integer", max=7 * 10**29), {str(7 * 10**29): [], str(7 * 10**29 + 1): [MAX], "3": []}),
    (col("integer", min=7 * 10**29), {str(7 * 10**29): [], str(7 * 10**29 - 1): [MIN], "3": [MIN]}),
    # numbers
    (col("number"), {
        "2.75": [], "-19": [], "+.25": [], "8.": [], "3e-4": [], "3E+4": [], "\n6.5": [], "1_1.5": [],
        "two": [TYPE], "infinity": [TYPE], "-Inf": [TYPE], "NaN": [TYPE], "4e400": [TYPE], "-4e400": [TYPE], "2,75": [TYPE],
        "1.2.3": [TYPE], "2.5f": [TYPE], "0x2p1": [TYPE], "e5": [TYPE], "-.": [TYPE], "5_": [TYPE]}),
    (col("number", min=-0.5, max=0.25), {"-0.5": [], "0.25": [], "-0.51": [MIN], "2.5e-1": [], "0.2501": [MAX]}),
    # booleans
    (col("boolean"), {
        "True": [], "fALSE": [], "YES": [], "No": [], "0": [], " 1": [], "n": [TYPE], "f": [TYPE], "00": [TYPE], "ok": [TYPE]}),
    # days
    (col("date", formats=["%Y-%m-%d", "%m/%d/%Y"]), {
        "2031-07-09": [], "07/09/2031": [], "09.07.2031": [DATE], "soon": [DATE], "31/12/2031": [DATE]}),
    (col("date"), {"2031-07-09": [DATE], "": []}),
    (col("date", formats=DAY), {
        "2028-02-29": [], "2031-7-9": [], "2030-02-29": [DATE], "2031-00-09": [DATE], "2031-07-32": [DATE],
        "2031-07-09 ": [], "2031-07-09Z": [DATE], "0000-07-09": [DATE], "2031-07- 9": []}),
    (col("date", formats=["%d-%b-%y"]), {"09-Jul-31": [], "9-JUL-31": [], "09-Jux-31": [DATE]}),
    (col("date", formats=["%K"]), {"2031": [DATE]}),
    (col("date", formats=DAY, min_date="2029-03-01", max_date="2029-10-31"), {
        "2029-03-01": [], "2029-10-31": [], "2029-02-28": [MIN], "2029-11-01": [MAX]}),
    (col("date", formats=["%d/%m/%y"], min_date="01/03/29", date_format="%d/%m/%y"), {"02/03/29": [], "28/02/29": [MIN]}),
    (col("date", formats=DAY, max_date="whenever"), {"2999-01-01": []}),
    (col("date", formats=["%Y-%m-%d%z"], min_date="2029-03-01", not_in=["2028-03-01+0200"]), {
        "2028-03-01+0200": ["PARSE_ERROR"], "2028-03-01": [DATE]}),
    (col("date", formats=["%Y-%m-%d%z"], min_date="2029-03-01+0000", date_format="%Y-%m-%d%z"), {
        "2029-03-01+0200": [MIN], "2029-03-01-0200": []}),
    (col("datetime", formats=["%d.%m.%Y %H:%M"], max_date="2029-10-31"), {
        "31.10.2029 00:00": [], "31.10.2029 00:01": [MAX], "31.10.2029": [DATE], "31.10.2029 24:00": [DATE]}),
    # lists
    (col("enum", allowed=["North", "SOUTH"]), {
        "north": [], "South": [], " SOUTH\t": [], "--": [], "east": [ENUM], "North South": [ENUM]}),
    (col("enum", allowed=[]), {"north": [ENUM], "": []}),
    (col("enum", allowed=["07", "8"]), {"8": [], "7": [ENUM]}),
    (col("enum", allowed=[f"k{i}" for i in range(150)]), {"K9": [], "k149": [], "k150": [ENUM]}),
    (col("string", not_in=["weed"]), {"fern": [], "WEED": [NOT_IN], " weed ": [NOT_IN], "NA": []}),
    (col("integer", not_in=[13]), {"12": [], "13": [NOT_IN], "+13": []}),
    (col("boolean", not_in=["false"]), {"no": [], "False": [NOT_IN]}),
    (col("string", min_len=4, not_in=["moss"]), {"fox": [MINL], "Moss": [NOT_IN]}),
    (col("unheard-of", not_in=["q"]), {"r": [], "Q": [NOT_IN]}),
]


@pytest.mark.parametrize("spec,cases", CASES, ids=[f"{i}-{c[0].type}" for i, c in enumerate(CASES)])
def test_codes(make, spec, cases):
    values = list(cases)
    found = cell_issues(make({"v": values}), DatasetSpec.of(spec))
    got = {v: [] for v in values}
    for r in found.orderBy("row", "rule_pos").collect():
        got[values[r["row"]]].append(r["code"])
    assert got == {v: list(codes) for v, codes in cases.items()}


def messages(make, spec, value, **options):
    found = cell_issues(make({"v": [value]}), DatasetSpec.of(spec, **options))
    return [r["message"] for r in found.orderBy("rule_pos").collect()]


@pytest.mark.parametrize("spec,value,expected", [
    (col("string", True), " ", ["Required field is empty"]),
    (col("integer"), " x ", ["Expected integer, got 'x'"]),
    (col("number"), "1,5", ["Expected number, got '1,5'"]),
    (col("boolean"), "Y", ["Expected boolean (true/false/yes/no/1/0), got 'Y'"]),
    (col("date"), "x", ["No date format specified — all dates rejected"]),
    (col("datetime"), "x", ["No datetime format specified — all datetimes rejected"]),
    (col("date", formats=["%Y", "%d"]), "x", ["Expected format(s): %Y, %d"]),
    (col("string", regex="^a$", min_len=3), "b", ["Value does not match pattern ^a$", "Length 1 < min 3"]),
    (col("string", max_len=1), "a😀", ["Length 2 > max 1"]),
    (col("integer", min=5), "+0_3", ["Value 3 < min 5"]),
    (col("integer", min=5), "-00", ["Value 0 < min 5"]),
    (col("integer", max=1.0), "9" * 40, ["Value " + "9" * 40 + " > max 1.0"]),
    (col("number", max=1), "1e7", ["Value 10000000.0 > max 1"]),
    (col("number", max=1.5), "123456789.125", ["Value 123456789.125 > max 1.5"]),
    (col("number", max=1), "1e16", ["Value 1e+16 > max 1"]),
    (col("number", min=1), "0.00005", ["Value 5e-05 < min 1"]),
    (col("number", min=1), "0.0005", ["Value 0.0005 < min 1"]),
    (col("number", min=1), "-0", ["Value -0.0 < min 1"]),
    (col("date", formats=["%d.%m.%Y"], min_date="2020-01-01"), "05.06.2019",
     ["Date 2019-06-05 is before minimum 2020-01-01"]),
    (col("date", formats=["%Y-%m-%d"], max_date="2020-01-01"), "2021-06-05",
     ["Date 2021-06-05 is after maximum 2020-01-01"]),
    (col("enum", allowed=["a", "b'c"]), "Z", ["'Z' not in allowed values: ['a', \"b'c\"]"]),
    (col("string", not_in=["x"]), " X ", ["'X' is in the blocklist"]),
])
def test_messages(make, spec, value, expected):
    assert messages(make, spec, value) == expected


def test_extra_null_tokens_add_to_the_fixed_ones(make):
    df = make({"X": ["unknown", "fir", "Unknown ", "--", "yew", "unknowns"]})
    found = cell_issues(df, DatasetSpec.of(ColumnSpec("X", required=True), null_values=["UNKNOWN"]))
    assert sorted(r["row"] for r in found.collect()) == [0, 2, 3]


def test_numeric_null_token_has_no_value(make):
    df = make({"X": ["-999", "5", "-1000"]})
    spec = DatasetSpec.of(ColumnSpec("X", "integer", rules={"min": 0}), null_values=["-999"])
    assert [(r["row"], r["code"]) for r in cell_issues(df, spec).collect()] == [(2, MIN)]


def test_typed_and_missing_cells(spark):
    df = spark.createDataFrame([(0, float("nan"), None), (1, 42.0, "x")], "row int, n double, s string")
    spec = DatasetSpec.of(ColumnSpec("n", "integer"), ColumnSpec("s", required=True))
    got = sorted((r["row"], r["column"], r["code"]) for r in cell_issues(df, spec).collect())
    assert got == [(0, "n", TYPE), (0, "s", REQ), (1, "n", TYPE)]


def test_unvalidated_columns_are_skipped(make):
    df = make({"height": ["9", "8"], "remark": ["tall", ""]})
    spec = DatasetSpec.of(ColumnSpec("height", "integer"), ColumnSpec("remark", "number", unvalidated=True))
    assert cell_issues(df, spec).count() == 0


def test_user_rule_and_type(make):
    from pyspark.sql import functions as F

    registry.register_rule("starts", "BAD_START", lambda c, p: F.when(
        ~F.startswith(c.value, F.lit(p)), F.concat(F.lit("no "), F.lit(p), F.lit(" in "), c.raw)))
    registry.register_type("hex", lambda t: F.struct(
        t.rlike(r"\A[0-9a-f]+\z").alias("ok"), F.conv(t, 16, 10).alias("value")), "hex digits")
    df = make({"a": ["xy", " zz "], "b": ["ff", "g"]})
    spec = DatasetSpec.of(ColumnSpec("a", rules={"starts": "x"}), ColumnSpec("b", "hex", rules={"starts": "2"}))
    got = sorted((r["row"], r["code"], r["message"]) for r in cell_issues(df, spec).collect())
    assert got == [(1, "BAD_START", "no x in  zz "), (1, TYPE, "Expected hex digits, got 'g'")]


def test_awkward_column_names(make):
    df = make({"a.b": ["x"], "e f": ["z"]})
    spec = DatasetSpec.of(ColumnSpec("a.b", "integer"), ColumnSpec("e f", "integer"))
    assert {r["column"] for r in cell_issues(df, spec).collect()} == {"a.b", "e f"}
