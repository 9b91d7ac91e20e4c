"""Scalar functions against CPython on random texts."""

import math
import random
import re
import string
import unicodedata
import warnings
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from cellsieve.functions import dates, numbers, patterns, text
from cellsieve.operators.infer import DATE_FORMATS, DATETIME_FORMATS

SPACES = [c for c in map(chr, range(0x3100)) if c.isspace()]


def rows(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").repartition(8)


def evaluate(spark, values, *columns):
    got = rows(spark, values).select("i", *columns).collect()
    return {r["i"]: tuple(r)[1:] for r in got}


def random_texts(alphabet, n, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randint(0, longest))) for _ in range(n)]


def py(fn, value):
    try:
        return fn(value)
    except ValueError:
        return None


def test_strip_and_key(spark):
    values = random_texts(SPACES + list("aÀß .\x00​"), 4000, 7, 1) + ["", "\x1ca\x1f", "İ", "ẞ"]
    got = evaluate(spark, values, text.py_strip(F.col("v")), text.norm_key(F.col("v")))
    for i, v in enumerate(values):
        assert got[i] == (v.strip(), v.strip().lower()), repr(v)


def test_numbers(spark):
    values = random_texts("0123456789+-._eE", 12000, 7, 2) + random_texts("0123456789+-._eEdfxXpPinaNI/, \x00\x01\x7f", 9000, 6, 3)
    values = [v.strip() for v in values] + ["1e308", "1e309", "-1e400", "1E5", "٣", "infinity", "9" * 25, "0x1p3", "-0X1.8P1", "1.", ".", "+", "+.5", "-9223372036854775808", "9223372036854775808"]
    t = F.col("v")
    got = evaluate(spark, values, numbers.is_integer(t), numbers.integer_value(t), numbers.number_value(t))
    for i, v in enumerate(values):
        whole, real = py(int, v), py(float, v)
        if any(ord(c) > 127 for c in v):
            continue  # only ASCII digits are read
        if real is not None and not math.isfinite(real):
            real = None
        small = whole if whole is not None and -(2**63) <= whole < 2**63 else None
        assert got[i] == (whole is not None, small, real), repr(v)


def test_integer_text(spark):
    values = [v for v in random_texts("0012_+-9", 4000, 8, 4) if py(int, v) is not None]
    got = evaluate(spark, values, numbers.integer_text(F.col("v")))
    assert {i: int(v) for i, v in enumerate(values)} == {i: int(g[0]) for i, g in got.items()}
    assert all(str(int(v)) == got[i][0] for i, v in enumerate(values))


def test_float_text(spark):
    rng = random.Random(5)
    values = [0.0, -0.0, 1e7, 9999999.0, 1e-3, 1e-4, 9.5e-5, 1e15, 1e16, 123456789012345680.0, 2.5e-300, 1.5e300]
    values += [round(rng.uniform(-1e6, 1e6), rng.randint(0, 6)) for _ in range(4000)]
    values += [float(f"{rng.randint(1, 10**rng.randint(1, 12))}e{rng.randint(-20, 20)}") for _ in range(4000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r[0]: r[1] for r in df.select("i", numbers.float_text(F.col("v"))).collect()}
    assert [(repr(v), got[i]) for i, v in enumerate(values) if got[i] != repr(v)] == []


FORMATS = [*DATETIME_FORMATS, *DATE_FORMATS, "%y%m%d", "%Y%m%d", "%H:%M:%S.%f", "%d %m %y", "day %d/%m of %Y",
           "%Y-%m-%dT%H:%M:%S.%f", "100%% %Y", "%d%m%Y%H%M", "%b %d, %Y", "%I:%M %p", "%Y-%j", "%Y-%m-%d %z"]


@pytest.mark.parametrize("fmt", FORMATS)
def test_strptime(spark, fmt):
    rng = random.Random(fmt)
    values = []
    for _ in range(250):
        moment = datetime(rng.choice([1, 999, 1900, 1969, 1999, 2024, 9999]), rng.randint(1, 12), rng.randint(1, 28),
                          rng.randint(0, 23), rng.randint(0, 59), rng.randint(0, 59), rng.randint(0, 999999))
        v = moment.strftime(fmt.replace("%z", "+0130"))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(v))
            v = v[:at] + rng.choice(list("0123456789 -/:T.") + ["", ""]) + v[at + rng.randint(0, 1):]
        values.append(v.swapcase() if rng.random() < 0.1 else v)
    values = [v.strip() for v in values]
    parsed = F.date_format(dates.strptime(F.col("v"), fmt), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    got = evaluate(spark, values, parsed)
    for i, v in enumerate(values):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            want = py(lambda s: datetime.strptime(s, fmt), v)
        shown = want and f"{want.year:04}-" + want.strftime("%m-%d %H:%M:%S.%f")
        assert got[i][0] == shown, (fmt, v)


NAMED = ["%d %b %Y", "%B %d, %Y", "%a %d %b %Y %H:%M:%S", "%A, %d. %B %y", "%I:%M %p", "%Y-%m-%d %I:%M:%S.%f%p", "%Y-%j", "%j %H",
         "%Y-%m-%dT%H:%M:%S%z", "%d %b %Y %H:%M %z", "%z %Y", "%Y%j%z", "%p %H:%M", "%y%B", "%b %d", "%Y %b %j"]


@pytest.mark.parametrize("fmt", NAMED)
def test_named_formats_and_offsets(spark, fmt):
    """Local and UTC time against CPython, without a Python worker in the plan."""
    rng = random.Random(fmt)
    offsets = ["Z", "z", "+0130", "-23:59", "+24:00", "+9959", "-00:00", "+01:30:45", "+013045", "+01:3045", "+0130:45", "-05:00:01.25", "+05"]
    values = ["29 Feb 2023", "29 feb 2024", "Feb 29", "\u017fep 1", "1 \u017fep 2024", "2023-366", "9999-366", "2024-366", "0000-001",
              "0001-01-01T00:00:00+0100", "9999-12-31T23:59:59-0100", "12:00 am", "12:30 PM", "00:10 am", "2024-02-30T00:00:00Z"]
    for _ in range(400):
        moment = datetime(rng.choice([1, 999, 1900, 1969, 2000, 2023, 9999]), rng.randint(1, 12), rng.randint(1, 28),
                          rng.randint(0, 23), rng.randint(0, 59), rng.randint(0, 59), rng.randint(0, 999999))
        v = moment.strftime(fmt.replace("%Y", f"{moment.year:04}").replace("%z", rng.choice(offsets)))
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randint(0, len(v))
            v = v[:at] + rng.choice(list("0123456789 -/:T.+Zaj|") + ["", ""]) + v[at + rng.randint(0, 1):]
        values.append(rng.choice([v, v, v.upper(), v.swapcase()]))
    assert dates.plan_format(fmt).kind == "parts"
    shape = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    both = [F.date_format(f(F.col("v"), fmt), shape) for f in (dates.strptime, dates.strptime_utc)]
    found = evaluate(spark, values, F.array(*both))
    got = [tuple(found[i][0]) for i in range(len(values))]
    parsed = 0
    for v, (local, utc) in zip(values, got):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            want = py(lambda s: datetime.strptime(s, fmt), v)
        want_utc = None
        if want is not None and want.tzinfo is not None:
            try:
                want_utc = want.astimezone(timezone.utc).replace(tzinfo=None)
            except OverflowError:
                want_utc = want.replace(tzinfo=None)
        show = lambda m: m and f"{m.year:04}-" + m.strftime("%m-%d %H:%M:%S.%f")
        assert (local, utc) == (show(want), show(want_utc)), (fmt, v)
        parsed += want is not None
    assert parsed > 50


PATTERNS = [
    r"[A-Z]+", r"^[A-B0-9-]{2,5}$", r"\d{2,3}", r"\w+@\w+\.com", r"(?P<a_b>x|y)(?P=a_b)", r"a.c", r"[[a]+", r"[a&&b]+",
    r"\s+x\S*", r"x\Z", r"(a)(b)?\1", r"[^\s]+", r"a|bc", r"(?:ab)*", r"\x41é", r"[]a]+", r"a$", r"(?i)abc", r"a{2}b*?c+",
    r"(?<=a)b", r"a(?=b)b", r"[\w-]+", r"\bab\b", r"[\b]", r"é+", r"(?!x).*", r"\.\+\(", r"[\d.]+", r"(?#c)a", r"[a-c&]+",
    r"(?i)[a-z]x.", r"(?is)a.c", r"(?s)a.+", r"(?i)k+", r"\w\W\w", r"\w+\b.*", r"a\Bb", r"[^\w]+",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_full_match(spark, pattern):
    values = random_texts(list("abcxyAB09@.-[]&é\n\t \x1c +("), 1500, 4, 6)
    values += ["xx", "yy", "abc", "AB12", "a@b.com", "aba", "ABC\n", "abab", "Aé", "aab", "ab", "x\n", "٣٤", "\x08"]
    values += ["हिन्दी", "a‿b", "x²", "नमस्ते", "ſx\n", "İxa", "ıXé", "K", "ΚK", "Ⅷ_", "一x", "A\nC", "a\rc", "axy"]
    got = evaluate(spark, values, patterns.full_match(F.col("v"), pattern))
    for i, v in enumerate(values):
        assert got[i][0] == (re.fullmatch(pattern, v) is not None), (pattern, v)


def test_word_characters(spark):
    """All code points both sides know; Python's Unicode tables are newer than the JVM's."""
    old = [c for c in map(chr, range(1, 0x110000)) if not 0xD800 <= ord(c) <= 0xDFFF and unicodedata.category(c) != "Cn"]
    known = evaluate(spark, old, F.col("v").rlike(r"\A\P{Cn}\z"))
    is_word = evaluate(spark, old, patterns.full_match(F.col("v"), r"\w"))
    wrong = [c for i, c in enumerate(old) if known[i][0] and is_word[i][0] != (re.fullmatch(r"\w", c) is not None)]
    assert not wrong, wrong[:20]


def test_inline_flags_stay_in_the_jvm():
    for pattern in (r"(?i)abc", r"(?is)a.c", r"\w+", r"\bab\b", r"[\w-]+"):
        assert patterns.to_java(pattern) is not None
    assert patterns.to_java("(?i)é") is None and patterns.to_java("(?m)a") is None


def test_slugify(spark):
    values = random_texts(list(string.ascii_letters + " -_.,éßﬁ½\t\n ñ"), 600, 9, 7) + ["  Hello, World!  ", "a -- b"]

    def slug(value):
        folded = unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode()
        kept = "".join(c for c in folded if c.isalnum() or c == "_" or c.isspace() or c == "-").strip().lower()
        return re.sub(r"[-\s]+", "-", kept)

    got = evaluate(spark, values, text.slugify(F.col("v")))
    for i, v in enumerate(values):
        assert got[i][0] == slug(v), repr(v)


def test_composite_key_is_injective(spark):
    parts = ["", "1", ":", "1:", "a", "ab", "b", "2:ab", "x" * 70, "x" * 71]
    pairs = [(a, b) for a in parts for b in parts]
    df = spark.createDataFrame(pairs, "a string, b string")
    keys = [r[0] for r in df.select(text.composite_key([F.col("a"), F.col("b")])).collect()]
    assert len(set(keys)) == len(pairs)
    assert max(len(k.encode()) for k in keys) <= text.KEY_DIGEST_BYTES + 1
