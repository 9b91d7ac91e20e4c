import hashlib
import re

import pytest

from cellsieve.llm import pii_bootstrap as P

from .conftest import plain, texts_of

KINDS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def passes(kind, match):
    digits = [int(c) for c in match if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        twice = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def expected(doc_id, text):
    spans = sorted((m.start(), n, f"{k}:{m.start()}:{m.end()}") for n, (k, r) in enumerate(KINDS.items())
                   for m in r.finditer(text or "") if passes(k, m[0]))
    shown = ",".join(s[2] for s in spans)
    return (doc_id, *[sum(s[1] == n for s in spans) for n in range(4)], hashlib.sha256(shown.encode()).hexdigest(), shown)


COLUMNS = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
TRICKY = [
    "a@b.c%d@e.f x@.y@z.q a@b", "1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112",
    "+1 (456) 555-2186, +49.30.1234567 ++1234567890 +1 +12((", "ü a.b-c_d@müller.de x@y-z.co.uk, 12345678901234567890123",
    "a" * 100_000, "a." * 50_000 + "@", "x@" + "a." * 50_000 + "b", "1 " * 50_000, "1." * 50_000, "+" * 50_000, "+1" + "(" * 50_000,
    "@" * 1000, "4539578763621486+1 212 555 0187.1.1.1", "\n5 5\n5@5.5\x1f", "0" * 19, "é" * 10 + " a@b.cd",
]


def test_base_spans(build):
    rows = [(i, t, "s") for i, t in enumerate(TRICKY)]
    docs = build(rows)
    assert plain(P.personal_data(docs), *COLUMNS) == sorted((expected(i, t) for i, t, _ in rows), key=repr)


def test_edges_and_documents(build, documents):
    for docs in (build(), documents):
        assert plain(P.personal_data(docs), *COLUMNS) == sorted((expected(*r) for r in texts_of(docs)), key=repr)
    assert P.personal_data(build([])).count() == 0


def test_patterns_find_unseen_identifiers(build):
    mail = [f"blah {w} contact email: user{i}@mail.example.com thanks" for i, w in enumerate("abcdefghij")]
    phone = [f"call now {w} hotline +1 456 555 21{i}6 today" for i, w in enumerate("abcdefghij")]
    unseen = ["blah z contact email: user7(at)mail9 thanks", "other order 66x shipped", "so contact email=bob[at]x9, yes"]
    common = [f"the {v}" for v in ("a1@b.co", "a2@b.co", "1.2.3.4", "2.2.3.4", "k9z", "a3@b.co", "a4@b.co", "a5@b.co", "3.3.3.3", "k8z")]
    docs = build([(i, t, "s") for i, t in enumerate(mail + phone + unseen + common)])
    got = {r["doc_id"]: r for r in P.personal_data(docs).collect()}
    found = {i: r["spans"] for i, r in got.items() if r["n_found"]}
    at = unseen[0].index("user7")
    second = unseen[2].index("bob")
    assert found == {20: f"email:{at}:{at + len('user7(at)mail9')}", 22: f"email:{second}:{second + len('bob[at]x9')}"}
    assert got[20]["n_email"] == 0 and got[20]["base_sha256"] == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("number,valid", [("4111111111111111", True), ("4111111111111112", False), ("0", True), ("18", True)])
def test_luhn(spark, number, valid):
    from pyspark.sql import functions as F

    assert spark.range(1).select(P.luhn(F.lit(number))).first()[0] == valid


def test_no_python(documents):
    plan = P._found(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
