import pytest

SF = "/root/testdata/sf0.001"
LONG = "Wort wörd, " * 20_000

#: Ids and texts with nulls, empty and very long texts, ties and repeated rows.
EDGES = [
    (None, None, "a"), (None, "one two three four five six", None), (1, None, "a"), (2, "", "a"), (3, " \n\t\x0b ", "b"),
    (4, LONG, "b"), (5, "same text here, five words", "b"), (5, "same text here, five words", "b"),
    (6, "first of two texts of one id", None), (6, "second of two texts of one id", "c"),
    (7, "SAME text here, FIVE words", "ä"), (8, "same text here, five words", "Z"), (-9, "x", "a"),
    (10, "é́ \U0001f600 ﻿ \x00 \x1f end", "a"), (1 << 62, "big id", "a"),
]
#: Names that operators might use themselves.
CLASHING = ("n", "size", "row", "_row", "_id", "_hash", "_o", "_tie", "o", "tie", "kept", "label", "shard", "node", "key",
            "_dirty", "runs", "_text", "pos", "hash", "words")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def build(spark):
    """Documents with all clashing columns, in several partitions."""

    def made(rows=EDGES, partitions=3):
        rows = [(i, t, "en", s, None if t is None else len(t), *["?"] * len(CLASHING)) for i, t, s in rows]
        extra = ", ".join(f"`{c}` string" for c in CLASHING)
        return spark.createDataFrame(
            rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(partitions)

    return made


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def plain(df, *columns):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
