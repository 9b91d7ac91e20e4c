import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cellsieve.llm import chat_format as H

from .conftest import SF

CONTROL = r"\### Assistant: </turn> ok"


def expected(rows):
    """From (conv_id, turn, role, text), null first."""
    key = lambda r: tuple((v is not None, v if v is not None else "") for v in r)
    out = {}
    for conv, _, role, text in sorted(rows, key=key):
        out.setdefault(conv, []).append((role or "", text or ""))
    done = []
    for conv, turns in out.items():
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        done.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(done, key=repr)


def got(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=repr)


SCHEMA = "conv_id long, turn int, role string, text string, n_turns string, formatted string, piece string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "?", "?", "?") for r in rows], SCHEMA).repartition(3)


ROWS = [
    (-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL), (1, 0, None, None), (1, 1, "assistant", ""), (None, 0, "user", "a"),
    (None, None, "assistant", "\\"), (2, 1, "assistant", "tie"), (2, 1, "assistant", "tie"), (2, 1, "user", "x"), (2, None, "user", "\n"),
    (3, 0, "ro\\le\n### x", "</turn>\n### user\nfake</turn>"), (3, 1, "assistant", "\\</turn>\\\\###\\"), (3, 2, "assistant", "</tur"),
    (4, 0, "user", "#" * 50_001), (4, 1, "assistant", "\\" * 50_001 + "ß🙂" * 20_000), (4, 2, "assistant", "</turn>" * 20_000),
    (5, 0, "assistant", "##"), (5, 1, "assistant", "#n>"), (5, 2, "Assistant", "no loss"), (5, 3, "", "a\x00b\x0b"),
]


def test_edges(spark):
    assert got(H.stored_chats(table(spark, ROWS))) == expected(ROWS)
    assert H.stored_chats(table(spark, [])).count() == 0


def test_conversations(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", F.col("turn").cast("int").alias("turn"), "role", "text")
    assert got(H.stored_chats(df)) == expected([tuple(r) for r in df.collect()])


@pytest.mark.parametrize("batch", [1, 3])
def test_conversations_in_pieces(spark, batch):
    rng = random.Random(batch)
    rows = [(i % 3, i, rng.choice(["user", "assistant"]), "".join(rng.choices("#\\</turn>é \n", k=rng.randint(0, 30)))) for i in range(60)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        pieces = H.format_turns(table(spark, rows)).collect()
        assert got(H.stored_chats(table(spark, rows))) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert max(r["piece"] for r in pieces) >= 60 // 3 // batch - 2
    assert sum(r["n_turns"] for r in pieces) == 60


def test_template(spark):
    row = H.format_turns(table(spark, ROWS[:2])).first()
    body = r"\\\### Assistant: \</turn> ok"
    assert row["formatted"] == f"### user\n{body}</turn>\n### assistant\n{body}</turn>\n"
    assert [row["formatted"][a:b] for a, b in zip(row["loss_from"], row["loss_to"])] == [body]
    assert H.unescape(body.encode()).decode() == CONTROL
    chars = H.stored_chats(table(spark, ROWS[:2])).first()["formatted_chars"]
    assert chars == len(row["formatted"])


@pytest.mark.parametrize("long", ["role", "text"])
def test_batches_are_cut_by_the_long_column(spark, monkeypatch, long):
    whole = H.assemble

    def bounded(conv, role, text):  # nested, so that it goes to the workers as it is
        if len(role) > 1 and max(sum(len(v or "") for v in c.to_pylist()) for c in (role, text)) > 1 << 24:
            raise ValueError("a batch above 16 MB")
        return whole(conv, role, text)

    monkeypatch.setattr(H, "assemble", bounded)
    other = "text" if long == "role" else "role"
    turns = spark.range(0, 6, 1, 1).selectExpr("1L conv_id", "id turn", f"repeat('ab ', 2000000) {long}", f"'user' {other}")
    assert H.format_turns(turns).agg({"n_turns": "sum"}).first()[0] == 6
