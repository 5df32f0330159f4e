"""Chat format: SQL oracle, random round trips, hand-made cases."""

import hashlib
import random

import duckdb

from conftest import SF_SMALL
from ringlens.llm import catalog, chat

SCHEMA = "conv_id long, turn long, role string, text string"


def test_query_equals_sql(spark):
    got = catalog.op8_chat(spark, SF_SMALL)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF_SMALL}/conversations.parquet'")
    cur = con.execute(catalog.ORACLE_SQL["op8_chat"])
    cols = [c[0] for c in cur.description]
    want = {r[0]: r for r in cur.fetchall()}
    rows = got.select(*cols).collect()
    assert len(rows) == len(want)
    assert all(tuple(r) == want[r.conv_id] for r in rows)
    own = next(r for r in rows if r.conv_id == -7)
    assert own.loss_chars == len(catalog.MARKED) and own.loss_sha256 == hashlib.sha256(catalog.MARKED.encode()).hexdigest()


def test_random_texts_round_trip(spark):
    rng = random.Random(1)
    bits = ["###", "\\", "</turn>", "\n", " ", "### user: ", "\n</turn>\n", "a", "%3A", ":", "</turn", ">", "😀"]
    rows = [(c, t, rng.choice(["user", "assistant", "a: b", "%3A", "x\n</turn>\n", "", "# ", None]),
             "".join(rng.choice(bits) for _ in range(rng.randrange(9)))) for c in range(150) for t in range(4)]
    out = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    for r in out:
        mine = [(x or "", t) for c, _, x, t in rows if c == r.conv_id]
        assert r.identical and [(t.role, t.text) for t in r.turns] == mine
        assert sum(m.n_chars for m in r.loss_mask) == len(r.formatted)
        at, masked = 0, []
        for m in r.loss_mask:
            if m.loss:
                masked.append(r.formatted[at:at + m.n_chars])
            at += m.n_chars
        assert masked == [t.body for t in r.turns if t.role == "assistant"]


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, 0, None, None), (1, 0, None, None), (None, 1, "assistant", "b"), (None, 0, "user", "a" * 100_000),
                                (2, None, "assistant", "y")], SCHEMA).selectExpr("*", "1 AS body", "2 AS formatted")
    out = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(df)).collect()}
    assert out[1].n_turns == 2 and out[1].loss_chars == 0
    assert out[1].turns_sha256 == hashlib.sha256(b"\n\n\n\n").hexdigest()
    assert out[None].turns_sha256 == hashlib.sha256(b"user\n" + b"a" * 100_000 + b"\nassistant\nb\n").hexdigest()
    assert out[2].loss_chars == 1 and all(r.identical for r in out.values())
    assert chat.conversation_digests(chat.format_conversations(df.limit(0))).count() == 0


def test_main_path_has_no_python(spark):
    plan = catalog.op8_chat(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_loss_columns_follow_the_mask(spark):
    from pyspark.sql import functions as F
    rows = [(c, t, "assistant" if t % 2 else "user", f"é😀 ### {t} " * (t % 5)) for c, n in ((1, 1), (2, 2), (3, 7), (4, 2000)) for t in range(n)]
    made = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).checkpoint()
    right = {r.conv_id: r for r in chat.conversation_digests(made).collect()}
    for c, r in right.items():
        said = "".join(t for i, _, role, t in rows if i == c and role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    turned = made.withColumn("loss_mask", F.transform("loss_mask", lambda m: F.struct(m["n_chars"].alias("n_chars"), (~m["loss"]).alias("loss"))))
    shifted = made.withColumn("loss_mask", F.transform("loss_mask", lambda m, i: F.struct(
        (m["n_chars"] + F.when(i == 0, 1).otherwise(0)).alias("n_chars"), m["loss"].alias("loss"))))
    for wrong in (turned, shifted):
        got = {r.conv_id: r for r in chat.conversation_digests(wrong).collect()}
        assert all(got[c].loss_sha256 != right[c].loss_sha256 for c in (2, 3, 4))
