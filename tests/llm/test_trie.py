"""Prefix trie: SQL oracle, brute force with small blocks, chunks and pieces, hot groups, odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from conftest import SF_SMALL
from ringlens.llm import catalog, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}


def rebuilt(rows):
    own, out = ordered(rows), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(set)
    for node in members:
        if node:
            kids[node[:-1]].add(node)
    out = []
    for node, cs in members.items():
        under = [m for m in members if m[:len(node)] == node]
        ends = sorted(c for c in cs if len(convs[c]) == len(node))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids[node]),
                    sum(not kids[m] for m in under), sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in under if m),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF_SMALL}/conversations.parquet'")
    cur = con.execute(catalog.ORACLE_SQL["op11_prefix_trie"])
    cols = [c[0] for c in cur.description]
    want = sorted(cur.fetchall(), key=str)
    got = result(catalog.op11_prefix_trie(spark, SF_SMALL).select(*cols))
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == want == brute(rebuilt(rows))


def _some(rng, convs, turns, texts):
    return [(c, t, rng.choice("ua"), rng.choice(texts)) for c in range(convs) for t in range(rng.randrange(turns))]


@pytest.mark.parametrize("block", [1, 2, 3, 8])
def test_random_conversations(spark, block, monkeypatch):
    """Few texts, so that conversations share, leave and end inside blocks and at their borders."""
    rng = random.Random(block)
    monkeypatch.setattr(trie, "CHUNK", 2)
    monkeypatch.setattr(trie, "PIECE", 8)
    rows = [r for r in _some(rng, 60, 9, ["x", "é"])] + [(c, t, "u", "x" if t < 17 + c % 3 else "y" * (c % 2)) for c in range(60, 72) for t in range(21)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(trie.conversation_trie(df, block=block)) == brute(ordered(rows))
    if block in (2, 8):
        assert result(trie.rebuilt_trie(df, block=block)) == brute(rebuilt(rows))


def test_copies_and_long_conversations(spark):
    base = [(t, "u", f"turn {t}") for t in range(50)]
    rows = [(c, *b) for c in range(300) for b in base[:3]] + [(1000, *b) for b in base] + [(1001, *b) for b in base[:33]]
    got = result(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(9)))
    assert got == brute(ordered(rows))


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "u", "a"), (1, 0, "u", "a"), (1, 0, "a", "é"), (None, 0, "u", "z"), (2, 5, "u", "b" * 100_000),
            (3, 1, None, "a"), (3, None, "", ""), (4, 0, "ua", "b"), (6, 0, "u", "ab"), (-7, 0, "u", "ab"), (9, 2, "u", None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS pos", "2 AS a", "3 AS n", "4 AS size")
    assert result(trie.conversation_trie(df)) == brute(ordered(rows))
    assert trie.conversation_trie(df.limit(0)).count() == 0 and trie.rebuilt_trie(df.limit(0)).count() == 0
    only = [(c, 0, "u", "t") for c in range(11, 15)]  # openings of a conversation that is absent: some have no turns left
    assert result(trie.rebuilt_trie(spark.createDataFrame(only, SCHEMA))) == brute(rebuilt(only))
