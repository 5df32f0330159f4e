"""Decontamination: SQL oracle, brute force on random word streams, proximity, odd rows, plan."""

import hashlib
import random
import re

import duckdb

from conftest import SF_SMALL
from ringlens.llm import catalog, decontaminate as dc

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def cut(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, length=10):
    out = []
    wins = [("" if i is None else str(i), w[s:s + length]) for i, t in items for w in [cut(t)]
            for s in range(max(len(w) - length + 1, 1) if w else 0)]
    for doc, text in docs:
        w, hit, ids = cut(text), set(), set()
        for item, win in wins:
            for at in range(len(w) - len(win) + 1):
                if w[at:at + len(win)] == win:
                    hit.update(range(at, at + len(win)))
                    ids.add(item)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_sql(spark):
    got = catalog.op12_decontamination(spark, SF_SMALL)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    want = sorted(con.execute(catalog.ORACLE_SQL["op12_decontamination"]).fetchall(), key=str)
    assert rows(got) == want and any(r[5] for r in want) and not all(r[5] for r in want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_random_streams_equal_brute_force(spark):
    """Few different words: many repeats, overlapping windows, matches that begin inside an item or end with the document."""
    rng = random.Random(11)

    def stream(n):
        return " ".join(rng.choice(["a", "B", "c9"]) for _ in range(n))

    items = [(k, stream(rng.choice([1, 2, 3, 4, 5, 9]))) for k in range(12)] + [(3, stream(6))]
    docs = [(k, stream(rng.randrange(40))) for k in range(25)]
    docs += [(100, "x " + " ".join(items[5][1].split()[1:]) + " y"), (101, items[4][1]), (102, ("zz " + items[4][1] + "!") * 30)]
    got = rows(dc.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), length=4))
    assert got == brute(docs, items, 4)


def test_whole_texts_and_repeated_passages(spark):
    passage = " ".join(f"w{k}" for k in range(30))
    far = "lorem ipsum " * 20_000
    docs = [(1, far + passage), (2, passage.upper()), (3, passage.replace(" ", "--\t")), (4, " ".join(passage.split()[:9])),
            (5, " ".join(passage.split()[7:17])), (6, "é" + passage)] + [(k, passage) for k in range(1000, 1400)]
    items = [(1, passage), (2, "é" + passage), (30, "ipsum lorem"), (4, " ".join(passage.split()[5:25]))]
    assert rows(dc.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))) == brute(docs, items)


def test_proximity(spark):
    win = "red green blue grey pink".split()
    docs = [(1, "red green blue grey pink"), (2, "red x green blue y grey pink"), (3, "green red blue grey pink"),
            (4, "pink grey blue green red"), (5, "red green blue grey"), (6, "red green blue grey x x x pink")]
    index = dc.build_index(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, " ".join(win))], ITEMS), length=5)
    names = {r.k1: r.doc_id for r in dc._keyed(spark.createDataFrame(docs, DOCS), "doc_id", "text").collect()}
    rare = dc._windows(index).first().q1

    def near(slop):
        return {names[r.k1] for r in dc.proximity_matches(index, slop).collect()}

    def plain(slop):
        out = set()
        for d, text in docs:
            w = text.split()
            for a in [p - rare for p, x in enumerate(w) if x == win[rare]]:
                if all(any(x == win[q] and abs(p - q - a) <= slop for p, x in enumerate(w)) for q in range(5)):
                    out.add(d)
        return out

    assert near(0) == {1} and near(1) == plain(1) >= {1, 3} and near(2) == plain(2) >= {1, 2, 3} and near(4) == plain(4) >= {6} and near(8) == plain(8) >= {4}


def test_odd_rows(spark):
    docs = [(None, "a b c"), (None, "a b c"), (None, None), (1, ""), (1, "A, b; C! d"), (2, "Ünder ünder x"), (2, "Ünder ünder x"), (3, "a b")]
    items = [(1, "a b c"), (None, "b c"), (2, None), (3, "!!"), (1, "ünder"), (11, "x"), (11, "x")]
    d = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS k1", "2 AS words", "3 AS pos", "4 AS item", "5 AS term")
    i = spark.createDataFrame(items, ITEMS).selectExpr("*", "1 AS item", "2 AS word", "3 AS n")
    assert rows(dc.contamination(d, i, length=3)) == brute(docs, items, 3)
    assert rows(dc.contamination(d, i.limit(0))) == brute(docs, [])
    assert dc.contamination(d.limit(0), i).count() == 0


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 1)
    docs = [(k, f"one two three {k} four five") for k in range(20)]
    items = [(1, "two three 7 four"), (2, "three 3"), (3, "five")]
    assert rows(dc.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))) == brute(docs, items)
