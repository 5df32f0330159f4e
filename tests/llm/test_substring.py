"""Substring dedup against brute force over all windows of all documents."""

import hashlib
import random

from conftest import SF_MID
from ringlens.llm import catalog, substring

K = 50


def brute(docs, k=K):
    words = [(d, (t or "").encode().split()) for d, t in docs]
    first = {}
    for d, w in words:
        for i in range(len(w) - k + 1):
            key = tuple(w[i:i + k])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if first[tuple(w[i:i + k])] < d:
                gone[i:i + k] = [True] * k
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out)


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs)
    assert sum(w[2] for w in want) > 0
    assert sorted(tuple(r) for r in catalog.op7_substring(spark, SF_MID).collect()) == want


def test_planted_passages_rings_and_odd_rows(spark):
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    p, q, ring = fresh(120), fresh(50), fresh(7)
    texts = []
    for i in range(40):
        parts = [fresh(rng.randrange(40)), p[rng.randrange(30):rng.randrange(70, 121)], fresh(rng.randrange(3)), q, fresh(rng.randrange(60))]
        if i % 3 == 0:
            rng.shuffle(parts)
        if i % 4 == 0:
            parts += [ring * rng.randrange(9, 30)]
        if i % 5 == 0:
            parts += [p, p]
        texts.append(" ".join(w for part in parts for w in part))
    texts += [texts[5], texts[5], texts[7].replace(" ", "\n", 30), " ".join(q[:49]), " ".join(q), "a " * 20_000, "a " * 300, "", None]
    docs = [(i * 3 % 101, t) for i, t in enumerate(texts)]
    docs += [docs[8], docs[8]]  # repeated rows
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, th long, lo int")
    assert sorted(tuple(r) for r in substring.dedup_substrings(df).collect()) == brute(docs)
    cut = substring.remove_repeats(df)
    assert cut.columns == df.columns
    want = {d: s for d, _, _, s in brute(docs)}
    rows = cut.collect()
    assert len(rows) == len(docs)
    assert all(hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() == want[r.doc_id] for r in rows)
    unchanged = {d: t for d, t in docs}
    assert all(r.text == unchanged[r.doc_id] for r in rows if r.doc_id == min(unchanged))
    assert substring.dedup_substrings(df.limit(0)).count() == 0
    null_ids = spark.createDataFrame([(None, texts[5]), (1, texts[5]), (None, None)], "doc_id long, text string")
    assert sorted(r.n_removed for r in substring.dedup_substrings(null_ids).collect()) == [0, 0, 0]


def test_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, long), (2, "a " + long + " b"), (None, None)], "doc_id long, text string").selectExpr(
        "*", "1 AS _k", "2 AS _th", "3 AS _ranges", "4 AS id", "5 AS th", "6 AS row", "7 AS ranges")
    got = substring.remove_repeats(df)
    assert got.columns == df.columns and {(r.doc_id, r.text, r.th) for r in got.collect()} == {(1, long, 5), (2, "a b", 5), (None, None, 5)}
