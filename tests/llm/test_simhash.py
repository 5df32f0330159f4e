"""SimHash groups against brute force over all pairs of fingerprints."""

import random
import re

import numpy as np
import xxhash

from conftest import SF_SMALL
from ringlens.llm import catalog, simhash
from ringlens.llm.common import Scratch


def plain_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, bits=2):
    """doc -> smallest linked doc, by union of all close pairs."""
    values = np.array(sorted(set(fps.values())), dtype=np.uint64)
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values ^ v) <= bits):
            parent[find(int(j))] = find(i)
    at = {int(v): find(i) for i, v in enumerate(values)}
    low = {}
    for d, f in fps.items():
        low[at[f]] = min(low.get(at[f], d), d)
    return {d: low[at[f]] for d, f in fps.items()}


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    fps = {d: plain_fingerprint(t) for d, t in docs}
    comps = components(fps)
    rows = catalog.op2_simhash(spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    assert all((r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", comps[r.doc_id]) for r in rows)
    assert len(set(comps.values())) < len(docs)


def test_hot_keys_are_cut_again_without_loss(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    values = {centre} | {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    fps = spark.createDataFrame(signed, "fp long")
    want = {(min(a, b), max(a, b)) for (a,) in signed for (b,) in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    for hot in (1 << 30, 8):
        got = {tuple(r) for r in simhash.near_pairs(fps, Scratch(spark, "test"), hot_key=hot).collect()}
        assert got == want


def test_fingerprint_rules_and_odd_rows(spark):
    for text in [None, "", " \n", "One", "one two", "A b c D\x0be É", "x " * 9, "a b c d " * 50]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    df = spark.createDataFrame([(5, None, 1), (3, "", 2), (3, "", 2), (9, "one two three four", 3), (8, "ONE two three four", 4)],
                               "doc_id long, text string, fp long")
    out = sorted((r.doc_id, r.component_id) for r in simhash.simhash_components(df).collect())
    assert out == [(3, 3), (3, 3), (5, 3), (8, 8), (9, 8)]
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    a, b, c = "one two three four five six", "alpha beta gamma delta epsilon", "x y z"
    rows = [(2, a), (5, b), (5, a), (7, c), (7, c), (None, c), (None, "only here"), (None, None), (9, ""), (None, "only here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS th", "3 AS row", "4 AS _id", "5 AS component")
    got = simhash.one_of_each_group(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(2, a), (5, b), (7, c), (None, "only here"), (9, "")], key=str)
    assert simhash.one_of_each_group(df.limit(0)).count() == 0
