"""Order MinHash: pairing with the next document, edited texts, kernel against a plain version."""

import hashlib

import numpy as np

from conftest import SF_MID
from ringlens.llm import catalog, omh


def plain_fingerprint(text, k=omh.K, sketches=omh.SKETCHES, tuple_len=omh.TUPLE_LEN):
    """The same selection written as loops: sort all numbered k-mers by each order's rank."""
    items = [int(x) for x in omh._numbered_kmers(text, k)]
    out = []
    for s in range(sketches):
        rank = [(((x >> 32) ^ int(omh._XOR[s])) * int(omh._MUL[s]) & 0xFFFFFFFF, i) for i, x in enumerate(items)]
        picked = sorted(i for _, i in sorted(rank)[:tuple_len])
        h = np.zeros(1, np.uint64)
        for j, i in enumerate(picked):
            h = omh._mix(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(items[i]) + np.uint64(j + 1))
        out.append(int(h[0] >> np.uint64(32)))
    return out


def test_kernel_equals_plain_selection():
    for text in ["a", "abcdefgh", "abc " * 30, "the end of the end of the tale " * 9, "é漢😀" * 7, "x" * 40, "".join(chr(97 + i * i % 23) for i in range(900))]:
        assert omh.fingerprint(text).tolist() == plain_fingerprint(text)
    numbered = omh._numbered_kmers("abab" * 5, 2)
    assert len(set(numbered.tolist())) == len(numbered)  # repeats are told apart


def test_order_matters_and_edits_cost():
    a, b = "".join(chr(97 + (i * 7919) % 26) for i in range(600)), "".join(chr(97 + (i * i * 31) % 26) for i in range(600))
    swapped = omh.likeness(omh.fingerprint(a + b), omh.fingerprint(b + a))
    small = omh.likeness(omh.fingerprint(a + b), omh.fingerprint(a + "Q" + b))
    assert small > 0.8 and swapped < small - 0.2
    assert omh.likeness(omh.fingerprint(""), omh.fingerprint(None)) == 1.0
    assert omh.likeness(omh.fingerprint(""), omh.fingerprint(a)) == 0.0


def _check(rows, docs):
    docs = sorted(docs, key=lambda r: r[0])
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    for i, (d, t) in enumerate(docs):
        t, nxt = t or "", docs[(i + 1) % len(docs)][1] or ""
        q = len(t) // 4
        new = t[:len(t) - q] + nxt[:q]
        r = got[d]
        fp, fp1, fp2 = omh.fingerprint(t), omh.fingerprint(new), omh.fingerprint(nxt)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (omh._hex(fp), omh._hex(fp1))
        assert (r.near_edited, r.near_next) == (omh.likeness(fp, fp1), omh.likeness(fp, fp2))


def test_query_over_the_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text").collect()]
    _check(catalog.op1_order_minhash(spark, SF_MID).collect(), docs)


def test_odd_tables(spark):
    schema = "doc_id long, text string, range int, low long"
    make = lambda rows: spark.createDataFrame([(*r, 1, 2) for r in rows], schema)
    for rows in ([(4, None)], [(4, "abcdefghij" * 3), (9, "")], [(i * 10, "text %d " % i * (i % 5)) for i in range(200)]):
        _check(omh.fingerprints(make(rows)).collect(), rows)
    assert omh.fingerprints(make([(1, "a")]).limit(0)).count() == 0
    # repeated ids and rows: every row is kept and has a next one
    repeated = [(1, "same text here")] * 40 + [(2, "other")] * 3 + [(None, "null id"), (None, None)]
    out = omh.fingerprints(make(repeated)).collect()
    assert len(out) == len(repeated)
    same = [r for r in out if r.doc_id == 1]
    assert len({r.fingerprint for r in same}) == 1 and sum(r.near_next == 1.0 for r in same) == 39


def test_occurrence_numbers_equal_a_plain_count():
    text = "the end of the end of the tale, abab abab " * 5 + "x" * 30
    for k in (1, 2, 9):
        items, seen, same = omh._numbered_kmers(text, k), {}, {}
        for i in range(len(text) - k + 1):
            kmer = text[i:i + k]
            seen[kmer] = seen.get(kmer, 0) + 1
            same.setdefault((kmer, seen[kmer]), items[i])
            assert same[kmer, seen[kmer]] == items[i]
        assert len(set(items.tolist())) == len(items)
        # the number of a k-mer does not depend on the text behind it
        assert (omh._numbered_kmers(text[:100], k) == items[:100 - k + 1]).all()


def test_shared_sketches_equal_separate_ones():
    import random
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é😀") for _ in range(n)) for n in (0, 1, 7, 8, 9, 11, 12, 13, 14, 15, 16, 40, 41, 400, 3000, 12_001)]
    texts += ["x" * 5000, "".join(chr(97 + rng.randrange(26)) for _ in range(9000))]
    for k, sketches, size in ((9, 64, 2), (3, 7, 3), (1, 64, 1)):
        for a in texts:
            one = omh.Sketched(a, k, sketches, size)
            assert (one.fp == omh.fingerprint(a, k, sketches, size)).all()
            for b in texts:
                new, fp = one.edited(b)
                assert new == omh.edited(a, b) and (fp == omh.fingerprint(new, k, sketches, size)).all(), (k, len(a), len(b))
