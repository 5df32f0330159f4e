"""Toxicity: held-out accuracy, the model against its written formula, odd rows."""

import math
import zlib
from collections import Counter

from conftest import SF_MID
from ringlens.llm import catalog, toxicity
from ringlens.llm.common import Scratch


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    rows = catalog.op5_toxicity(spark, SF_MID).collect()
    assert len(rows) == spark.read.parquet(f"{SF_MID}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    toxic, clean = [p for p, y in held if y], [p for p, y in held if not y]
    assert sum(clean) / len(clean) < 0.05 and sum(toxic) / len(toxic) > 0.6


def test_probabilities_sum_to_one_and_ratio_is_their_quotient():
    counts = [{"abc": 3, "abd": 1, "bcd": 2, "xyz": 1}, {"abc": 1, "bce": 2}]
    model = toxicity.LogRatio(counts, order=3)
    # after a context that neither class knows both models are the shared one
    assert model.context.get("qq", 0.0) == 0.0
    # a gram seen only with the toxic class speaks for it, one seen only with the other against
    assert model.gram["bce"] > 0 > model.gram["xyz"]
    assert math.isclose(model.word("q"), sum(model.gram.get(g, model.context.get(g[:-1], 0.0)) for g in toxicity.grams_of("q", 3)))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, ("good plain words here " * 5) + ("vile scum " if i % 4 == 0 else ""), "a", 0.5) for i in range(400)]
                                 + [(900, None, "b", 0.0), (901, "", "c", 0.0), (902, "!!! ...", "d", 0.0), (903, "plain words " * 40_000 + "vile scum", "e", 0.0),
                                    (904, "w" * 300_000, "f", 0.0), (903, "vile scum", "e", 0.0), (None, "plain", "g", 0.0)],
                                 "doc_id long, text string, score string, _toxicity double")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(3, 1, None), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    out = toxicity.score_documents(docs, labels).collect()
    assert len(out) == 407 and all(0 <= r.score <= 1 for r in out)
    flagged = {r.doc_id for r in out if r.predicted}
    assert {i for i in range(0, 400, 4)} | {903} == flagged
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 407 - 102
    # labels of one class or none: nothing is rejected; empty tables
    assert toxicity.reject_toxic(docs, labels.where("toxic = 0")).count() == 407
    assert toxicity.score_documents(docs, labels.limit(0)).where("score <> 0").count() == 0
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_spark_ratios_equal_the_plain_model(spark, monkeypatch):
    """Class counts over the labelled texts of each model, shared counts over all texts, against the in-memory statement."""
    monkeypatch.setattr(toxicity, "HELD_WORDS", 3)
    texts = [("vile scum talk", 1, 0), ("good talk here", 0, 0), ("vile vile thing", 1, 1), ("a thing of scum and good", 0, 2),
             ("unlabelled goodness, scummy \U00010400x", None, None), (None, 0, 1), ("", None, None), ("vilest", 1, 2)]
    classes = ", ".join(f"c{j} long" for j in range(6))
    found = {}
    for cls, g, n in [(r.cls, r.gram, r.n) for r in spark.createDataFrame(texts, "text string, toxic int, part int").mapInArrow(
            toxicity._count_grams, "cls int, gram string, n long").collect()]:
        found.setdefault(g, [0] * 6)
        if cls >= 0:
            found[g][cls] += n
    every, by_class = set(), {}
    for t, toxic, part in texts:
        grams = [g for w in toxicity.words_of(t) for g in toxicity.grams_of(w)]
        every.update(grams)
        if toxic is not None:
            by_class.setdefault((part, toxic), Counter()).update(grams)
    assert set(found) == every and all(found[g][2 * p + k] == n for (p, k), own in by_class.items() for g, n in own.items())
    assert sum(map(sum, found.values())) == sum(sum(c.values()) for c in by_class.values())
    grams, contexts = toxicity.ratio_tables(spark.createDataFrame([(g, *c) for g, c in found.items()], f"gram string, {classes}"), Scratch(spark, "t"))
    rows, ctx = {r.gram: r for r in grams.collect()}, {r.context: r for r in contexts.collect()}
    for i in range(4):
        counts = [sum((c for (p, k), c in by_class.items() if k == kind and p != i - 1), Counter()) for kind in (0, 1)]
        plain = toxicity.LogRatio(counts, corpus=every)
        assert {g for g, r in rows.items() if r[f"r{i}"] is not None} == set(plain.gram)
        assert all(math.isclose(rows[g][f"r{i}"], x, abs_tol=1e-12) for g, x in plain.gram.items())
        assert all(math.isclose(r[f"x{i}"], plain.context.get(h, 0.0), abs_tol=1e-12) for h, r in ctx.items())


def test_shared_counts_come_from_unlabelled_documents_too(spark):
    """A text that no label covers changes how rare the n-grams around it are."""
    labelled = [(i, "plain words here" + (" vile scum" if i % 3 == 0 else "")) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    few = toxicity.fit(spark.createDataFrame(labelled, "doc_id long, text string"), labels)
    more = toxicity.fit(spark.createDataFrame(labelled + [(1000 + i, f"evil devil {w} scums") for i, w in enumerate(["revile", "civile", "servile"])], "doc_id long, text string"), labels)
    assert few.model.value.gram.keys() == more.model.value.gram.keys() and few.model.value.gram != more.model.value.gram


def test_joined_scores_equal_broadcast_scores(spark):
    """Beyond the broadcast bound the same scores come from joins; all rows stay, with clashing names."""
    docs = spark.createDataFrame([(i, ("good plain words here " * (1 + i % 3)) + ("vile scum " if i % 4 == 0 else ""), "x", 1) for i in range(200)]
                                 + [(7, None, "a", 1), (None, "", "b", 2), (901, "!!!", "c", 3), (0, "vile scum", "d", 4), (902, "w" * 3000 + " scum", "e", 5)],
                                 "doc_id long, text string, row string, _toxicity int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    def scores(**kw):
        return sorted(((r.doc_id is None, r.doc_id or 0, r.score, r.predicted) for r in toxicity.score_documents(docs, labels, **kw).collect()))
    near, far = scores(), scores(model_grams=0)
    assert len(near) == len(far) == 205
    assert all(a[:2] == b[:2] and math.isclose(a[2], b[2], abs_tol=1e-9) and a[3] == b[3] for a, b in zip(near, far))
    kept = toxicity.reject_toxic(docs, labels, model_grams=0)
    assert kept.columns == docs.columns and kept.count() == toxicity.reject_toxic(docs, labels).count()
