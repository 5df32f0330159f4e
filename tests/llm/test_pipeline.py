"""The pipeline's stages, each on its own input, against brute force or the operator's contract."""

import hashlib
import struct

from conftest import SF_MID, SF_SMALL
from tokenizers import Tokenizer

import corpus_pipeline
from ringlens.llm import bpe
from ringlens.llm.common import Scratch


def test_stages_on_small_tables(spark):
    from test_simhash import components, plain_fingerprint
    from test_substring import brute
    library = Tokenizer.from_file(bpe.default_vocabulary())
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = scratch.table(stage(spark, docs, SF_SMALL))
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(after), name
        if name != "bpe":
            assert docs.columns == columns
        if name == "toxicity":
            gone = [labels[d] for d in before if d not in after and d in labels]
            assert sum(r.toxic for r in gone) >= 0.7 * len(gone)
        elif name == "simhash_near_dedup":
            comps = components({d: plain_fingerprint(r.text) for d, r in before.items()})
            assert set(after) == set(comps.values()) and len(after) < len(before)
            assert all(after[d] == before[d] for d in after)
        elif name == "substring_dedup":
            want = {d: s for d, _, _, s in brute([(d, r.text) for d, r in before.items()])}
            assert {d: hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() for d, r in after.items()} == want
        elif name == "mixing":
            assert all(after[d] == before[d] for d in after)
            clean = [d for d in before if d in labels and labels[d].quality == 1 and labels[d].toxic == 0]
            assert sum(d in after for d in clean) > 0.95 * len(clean)
        else:
            for d, r in before.items():
                ids = library.encode(r.text or "", add_special_tokens=False).ids
                assert (after[d].n_tokens, after[d].ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF_MID)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    n = out.count()
    assert 0 < n < spark.read.parquet(f"{SF_MID}/documents.parquet").count() and out.select("doc_id").distinct().count() == n
