"""BPE against the tokenizers library: whole table, every code point, long words, special tokens."""

import hashlib
import random
import struct

import pytest
from tokenizers import Tokenizer

from conftest import SF_SMALL
from ringlens.llm import bpe, catalog


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


def _same(model, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    mine = model.encode(text)
    assert list(struct.unpack(f"<{len(mine) // 4}I", mine)) == ids, text[:80]
    assert model.decode(mine) == library.decode(ids, skip_special_tokens=False)


def test_every_code_point_in_context(library):
    model = bpe.load(bpe.default_vocabulary())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    bad = []
    for at in range(0, len(points), 64):
        text = "".join(f"a{chr(c)}1 {chr(c)}{chr(c)}b  {chr(c)}!" for c in points[at:at + 64])
        ids = library.encode(text, add_special_tokens=False).ids
        if struct.pack(f"<{len(ids)}I", *ids) != model.encode(text):
            bad += [hex(c) for c in points[at:at + 64]
                    if struct.pack(f"<{len(i := library.encode(t := f'a{chr(c)}1 {chr(c)}{chr(c)}b  {chr(c)}!', add_special_tokens=False).ids)}I", *i) != model.encode(t)]
    assert not bad, (len(bad), bad[:20])


def test_random_long_and_special_texts(library):
    model, rng = bpe.load(bpe.default_vocabulary()), random.Random(5)
    for text in ["", " ", "\n\n \t x", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext", "it's we'll 'S", "x" * 5000, "ab" * 3000 + " " * 700 + "é" * 900]:
        _same(model, library, text)
    for _ in range(300):
        _same(model, library, "".join(rng.choice("ab e\tthein'sé漢😀1! ​") for _ in range(rng.randrange(700))))


def test_short_and_long_merges_agree():
    model, rng = bpe.load(bpe.default_vocabulary()), random.Random(6)
    for _ in range(200):
        parts = [model.first[rng.choice(b"theinaer ")] for _ in range(rng.randrange(1, 300))]
        assert model.merge_short(list(parts)) == model.merge_long(list(parts))


def test_query_equals_library(spark, library):
    rows = {r.doc_id: r for r in catalog.op6_bpe(spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        plain = library.decode(ids, skip_special_tokens=False)
        r = rows[doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(plain.encode()).hexdigest())


def test_nulls_repeats_empty_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", "y"), (None, "hi", "z")], "doc_id long, text string, ids string")
    out = sorted(map(tuple, bpe.encode_documents(df).select("doc_id", "n_tokens").collect()), key=str)
    assert out == sorted([(1, 0), (1, 0), (2, 0), (None, 1)], key=str)
    assert bpe.encode_documents(df.limit(0)).count() == 0
    assert bpe.encode_documents(df.where("doc_id is null"), outputs="ids").first().decoded == "hi"


def test_words_merged_together_agree_with_single_words():
    model, rng = bpe.RankArrayBPE(bpe.default_vocabulary()), random.Random(7)
    words = ["".join(rng.choice("theinaer sé漢😀") for _ in range(rng.randrange(1, 60))) for _ in range(2000)] + ["x", "the" * 85, "the" * 86, "ab" * 400]
    assert model._merged(words) == [struct.pack(f"<{len(i)}I", *i) for w in words for i in [model.merge_long([model.first[b] for b in w.encode()])]]
    assert model._merged([]) == []


def test_cache_generations_and_groups_change_nothing(monkeypatch):
    model, fresh = bpe.RankArrayBPE(bpe.default_vocabulary()), bpe.load(bpe.default_vocabulary())
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 300)
    rng = random.Random(8)
    texts = ["", "<|endoftext|>"] + [" ".join(str(rng.randrange(60)) + rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(200)]
    assert list(model.encode_in_groups(texts)) == [fresh.encode(t) for t in texts]
    assert list(model.encode_in_groups([])) == []
