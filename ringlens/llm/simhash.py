"""SimHash near-dedup with pigeonhole blocks.

Fingerprints of 64 bits are cut into four blocks. Two fingerprints that differ
in at most two bits differ in at most two blocks, so they share two whole
blocks: each fingerprint is filed under its six pairs of blocks, fingerprints
filed together are joined, and the Hamming distance is verified. Equal
fingerprints are one row before the join, so copies never make pairs.

A pair of blocks that holds more than ``HOT_KEY`` fingerprints is cut again: the
bits that are still free are split into four blocks by the same rule. After
three cuts 8 bits are free, so such a group has at most 256 members.

Defined cases: a null text counts as an empty one; a text without words has
the fingerprint zero and links like any other; repeated rows are rows of their
own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlens.llm.common import Scratch, connected_components, prepare

SHINGLE, MAX_BITS, SEED = 3, 2, 42
HOT_KEY = 512
_CHUNK = 65_536


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if set in over half of the shingles' XXH64."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and the six ASCII white spaces count
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > n:
        starts, ends = starts[:len(words) - n + 1], ends[n - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + _CHUNK].tolist(), ends[at:at + _CHUNK].tolist())], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, hashed: bool = False) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long; with ``hashed`` also th, the text's XXH64."""
    prepare(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    more = [F.xxhash64(F.col(text).cast("string")).alias("th")] if hashed else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *(["th"] if hashed else [])])

    return df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), *more).mapInArrow(
        run, f"doc_id {kind}, fp long" + (", th long" if hashed else ""))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _cuts(free: list[int], max_bits: int) -> list[tuple[int, list[int]]]:
    """(mask of the agreed bits, bits left free) for each way two fingerprints can agree on blocks of ``free``."""
    blocks = [free[i::max_bits + 2] for i in range(max_bits + 2)]
    out = []
    for kept in combinations(range(max_bits + 2), 2):
        agreed = [b for i in kept for b in blocks[i]]
        out.append((sum(1 << b for b in agreed), [b for b in free if b not in agreed]))
    return out


def near_pairs(fps: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS, hot_key: int = HOT_KEY) -> DataFrame:
    """(a, b), a < b, of distinct fingerprints that differ in 1 to ``max_bits`` bits; ``fps`` has the distinct ``fp``."""
    found = None
    # the cuts of each level as a literal table: (cut of this level -> masks of the next)
    level = [(0, 0, list(range(64)))]
    rows = fps.select("fp", F.lit(0).alias("cut"))
    while True:
        nxt, filed = [], []
        for cut, mask, free in level:
            for more, left in _cuts(free, max_bits):
                nxt.append((len(nxt), mask | more, left))
                filed.append((cut, nxt[-1][0], mask | more))
        by_cut: dict[int, list] = {}
        for cut, new, mask in filed:
            by_cut.setdefault(cut, []).append((new, _signed(mask)))
        options = F.create_map(*[x for cut, masks in by_cut.items() for x in (
            F.lit(cut), F.array(*[F.struct(F.lit(new).alias("cut"), F.lit(m).alias("mask")) for new, m in masks]))])
        keyed = (rows.select("fp", F.explode(F.element_at(options, F.col("cut"))).alias("o"))
                 .select("fp", F.col("o.cut").alias("cut"), F.col("fp").bitwiseAND(F.col("o.mask")).alias("key")))
        last = len(nxt[0][2]) <= 8
        hot = None
        if not last:
            hot = scratch.table(keyed.groupBy("cut", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot_key).select("cut", "key"))
            if hot.isEmpty():
                hot = None
        cold = keyed if hot is None else keyed.join(hot, ["cut", "key"], "left_anti")
        a, b = cold.alias("a"), cold.alias("b")
        pairs = (a.join(b, (F.col("a.cut") == F.col("b.cut")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
                        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits))
                 .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")))
        found = pairs if found is None else found.unionByName(pairs)
        if hot is None:
            return found.distinct()
        rows = scratch.table(keyed.join(hot, ["cut", "key"], "left_semi").select("fp", "cut"))
        level = nxt


def _components_of(docs: DataFrame, scratch: Scratch, max_bits: int) -> DataFrame:
    """(fp, component, component_id) for the stored fingerprints ``docs (doc_id, fp)``."""
    groups = scratch.table(docs.groupBy("fp").agg(F.min("doc_id").alias("first")))
    comps = connected_components(near_pairs(groups, scratch, max_bits), scratch)
    # one row a fingerprint: its component, then the smallest document of the component
    named = groups.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return scratch.table(named.join(smallest, "component").select("fp", "component", "component_id"))


def simhash_components(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                       max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id reachable over links.

    A null id takes part like any other row and is never the smallest: its component_id is the
    smallest id of its group, or null where the group has no id.
    """
    scratch = Scratch(df.sparkSession, "simhash")
    docs = scratch.table(fingerprints(df, key, text, shingle))
    return docs.join(_components_of(docs, scratch, max_bits).drop("component"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``df``, one for each SimHash group: the smallest id (null last), then the smallest hash of its text.

    Groups are of rows, not of ids: of two texts under one id only the one that has a copy elsewhere
    goes. Rows that agree in id and text are one row in the result.
    """
    scratch = Scratch(df.sparkSession, "simhash")
    docs = scratch.table(fingerprints(df, key, text, shingle, hashed=True))
    placed = docs.join(_components_of(docs, scratch, max_bits).select("fp", "component"), "fp")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "th")
    first = placed.groupBy("component").agg(F.min(rank).alias("first"))
    counted = placed.groupBy("component", "doc_id", "th").agg(F.count("*").alias("rows")).join(first, "component")
    stays = F.col("first") == rank
    named = scratch.table(counted.where(~stays | (F.col("rows") > 1)).groupBy("doc_id", "th").agg(F.max(stays).alias("stays")))
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(key).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("hash"))
    met = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("th"))
    alone = whole.join(named, met, "left_anti").select("row.*")
    repeated = named.where("stays")
    if repeated.isEmpty():
        return alone
    return alone.unionByName(whole.join(repeated, met, "left_semi").dropDuplicates(["id", "hash"]).select("row.*"))
