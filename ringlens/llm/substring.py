"""Substring dedup by De Bruijn compaction of token k-mers.

Edges are the windows of ``k`` = 50 words, nodes the 49 words two windows share. A text is
cut into paths of consecutive edges that hang on one anchor (the leftmost smallest 16-word
hash inside the window, which depends on the window's words alone). Paths that
stand in two documents are the repeated part of the graph:

1. anchors that stand in one document only are dropped; nothing repeated hangs on them;
2. a path followed by one path everywhere, which in turn has one predecessor everywhere, is
   nonbranching: pointer-doubling joins compact such chains into unitigs;
3. every occurrence of a unitig outside its first document is a repeated span;
4. where an anchor has several paths (the ends of shared passages, edits), their windows are
   compared one by one: the coordinates of each path's first document fetch the words,
   and the smallest document of each window decides.

Equal words are told by two independent 64-bit hashes together. All joins are on hashes
or documents, aggregates are combined before the shuffle, and skewed joins are split; one
document is the largest thing a task holds.

Defined cases: a null text has no words; fewer than 50 words have no window; rows with one
doc_id never remove each other's words, and repeated rows get the same result; a row
without doc_id keeps its words and is no source; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlens.llm.common import Scratch, prepare

WINDOW, ANCHOR = 50, 16
HOT_SHARE = 1_000
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_CHUNK = 1 << 16
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 12) * 2
        have = tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        if size <= 1 << 20:
            _powers[base] = have
    return have


class Runs:
    """Hashes of any run of words of a text, from prefix sums of a polynomial modulo 2^64."""

    def __init__(self, hashes: np.ndarray, base: int):
        self.up, down = _power_tables(base, len(hashes) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * down[:len(hashes)], dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(np.uint64))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes: splits at the six ASCII white spaces only


def _runs(words: list[bytes]) -> tuple[Runs, Runs]:
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w) for w in words], dtype=np.uint64)
    return Runs(h, _BASES[0]), Runs(_mix(h ^ np.uint64(0x5851F42D4C957F2D)), _BASES[1])


def paths(words: list[bytes], k: int = WINDOW, anchor: int = ANCHOR):
    """(anchor hash, path hash, second path hash, first window, last window) of the paths of a text, or None."""
    n = len(words)
    if n < k:
        return None
    one, two = _runs(words)
    at = np.arange(n - anchor + 1)
    grams = one.of(at, at + anchor)
    span, windows = k - anchor + 1, n - k + 1
    place = np.empty(windows, np.int64)
    for lo in range(0, windows, _CHUNK):
        hi = min(windows, lo + _CHUNK)
        view = np.lib.stride_tricks.sliding_window_view(grams[lo:hi + span - 1], span)
        place[lo:hi] = np.arange(lo, hi) + view.argmin(axis=1)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.append(first[1:], windows) - 1
    return grams[place[first]], one.of(first, last + k), two.of(first, last + k), first, last


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def repeated_ranges(docs: DataFrame, scratch: Scratch, k: int = WINDOW) -> DataFrame:
    """(doc_id, th, ranges): window ranges (lo, hi) of a text whose words also start a window of a smaller doc_id.

    ``docs`` has doc_id, th (xxhash64 of the text) and text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, p) for i, t in enumerate(batch.column(2).to_pylist()) if (p := paths(words_of(t), k)) is not None]
            if found:
                rows = pa.array(np.repeat([i for i, _ in found], [len(p[0]) for _, p in found]))
                a, c, v, lo, hi = (np.concatenate(x) for x in zip(*(p for _, p in found)))
                yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), _long(a), _long(c), _long(v),
                                       pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
                                      ["doc_id", "th", "anchor", "c", "v", "lo", "hi"])

    occ = scratch.table(docs.where("doc_id is not null").select("doc_id", "th", "text").mapInArrow(
        cut, f"doc_id {kind}, th long, anchor long, c long, v long, lo int, hi int"))
    # anchors with over 1/HOT_SHARE of the rows are fewer than HOT_SHARE: broadcast, their rows are never brought together
    sizes = scratch.table(occ.groupBy("anchor").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
                          .select("anchor", "n", F.expr("a < b").alias("shared")))
    hot = F.col("n") * HOT_SHARE > (sizes.agg(F.sum("n")).first()[0] or 0)
    hot_anchors = F.broadcast(scratch.table(sizes.where(hot).select("anchor", "shared")))
    cold_shared = sizes.where(~hot & F.col("shared")).select("anchor")
    cand = scratch.table(occ.join(hot_anchors.where("shared"), "anchor", "left_semi")
                         .unionByName(occ.join(hot_anchors, "anchor", "left_anti").join(cold_shared, "anchor", "left_semi")).distinct())
    scratch.drop(occ)

    # each path with its neighbours in the text; a path is one node of the compaction
    after = cand.select("doc_id", "th", F.col("lo").alias("at"), F.struct("c", "v").alias("next"))
    before = cand.select("doc_id", "th", F.col("hi").alias("to"), F.struct("c", "v").alias("prev"), (F.col("hi") - F.col("lo") + 1).alias("step"))
    around = (cand.withColumn("at", F.col("hi") + 1).join(after, ["doc_id", "th", "at"], "left")
              .withColumn("to", F.col("lo") - 1).join(before, ["doc_id", "th", "to"], "left"))
    cls = scratch.table(around.groupBy("c", "v").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("final"), F.min("anchor").alias("anchor"),
        F.min(F.struct("doc_id", "th", "lo", "hi")).alias("src"),
        *[f(x).alias(f"{n}_{x}") for x in ("next", "prev") for n, f in (("lo", F.min), ("hi", F.max))],
        *[F.count_if(F.col(x).isNull()).alias(f"no_{x}") for x in ("next", "prev")], F.max("step").alias("step")))

    # compaction: a path points to its predecessor where nothing branches between them
    rep = cls.where("first < final").select(F.struct("c", "v").alias("k"), "first", "step", *[f"{n}_{x}" for x in ("next", "prev") for n in ("lo", "hi", "no")])
    one_next = rep.where("no_next = 0 AND lo_next = hi_next").select(F.col("k").alias("p"), F.col("lo_next").alias("k"))
    one_prev = rep.where("no_prev = 0 AND lo_prev = hi_prev").select("k", F.col("lo_prev").alias("p"), "step")
    linked = one_prev.join(one_next, ["k", "p"])
    tips = scratch.table(rep.select("k", "first").join(linked, "k", "left").select(
        "k", "first", F.coalesce("p", "k").alias("head"), F.coalesce("step", F.lit(0)).cast("long").alias("off")))
    open_before = None
    while True:
        jump = tips.select(F.col("k").alias("head"), F.col("head").alias("head2"), F.col("off").alias("off2"))
        nxt = scratch.table(tips.join(jump, "head").select("k", "first", F.col("head2").alias("head"), (F.col("off") + F.col("off2")).alias("off"),
                                                           (F.col("head") != F.col("head2")).alias("open")))
        left_open = nxt.where("open").count()
        scratch.drop(tips)
        tips = nxt.select("k", "first", "head", "off", "open")
        scratch.paths[id(tips)] = scratch.paths[id(nxt)]
        if left_open == 0:
            break
        if left_open == open_before:  # only rings are left: their paths stand for themselves
            tips = tips.select("k", "first", F.when(F.col("open"), F.col("k")).otherwise(F.col("head")).alias("head"),
                               F.when(F.col("open"), F.lit(0)).otherwise(F.col("off")).alias("off"), "open")
            break
        open_before = left_open
    unitigs = tips.select(F.col("k.c").alias("c"), F.col("k.v").alias("v"), "first", "head", "off")

    # repeated spans: a unitig's occurrences outside its first document, whole
    spans = (cand.join(unitigs, ["c", "v"]).where("doc_id > first")
             .groupBy("doc_id", "th", "head", (F.col("lo") - F.col("off")).alias("start"))
             .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("doc_id", "th", "lo", "hi"))

    # anchors with several paths: compare the windows of each path, read at its first document
    several = scratch.table(cls.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    asked = (cls.join(several, "anchor", "left_semi")
             .groupBy(F.col("src.doc_id").alias("doc_id"), F.col("src.th").alias("th"))
             .agg(F.collect_list(F.struct("c", "v", F.col("src.lo").alias("lo"), F.col("src.hi").alias("hi"))).alias("asked")))
    texts = docs.select("doc_id", "th", "text").join(asked, ["doc_id", "th"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            row = []
            for i, (t, coords) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                one, two = _runs(words_of(t))
                lo, hi = (np.array([x[n] for x in coords], np.int64) for n in ("lo", "hi"))
                times = hi - lo + 1
                at = np.repeat(np.arange(len(coords)), times)
                rel = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                s = lo[at] + rel
                row.append(np.full(len(at), i))
                for col, x in zip(cols, (one.of(s, s + k).view(np.int64), two.of(s, s + k).view(np.int64),
                                         np.array([x["c"] for x in coords], np.int64)[at], np.array([x["v"] for x in coords], np.int64)[at], rel)):
                    col.append(x)
            if row:
                yield pa.record_batch([batch.column(0).take(pa.array(np.concatenate(row))), *[pa.array(np.concatenate(c)) for c in cols[:4]],
                                       pa.array(np.concatenate(cols[4]).astype(np.int32))], ["doc_id", "w", "x", "c", "v", "rel"])

    wins = scratch.table(texts.select("doc_id", "text", "asked").mapInArrow(windows, f"doc_id {kind}, w long, x long, c long, v long, rel int"))
    owner = wins.groupBy("w", "x").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("most")).where("owner < most").select("w", "x", "owner")
    # a path's windows were read at its first document, and only there can they belong to another one
    owned = scratch.table(wins.join(owner, ["w", "x"]).where("owner < doc_id").groupBy("doc_id", "c", "v").agg(F.collect_set("rel").alias("rels")))
    single = (cand.join(owned, ["doc_id", "c", "v"])
              .select("doc_id", "th", F.explode("rels").alias("rel"), "lo").select("doc_id", "th", (F.col("lo") + F.col("rel")).alias("lo"), (F.col("lo") + F.col("rel")).alias("hi")))
    return scratch.table(spans.unionByName(single).groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")))


def _covered(n: int, ranges: list | None, k: int) -> np.ndarray:
    """Words covered by the windows of ``ranges``."""
    step = np.zeros(n + 1, np.int64)
    for r in ranges or ():
        step[r["lo"]] += 1
        step[r["hi"] + k] -= 1
    return np.cumsum(step[:-1]) > 0


def cut_text(text: str, gone: np.ndarray) -> str:
    """The text without the marked words and the white space after them."""
    raw = text.encode()
    out, at, keep = [], 0, True
    for w, g in zip(raw.split(), gone.tolist()):
        begin = raw.index(w, at)
        if keep:
            out.append(raw[at:begin])
        if not g:
            out.append(w)
        at, keep = begin + len(w), not g
    if keep:
        out.append(raw[at:])
    return b"".join(out).decode()


def _with_ranges(df: DataFrame, k: int, key: str, text: str, name: str) -> DataFrame:
    prepare(df.sparkSession)
    scratch = Scratch(df.sparkSession, name)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = df.select(F.col(key).alias("doc_id"), F.xxhash64(body).alias("th"), body.alias("text"))
    return repeated_ranges(docs, scratch, k)


def dedup_substrings(df: DataFrame, k: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row."""
    ranges = _with_ranges(df, k, key, text, "substring")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = df.select(F.col(key).alias("doc_id"), F.xxhash64(body).alias("th"), body.alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = words_of(t)
                if r:
                    gone = _covered(len(words), r, k)
                    rows.append((len(words), int(gone.sum()), hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist()) if not g])).hexdigest()))
                else:
                    rows.append((len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()))
            n, m, s = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(s, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return docs.join(ranges, ["doc_id", "th"], "left").select("doc_id", "text", "ranges").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(df: DataFrame, k: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` with their columns; repeated words are cut out of ``text``, other texts stay as they are."""
    ranges = _with_ranges(df, k, key, text, "substring")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))

    @F.pandas_udf("string")
    def cut(texts, found):
        return texts.combine(found, lambda t, r: t if t is None or r is None or len(r) == 0 else cut_text(t, _covered(len(words_of(t)), list(r), k)))

    # the columns of ``df`` travel inside one struct, so that none can clash with those of the ranges
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(key).alias("id"), F.xxhash64(body).alias("hash"), F.col(text).alias("said"))
    joined = rows.join(ranges, (F.col("id") == F.col("doc_id")) & (F.col("hash") == F.col("th")), "left")
    left = F.when(F.col("ranges").isNull(), F.col("said")).otherwise(cut(F.col("said"), F.col("ranges")))
    return joined.select("row", left.alias("left")).select(*[F.col("left").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in df.columns])
