"""Benchmark decontamination over a distributed positional inverted index, in DataFrame expressions only.

``build_index`` stores the postings (document key, term, position) of all training
documents for the vocabulary of the test items; no other term can take part in a
match. Each task writes a segment: the postings of its documents, sorted by term, so
that nothing is shuffled to build the index and reading a few terms touches few row
groups.

A window is ``length`` consecutive words of an item; an item of fewer words, but not
none, is one window. ``phrase_matches`` starts from the rarest two terms of every
window (by their number of postings in the whole index): the first term's list, each
position less the term's offset in the item, gives diagonals (document, item, document
position - item position); the second term's offset-adjusted list is intersected with
them. On a diagonal that is left all words of the item are looked up in the index,
and runs of at least a window's length are exact phrase matches.
``proximity_matches`` does the same with a tolerance on the adjusted positions.

Words: A-Z lower-cased, then runs of digits, a-z and characters beyond ASCII.

Defined cases: a null text has no words. Repeated documents, and documents without id,
are rows of their own with their own result. Repeated item ids are one item with several
texts (a window never spans two). A null item id counts as one item, written as an empty
string in the digest. Items without words match nothing. Empty tables: no hits, or no rows.
Other columns are not read. Postings are keyed by two 64-bit hashes, of id and of text.

Broadcast sides (vocabulary, seeds, item words, documents with diagonals) are counted
first; beyond ``BROADCAST_ROWS`` Spark joins them by shuffle, with skewed keys split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringlens.llm.common import Scratch

#: Separators are all ASCII characters but digits and (lower-cased) letters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window.
LENGTH = 10
#: Most rows of a side that is broadcast.
BROADCAST_ROWS = 500_000

KEY = ["k1", "k2"]


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Documents as (k1, k2, doc_id, words): equal keys only for equal texts of one id, whose results are equal too."""
    return docs.select(F.xxhash64(F.col(doc_id)).alias("k1"), F.xxhash64(F.col(text)).alias("k2"),
                       F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("words"))


def _small(df: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


@dataclass
class Index:
    """Stored tables: ``postings`` (k1, k2, term, pos), ``item_words`` (item, item_id, n, q, term), ``frequency`` (term, cf)."""

    postings: DataFrame
    item_words: DataFrame
    frequency: DataFrame
    scratch: Scratch
    length: int


def build_index(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                item_text: str = "text", length: int = LENGTH) -> Index:
    """Positional index of ``docs`` for the terms of ``items``, written to the shared folder."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    said = scratch.table(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).cast("string").alias("item_id"),
                                      words(F.col(item_text)).alias("words")))
    spread = said.select("item", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("q", "word"))
    vocabulary = scratch.table(spread.select("word").distinct().withColumn("term", F.monotonically_increasing_id()))
    item_words = scratch.table(spread.join(vocabulary, "word").drop("word"))
    postings = (_keyed(docs, doc_id, text).select(*KEY, F.posexplode("words").alias("pos", "word"))
                .join(_small(vocabulary), "word").select(*KEY, "term", "pos").sortWithinPartitions("term"))
    postings = scratch.table(postings)
    frequency = scratch.table(postings.groupBy("term").agg(F.count("*").alias("cf")))
    return Index(postings, item_words, frequency, scratch, length)


def _windows(index: Index) -> DataFrame:
    """(item, s, w, t1, q1, t2, q2): each window whose terms all occur, with its two rarest terms (t2 null if it has one word)."""
    placed = index.item_words.withColumn("w", F.least("n", F.lit(index.length))).join(index.frequency, "term", "left")
    per_window = placed.withColumn("s", F.explode(F.sequence(F.greatest(F.col("q") - F.col("w") + 1, F.lit(0)),
                                                             F.least(F.col("q"), F.col("n") - F.col("w")))))
    rare = per_window.groupBy("item", "s", "w").agg(F.sort_array(F.collect_list(F.struct(
        F.coalesce("cf", F.lit(0)).alias("cf"), "q", "term"))).alias("r"))
    return rare.where(F.col("r")[0]["cf"] > 0).select(
        "item", "s", "w", F.col("r")[0]["term"].alias("t1"), F.col("r")[0]["q"].alias("q1"),
        F.get("r", F.lit(1))["term"].alias("t2"), F.get("r", F.lit(1))["q"].alias("q2"))


def _anchored(index: Index, seeds: DataFrame) -> DataFrame:
    """Diagonals of the rarest terms: the key, ``diag`` and the other columns of ``seeds``; a diagonal may begin before the document."""
    first = index.postings.withColumnRenamed("term", "t1").join(_small(seeds), "t1")
    return first.withColumn("diag", F.col("pos") - F.col("q1")).drop("pos", "t1", "q1").distinct()


def _looked_up(index: Index, diagonals: DataFrame, slop: int = 0) -> DataFrame:
    """``diagonals`` with each ``q`` whose term the index holds within ``slop`` of position diag + q.

    The expected postings are spelled out, an item's words for each diagonal, and joined on all of
    (document, term, position); only postings of documents with a diagonal are shuffled for that.
    """
    seen = index.scratch.table(diagonals)
    posted = index.postings.join(_small(index.scratch.table(seen.select(*KEY).distinct())), KEY, "left_semi")
    wanted = seen.join(_small(index.item_words.select("item", "q", "term")), "item")
    if "s" in diagonals.columns:
        wanted = wanted.where("q >= s AND q < s + w")
    if slop:
        wanted = wanted.withColumn("off", F.explode(F.array(*map(F.lit, range(-slop, slop + 1)))))
    wanted = wanted.withColumn("pos", F.col("diag") + F.col("q") + (F.col("off") if slop else 0))
    return wanted.join(posted, [*KEY, "term", "pos"]).select(*diagonals.columns, "q").distinct()


def phrase_matches(index: Index) -> DataFrame:
    """Maximal runs (k1, k2, item, item_id, start, n): document words start .. start + n - 1 are consecutive words of the item."""
    seeds = index.scratch.table(_windows(index).select("item", "t1", "q1", "t2", "q2").distinct())
    found = _anchored(index, seeds)
    one = found.where("t2 IS NULL").select(*KEY, "item", "diag")
    second = index.postings.join(_small(index.scratch.table(seeds.select(F.col("t2").alias("term")).distinct())), "term", "left_semi")
    two = (found.where("t2 IS NOT NULL").withColumn("pos", F.col("diag") + F.col("q2")).withColumnRenamed("t2", "term")
           .join(second, [*KEY, "term", "pos"]).select(*KEY, "item", "diag"))
    matched = _looked_up(index, one.unionByName(two).distinct())
    run = F.col("q") - F.row_number().over(Window.partitionBy(*KEY, "item", "diag").orderBy("q"))
    runs = matched.withColumn("run", run).groupBy(*KEY, "item", "diag", "run").agg(
        (F.col("diag") + F.min("q")).alias("start"), F.count("*").alias("n"))
    known = index.item_words.select("item", "item_id", F.least("n", F.lit(index.length)).alias("w")).distinct()
    return runs.join(known, "item").where("n >= w").select(*KEY, "item", "item_id", F.col("start").cast("int"), F.col("n").cast("int"))


def proximity_matches(index: Index, slop: int) -> DataFrame:
    """(k1, k2, item, item_id, s, anchor): windows whose words all stand within ``slop`` words of their place.

    ``anchor`` is where the window would start by its rarest term; every other word must
    occur at most ``slop`` words off its place from there. With ``slop`` 0 these are the
    exact occurrences.
    """
    windows = index.scratch.table(_windows(index).drop("t2", "q2"))
    hits = _looked_up(index, _anchored(index, windows), slop).groupBy(*KEY, "item", "s", "w", "diag").agg(F.count("*").alias("found"))
    named = index.item_words.select("item", "item_id").distinct()
    return hits.where("found = w").join(named, "item").select(*KEY, "item", "item_id", "s", (F.col("diag") + F.col("s")).alias("anchor"))


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    index = build_index(docs, items, doc_id, text, item_id, item_text, length)
    runs = index.scratch.table(phrase_matches(index))
    index.scratch.drop_others(runs)
    hit = runs.select(*KEY, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("pos")).distinct() \
        .groupBy(*KEY).agg(F.count("*").alias("n_hit"))
    which = runs.select(*KEY, F.coalesce("item_id", F.lit("")).alias("item_id")).distinct() \
        .groupBy(*KEY).agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    found = hit.join(which, KEY)
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return _keyed(docs, doc_id, text).withColumn("n_words", F.size("words").cast("long")).drop("words").join(found, KEY, "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))
