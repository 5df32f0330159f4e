"""Prefix trie of conversations by fixed-length block hashing.

A conversation is cut into blocks of ``BLOCK`` turns. Conversations are grouped by their
successive block digests first: every block carries the digest of all blocks before it and
of all blocks up to it, so one grouping by both gives the distinct blocks below each
block boundary with their numbers of conversations, and copies are one row from there on.
Turn boundaries are refined only inside blocks where siblings diverge: the distinct blocks
(not the conversations) below one boundary are spelled out turn by turn and grouped again.
A block without siblings is spelled out without grouping.

Node identity is a 128-bit digest of the turns up to the node: the digest at the block
boundary before it, combined with that of the block's first turns. Subtree sums are taken
inside the blocks first (a node passes its own value to its at most ``BLOCK`` ancestors in the
block) and then between block boundaries by pointer doubling, so a trie of depth D needs
log2(D / BLOCK) rounds over boundary nodes only.

Turns of one conversation are never gathered in one task: they are numbered by a range
cut of all rows by (conversation, turn), whose pieces are counted and shifted. The ids
that end in one node are digested in order, piece by piece, as a stream.

Defined cases: turns are ordered by (turn, role, text), nulls first; a null role or text is
empty; repeated rows are turns of their own. Rows without ``conv_id`` belong to no
conversation and are left out. Conversations without turns (given by ``shared_openings``
or an id table) are members of the root. An empty table has no nodes. Other columns are
not read. Ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringlens.llm.common import Scratch, prepare

#: Turns of a block.
BLOCK = 8
#: Blocks of one conversation whose digests are combined in one window; beyond, windows are shifted by their totals.
CHUNK = 4096
#: Characters of one piece of a node's id list.
PIECE = 1 << 16

NODE = ["a", "b"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turn_digests(df: DataFrame, scratch: Scratch, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """Turns as (conv_id, pos from 1, n, t1, t2, size): number of turns, 128-bit digest of role and text, UTF-8 bytes of the text."""
    src = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = src.repartitionByRange(parts, "conv_id", "turn", "role", F.substring("text", 1, 64)) \
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = scratch.table(cut.select("conv_id", F.monotonically_increasing_id().alias("at"), F.xxhash64("role", "text").alias("t1"),
                                    F.xxhash64(F.lit(1), "role", "text").alias("t2"), F.octet_length("text").cast("long").alias("size")))
    # row numbers of a sorted piece follow each other; the piece's number stands above them
    rows = rows.withColumn("piece", F.shiftright("at", 33))
    pieces = rows.groupBy("conv_id", "piece").agg(F.min("at").alias("first"), F.count("*").alias("here"))
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("conv_id", "piece", "first", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("shift"),
                           F.sum("here").over(Window.partitionBy("conv_id")).alias("n"))
    return scratch.table(rows.join(pieces, ["conv_id", "piece"]).select(
        "conv_id", (F.col("at") - F.col("first") + F.col("shift") + 1).alias("pos"), "n", "t1", "t2", "size"))


def shared_openings(turns: DataFrame, most: int = 9, family: int = 5) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations (turns, ids): conversation c opens with the first h turns of conversation c - c % family.

    h is crc32 of the decimal id, modulo ``most``; the conversation's own turns after its first
    h follow. ``turns`` as from ``turn_digests``; ids holds every conversation, with or without turns.
    """
    convs = turns.where("pos = 1").select("conv_id", "n").withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most) \
        .withColumn("opens", F.col("conv_id") - F.col("conv_id") % family)
    first = turns.where((F.col("pos") < most) & (F.col("conv_id") % family == 0))
    first = first.select(F.col("conv_id").alias("opens"), F.col("n").alias("there"), "pos", "t1", "t2", "size")
    opening = convs.join(first, "opens").where("pos <= h").select("conv_id", "pos", "t1", "t2", "size")
    sizes = first.where("pos = 1").select("opens", "there")
    kept = convs.join(sizes, "opens", "left").select("conv_id", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("kept"))
    own = turns.join(kept, "conv_id").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("kept")).alias("pos"), "t1", "t2", "size")
    return opening.unionByName(own), convs.select("conv_id")


def _lanes(number: Column, block: Column) -> list[Column]:
    """Two 64-bit digests of (number of the block, its first turns)."""
    return [F.xxhash64(F.lit(seed), number, block) for seed in (1, 2)]


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """One row for each block of each conversation: (conv_id, k, turns, pa, pb, a, b), the digests before and after the block."""
    packed = turns.groupBy("conv_id", F.expr(f"(pos - 1) div {block}").alias("k")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "t1", "t2", "size"))).alias("turns"))  # at most `block` turns
    packed = packed.withColumn("turns", F.transform("turns", lambda t: F.struct(t["t1"].alias("t1"), t["t2"].alias("t2"), t["size"].alias("size"))))
    one, two = _lanes(F.col("k"), F.col("turns"))
    packed = packed.withColumn("d1", one).withColumn("d2", two).withColumn("chunk", F.expr(f"k div {CHUNK}"))
    upto = Window.partitionBy("conv_id", "chunk").orderBy("k")
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = packed.where(f"k % {CHUNK} = {CHUNK - 1}").select("conv_id").distinct()  # conversations of more than one chunk, if any
    shift = packed.join(chunks, "conv_id", "left_semi").groupBy("conv_id", "chunk").agg(F.bit_xor("d1").alias("s1"), F.bit_xor("d2").alias("s2")) \
        .select("conv_id", "chunk", F.bit_xor("s1").over(earlier).alias("s1"), F.bit_xor("s2").over(earlier).alias("s2"))
    chained = packed.withColumn("a", F.bit_xor("d1").over(upto)).withColumn("b", F.bit_xor("d2").over(upto)) \
        .join(shift, ["conv_id", "chunk"], "left")
    after = [F.col(c).bitwiseXOR(F.coalesce(F.col(s), F.lit(0))) for c, s in (("a", "s1"), ("b", "s2"))]
    return chained.select("conv_id", "k", "turns", after[0].bitwiseXOR(F.col("d1")).alias("pa"), after[1].bitwiseXOR(F.col("d2")).alias("pb"),
                          after[0].alias("a"), after[1].alias("b"))


def _spelled(blocks: DataFrame, block: int) -> DataFrame:
    """The turns of distinct blocks as nodes: (depth, a, b, pa, pb, size, n_convs, conv_id, path); path = the block's nodes down to it."""
    number = F.col("k")

    def node(length: Column) -> Column:
        head = F.slice("turns", 1, length)
        one, two = _lanes(number, head)
        return F.struct(one.bitwiseXOR(F.col("pa")).alias("a"), two.bitwiseXOR(F.col("pb")).alias("b"))

    nodes = F.transform(F.sequence(F.lit(1), F.size("turns")), node)
    spelled = blocks.withColumn("nodes", nodes).withColumn("j", F.explode(F.sequence(F.lit(1), F.size("turns"))))
    here, above = F.col("nodes")[F.col("j") - 1], F.get("nodes", F.col("j") - 2)
    return spelled.select((number * block + F.col("j")).alias("depth"), here["a"].alias("a"), here["b"].alias("b"),
                          F.coalesce(above["a"], F.col("pa")).alias("ua"), F.coalesce(above["b"], F.col("pb")).alias("ub"),
                          F.col("turns")[F.col("j") - 1]["size"].alias("size"), "n_convs", "conv_id", F.slice("nodes", 1, F.col("j")).alias("path"), "pa", "pb")


def _grown(blocks: DataFrame, block: int, scratch: Scratch) -> DataFrame:
    """Nodes below the root, from the blocks of all conversations."""
    distinct = scratch.table(blocks.groupBy("k", "pa", "pb", "a", "b").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns")))
    siblings = distinct.groupBy("pa", "pb").agg(F.count("*").alias("siblings"))
    marked = distinct.join(siblings, ["pa", "pb"])
    straight = _spelled(marked.where("siblings = 1"), block)
    forked = _spelled(marked.where("siblings > 1"), block).groupBy("depth", "a", "b", "ua", "ub", "pa", "pb").agg(
        F.first("size").alias("size"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("path").alias("path"))
    return scratch.table(straight.unionByName(forked))


def _boundary_totals(values: DataFrame, block: int, scratch: Scratch) -> DataFrame:
    """(pa, pb, leaves, saved): sums over all nodes below each block boundary, by pointer doubling over the boundaries."""
    below = values.groupBy("pa", "pb").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    up = values.where(F.col("depth") % block == 0).select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.col("pa").alias("ua"), F.col("pb").alias("ub"))
    cur = scratch.table(below.join(up, (F.col("pa") == F.col("ca")) & (F.col("pb") == F.col("cb")), "left").drop("ca", "cb"))
    while cur.where("ua IS NOT NULL").limit(1).count():
        # each boundary hands the sum it has to the boundary it points to, then points to where that one points
        moving, done = cur.where("ua IS NOT NULL"), cur.where("ua IS NULL")
        gained = moving.groupBy(F.col("ua").alias("pa"), F.col("ub").alias("pb")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        further = moving.select(F.col("pa").alias("ua"), F.col("pb").alias("ub"), F.col("ua").alias("na"), F.col("ub").alias("nb"))
        moved = moving.join(further, ["ua", "ub"], "left").select("pa", "pb", "leaves", "saved", F.col("na").alias("ua"), F.col("nb").alias("ub"))
        nxt = scratch.table(moved.unionByName(done).join(gained, ["pa", "pb"], "left").select(
            "pa", "pb", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), "ua", "ub"))
        scratch.drop(cur)
        cur = nxt
    return cur.drop("ua", "ub")


def _ends(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """(a, b, conv_id): the node at which each conversation ends; the root is (0, 0)."""
    last = blocks.groupBy("conv_id").agg(F.max(F.struct("k", "a", "b")).alias("z")).select("conv_id", "z.a", "z.b")
    return ids.join(last, "conv_id", "left").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"), "conv_id")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, b, conv_id) to pieces of comma-joined ids: (a, b, first, ids)."""
    key, waiting, size = None, [], 0

    def out():
        return pa.RecordBatch.from_pydict({"a": [key[0]], "b": [key[1]], "first": [waiting[0]], "ids": [",".join(map(str, waiting))]},
                                          pa.schema([("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))

    for batch in batches:
        for a, b, c in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if waiting and (key != (a, b) or size >= PIECE):
                yield out()
                waiting, size = [], 0
            key = (a, b)
            waiting.append(c)
            size += len(str(c)) + 1
    if waiting:
        yield out()


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, sorted by (a, b, first): only the digest's state is held."""
    key, sha = None, None

    def out():
        return pa.RecordBatch.from_pydict({"a": [key[0]], "b": [key[1]], "ends_sha256": [sha.hexdigest()]},
                                          pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())]))

    for batch in batches:
        for a, b, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
            if key == (a, b):
                sha.update(b",")
            else:
                if key:
                    yield out()
                key, sha = (a, b), hashlib.sha256()
            sha.update(ids.encode())
    if key:
        yield out()


def _end_digests(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, ends_sha256) for the nodes at which a conversation ends.

    The ids are cut by range and sorted, so a node's list spreads over tasks as pieces. A node
    of one piece is digested where it is; SHA-256 of a longer list is a stream over its pieces.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = ends.repartitionByRange(parts, "a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
    pieces = scratch.table(cut.mapInArrow(_pieces, "a long, b long, first long, ids string"))
    counted = pieces.groupBy("a", "b").agg(F.count("*").alias("m"))
    single = counted.where("m = 1").join(pieces, NODE).select("a", "b", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    several = pieces.join(counted.where("m > 1"), NODE, "left_semi").repartition(parts, "a", "b").sortWithinPartitions("a", "b", "first")
    return single.unionByName(several.mapInArrow(_streamed, "a long, b long, ends_sha256 string"))


def grow(turns: DataFrame, ids: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """The trie's nodes from numbered turn digests and the ids of all conversations."""
    prepare(turns.sparkSession)
    blocks = scratch.table(_blocks(turns, block))
    ids = scratch.table(ids)
    nodes = _grown(blocks, block, scratch)
    children = nodes.groupBy(F.col("ua").alias("a"), F.col("ub").alias("b")).agg(F.count("*").alias("n_children"))
    counted = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    valued = scratch.table(counted.withColumn("leaf", (F.col("n_children") == 0).cast("long"))
                           .withColumn("saved", (F.col("n_convs") - 1) * F.col("size")))
    totals = scratch.table(_boundary_totals(valued, block, scratch))
    # what lies below a boundary counts for the boundary's node, and so for its ancestors in its block
    under = totals.select(F.col("pa").alias("a"), F.col("pb").alias("b"), F.col("leaves").alias("low_leaves"), F.col("saved").alias("low_saved"))
    passed = valued.join(under, NODE, "left").select(
        F.explode("path").alias("to"), (F.col("leaf") + F.coalesce("low_leaves", F.lit(0))).alias("leaf"),
        (F.col("saved") + F.coalesce("low_saved", F.lit(0))).alias("saved"))
    sums = passed.groupBy(F.col("to.a").alias("a"), F.col("to.b").alias("b")).agg(
        F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in NODE], "conv_id", "n_convs")
    first = totals.where("pa = 0 AND pb = 0").select(F.col("pa").alias("a"), F.col("pb").alias("b"), F.col("leaves").alias("n_leaves"),
                                                     F.col("saved").alias("saved_tokens"))
    top = root.join(first, NODE, "left").join(children.where("a = 0 AND b = 0"), NODE, "left").select(
        "depth", "a", "b", F.lit(None).cast("long").alias("ua"), F.lit(None).cast("long").alias("ub"), "conv_id", "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"))
    every = top.unionByName(valued.join(sums, NODE).select(*top.columns))
    named = root.select("a", "b", "conv_id").unionByName(nodes.select("a", "b", "conv_id")).toDF("ua", "ub", "parent_conv_id")
    out = scratch.table(every.join(named, ["ua", "ub"], "left").join(_end_digests(_ends(blocks, ids), scratch), NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256")))
    scratch.drop_others(out)
    return out


def conversation_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                      block: int = BLOCK) -> DataFrame:
    """Prefix trie of the conversations as they stand; a node's turn is turn ``depth`` of conversation ``conv_id``."""
    scratch = Scratch(df.sparkSession, "trie")
    turns = turn_digests(df, scratch, conv, turn, role, text)
    return grow(turns, turns.where("pos = 1").select("conv_id"), scratch, block)


def rebuilt_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 block: int = BLOCK) -> DataFrame:
    """Prefix trie of the conversations rebuilt by ``shared_openings``."""
    scratch = Scratch(df.sparkSession, "trie")
    turns, ids = shared_openings(turn_digests(df, scratch, conv, turn, role, text))
    return grow(scratch.table(turns), ids, scratch, block)
