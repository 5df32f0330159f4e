"""CSV files whose fields hold line breaks, read in as many tasks as there are splits.

A CSV reader for quoted line breaks takes a whole file in one task, because only what
stands before a line tells whether it begins a record. Here that is found by a scan of
quote parities:

1. Every split counts the quotes of its lines. The parities before it in its file, added
   up in split order, tell whether it begins inside a quoted field (one row a split).
2. Each task cuts its own split into records: a line begins a record if the quotes before
   it are even. Lines stay where they are; nothing is shuffled.
3. Only records that cross a split border are put together from their pieces: the end of
   one split, whole splits inside a field, the beginning of the next.

Lines end with ``\\n``; a ``\\r`` at the end of a record is taken off, one inside a field is
kept. Quotes are doubled inside fields, as RFC 4180 has it. A quote inside a field that is not quoted
changes the parity: such files need ``load_raw(whole_files=True)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringlens.sources.sinks import materialise

#: Most splits whose marks are broadcast; beyond, lines are dealt to their split's marks by a shuffle.
BROADCAST_SPLITS = 200_000

_RECORD = "file string, block long, part int, first boolean, record string"


def _lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def split_marks(lines: DataFrame, quote: str = '"') -> DataFrame:
    """(file, block, inside, open): whether the split begins, and whether the next one begins, inside a quoted field."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    odd = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    order = Window.partitionBy("file").orderBy("block")
    before = F.coalesce(F.sum("odd").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    return odd.withColumn("inside", before.cast("int")).withColumn("open", F.coalesce(F.lead("inside").over(order), F.lit(0))).drop("odd")


def _marked(lines: DataFrame, marks: DataFrame, splits: int) -> DataFrame:
    """Lines with their split's marks, the lines of a split together and in order."""
    if splits <= BROADCAST_SPLITS:
        return lines.join(F.broadcast(marks), ["file", "block"])  # the scan's order is kept
    numbered = lines.withColumn("at", F.monotonically_increasing_id()).join(marks, ["file", "block"])
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return numbered.repartition(parts, "file", "block").sortWithinPartitions("file", "block", "at").drop("at")


class _Split:
    """Records of one split, from its lines in order."""

    def __init__(self, file: str, block: int, inside: int, goes_on: int, quote: str):
        self.file, self.block, self.inside, self.goes_on, self.quote = file, block, inside, goes_on, quote
        self.waiting: list[str] = []
        self.begun = False  # whether the waiting lines begin a record, or go on with an earlier split's
        self.at_top = block == 0

    def _rows(self, records: pa.Array, part: int) -> pa.RecordBatch:
        first = np.zeros(len(records), bool)
        if self.at_top and len(records):
            first[0], self.at_top = True, False
        n = len(records)
        return pa.RecordBatch.from_arrays([pa.array([self.file] * n, pa.string()), pa.array(np.full(n, self.block)), pa.array(np.full(n, part, np.int32)),
                                           pa.array(first), records.cast(pa.string())], ["file", "block", "part", "first", "record"])

    def _out(self, last: bool) -> Iterator[pa.RecordBatch]:
        """The waiting lines: a whole record (part 2), the beginning (1) or the continuation (0) of one."""
        if self.waiting:
            part = (1 if last and self.goes_on else 2) if self.begun else 0
            yield self._rows(pa.array(["\n".join(self.waiting)], pa.string()), part)
        self.waiting = []

    def add(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        quotes = pc.count_substring(lines, self.quote).to_numpy(zero_copy_only=False)
        before = (self.inside + np.concatenate([[0], np.cumsum(quotes)])) % 2
        self.inside = int(before[-1])
        starts = np.flatnonzero(before[:-1] == 0)
        if not len(starts):
            self.waiting += lines.to_pylist()
            return
        self.waiting += lines.slice(0, starts[0]).to_pylist()
        yield from self._out(last=False)
        if len(starts) > 1:
            records = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), lines)
            yield self._rows(pc.binary_join(records, "\n"), 2)
        self.waiting, self.begun = lines.slice(starts[-1]).to_pylist(), True

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self._out(last=True)


def _cutter(quote: str, pieces: bool):
    """Arrow function over marked lines: whole records, or the ``pieces`` of those that cross a border."""
    def wanted(batch: pa.RecordBatch) -> pa.RecordBatch:
        whole = pc.equal(batch.column(2), 2)
        return batch.filter(pc.invert(whole) if pieces else whole)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None
        for batch in batches:
            file, block, value, inside, goes_on = (batch.column(batch.schema.get_field_index(c)) for c in ("file", "block", "value", "inside", "open"))
            n = batch.num_rows
            if not n:
                continue
            turn = pc.or_(pc.not_equal(file.slice(1), file.slice(0, n - 1)), pc.not_equal(block.slice(1), block.slice(0, n - 1)))
            edges = [0, *(np.flatnonzero(turn.to_numpy(zero_copy_only=False)) + 1), n]
            for lo, hi in zip(edges, edges[1:]):
                key = (file[lo].as_py(), block[lo].as_py())
                if split is None or key != (split.file, split.block):
                    if split is not None:
                        yield from map(wanted, split.end())
                    split = _Split(*key, inside[lo].as_py(), goes_on[lo].as_py(), quote)
                yield from map(wanted, split.add(value.slice(lo, hi - lo)))
        if split is not None:
            yield from map(wanted, split.end())

    return cut


def csv_records(spark: SparkSession, path, quote: str = '"') -> DataFrame:
    """One row for each record of the CSV files at ``path``: (file, first, record); ``first`` marks a file's first record."""
    lines = _lines(spark, path)
    marks = materialise(split_marks(lines, quote), "csv-splits")
    splits = marks.count()
    whole = _marked(lines, marks, splits).mapInArrow(_cutter(quote, False), _RECORD).select("file", "first", "record")
    crossing = marks.where("inside = 1 OR open = 1")
    if not crossing.limit(1).count():
        return whole
    pieces = materialise(_marked(lines, crossing, splits).mapInArrow(_cutter(quote, True), _RECORD), "csv-pieces")
    number = F.sum("part").over(Window.partitionBy("file").orderBy("block", "part"))  # a piece of part 1 begins a record
    joined = pieces.withColumn("number", number).groupBy("file", "number").agg(
        F.max("first").alias("first"), F.sort_array(F.collect_list(F.struct("block", "part", "record"))).alias("p"))
    return whole.unionByName(joined.select("file", "first", F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record")))


def read_csv(spark: SparkSession, path, columns: list[str], quote: str = '"') -> DataFrame:
    """Text columns of CSV files with a header; blank records are passed over, as the built-in reader does."""
    record = F.regexp_replace("record", "\r$", "")
    rows = csv_records(spark, path, quote).where("NOT first").select(record.alias("record")).where("record <> ''")
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    options = {"multiLine": "true", "escape": quote, "quote": quote, "mode": "PERMISSIVE"}
    return rows.select(F.from_csv("record", schema, options).alias("row")).select("row.*")
