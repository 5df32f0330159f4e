"""Document fingerprints by Order MinHash: sketches that are sensitive to edit distance.

A text's k-mers of code points are numbered by occurrence, so that repeats differ.
For each of ``sketches`` random orders the ``tuple_len`` smallest k-mers are selected, put
back into the order in which they stand in the text, and the tuple is hashed.
Two fingerprints are as alike as the share of equal tuple hashes: unlike a plain
MinHash it falls when common pieces change their order.

Every text is also compared with an edited text, whose last quarter is replaced by
the start of the next document. What the two share, the k-mers of the first three quarters with
their numbers and smallest ranks, is worked out once (``Sketched``). Documents are dealt into ranges of ascending id,
and the first document of the following range is added to each range, so
neighbours meet in one pass over one shuffle of the texts.

Defined cases: a null text is empty; all texts shorter than k are one k-mer, the
empty text is the empty tuple; the next document of rows with equal ids is decided by
the hash of their text; a null id comes first; the only row of a table is its own next
document; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringlens.llm.common import prepare

K, SKETCHES, TUPLE_LEN = 9, 64, 2
#: Ranges of documents: some for each shuffle partition, so that they fill partitions evenly.
RANGES_PER_PARTITION, MOST_RANGES = 8, 65_536
_MATRIX = 1 << 18  # cells of a block of (sketches x k-mers): stays in a core's cache
_SORTED = 64  # k-mers of a block that is sorted

_rng = np.random.default_rng(20_240_501)  # fixed: fingerprints of different runs are comparable
_XOR = _rng.integers(0, 1 << 32, 4096, dtype=np.uint64).astype(np.uint32)
_MUL = (_rng.integers(0, 1 << 32, 4096, dtype=np.uint64) | 1).astype(np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _kmer_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash per position of a k-mer."""
    cp = points.astype(np.uint64) + np.uint64(1)
    n = len(cp) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += cp[j:j + n]
    return _mix(h)


def _occurrences(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of earlier equal hashes per position, sorted hashes)."""
    order = np.argsort(h)
    by = h[order]
    count = np.zeros(len(h), np.uint64)
    same = np.flatnonzero(by[1:] == by[:-1]) + 1
    if len(same):
        new = np.ones(len(h), bool)
        new[same] = False
        run = np.cumsum(new) - 1
        again = ~new
        again[same - 1] = True  # members of runs of equal k-mers
        members = np.flatnonzero(again)
        at = np.lexsort((order[members], run[members]))
        run, place = run[members][at], order[members][at]
        start = np.concatenate(([True], run[1:] != run[:-1]))
        count[place] = np.arange(len(run)) - np.flatnonzero(start)[np.cumsum(start) - 1]
    return count, by


def _numbered(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The hashes of k-mers together with their occurrence numbers; a first occurrence keeps its hash."""
    again = np.flatnonzero(count)
    if len(again):
        h = h.copy()
        h[again] = _mix(h[again] + count[again] * np.uint64(0xD1B54A32D192ED03))
    return h


def _numbered_kmers(text: str, k: int) -> np.ndarray:
    """One 64-bit hash per position: the k-mer together with the number of its earlier occurrences."""
    points = _code_points(text)
    h = _kmer_hashes(points, min(k, len(points)))
    return _numbered(h, _occurrences(h)[0])


#: The smallest ranks of each sketch and where their k-mers stand, both (sketches x tuple length).
Smallest = tuple[np.ndarray, np.ndarray]


def _smallest(items: np.ndarray, sketches: int, take: int, start: int = 0, before: Smallest | None = None) -> Smallest:
    """The ``take`` smallest ranks of each sketch among ``items`` and those found ``before``.

    Of equal ranks the earlier place is smaller. ``items`` stand at ``start`` and after, ``before`` at places below.
    """
    low = (items >> np.uint64(32)).astype(np.uint32)
    xor, mul, row = _XOR[:sketches, None], _MUL[:sketches, None], np.arange(sketches)
    step = max(1, _MATRIX // sketches)
    for at in range(0, len(low), step):
        ranks = np.bitwise_xor(low[None, at:at + step], xor)
        ranks *= mul
        if ranks.shape[1] <= _SORTED:
            place = np.argsort(ranks, axis=1, kind="stable")[:, :take]
            value = np.take_along_axis(ranks, place, 1)
        else:
            # take the smallest out, one after the other
            value, place = np.empty((sketches, take), np.uint32), np.empty((sketches, take), np.int64)
            for j in range(take):
                place[:, j] = ranks.argmin(axis=1)
                value[:, j] = ranks[row, place[:, j]]
                ranks[row, place[:, j]] = 0xFFFFFFFF
        place += start + at
        if before is not None:
            value, place = np.concatenate((before[0], value), axis=1), np.concatenate((before[1], place), axis=1)
            order = np.argsort(value, axis=1, kind="stable")[:, :take]
            value, place = np.take_along_axis(value, order, 1), np.take_along_axis(place, order, 1)
        before = value, place
    return before


def _tuples(items: np.ndarray, found: Smallest) -> np.ndarray:
    """Hashes (uint32) of the selected k-mers in the order of the text."""
    places = np.sort(found[1], axis=1)
    h = np.zeros(len(places), np.uint64)
    for j in range(places.shape[1]):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + items[places[:, j]] + np.uint64(j + 1))
    return (h >> np.uint64(32)).astype(np.uint32)


def fingerprint(text: str | None, k: int = K, sketches: int = SKETCHES, tuple_len: int = TUPLE_LEN) -> np.ndarray:
    """``sketches`` tuple hashes (uint32) of a text."""
    if not text:
        return _mix(np.arange(sketches, dtype=np.uint64) + np.uint64(77)).astype(np.uint32)
    items = _numbered_kmers(text, k)
    return _tuples(items, _smallest(items, sketches, min(tuple_len, len(items))))


class Sketched:
    """A text's fingerprint, and what a text with the same first three quarters takes over from it.

    The number of a k-mer depends on the text before it alone, so the k-mers that lie wholly in the
    kept part, their numbers and their smallest ranks are the same in both.
    """

    def __init__(self, text: str, k: int = K, sketches: int = SKETCHES, tuple_len: int = TUPLE_LEN):
        self.text, self.k, self.sketches, self.tuple_len = text, k, sketches, tuple_len
        self.points = _code_points(text)
        self.kept = len(text) - len(text) // 4
        head = self.kept - k + 1
        self.shares = head >= max(tuple_len, 1)
        if not self.shares:
            self.fp = fingerprint(text, k, sketches, tuple_len)
            return
        h = _kmer_hashes(self.points, k)
        count, self.sorted = _occurrences(h[:head])
        self.items = _numbered(h[:head], count)
        self.found = _smallest(self.items, sketches, tuple_len)
        self.fp = self._with_end(h[head:])

    def _with_end(self, h: np.ndarray) -> np.ndarray:
        """The fingerprint of the shared k-mers followed by those of hashes ``h``."""
        if not len(h):
            return _tuples(self.items, self.found)
        at = np.searchsorted(self.sorted, h)
        count = _occurrences(h)[0]
        seen = np.flatnonzero(self.sorted[np.minimum(at, len(self.sorted) - 1)] == h)
        count[seen] += (np.searchsorted(self.sorted, h[seen], side="right") - at[seen]).astype(np.uint64)
        end = _numbered(h, count)
        return _tuples(np.concatenate((self.items, end)), _smallest(end, self.sketches, self.tuple_len, len(self.items), self.found))

    def edited(self, following: str) -> tuple[str, np.ndarray]:
        """The text whose last quarter is replaced by the start of ``following``, and its fingerprint."""
        new = edited(self.text, following)
        if new == self.text:
            return new, self.fp
        if not self.shares:
            return new, fingerprint(new, self.k, self.sketches, self.tuple_len)
        border = np.concatenate((self.points[self.kept - self.k + 1:self.kept], _code_points(new[self.kept:])))
        return new, self._with_end(_kmer_hashes(border, self.k))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def _hex(fp: np.ndarray) -> str:
    return fp.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many first code points of the next text (or all of them)."""
    q = len(text) // 4
    return text[:len(text) - q] + following[:q]


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, sketches: int = SKETCHES,
                 tuple_len: int = TUPLE_LEN) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    if sketches > len(_XOR):
        raise ValueError(f"at most {len(_XOR)} sketches")
    spark = prepare(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    src = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n_ranges = min(MOST_RANGES, RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = src.agg(F.percentile_approx("doc_id", [i / n_ranges for i in range(1, n_ranges)], 4 * n_ranges)).first()[0]
    bounds = np.unique(np.array(cuts if cuts else [], dtype=np.int64))

    @F.pandas_udf(T.IntegerType())
    def range_of(ids):
        # a null id belongs to the first range
        return ids.isna().map({True: 0, False: 0}).add(np.where(ids.isna(), 0, np.searchsorted(bounds, ids.fillna(0).astype("int64"), side="left"))).astype("int32")

    # the smallest (id, text hash) of each range: at most MOST_RANGES rows
    lows = [r for r in src.select("doc_id", range_of("doc_id").alias("range")).groupBy("range")
            .agg(F.min("doc_id").alias("low"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).orderBy("range").collect()]
    if not lows:
        return spark.createDataFrame([], schema)
    # the first row of a range ends the range before it; the first of all ends the last
    firsts = [(lows[i - 1]["range"], None if r["nulls"] else r["low"]) for i, r in enumerate(lows)]
    ends = F.broadcast(spark.createDataFrame(firsts, f"range int, low {kind}"))
    heads = src.join(ends, src["doc_id"].eqNullSafe(ends["low"])).select("range", F.lit(1).alias("extra"), "doc_id", "text")
    dealt = (src.select(range_of("doc_id").alias("range"), F.lit(0).alias("extra"), "doc_id", "text").unionByName(heads)
             .repartition("range").withColumn("tie", F.xxhash64("text"))
             .sortWithinPartitions("range", "extra", F.col("doc_id").asc_nulls_first(), "tie").drop("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next document is still to come
        for batch in batches:
            rows = []
            for rng, extra, doc, txt in zip(*(c.to_pylist() for c in batch.columns)):
                if held is not None and held[0] != rng:
                    held = None
                if extra and held is None:
                    continue  # further rows with the id of the next range's first
                now = Sketched(txt, k, sketches, tuple_len)
                if held is not None:
                    _, doc0, was = held
                    new, fp1 = was.edited(txt)
                    rows.append((doc0, len(was.text), hashlib.sha256(new.encode()).hexdigest(), _hex(was.fp), _hex(fp1),
                                 likeness(was.fp, fp1), likeness(was.fp, now.fp)))
                held = None if extra else (rng, doc, now)
            if rows:
                types = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(run, schema)
