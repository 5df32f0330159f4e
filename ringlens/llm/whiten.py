"""Embedding whitening from an exact, bit-sliced scatter matrix.

Every entry c becomes the integer x = floor(256 c). The distinct x-vectors are the
fit list. A task takes its vectors in blocks; in a block each dimension is shifted
by its smallest entry, and bit a of all shifted entries is packed across the rows
into 64-bit words, one word row (a bit plane) for each dimension and bit. The cross
product of two dimensions is then the sum of 2^(a+b) * popcount(plane_a AND plane_b):
whole numbers only. The shift is put back in integers, the tasks' sums are added up
by Spark, and n^2 V = n * sum(x x') - S S' is centred as integers before the eigen
decomposition, so a large common offset costs no digit.

``eigh`` is followed by refinement steps in extended precision, which give small
eigenvalues beside very large ones their own digits.

Defined cases: vectors that are null or hold a null, NaN, infinite or larger entry
than a 64-bit x can hold (|c| >= 2^54) are left out; so are vectors without entries.
Vectors of different lengths are whitened apart, each length with its own fit list
and its own n. A null or repeated ``vec_id`` is an id like any other: every row is
returned. Components are numbered up to the smaller of ``components`` and the length.
A component without variance (one distinct vector, or fewer independent directions
than components) has ``whitened`` 0 and ``explained`` 0 and is left out of
``identity_error``; where no component has variance that is 0. ``deviation`` is exact;
it is null where it does not fit a long, while ``deviation_wide`` holds it as text.
An empty table gives no rows. Other columns of the input are not read.

The driver receives the d x d sums and the distinct lengths, never vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlens.llm.common import Scratch

#: x = floor(SCALE * c).
SCALE = 256
#: Entries from this size on have no 64-bit x.
LARGEST = 2.0 ** 54
#: Rows of a block whose bit planes are held at once: 64 words a plane.
BLOCK = 4096
#: Sums leave a task in signed limbs of this many bits, so that Spark adds them up as longs.
LIMB = 32


def integer_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """``df`` with ``_x`` = the vector's integers, without the rows that have none (see the module's cases)."""
    entries = F.col(vector).cast("array<double>")
    usable = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(
        entries, lambda c: F.coalesce((F.abs(c) < LARGEST) & ~F.isnan(c), F.lit(False)))
    return df.where(usable).withColumn("_x", F.transform(entries, lambda c: F.floor(c * SCALE).cast("long")))


def _planes(x: np.ndarray) -> np.ndarray:
    """Bit planes of the nonnegative entries of ``x`` (rows, dims): words (dims, bits, rows / 64)."""
    bits = max(1, int(x.max()).bit_length())
    padded = np.zeros((-(-len(x) // 64) * 64, x.shape[1]), np.uint64)
    padded[:len(x)] = x
    planes = np.empty((x.shape[1], bits, len(padded) // 64), np.uint64)
    for a in range(bits):
        plane = ((padded >> np.uint64(a)) & np.uint64(1)).astype(np.uint8)
        planes[:, a] = np.packbits(np.ascontiguousarray(plane.T), axis=1).view(np.uint64)
    return planes


def bit_sliced_scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums (dims) and cross products (dims, dims) of the long rows ``x``, as Python integers."""
    low = [int(v) for v in x.min(axis=0)]
    # differences of longs modulo 2^64 are the true differences: they are below 2^64
    planes = _planes(x.astype(np.uint64) - x.min(axis=0).astype(np.uint64))
    dims, bits, words = planes.shape
    sums = [sum(int(c) << a for a, c in enumerate(np.bitwise_count(planes[i]).sum(axis=1))) for i in range(dims)]
    kind = np.int64 if 2 * bits + len(x).bit_length() < 62 else object  # the weighted counts fit a long, or not
    weights = np.array([1 << b for b in range(bits)], kind)
    cross = np.empty((dims, dims), object)
    for i in range(dims):
        counts = [np.bitwise_count(planes[i, a] & planes[i:]).sum(axis=2, dtype=np.int64) for a in range(bits)]
        total = sum((c.astype(kind) @ weights) * weights[a] for a, c in enumerate(counts))
        cross[i, i:] = cross[i:, i] = [int(t) for t in total]
    n = len(x)
    shift = np.array(low, object)
    shifted = np.array(sums, object)
    return shifted + n * shift, cross + np.outer(shift, shifted) + np.outer(shifted, shift) + n * np.outer(shift, shift)


_SUMS = "dims int, i int, j int, limb int, v long"


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """``value`` as the sum of v * 2^(LIMB * limb), each |v| < 2^LIMB, with the sign of the value."""
    sign, value, limb = (-1 if value < 0 else 1), abs(value), 0
    while value:
        if value & ((1 << LIMB) - 1):
            yield limb, sign * (value & ((1 << LIMB) - 1))
        value >>= LIMB
        limb += 1


def _task_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task's distinct vectors by length: n at (-1, -1), S_j at (-1, j), cross products at (i, j), i <= j."""
    waiting: dict[int, list[np.ndarray]] = {}
    n: dict[int, int] = {}
    sums: dict[int, np.ndarray] = {}
    cross: dict[int, np.ndarray] = {}

    def add(dims: int) -> None:
        x = np.concatenate(waiting.pop(dims))
        s, m = bit_sliced_scatter(x)
        n[dims] = n.get(dims, 0) + len(x)
        sums[dims] = sums.get(dims, 0) + s
        cross[dims] = cross.get(dims, 0) + m

    for batch in batches:
        for dims, rows in _by_length(batch.column(0)):
            for part in np.array_split(rows[1], -(-len(rows[1]) // BLOCK)):
                waiting.setdefault(dims, []).append(part)
                if sum(map(len, waiting[dims])) >= BLOCK:
                    add(dims)
    for dims in list(waiting):
        add(dims)
    for dims in n:
        cells = [(-1, -1, n[dims]), *((-1, j, sums[dims][j]) for j in range(dims)),
                 *((i, j, cross[dims][i, j]) for i in range(dims) for j in range(i, dims))]
        out = [(dims, i, j, limb, v) for i, j, value in cells for limb, v in _limbs(int(value))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in list(zip(*out))[:4]]
                                         + [pa.array([r[4] for r in out], pa.int64())], ["dims", "i", "j", "limb", "v"])


def _by_length(lists: pa.Array) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """(length, (row numbers, long matrix)) for each length in a column of long lists without nulls."""
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy()
    lengths = np.diff(offsets)
    for dims in np.unique(lengths):
        rows = np.flatnonzero(lengths == dims)
        yield int(dims), (rows, flat[offsets[rows][:, None] + np.arange(dims)])


@dataclass
class Whitening:
    """Model of one vector length: ``axes`` (components, dims), ``values`` their eigenvalues, ``trace`` of V."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates (rows, components) of integer rows."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        centred = (x - whole).astype(np.float64) - rest  # the integer part goes before the rounding
        scale = np.array([1 / np.sqrt(v) if v > 0 else 0.0 for v in self.values])
        return (centred @ self.axes.T) * scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sum of (n x - S)^2 for each integer row."""
        far = max(abs(self.n * int(v) - s) for m in (x.min(axis=0), x.max(axis=0)) for v, s in zip(m, self.sums))
        if far * far * len(self.sums) < 2 ** 62:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        return [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]


def _extended(value: int, scale: int) -> np.longdouble:
    """value / scale in extended precision, for scale a power of two."""
    head = float(value)
    return (np.longdouble(head) + np.longdouble(float(value - int(head)))) / np.longdouble(scale)


def principal_axes(scatter: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit eigenvectors and eigenvalues, largest first, and the trace, of V = scatter / n^2 (centred integers).

    ``eigh`` in double precision, then refinement steps on X'VX in extended precision: an
    eigenvector's error e falls to e^2, until the off-diagonal part no longer shrinks.
    """
    dims = len(scatter)
    most = max((abs(int(v)) for v in scatter.diagonal()), default=0)
    trace = sum(int(v) for v in scatter.diagonal()) / (n * n)
    if most == 0:
        return np.eye(dims)[:components], np.zeros(min(components, dims)), 0.0
    unit = 1 << most.bit_length()  # keeps the doubles in range
    v = np.array([[_extended(int(c), unit) for c in row] for row in scatter], np.longdouble)
    x = np.linalg.eigh(v.astype(np.float64))[1].astype(np.longdouble)
    eye, before = np.eye(dims, dtype=np.longdouble), np.inf
    for _ in range(8):
        r, s = eye - x.T @ x, x.T @ v @ x
        values = s.diagonal() / (1 - r.diagonal())
        gap = values[None, :] - values[:, None]
        close = np.abs(gap) <= 1e-13 * np.maximum(np.abs(values[None, :]), np.abs(values[:, None]))
        step = np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, gap))
        size = np.abs(step).max()
        if not size < before / 2:
            break
        x, before = x + x @ step, size
    order = np.argsort(-values)[:components]
    axes = (x / np.sqrt((x * x).sum(axis=0)))[:, order].T
    found = values[order].astype(np.float64)
    found[found <= dims * np.finfo(np.longdouble).eps * float(values.max())] = 0.0  # rounding of a flat direction
    return axes.astype(np.float64), found * (unit / (n * n)), trace


def fit_whitening(fit: DataFrame, components: int = 4) -> dict[int, Whitening]:
    """One model for each length of the distinct integer vectors ``fit (_x)``."""
    sums = fit.select("_x").mapInArrow(_task_sums, _SUMS).groupBy("dims", "i", "j", "limb").agg(F.sum("v").alias("v"))
    cells: dict[int, dict[tuple[int, int], int]] = {}
    for dims, i, j, limb, v in sums.collect():  # dims^2 / 2 numbers of a few limbs
        own = cells.setdefault(dims, {})
        own[i, j] = own.get((i, j), 0) + (v << (LIMB * limb))
    models = {}
    for dims, own in cells.items():
        n, s = own[-1, -1], [own.get((-1, j), 0) for j in range(dims)]
        centred = np.empty((dims, dims), object)
        for i in range(dims):
            for j in range(i, dims):
                centred[i, j] = centred[j, i] = n * own.get((i, j), 0) - s[i] * s[j]
        axes, values, trace = principal_axes(centred, n, components)
        models[dims] = Whitening(n, s, axes, values, trace)
    return models


def _identity_errors(fit: DataFrame, models: dict[int, Whitening], components: int) -> dict[int, float]:
    """Largest absolute entry of (covariance of the whitened fit list - identity), by length."""
    names = [f"w{k}" for k in range(components)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, (_, x) in _by_length(batch.column(0)):
                w = models[dims].project(x)
                w = np.hstack([w, np.zeros((len(w), components - w.shape[1]))])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), dims, np.int32)), *map(pa.array, w.T)], ["dims", *names])

    pairs = [(a, b) for a in range(components) for b in range(a, components)]
    rows = fit.select("_x").mapInArrow(project, "dims int, " + ", ".join(f"{w} double" for w in names)).groupBy("dims").agg(
        *[F.covar_pop(names[a], names[b]).alias(f"c{a}_{b}") for a, b in pairs]).collect()
    errors = {}
    for row in rows:
        live = [k for k, v in enumerate(models[row["dims"]].values) if v > 0]
        errors[row["dims"]] = max([abs(row[f"c{a}_{b}"] - (a == b)) for a, b in pairs if a in live and b in live], default=0.0)
    return errors


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """Whitened coordinates of every usable row of ``df``: one row for each component.

    Columns: vec_id, component, n, deviation, whitened, explained, identity_error, deviation_wide.
    """
    scratch = Scratch(df.sparkSession, "whiten")
    rows = integer_vectors(df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("_vector")), "_vector").select("vec_id", "_x")
    fit = scratch.table(rows.select("_x").distinct())
    models = fit_whitening(fit, components)
    errors = _identity_errors(fit, models, components)

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, (at, x) in _by_length(batch.column(1)):
                m = models[dims]
                k, w = len(m.values), m.project(x)
                wide = [d for d in m.deviations(x) for _ in range(k)]
                size = len(at) * k
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(size, m.n, np.int64)), pa.array([d if d < 2 ** 63 else None for d in wide], pa.int64()),
                    pa.array(w.ravel()), pa.array(np.tile(m.values / m.trace if m.trace else m.values, len(at))),
                    pa.array(np.full(size, errors[dims])), pa.array(map(str, wide), pa.string())],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_wide"])

    kind = dict(rows.dtypes)["vec_id"]
    return rows.mapInArrow(coordinates, f"vec_id {kind}, component int, n long, deviation long, whitened double, "
                                        "explained double, identity_error double, deviation_wide string")
