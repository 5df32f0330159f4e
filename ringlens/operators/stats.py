"""Statistical operators (T1-T8) as distributed aggregations.

* two-proportion z-test (pooled, two-sided), p from the normal tail;
* Mann-Whitney U (tie-aware mid-ranks, normal approximation with tie and
  continuity correction; exact null distribution for a small tie-free side);
* Spearman correlation of mid-ranks, pairwise non-null;
* eta squared (numeric x category) from per-group moments;
* Cramer's V over the complete contingency grid, Yates for 2x2 tables.

Every statistic is computed from an aggregated table (one row per group /
value / cell); raw rows are only scanned and partially aggregated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringlens import constants as K
from ringlens.operators.ranks import midranks
from ringlens.sources.sinks import materialise

# ---------------------------------------------------------------------------
# normal distribution tail (JVM expression, double precision)
# ---------------------------------------------------------------------------

# fixed values: coefficients of Hart's double-precision rational approximation
# of the standard normal CDF (numerator, denominator, continued-fraction tail)
_HART_NUM = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
             112.079291497871, 221.213596169931, 220.206867912376]
_HART_DEN = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
             296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
_HART_SPLIT = 7.07106781186547
_SQRT_2PI = 2.506628274631


def _horner(x: Column, coefs) -> Column:
    acc = F.lit(coefs[0]) * x + F.lit(coefs[1])
    for c in coefs[2:]:
        acc = acc * x + F.lit(c)
    return acc


def normal_lower_tail(z: Column) -> Column:
    """P(Z <= -|z|) for a standard normal Z (upper/lower tail of |z|)."""
    a = F.abs(z)
    e = F.exp(-a * a / F.lit(2.0))
    mid = e * _horner(a, _HART_NUM) / _horner(a, _HART_DEN)
    b = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        b = a + F.lit(k) / b
    far = e / b / F.lit(_SQRT_2PI)
    return F.when(a > 37, F.lit(0.0)).when(a < _HART_SPLIT, mid).otherwise(far)


def two_sided_p(z: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(2.0) * normal_lower_tail(z))


# ---------------------------------------------------------------------------
# Two-proportion z-test
# ---------------------------------------------------------------------------

def ztest_columns(n1: Column, c1: Column, n2: Column, c2: Column) -> dict[str, Column]:
    """Pooled two-proportion z-test; se = 0 gives (z, p) = (0, 1)."""
    p1 = F.when(n1 > 0, c1 / n1).otherwise(F.lit(0.0))
    p2 = F.when(n2 > 0, c2 / n2).otherwise(F.lit(0.0))
    pool = (c1 + c2) / (n1 + n2)
    se = F.sqrt(pool * (F.lit(1.0) - pool) * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    z = F.when(F.coalesce(se, F.lit(0.0)) == 0, F.lit(0.0)).otherwise((p1 - p2) / se)
    p = F.when(F.coalesce(se, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(two_sided_p(z))
    return {"rate_a": p1, "rate_b": p2, "z": z, "p_value": p}


def segments(df: DataFrame, test_campaign: str = K.TEST_CAMPAIGN) -> DataFrame:
    """explode each row into its audit segments (hora_0, prueba, resto; a row may be in two)."""
    h0 = F.coalesce(F.col("hour") == 0, F.lit(False))
    pr = F.coalesce(F.col("campaign_type") == test_campaign, F.lit(False))
    rest = F.coalesce((F.col("hour") != 0) & (F.col("campaign_type") != test_campaign), F.lit(False))
    segs = F.array(F.when(h0, F.lit("hora_0")), F.when(pr, F.lit("prueba")), F.when(rest, F.lit("resto")))
    return df.withColumn("segment", F.explode(F.filter(segs, lambda s: s.isNotNull())))


def segment_ztests(df: DataFrame) -> DataFrame:
    """Connection rate of each candidate segment against the rest."""
    counts = segments(df).groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.col("connected").cast("int")), F.lit(0)).alias("c"),
    )
    # the rest's counts reach every candidate through a window over the <= 3 aggregated rows
    allw = Window.partitionBy()
    out = counts.select(
        "segment", F.col("n").alias("n_a"), F.col("c").alias("c_a"),
        F.max(F.when(F.col("segment") == "resto", F.col("n"))).over(allw).alias("n_b"),
        F.max(F.when(F.col("segment") == "resto", F.col("c"))).over(allw).alias("c_b"),
    ).filter(F.col("segment") != "resto")
    cols = ztest_columns(F.col("n_a").cast("double"), F.col("c_a").cast("double"),
                         F.col("n_b").cast("double"), F.col("c_b").cast("double"))
    return out.withColumns(cols)


# ---------------------------------------------------------------------------
# Mann-Whitney U
# ---------------------------------------------------------------------------

#: Largest small side that has an exact tail: its work grows with lcm(1..m), not with the other side.
EXACT_MAX_SIDE = 12
METHODS = ("small_side", "exact", "asymptotic")


@lru_cache(maxsize=None)
def _partition_series(m: int) -> tuple[int, tuple[int, ...]]:
    """(L, A) with 1 / ((1 - q) (1 - q)(1 - q^2)...(1 - q^m)) = A(q) / (1 - q^L)^(m + 1), L = lcm(1..m)."""
    period = math.lcm(*range(1, m + 1))
    series = [1]
    for i in (1, *range(1, m + 1)):  # times (1 - q^L) / (1 - q^i) = 1 + q^i + ... + q^(L - i)
        out = [0] * (len(series) + period - i)
        for shift in range(i):
            run = 0
            for j in range(shift, len(out), i):
                run += series[j] if j < len(series) else 0
                run -= series[j - period] if 0 <= j - period < len(series) else 0
                out[j] = run
        series = out
    return period, tuple(series)


def _series_at(t: int, m: int) -> int:
    """Coefficient of q^t in the series of ``_partition_series``."""
    if t < 0:
        return 0
    period, a = _partition_series(m)
    return sum(a[j] * math.comb((t - j) // period + m, m) for j in range(t % period, min(t, len(a) - 1) + 1, period))


def exact_upper_tail(u: int, small: int, large: int) -> float:
    """P(U >= u) under H0 without ties, exact, for sides of ``small`` and ``large`` values.

    P(U >= u) = P(U <= m n - u), and the number of arrangements with U <= t is the coefficient of q^t
    in the Gaussian binomial over (1 - q). Its numerator has 2^m signed powers, the rest is a series
    with closed-form coefficients, so the work does not depend on ``large``.
    """
    m, n = min(small, large), max(small, large)
    if m > EXACT_MAX_SIDE:
        raise ValueError(f"the exact tail needs a side of at most {EXACT_MAX_SIDE} values, not {m}")
    signed = {0: 1}  # product of (1 - q^(n + i))
    for i in range(1, m + 1):
        grown = dict(signed)
        for power, sign in signed.items():
            grown[power + n + i] = grown.get(power + n + i, 0) - sign
        signed = grown
    t = m * n - u
    return sum(sign * _series_at(t - power, m) for power, sign in signed.items()) / math.comb(m + n, m)


def _mwu_p(u1: float, na: int, nb: int, tie_term: float, method: str, exact_max_n: int) -> tuple[str, float]:
    """(method used, two-sided p) of Mann-Whitney U (statistic of side a)."""
    if na < 2 or nb < 2:
        return "none", float("nan")
    big = max(u1, na * nb - u1)
    if method == "exact" or (method == "small_side" and min(na, nb) <= exact_max_n and tie_term == 0):
        if tie_term:
            raise ValueError("the exact distribution is that of values without ties")
        return "exact", min(1.0, 2.0 * exact_upper_tail(math.ceil(big), na, nb))
    n = na + nb
    sd = math.sqrt(na * nb / 12 * ((n + 1) - tie_term / (n * (n - 1))))
    if sd == 0:  # every value ties: no evidence either way
        return "asymptotic", 1.0
    z = (big - na * nb / 2 - 0.5) / sd
    if z < 0:
        return "asymptotic", 1.0
    return "asymptotic", min(1.0, math.erfc(z / math.sqrt(2)))


def mann_whitney(df: DataFrame, value: str, side: str, tests: str = "test", method: str = "small_side",
                 exact_max_n: int = 8) -> DataFrame:
    """Mann-Whitney U per test.

    ``df`` holds (``tests``, ``side`` in {'a','b'}, ``value``) rows. Output per
    test: n_a, n_b, u (statistic of side a), rank sum, tie term, method, p.
    Fewer than 2 values on a side -> NaN; all values tied -> p = 1.

    ``method`` is ``exact``, ``asymptotic`` (tie and continuity correction) or
    ``small_side``: exact where the smaller side has at most ``exact_max_n``
    values and nothing ties, however large the other side is.

    The rank sums are distributed (value counts -> mid-ranks -> one
    aggregation per test). The result has one row per test; it is collected
    and the p-value is finished on the driver.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    base = df.filter(F.col(value).isNotNull()).select(tests, side, F.col(value).cast("double").alias("v"))
    return _mann_whitney_of_counts(base.groupBy(tests, "v").agg(
        F.count_if(F.col(side) == "a").alias("na"), F.count_if(F.col(side) == "b").alias("nb")), tests, method, exact_max_n)


def _mann_whitney_of_counts(counts: DataFrame, tests: str, method: str = "small_side", exact_max_n: int = 8) -> DataFrame:
    """``mann_whitney`` from (``tests``, v, na, nb): the values of each side counted per distinct value."""
    counts = materialise(counts.withColumn("cnt", F.col("na") + F.col("nb")), "mann-whitney")
    ranked = midranks(counts, "v", "cnt", keys=[tests])
    stats = ranked.groupBy(tests).agg(
        F.sum("na").alias("n_a"),
        F.sum("nb").alias("n_b"),
        F.sum(F.col("na") * F.col("midrank")).alias("rank_sum_a"),
        F.sum(F.col("cnt").cast("double") ** 3 - F.col("cnt")).alias("tie_term"),
    ).collect()
    rows = []
    for r in stats:
        na, nb = int(r["n_a"]), int(r["n_b"])
        u1 = float(r["rank_sum_a"]) - na * (na + 1) / 2
        used, p = _mwu_p(u1, na, nb, float(r["tie_term"]), method, exact_max_n)
        u = float("nan") if used == "none" else u1
        rows.append((r[tests], na, nb, float(r["rank_sum_a"]), float(r["tie_term"]), u, used, p))
    schema = (f"{tests} string, n_a long, n_b long, rank_sum_a double, tie_term double, u double, "
              "method string, p_value double")
    return counts.sparkSession.createDataFrame(rows, schema)


def segment_duration_tests(df: DataFrame) -> DataFrame:
    """Durations of connected calls: each candidate segment (a) against the rest (b).

    Durations are counted per (segment, value) first; only the counts of the rest are repeated per test.
    """
    counts = segments(df.filter(F.col("connected") & F.col("duration_sec").isNotNull())).groupBy(
        "segment", F.col("duration_sec").cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    rest = F.col("segment") == "resto"
    tests = F.when(rest, F.array(F.lit("hora_0"), F.lit("prueba"))).otherwise(F.array("segment"))
    sides = counts.select(F.explode(tests).alias("test"), "v", F.when(rest, 0).otherwise(F.col("n")).alias("a"),
                          F.when(rest, F.col("n")).otherwise(0).alias("b"))
    return _mann_whitney_of_counts(sides.groupBy("test", "v").agg(F.sum("a").alias("na"), F.sum("b").alias("nb")), "test")


# ---------------------------------------------------------------------------
# Spearman
# ---------------------------------------------------------------------------

def spearman(df: DataFrame, columns: list[str], min_pairs: int = K.MIN_PAIRS) -> DataFrame:
    """Spearman rho for every pair of ``columns`` over pairwise non-null rows (< min_pairs -> NaN).

    Rows are stacked to (pair, x, y) and counted once (combined before the
    shuffle); everything after works on distinct values. The values of each
    side get mid-ranks from the distributed cumulative counts, and rho is the
    correlation of the ranks weighted by the counts, around the mean rank
    (n + 1) / 2. A column without variation gives NaN.
    """
    pairs = list(combinations(columns, 2))
    rows = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        for i, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")
    xy = rows.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("pair", "x", "y").agg(
        F.count(F.lit(1)).alias("w"))
    xy = materialise(xy, "spearman-pairs")
    counts = xy.select("pair", "w", F.explode(F.array(
        F.struct(F.lit("x").alias("side"), F.col("x").alias("v")),
        F.struct(F.lit("y").alias("side"), F.col("y").alias("v")))).alias("s")).groupBy("pair", "s.side", "s.v").agg(
        F.sum("w").alias("cnt"))
    ranks = midranks(counts, "v", "cnt", keys=["pair", "side"]).select("pair", "side", "v", "midrank")
    rx = ranks.filter(F.col("side") == "x").select("pair", F.col("v").alias("x"), F.col("midrank").alias("rx"))
    ry = ranks.filter(F.col("side") == "y").select("pair", F.col("v").alias("y"), F.col("midrank").alias("ry"))
    # one row per pair of columns
    size = xy.groupBy("pair").agg(F.sum("w").alias("n"))
    dx, dy = (F.col(c) - (F.col("n") + 1) / 2 for c in ("rx", "ry"))
    r = xy.join(rx, ["pair", "x"]).join(ry, ["pair", "y"]).join(F.broadcast(size), "pair").groupBy("pair", "n").agg(
        F.sum(F.col("w") * dx * dy).alias("sxy"), F.sum(F.col("w") * dx * dx).alias("sxx"),
        F.sum(F.col("w") * dy * dy).alias("syy"))
    varies = (F.col("sxx") > 0) & (F.col("syy") > 0)
    r = r.withColumn("rho", F.when(varies, F.col("sxy") / F.sqrt(F.col("sxx")) / F.sqrt(F.col("syy"))).otherwise(F.lit(float("nan"))))
    names = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)],
                                            "pair int, col_a string, col_b string")
    out = names.join(F.broadcast(r), "pair", "left")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("long")
    return out.select("col_a", "col_b", n.alias("n"),
                      F.when(n < min_pairs, F.lit(float("nan"))).otherwise(F.col("rho")).alias("rho"))


#: Contingency cells that a task holds before it hands them on.
_CELLS_HELD = 500_000

# ---------------------------------------------------------------------------
# T4: eta squared, T5: Cramer's V  (all pairs in one aggregation each)
# ---------------------------------------------------------------------------

def eta_squared(df: DataFrame, numerics: list[str], categoricals: list[str], min_rows: int = K.MIN_PAIRS) -> DataFrame:
    """eta^2 = SS_between / SS_total for every (numeric, categorical) pair.

    Rows are stacked to (num, cat, x, level) in memory and reduced by one
    aggregation per (num, cat, level): count, mean and the within-group sum
    of squares (``var_pop * n``). SS_total = SS_within + SS_between (law of
    total variance), so no second pass over rows is needed.
    """
    pairs = [(n, c) for n in numerics for c in categoricals]
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("num"), F.lit(c).alias("cat"), F.col(n).cast("double").alias("x"),
                 F.col(c).cast("string").alias("level")) for n, c in pairs])).alias("s")).select("s.*")
    stacked = stacked.filter(F.col("x").isNotNull() & F.col("level").isNotNull())
    g = stacked.groupBy("num", "cat", "level").agg(
        F.count(F.lit(1)).alias("n_g"), F.avg("x").alias("mean_g"), (F.var_pop("x") * F.count(F.lit(1))).alias("ss_w"))
    w = Window.partitionBy("num", "cat")
    g = g.withColumn("n", F.sum("n_g").over(w)).withColumn("grand", F.sum(F.col("n_g") * F.col("mean_g")).over(w) / F.col("n"))
    out = g.groupBy("num", "cat").agg(
        F.first("n").alias("n"),
        F.sum(F.col("n_g") * (F.col("mean_g") - F.col("grand")) ** 2).alias("ss_between"),
        F.sum("ss_w").alias("ss_within"),
    )
    ss_total = F.col("ss_between") + F.col("ss_within")
    eta = F.when((F.col("n") < min_rows) | (ss_total == 0), F.lit(float("nan"))).otherwise(
        F.least(F.lit(1.0), F.col("ss_between") / ss_total))
    return out.select("num", "cat", "n", "ss_between", ss_total.alias("ss_total"), eta.alias("eta_squared"))


def pair_counts(df: DataFrame, columns: list[str], most: int = _CELLS_HELD) -> DataFrame:
    """(col_a, col_b, va, vb, o): rows by value for every pair of ``columns``, rows with a null in the pair left out.

    A task numbers the values of each column as they come and counts every pair of numbers batch
    by batch, so a row costs one small integer for each pair instead of a stacked row of four texts;
    Spark adds up the cells of the tasks. Beyond ``most`` cells a task hands on what it has.
    """
    pairs = list(combinations(range(len(columns)), 2))
    names = list(columns)

    def cells(values: list[dict], counts: dict) -> pa.RecordBatch:
        levels = [list(v) for v in values]
        rows = [(names[i], names[j], levels[i][c >> 32], levels[j][c & 0xFFFFFFFF], n) for (i, j), found in counts.items() for c, n in found.items()]
        a, b, va, vb, o = zip(*rows)
        text = pa.string()
        return pa.RecordBatch.from_arrays([pa.array(a, text), pa.array(b, text), pa.array(va, text), pa.array(vb, text), pa.array(o, pa.int64())],
                                          ["col_a", "col_b", "va", "vb", "o"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts, held = [{} for _ in names], {}, 0
        for batch in batches:
            codes = []
            for place, column in zip(values, batch.columns):
                coded = column.dictionary_encode()
                own = np.array([place.setdefault(v, len(place)) for v in coded.dictionary.to_pylist()] + [-1], np.int64)  # last: null
                codes.append(own[coded.indices.fill_null(len(own) - 1).to_numpy(zero_copy_only=False)])
            for i, j in pairs:
                a, b = codes[i], codes[j]
                width, whole = len(values[j]), (a >= 0) & (b >= 0)
                flat = (a * width + b)[whole]
                if len(values[i]) * width <= batch.num_rows:
                    tally = np.bincount(flat)
                    at = np.flatnonzero(tally)
                    n = tally[at]
                else:
                    at, n = np.unique(flat, return_counts=True)
                if len(at):
                    own = counts.setdefault((i, j), {})
                    held -= len(own)
                    for c, more in zip((at // width << 32 | at % width).tolist(), n.tolist()):
                        own[c] = own.get(c, 0) + more
                    held += len(own)
            if held > most:
                yield cells(values, counts)
                values, counts, held = [{} for _ in names], {}, 0
        if held:
            yield cells(values, counts)

    rows = df.select(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(names)])
    return rows.mapInArrow(task, "col_a string, col_b string, va string, vb string, o long").groupBy("col_a", "col_b", "va", "vb").agg(
        F.sum("o").alias("o"))


def cramers_v(df: DataFrame, columns: list[str], min_rows: int = K.MIN_PAIRS, yates: bool = True) -> DataFrame:
    """Cramer's V for every pair of categorical/binary ``columns`` (pairwise non-null).

    chi^2 runs over the complete a x b grid without materialising it: absent
    cells have o = 0, so their terms sum to ``n - sum(observed e)``; the work
    is linear in the observed cells. 2x2 tables get Yates' correction, for
    which the (at most four) cells are generated explicitly.
    """
    # read for the cells, both margins, the sizes and the 2x2 grids: the rows are counted once
    cells = materialise(pair_counts(df, columns), "contingency-cells")
    key = ["col_a", "col_b"]
    ra = cells.groupBy(*key, "va").agg(F.sum("o").alias("ra"))
    cb = cells.groupBy(*key, "vb").agg(F.sum("o").alias("cb"))
    dims = cells.groupBy(*key).agg(F.sum("o").alias("n"), F.count_distinct("va").alias("r"),
                                   F.count_distinct("vb").alias("c"))
    e = F.col("ra") * F.col("cb") / F.col("n")
    two_by_two = (F.col("r") == 2) & (F.col("c") == 2) if yates else F.lit(False)
    # observed cells (all tables)
    obs = cells.join(ra, [*key, "va"]).join(cb, [*key, "vb"]).join(dims, key) \
               .withColumn("o", F.col("o").cast("double")).withColumn("e", e)
    diff = F.col("e") - F.col("o")
    o_yates = F.col("o") + F.signum(diff) * F.least(F.lit(0.5), F.abs(diff))
    o_eff = F.when(two_by_two, o_yates).otherwise(F.col("o"))
    chi_obs = obs.groupBy(*key).agg(
        F.first("n").alias("n"), F.first("r").alias("r"), F.first("c").alias("c"),
        F.sum((o_eff - F.col("e")) ** 2 / F.col("e")).alias("chi_obs"),
        F.sum("e").alias("e_obs"),
    )
    # absent cells of 2x2 tables (Yates changes their terms): at most 4 cells per pair
    small = dims.filter(two_by_two).select(*key, "n")
    grid = ra.join(small, key).join(cb, key).join(cells.select(*key, "va", "vb"), [*key, "va", "vb"], "left_anti")
    ge = grid.withColumn("e", e)
    absent_yates = ge.groupBy(*key).agg(
        F.sum((F.col("e") - F.least(F.lit(0.5), F.col("e"))) ** 2 / F.col("e")).alias("chi_absent"))
    chi = chi_obs.join(absent_yates, key, "left")
    chi2 = F.when(two_by_two, F.col("chi_obs") + F.coalesce(F.col("chi_absent"), F.lit(0.0))) \
            .otherwise(F.col("chi_obs") + (F.col("n") - F.col("e_obs")))
    k = F.least(F.col("r"), F.col("c")) - 1
    out = chi.withColumn("chi2", chi2)
    v = F.when((F.col("n") < min_rows) | (k == 0), F.lit(float("nan"))).otherwise(
        F.least(F.lit(1.0), F.sqrt(F.col("chi2") / (F.col("n") * k))))
    return out.select(*key, "n", "r", "c", "chi2", v.alias("cramers_v"))


# ---------------------------------------------------------------------------
# Column classification, T7: recommendation, T8: verdict
# ---------------------------------------------------------------------------

_INTEGERS = ["tinyint", "smallint", "int", "bigint"]
_REALS = ["float", "double"]


def column_kinds(profile: DataFrame, max_categories: int = K.CATEGORY_MAX_DISTINCT, skip=K.AUDIT_SKIP_COLUMNS,
                 numeric_skip=K.AUDIT_NUMERIC_SKIP_COLUMNS) -> DataFrame:
    """(column, kind) for the columns of a column profile that take part in the association audit.

    A rule table over the profile rows (column, dtype, n_distinct): the first rule that holds
    names the kind, and a column without kind (identifier, long text, many categories) is left out.
    """
    name, kind, values = F.col("column"), F.col("dtype"), F.col("n_distinct")
    integer = kind.isin(_INTEGERS)
    number = integer | kind.isin(_REALS) | kind.startswith("decimal")
    rules = [
        (None, name.endswith(K.ID_SUFFIX) | name.isin(K.ID_COLUMNS) | name.isin(list(skip))),
        ("binary", (kind == "boolean") | (integer & (values <= 2))),
        ("numeric", number & ~name.isin(list(numeric_skip))),
        ("categorical", (kind == "string") & (values <= max_categories)),
    ]
    picked = F.coalesce(*[F.when(holds, F.lit(label or "")) for label, holds in rules])
    return profile.select("column", picked.alias("kind")).where("kind <> ''")


def classify_columns(df: DataFrame, profile: DataFrame, **rules) -> dict[str, list[str]]:
    """T6 as lists in the column order of ``df`` (one profile row per column reaches the driver)."""
    kind = {r["column"]: r["kind"] for r in column_kinds(profile, **rules).collect()}
    return {k: [c for c in df.columns if kind.get(c) == k] for k in ("numeric", "categorical", "binary")}


def recommend_features(spearman_df: DataFrame, eta_df: DataFrame, v_df: DataFrame, numerics: list[str],
                       categoricals: list[str], binaries: list[str], redundancy: float = K.REDUNDANCY_THRESHOLD,
                       eta_min: float = K.ETA2_THRESHOLD, v_min: float = K.CRAMERS_V_THRESHOLD) -> DataFrame:
    """One row per candidate feature with its strength, verdict and an algorithm hint.

    Numerics are taken in order unless an earlier taken one correlates with
    them (abs rho >= ``redundancy``; the first such one is ``redundant_with``)
    and recommended if their largest eta^2 reaches ``eta_min``; categoricals
    if their largest Cramer's V reaches ``v_min``; binaries are only rated.
    ``algorithm`` is ``K-Prototypes`` as soon as one categorical is
    recommended, else ``K-Means``. Joins of the three result tables: their
    rows are bounded by the number of column pairs.
    """
    best_eta = eta_df.where(~F.isnan("eta_squared")).groupBy(F.col("num").alias("feature")).agg(F.max("eta_squared").alias("eta"))
    best_v = v_df.where(~F.isnan("cramers_v")).select(F.explode(F.array("col_a", "col_b")).alias("feature"), "cramers_v") \
        .groupBy("feature").agg(F.max("cramers_v").alias("v"))
    # pairs that say the same, both ways round; one row holds them all and the taken numerics
    close = spearman_df.where(~F.isnan("rho") & (F.abs("rho") >= redundancy)).agg(
        F.flatten(F.collect_list(F.array(F.struct(F.col("col_a").alias("x"), F.col("col_b").alias("y")),
                                         F.struct(F.col("col_b").alias("x"), F.col("col_a").alias("y"))))).alias("close"))

    def alike(x, y):
        return F.exists("close", lambda p: (p.getField("x") == x) & (p.getField("y") == y))

    order = F.array(*[F.lit(c) for c in numerics]).cast("array<string>")
    taken = F.aggregate(order, F.array().cast("array<string>"),
                        lambda kept, c: F.when(F.exists(kept, lambda k: alike(c, k)), kept).otherwise(F.array_append(kept, c)))
    kinds = [(c, "numeric") for c in numerics] + [(c, "categorical") for c in categoricals] + [(c, "binary") for c in binaries]
    features = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(k).alias("kind")) for c, k in kinds])
    rated = close.select("close", taken.alias("taken"), F.inline(features)) \
        .join(F.broadcast(best_eta), "feature", "left").join(F.broadcast(best_v), "feature", "left")
    same = F.filter("taken", lambda k: alike(F.col("feature"), k))
    numeric = F.col("kind") == "numeric"
    rated = rated.withColumn("redundant_with", F.when(numeric & ~F.array_contains("taken", F.col("feature")), F.try_element_at(same, F.lit(1)))) \
        .withColumn("strength", F.coalesce(F.when(numeric, F.col("eta")).otherwise(F.col("v")), F.lit(0.0))) \
        .withColumn("recommended", F.col("redundant_with").isNull() & (
            (numeric & (F.col("strength") >= eta_min)) | ((F.col("kind") == "categorical") & (F.col("strength") >= v_min))))
    mixed = F.max(F.col("recommended") & (F.col("kind") == "categorical")).over(Window.partitionBy())
    return rated.select("feature", "kind", "recommended", "redundant_with", "strength",
                        F.when(mixed, "K-Prototypes").otherwise("K-Means").alias("algorithm"))


def exclusion_verdict(rate_tests: DataFrame, duration_tests: DataFrame, alpha: float = 0.05,
                      low_volume: int = K.LOW_VOLUME) -> DataFrame:
    """Exclude a segment when its connection rate or durations differ (p < alpha) or it is tiny."""
    d = duration_tests.select(F.col("test").alias("segment"), F.col("p_value").alias("p_duration"))
    out = rate_tests.select("segment", "n_a", F.col("p_value").alias("p_rate")).join(d, "segment", "left")
    sig = lambda p: F.coalesce((~F.isnan(p)) & (p < alpha), F.lit(False))
    return out.withColumns({
        "rate_differs": sig(F.col("p_rate")),
        "duration_differs": sig(F.col("p_duration")),
        "low_volume": F.col("n_a") < low_volume,
    }).withColumn("exclude", F.col("rate_differs") | F.col("duration_differs") | F.col("low_volume"))
