"""Three quantile definitions over value counts, exact and spread over the cluster.

* ``nearest``  - value at 0-based rank ``floor((n-1)*q + 0.5)`` of the sorted
  non-null values (used by the cleaning rules and the profiles).
* ``linear``   - linear interpolation between closest ranks.
* ``midpoint`` - the median as the mean of the two middle values (linear, q = 1/2).

The rows are reduced to one row per distinct (group, value) first. That table
is written to the shared checkpoint folder once, cut into value ranges and
summed range by range (``operators.ranks``), so neither a hot group nor a
column without groups ever meets in one task. ``approx=True`` takes a
Greenwald-Khanna sketch instead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringlens.operators.ranks import cumulative_before, join_groups
from ringlens.sources.sinks import materialise

#: (definition, q) of the statistics most reports ask for.
MEDIAN = ("linear", 0.5)
Q25, Q75 = ("linear", 0.25), ("linear", 0.75)


def value_counts(df: DataFrame, keys: list[str], value: str | Column) -> DataFrame:
    """(keys, v, cnt): non-null values as doubles, counted per group and written once."""
    v = F.col(value) if isinstance(value, str) else value
    counts = df.select(*keys, v.cast("double").alias("v")).where("v IS NOT NULL").groupBy(*keys, "v").agg(
        F.count(F.lit(1)).alias("cnt"))
    return materialise(counts, "value-counts")


def _position(kind: str, q: float | Column) -> Column:
    """0-based rank that a definition asks for (fractional for ``linear``), from the group size ``n``."""
    h = (F.col("n") - 1) * q
    return {"nearest": F.floor(h + 0.5).cast("double"), "linear": h}[kind]


def quantiles_of_counts(counts: DataFrame, keys: list[str], specs: dict[str, tuple[str, float]]) -> DataFrame:
    """One row per group of ``value_counts``: keys, n and one column per name in ``specs`` {name: (definition, q)}."""
    cum = cumulative_before(counts, "v", "cnt", keys, total="n")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("cnt")), F.col("v")))

    ends = {}
    for name, (kind, q) in specs.items():
        ends[f"_lo_{name}"] = at(F.floor(_position(kind, q)))
        ends[f"_hi_{name}"] = at(F.ceil(_position(kind, q)))
    out = cum.groupBy(*keys).agg(F.max("n").alias("n"), *[e.alias(c) for c, e in ends.items()])
    for name, (kind, q) in specs.items():
        pos = _position(kind, q)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out = out.withColumn(name, F.when(lo == hi, lo).otherwise((F.ceil(pos) - pos) * lo + (pos - F.floor(pos)) * hi))
    return out.select(*keys, "n", *specs)


def group_quantiles(df: DataFrame, keys: list[str], value: str | Column, specs: dict[str, tuple[str, float]]) -> DataFrame:
    """``quantiles_of_counts`` of the rows of ``df``; groups without a non-null value have no row."""
    return quantiles_of_counts(value_counts(df, keys, value), keys, specs)


def attach_quantiles(report: DataFrame, df: DataFrame, keys: list[str], value: str | Column,
                     specs: dict[str, tuple[str, float]]) -> DataFrame:
    """``report`` (one row per group) with the quantiles of ``df``'s rows of the same group; null where there is none."""
    if not keys:
        found = quantile_scalars(df, [(value, kind, q) for kind, q in specs.values()])
        return report.withColumns({n: F.lit(x).cast("double") for n, x in zip(specs, found)})
    q = group_quantiles(df, keys, value, specs)
    return join_groups(report, q.drop("n"), keys)


def quantile_scalars(df: DataFrame, wanted: list[tuple[str | Column, str, float]]) -> list[float | None]:
    """Quantiles [(value, definition, q)] as driver scalars, all in one counting pass; None without a value.

    Used where a later plan needs a literal (outlier flag, IQR fence, fill value).
    A value expression may carry its own row condition as ``F.when(cond, x)``.
    """
    exprs: list[Column] = []
    index: dict[str, int] = {}
    of = []
    for value, _, _ in wanted:
        col = F.col(value) if isinstance(value, str) else value
        if str(col) not in index:
            index[str(col)] = len(exprs)
            exprs.append(col.cast("double"))
        of.append(index[str(col)])
    stacked = df.select(F.posexplode(F.array(*exprs)).alias("i", "x"))
    counts = value_counts(stacked, ["i"], "x")
    specs = {f"q{j}": (kind, q) for j, (_, kind, q) in enumerate(wanted)}
    rows = {r["i"]: r for r in quantiles_of_counts(counts, ["i"], specs).collect()}
    return [rows[i][f"q{j}"] if i in rows else None for j, i in enumerate(of)]


def nearest_quantiles(df: DataFrame, col: str, qs: list[float], approx: bool = False,
                      accuracy: int = 1_000_000) -> list[float | None]:
    """Nearest-rank quantiles of ``col`` as driver scalars."""
    if approx:
        found = df.select(F.percentile_approx(F.col(col).cast("double"), list(qs), accuracy).alias("v")).first()["v"]
        return list(found) if found else [None for _ in qs]
    return quantile_scalars(df, [(col, "nearest", q) for q in qs])


def median_scalar(df: DataFrame, value: str | Column, empty: float = 0.0) -> float:
    """Midpoint median as a driver scalar; ``empty`` when there is no value."""
    (m,) = quantile_scalars(df, [(value, *MEDIAN)])
    return empty if m is None or math.isnan(m) else m
