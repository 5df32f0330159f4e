"""A20/A28 for very large tables: quantiles and distinct counts from stored sketches.

A sketch row holds, for one input file and one group, the number of rows, a KLL sketch of
each numeric column and an HLL sketch of each column whose values are to be counted. Rows
merge: any day, campaign or set of files is answered from sketch rows alone, and a new file
costs one pass over that file (``SketchStore``). The exact operators stay the default
(``functions.quantiles``, ``profile.column_profile``).

Null values are counted and not sketched; a group without values has null quantiles and no
distinct value. NaN is no value either.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringlens.sources.incremental import SOURCE, Refresh, refresh_stage
from ringlens.sources.sinks import stage_key

KLL_K, HLL_LG = 200, 12


def rank_error(k: int = KLL_K) -> float:
    """Rank error of a KLL quantile that 99 % of the answers stay within (published fit of the sketch's authors)."""
    return 2.296 / k ** 0.9723


def distinct_error(lg: int = HLL_LG) -> float:
    """Relative standard error of an HLL count after merging."""
    return 1.04 / 2 ** (lg / 2)


def _number(name: str) -> Column:
    c = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(c), c)


def sketch_rows(df: DataFrame, by: list[str], numbers: list[str] = (), counted: list[str] = (), k: int = KLL_K, lg: int = HLL_LG) -> DataFrame:
    """One row for each group ``by``: n, and per column valid_, low_, high_, kll_ (``numbers``) and hll_ (``counted``)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in numbers:
        aggs += [F.count(_number(c)).alias(f"valid_{c}"), F.min(_number(c)).alias(f"low_{c}"), F.max(_number(c)).alias(f"high_{c}"),
                 F.kll_sketch_agg_double(_number(c), k).alias(f"kll_{c}")]
    for c in counted:
        aggs.append(F.hll_sketch_agg(F.col(f"`{c}`").cast("string"), lg).alias(f"hll_{c}"))
    return df.groupBy(*by).agg(*aggs)


def merge_sketches(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sketch rows of the coarser groups ``by`` (none: of everything), from sketch rows alone."""
    merged = {"n": F.sum, "valid": F.sum, "low": F.min, "high": F.max, "kll": F.kll_merge_agg_double, "hll": F.hll_union_agg}
    kinds = [(c, merged.get(c.split("_", 1)[0])) for c in rows.columns if c not in by]
    aggs = [f(F.col(f"`{c}`")).alias(c) for c, f in kinds if f is not None and (c == "n" or "_" in c)]
    return rows.groupBy(*by).agg(*aggs)


def sketched_quantiles(rows: DataFrame, by: list[str], column: str, probabilities: list[float]) -> DataFrame:
    """(by..., p, valid, value): nearest-rank quantiles of ``column``, one row for each group and probability.

    The ends are exact: 0 and 1 give the smallest and largest value seen.
    """
    state = merge_sketches(rows, by).where(F.col(f"valid_{column}") > 0)
    # a sketch takes its rank as a literal
    value = [F.col(f"low_{column}") if p <= 0 else F.col(f"high_{column}") if p >= 1 else F.kll_sketch_get_quantile_double(f"kll_{column}", F.lit(float(p)))
             for p in probabilities]
    each = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(f"valid_{column}").alias("valid"), v.alias("value")) for p, v in zip(probabilities, value)]))
    return state.select(*by, each.alias("q")).select(*by, "q.*")


def sketched_distinct(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """(by..., n, n_distinct): estimated number of different values of ``column`` that are not null."""
    return merge_sketches(rows, by).select(*by, "n", F.hll_sketch_estimate(f"hll_{column}").alias("n_distinct"))


def rank_distance(df: DataFrame, quantiles: DataFrame, by: list[str], column: str) -> DataFrame:
    """``quantiles`` and ``off``: how far each value's exact ranks in ``df`` lie from its probability (0: inside them).

    An audit of the sketches against the rows; one aggregation with map-side combine, no sort.
    """
    asked = quantiles.groupBy(*by).agg(F.collect_list(F.struct("p", "valid", "value")).alias("asked"))
    keys = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    rows = df.select(*by, _number(column).alias("_value")).where("_value is not null")
    # each row counts for the few quantiles of its group where it stands
    # without groups the right side is one row
    both = rows.alias("l").join(asked.alias("r"), keys or F.lit(True)).select(*[F.col(f"l.{c}").alias(c) for c in by], "_value", F.explode("asked").alias("q"))
    share = both.groupBy(*by, "q").agg((F.count_if(F.col("_value") < F.col("q.value")) / F.count(F.lit(1))).alias("below"),
                                       (F.count_if(F.col("_value") <= F.col("q.value")) / F.count(F.lit(1))).alias("up_to"))
    return share.select(*by, "q.*", F.greatest(F.col("below") - F.col("q.p"), F.col("q.p") - F.col("up_to"), F.lit(0.0)).alias("off"))


class SketchStore:
    """Sketch rows per input file and group, kept below ``base``; only new and changed files are read.

    ``read(paths)`` gives the rows of some files with the column ``source_file``.
    """

    def __init__(self, spark: SparkSession, base: str, read: Callable[[list[str]], DataFrame], by: list[str],
                 numbers: list[str] = (), counted: list[str] = (), k: int = KLL_K, lg: int = HLL_LG):
        self.spark, self.base, self.read = spark, base, read
        self.by, self.numbers, self.counted, self.k, self.lg = list(by), list(numbers), list(counted), k, lg

    def refresh(self, inputs: str) -> Refresh:
        """Bring the sketches up to date with the files below ``inputs``; ``rows`` of the result are the sketch rows."""
        def build(paths: list[str]) -> DataFrame:
            return sketch_rows(self.read(paths), [SOURCE, *self.by], self.numbers, self.counted, self.k, self.lg)

        return refresh_stage(self.spark, inputs, self.base, build, rules=stage_key(self.by, self.numbers, self.counted, self.k, self.lg))
