"""Clustering features (M1-M4, P19-P23): encoding, imputation, population scaling, sampling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringlens.functions.quantiles import median_scalar, quantile_scalars
from ringlens.functions.categorical import churn_group, engagement, has_reason, sentiment_ordinal

FEATURES_7 = ["f_duration", "f_hour", "f_engagement", "f_outlier", "f_inconsistency", "f_sentiment", "f_has_reason"]
FEATURES_6 = ["f_duration", "f_hour", "f_engagement", "f_sentiment", "f_has_reason", "f_inconsistency"]


def encode_features(df: DataFrame, duration_fill: float | None = None, no_reason=None) -> DataFrame:
    """M1/M2: seven numeric features; no row is dropped.

    duration (null -> median of ``df`` unless ``duration_fill`` is given), hour,
    engagement ordinal, outlier 0/1, inconsistency 0/1, recorded-sentiment
    ordinal (null -> neutral), has documented churn reason 0/1.
    """
    if duration_fill is None:
        duration_fill = median_scalar(df, "duration_sec")
    kw = {} if no_reason is None else {"no_reason": no_reason}
    return df.withColumns({
        "f_duration": F.coalesce(F.col("duration_sec"), F.lit(float(duration_fill))).cast("double"),
        "f_hour": F.col("hour").cast("double"),
        "f_engagement": engagement("disconnected_reason"),
        "f_outlier": F.coalesce(F.col("duration_outlier").cast("double"), F.lit(0.0)),
        "f_inconsistency": F.coalesce(F.col("inconsistency_flag").cast("double"), F.lit(0.0)),
        "f_sentiment": sentiment_ordinal("pca_sentimiento"),
        "f_has_reason": has_reason("pca_razon_churn", **kw),
    })


def prepare_variables(df: DataFrame) -> DataFrame:
    """Churn macro group, booleans as 0/1, reason null -> unknown (K-Prototypes inputs)."""
    out = {
        "razon_grupo": churn_group("pca_razon_churn"),
        "disconnected_reason": F.coalesce(F.col("disconnected_reason"), F.lit("unknown")),
    }
    for c in ("duration_outlier", "inconsistency_flag"):
        if c in df.columns:
            out[f"{c}_i"] = F.coalesce(F.col(c).cast("int"), F.lit(0))
    return df.withColumns(out)


@dataclass(frozen=True)
class Scaler:
    """Standard scaling with the *population* std; zero variance maps to 0."""
    columns: tuple
    means: tuple
    stds: tuple

    def transform(self, df: DataFrame, suffix: str = "_z") -> DataFrame:
        out = {}
        for c, m, s in zip(self.columns, self.means, self.stds):
            out[c + suffix] = F.lit(0.0) if not s else (F.col(c) - F.lit(m)) / F.lit(s)
        return df.withColumns(out)


def fit_scaler(df: DataFrame, columns: list[str]) -> Scaler:
    """M3: means and population stds in one aggregation (fit on a subset, apply to all)."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    return Scaler(tuple(columns), tuple(float(row[f"m_{c}"] or 0.0) for c in columns),
                  tuple(float(row[f"s_{c}"] or 0.0) for c in columns))


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="keep").transform(df)


def hash_sample(df: DataFrame, n: int, key: str = "call_id", seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, reproducible under any partitioning.

    Rows are ordered by a seeded 64-bit hash of the key; ``limit`` after an
    ``orderBy`` is a distributed top-k (each task keeps at most ``n`` rows).
    """
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(n)


# parameters of the portable sampling key: a prime modulus and a seeded multiplier
SAMPLE_PRIME = 2147483647
SAMPLE_BASE = 48271


def portable_key(col, seed: int = 42):
    """Seeded pseudo-random order key ``(col mod p) * m mod p`` for a non-negative integer key.

    ``m = 48271^(1000 + seed) mod p``: consecutive keys land far apart,
    every intermediate value stays below 2^62 (no overflow), and the same
    arithmetic gives the same order in any SQL engine.
    """
    m = pow(SAMPLE_BASE, 1000 + seed, SAMPLE_PRIME)
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.pmod(c.cast("long"), F.lit(SAMPLE_PRIME)) * F.lit(m), F.lit(SAMPLE_PRIME))


def share_sample(df: DataFrame, share: float = 0.15, least: int = 500, key: str = "call_id", seed: int = 42) -> DataFrame:
    """M4: ``share`` of the rows, at least ``least`` (or all), the first by ``portable_key``.

    The last key that is in comes from value counts cut into ranges, so a sample that grows with the
    table passes through no single task. Keys are taken to be unique.
    """
    total = df.count()
    n = min(total, max(least, int(total * share)))
    if n == total:
        return df
    (last,) = quantile_scalars(df, [(portable_key(key, seed), "nearest", (n - 1) / (total - 1))])
    return df.where(portable_key(key, seed) <= F.lit(int(last)))


def hash_sample_per_group(df: DataFrame, group: str, n: int, key: str = "call_id", seed: int = 42,
                          buckets: int = 64) -> DataFrame:
    """Up to ``n`` rows per group (fewer when the group is smaller), exact and skew-safe.

    Rows are ordered by ``portable_key(key, seed)`` (ties by key). Stage 1
    keeps the ``n`` first inside each (group, key bucket) so even a group
    holding a third of all rows is split over ``buckets`` tasks; stage 2
    picks the ``n`` first of those <= n x buckets candidates per group. The
    global first-n of a group is always among the per-bucket first-n, so the
    result equals a single-stage top-n.
    """
    from pyspark.sql import Window

    x = df.withColumn("_h", portable_key(key, seed)).withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)))
    w1 = Window.partitionBy(group, "_b").orderBy("_h", key)
    cand = x.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= n).drop("_r")
    w2 = Window.partitionBy(group).orderBy("_h", key)
    return cand.withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= n).drop("_r", "_h", "_b")


def labelled_samples(df: DataFrame, labels: list[tuple[Column, int]], out: str = "sample", key: str = "call_id", seed: int = 42,
                     buckets: int = 64) -> DataFrame:
    """O4 for labels that overlap: up to n rows of each label, all from one scan, the label in column ``out``.

    ``labels``: pairs (string column: the row's label, null where it has none; n). A row may carry
    several labels and stands once under each whose first n (by ``portable_key``, ties by key) it
    is among. The first rows of each (label, key bucket) are taken inside the tasks before the
    shuffle, so a label on a third of all rows sends at most n rows per task and bucket.
    """
    from pyspark.sql import Window

    most = max(n for _, n in labels)
    marks = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(c.alias("label"), F.lit(n).alias("n"))) for c, n in labels]))
    x = (df.withColumn("_m", F.explode(marks)).withColumns({out: F.col("_m.label"), "_n": F.col("_m.n")}).drop("_m")
         .withColumn("_h", portable_key(key, seed)).withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets))))
    for parts in ([out, "_n", "_b"], [out, "_n"]):
        w = Window.partitionBy(*parts).orderBy("_h", key)
        x = x.withColumn("_r", F.row_number().over(w)).filter((F.col("_r") <= most) & (F.col("_r") <= F.col("_n"))).drop("_r")
    return x.drop("_n", "_h", "_b")
