"""Sinks and stage checkpoints.

Stage hand-over is a Parquet table (columnar, splittable, schema kept), not a
CSV file. ``reuse_or_build`` keys a stage table by a hash of its inputs and
rules, so changed inputs or rules never silently reuse a stale table.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ringlens.session import ensure_checkpoint_dir


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Write a stage table (Parquet by default; ``fmt='csv'`` writes a header and doubles quotes inside fields)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)


def write_observed(df: DataFrame, path: str, checks: dict[str, Column], **how) -> dict:
    """``write_table`` that also returns the aggregate ``checks`` over the rows it writes, without a second scan.

    ``how`` as for ``write_table``. The values come with the end of the write; a failed write raises.
    """
    seen = Observation()
    write_table(df.observe(seen, *[c.alias(name) for name, c in checks.items()]), path, **how)
    return seen.get


def write_samples_csv(df: DataFrame, path: str) -> None:
    """Small audit samples as CSV (one file per task; the samples are bounded by construction)."""
    write_table(df, path, fmt="csv")


def stage_key(*parts) -> str:
    """Stable key of a stage's inputs and parameters."""
    blob = json.dumps(parts, sort_keys=True, default=str).encode()
    return hashlib.sha1(blob).hexdigest()[:16]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ringlens-tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _complete(spark: SparkSession, path: str) -> list[str]:
    """Finished writes below ``path``, oldest first: those with a ``_SUCCESS`` file."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    done = []
    for child in fs.listStatus(folder):
        mark = jvm.org.apache.hadoop.fs.Path(child.getPath(), "_SUCCESS")
        if child.isDirectory() and fs.exists(mark):
            done.append((fs.getFileStatus(mark).getModificationTime(), child.getPath().toString()))
    return [p for _, p in sorted(done)]


def reuse_or_build(spark: SparkSession, base_dir: str, key: str, build, expected_cols: list[str] | None = None,
                   expected_rows: int | None = None, min_rows: int | None = None) -> DataFrame:
    """Read a finished table below ``base_dir/key`` that passes the checks, else build, write and read one.

    Every write has a folder of its own below the key: an interrupted one has no ``_SUCCESS`` and
    is never read, and two sessions that build one key do not touch each other's files.

    Checks: required columns present; row count equal to ``expected_rows`` /
    at least ``min_rows`` (one ``count()`` when a row check is requested).
    """
    path = f"{base_dir.rstrip('/')}/{key}"
    for done in _complete(spark, path):
        cached = spark.read.parquet(done)
        ok = not expected_cols or set(expected_cols) <= set(cached.columns)
        if ok and (expected_rows is not None or min_rows is not None):
            n = cached.count()
            ok = (expected_rows is None or n == expected_rows) and (min_rows is None or n >= min_rows)
        if ok:
            return cached
    own = f"{path}/{uuid.uuid4().hex}"
    write_table(build(), own, mode="errorifexists")
    return spark.read.parquet(own)


def attach_checkpoint(df: DataFrame, checkpoint: DataFrame, key: str = "call_url", fill: dict | None = None) -> DataFrame:
    """Left join of a (key + new columns) checkpoint, one row per key.

    Of rows that disagree about a key the smallest (column by column) counts, whatever order they arrive in.
    """
    new_cols = [c for c in checkpoint.columns if c != key]
    right = checkpoint.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*new_cols)).alias("_new")).select(key, "_new.*")
    out = df.drop(*[c for c in new_cols if c in df.columns]).join(right, key, "left")
    return out.na.fill(fill) if fill else out
