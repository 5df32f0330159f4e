"""Helpers shared by the training-data operators: scratch tables and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringlens.session import ensure_checkpoint_dir

#: Rows of one Arrow batch sent to Python: texts may be long, so batches stay small.
ARROW_ROWS = 512


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a Python worker never holds many long texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


class Scratch:
    """Intermediate tables as Parquet in the shared folder of ``spark.checkpoint.dir``.

    A written table cuts the lineage: a lost executor re-reads it instead of
    recomputing the stages before it. ``drop`` removes tables that no returned
    DataFrame reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ringlens-llm/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self.kept = [*getattr(self, "kept", []), out]  # keeps id(out) from being reused
        return out

    def drop_others(self, *kept: DataFrame) -> None:
        """Remove every table but ``kept``."""
        self.drop(*[t for t in getattr(self, "kept", []) if all(t is not k for k in kept)])

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.paths.get(id(t))
            if path:
                p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drawn(draw: Column, wanted: int, n: int) -> Column:
    """Whether a row is among about ``wanted`` of ``n``, by the hash ``draw``; the share keeps 40 bits, so it never rounds to none."""
    share = min(1.0, wanted / max(n, 1))
    return F.pmod(draw, F.lit(1 << 40)) < F.lit(max(1, round(share * (1 << 40))))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node per node, for undirected ``edges (a, b)`` of one orderable type.

    Alternating large-star and small-star rounds. Each round is a ``min`` per
    node (combined before the shuffle) joined back to the edges, so a hub with
    very many edges is split by the skew join and never gathered in one group.
    Every round is written to the shared folder. Returns (node, component) for
    the nodes that have an edge to another node; others are their own component.
    """
    cur = scratch.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .where("a <> b").distinct())

    def state(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = state(cur)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        # large star: neighbours above the node point to the smallest of its neighbourhood
        both = cur.select("a", "b").unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = scratch.table(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                              .where("a <> b").distinct())
        # small star: neighbours below the node, and the node itself, point to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = scratch.table(down.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        after = state(nxt)
        scratch.drop(cur, large)
        cur, done = nxt, after == before
        before = after
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionByName(roots)
