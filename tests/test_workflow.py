"""End-to-end run on a raw CSV written from the sf0.001 call view."""

import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from ringlens.constants import COLUMN_RENAME
from ringlens.plans import stages
from ringlens.plans.workflow import run_calls_workflow
from ringlens.sources.calls import load_calls


def test_workflow_on_raw_csv(spark):
    d = tempfile.mkdtemp(prefix="ringlens-wf-")
    inverse = {v: k for k, v in COLUMN_RENAME.items()}
    calls = load_calls(spark, SF_SMALL).drop("call_completed", "call_id")
    raw = calls.select(*[F.col(c).cast("string").alias(inverse[c]) for c in COLUMN_RENAME.values()])
    raw.coalesce(1).write.option("header", True).option("escape", '"').csv(f"{d}/raw")
    out = run_calls_workflow(spark, f"{d}/raw", f"{d}/out", k=4, n_init=2)
    n = out["calls"].count()
    assert n == calls.count()
    # the clean table equals the registered pipeline's clean rows (same rules, same limits)
    ref = stages.clean(spark, SF_SMALL).count()
    assert out["clean"].count() == ref
    ids = {r[0] for r in out["calls"].select("cluster_id").distinct().collect()}
    assert ids <= {-1, 0, 1, 2, 3}
    assert out["top_windows"].count() <= 10
    assert spark.read.parquet(f"{d}/out/clusters_contacts").count() == out["clean"].filter("connected").count()
    # the audit sample: CSV, up to 20 clean calls of every campaign type
    sample = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{d}/out/samples_by_campaign")
    sizes = {r["campaign_type"]: r["count"] for r in out["clean"].groupBy("campaign_type").count().collect()}
    assert {r["campaign_type"]: r["count"] for r in sample.groupBy("campaign_type").count().collect()} == {c: min(20, n) for c, n in sizes.items()}
    assert sample.join(out["clean"], "call_id", "left_semi").count() == sample.count()
