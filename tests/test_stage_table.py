"""The shared stage table is keyed by the input files: changed input -> new table, same input -> reused."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from ringlens import constants
from ringlens.plans import stages
from ringlens.sources.sinks import reuse_or_build


def test_stage_table_follows_its_input(spark):
    d = tempfile.mkdtemp(prefix="ringlens-stage-input-")
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    events.write.mode("overwrite").parquet(f"{d}/events.parquet")
    stages.clear()
    first = stages.table(spark, d).count()
    stages.clear()
    again = stages.table(spark, d)
    assert again.count() == first
    # change the input: drop a tenth of the events
    events.filter(F.col("event_id") % 10 != 0).write.mode("overwrite").parquet(f"{d}/events.parquet")
    stages.clear()
    changed = stages.table(spark, d).count()
    assert changed == events.filter(F.col("event_id") % 10 != 0).count() and changed < first
    stages.clear()


def test_stage_table_needs_no_clear(spark):
    d = tempfile.mkdtemp(prefix="ringlens-stage-input-")
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    events.write.parquet(f"{d}/events.parquet")
    first = stages.table(spark, d).count()
    events.filter(F.col("event_id") % 10 != 0).write.mode("overwrite").parquet(f"{d}/events.parquet")
    assert stages.table(spark, d).count() < first


def test_changed_rule_gives_another_table(spark, monkeypatch):
    def shares():
        return {r["campaign_type"]: r["count"] for r in stages.table(spark, SF_SMALL).groupBy("campaign_type").count().collect()}

    before = shares()
    monkeypatch.setattr(constants, "REPEAT_MIN_CHARS", constants.REPEAT_MIN_CHARS + 1)
    key = stages._rules()
    monkeypatch.undo()
    assert key != stages._rules() and shares() == before


def test_half_written_stage_is_built_again(spark):
    base = tempfile.mkdtemp(prefix="ringlens-stage-half-")
    whole = spark.range(1000).repartition(4)
    whole.write.parquet(f"{base}/key/one")
    files = sorted(f for f in os.listdir(f"{base}/key/one") if f.startswith("part-"))
    for f in files[1:] + ["_SUCCESS"]:
        os.replace(f"{base}/key/one/{f}", f"{base}/{f}")
    assert reuse_or_build(spark, base, "key", lambda: whole).count() == 1000
    built = []
    again = reuse_or_build(spark, base, "key", lambda: built.append(1) or whole)
    assert again.count() == 1000 and not built
