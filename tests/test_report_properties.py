"""Report-level properties: partition invariance, shares, accounting, id ranges."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from ringlens.operators import elimination as EL
from ringlens.operators.contact import category_share
from ringlens.operators.reports import value_counts
from ringlens.plans import stages

INVARIANT = ["top_windows", "heat_grid", "sentiment_share_by_campaign", "segment_mannwhitney", "spearman_matrix",
             "cramers_v_matrix", "eta_squared_matrix", "column_profile", "cluster_profile_fixed", "duration_histogram"]


def _rows(df):
    def norm(v):
        if isinstance(v, float):
            return ("nan",) if math.isnan(v) else round(v, 9)
        return v
    return sorted((tuple(norm(x) for x in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", INVARIANT)
def test_results_do_not_depend_on_partitioning(spark, name):
    q = E.queries()[name]
    out = []
    for parts in ("1", "7", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        stages.clear()
        out.append(_rows(q(spark, SF_SMALL)))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    stages.clear()
    assert out[0] == out[1] == out[2]


def test_shares_sum_to_one(spark):
    t = stages.table(spark, SF_SMALL)
    shares = category_share(t, "day_of_week", "disconnected_reason")
    sums = shares.groupBy("day_of_week").agg(F.sum("pct").alias("s")).collect()
    assert all(abs(r["s"] - 1.0) < 1e-12 for r in sums)
    vc = value_counts(t, "campaign_type")
    assert abs(vc.agg(F.sum("pct")).first()[0] - 1.0) < 1e-12


def test_kept_plus_removed_is_input(spark):
    t = stages.table(spark, SF_SMALL)
    fence = stages.limits(spark, SF_SMALL)[1]
    n = t.count()
    by_hour = EL.removed_by(t, fence, "hour").agg(F.sum("kept"), F.sum("removed")).first()
    assert by_hour[0] + by_hour[1] == n
    clean = stages.clean(spark, SF_SMALL)
    gone = EL.eliminated_rows(t, clean, "call_id")
    assert clean.count() + gone.count() == n


def test_cluster_ids_in_range(spark):
    ids = {r[0] for r in E.queries()["cluster_assign_fixed"](spark, SF_SMALL).select("cluster_id").distinct().collect()}
    assert ids <= {-1, 0, 1, 2, 3}
