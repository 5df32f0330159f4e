"""Physical-plan checks: no Python in the hot path, pruning/pushdown, no single-partition sorts of raw rows."""

import __spark_entry__ as E

from conftest import SF_SMALL
from ringlens.plans.registry import all_queries


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_udf_in_text_core(spark):
    q = E.queries()
    for name in ["sentiment_rows", "agent_failures", "clean_rows", "window_score_top10"]:
        plan = _plan(q[name](spark, SF_SMALL))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(E.queries()["rate_by_hour"](spark, SF_SMALL))
    assert "ReadSchema: struct<connected:boolean,hour:int>" in plan


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["day_of_week", "hour", "total", "connected_count", "connection_rate"]
    assert len(rows) <= 10


def test_registry_names_and_sql():
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    assert len(q) >= 60


_MODEL_FITS = {"kmeans_clusters", "kmeans_k_selection", "kmeans_quality", "kmeans_trained_on_complete",
               "kmeans_ordinal_baseline", "kprototypes_clusters", "kprototypes_k_selection", "feature_recommendation", "exclusion_verdict",
               "segment_mannwhitney"}


def test_quantiles_never_meet_in_one_task(spark, monkeypatch):
    """Neither the plans nor the jobs run while a plan is built hold a percentile aggregate."""
    from ringlens.functions import quantiles

    seen = []
    real = quantiles.materialise
    monkeypatch.setattr(quantiles, "materialise", lambda df, name: seen.append(_plan(df)) or real(df, name))
    q = E.queries()
    for name in ["box_duration_by_day", "campaign_order_by_median", "duration_by_sentiment", "kept_vs_removed",
                 "elimination_cause_detail", "segment_duration_describe", "cluster_profile_fixed"]:
        seen.append(_plan(q[name](spark, SF_SMALL)))
    assert len(seen) > 7
    assert not [plan for plan in seen if "percentile(" in plan or "percentile_disc(" in plan or "median(" in plan]


def test_plans_have_no_python_and_no_single_partition_on_raw_rows(spark):
    """Every registered report: no Python evaluation node, and each SinglePartition exchange
    sits directly on an aggregate or a limit (i.e. on already reduced data), never on raw rows."""
    bad = []
    for name, build in E.queries().items():
        if name in _MODEL_FITS or name not in all_queries():  # reports only: the optional subpackage has tests of its own
            continue
        plan = _plan(build(spark, SF_SMALL))
        for node in ["BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"]:
            if node in plan:
                bad.append((name, node))
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" not in line:
                continue
            j, child = i + 1, ""
            while j < len(lines):  # look through unary projections/filters to the producing operator
                child = lines[j].strip().lstrip("+-: ").split("(")[0].split(" ")[0]
                if child not in ("Project", "Filter"):
                    break
                j += 1
            if not any(k in child for k in ("Aggregate", "Limit", "TakeOrdered")):
                bad.append((name, child))
    assert not bad, bad
