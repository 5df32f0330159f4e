"""Registered queries: answers from merged sketches, held against the rows they were made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringlens.operators import sketches as S
from ringlens.plans import oracle_sql as O
from ringlens.plans.registry import register
from ringlens.plans.stages import table

PROBABILITIES, WIDE_K = [0.05, 0.25, 0.5, 0.75, 0.95], 1000


@register("sketch_quantiles_by_campaign", O.with_stage("prepared", [], f"""
SELECT campaign_type, CAST(p AS DOUBLE) AS p, count(duration_sec) AS valid, TRUE AS within_bound
FROM prepared, (SELECT unnest([{', '.join(map(str, PROBABILITIES))}]) AS p)
GROUP BY campaign_type, p HAVING count(duration_sec) > 0"""), "A20")
def sketch_quantiles_by_campaign(spark, sf):
    """Quantiles per campaign type from sketches per (day, campaign type); within twice the 99 % rank error of the exact ranks."""
    calls = table(spark, sf)
    rows = S.sketch_rows(calls, ["date", "campaign_type"], numbers=["duration_sec"], k=WIDE_K)
    asked = S.sketched_quantiles(rows, ["campaign_type"], "duration_sec", PROBABILITIES)
    off = S.rank_distance(calls, asked, ["campaign_type"], "duration_sec")
    return off.select("campaign_type", F.col("p").cast("double").alias("p"), "valid", (F.col("off") <= 2 * S.rank_error(WIDE_K)).alias("within_bound"))


@register("sketch_distinct_contacts", O.with_stage("prepared", [], """
SELECT campaign_type, count(*) AS n, count(DISTINCT target_id) AS n_exact, TRUE AS within_bound FROM prepared GROUP BY campaign_type"""), "A28")
def sketch_distinct_contacts(spark, sf):
    """Different contacts per campaign type from sketches per (day, campaign type); within five standard errors of the exact count."""
    calls = table(spark, sf)
    rows = S.sketch_rows(calls, ["date", "campaign_type"], counted=["target_id"])
    guess = S.sketched_distinct(rows, ["campaign_type"], "target_id").withColumnRenamed("campaign_type", "c")
    exact = calls.groupBy("campaign_type").agg(F.count_distinct("target_id").alias("n_exact"))
    near = F.abs(F.col("n_distinct") - F.col("n_exact")) <= 1 + 5 * S.distinct_error() * F.col("n_exact")
    return exact.join(guess, F.col("campaign_type").eqNullSafe(F.col("c"))).select("campaign_type", "n", "n_exact", near.alias("within_bound"))
