"""Market-health score of every date from the market and role series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide import fixed
from jobtide.functions.scoring import bucket_status, clamp, minmax, rescale_pct, round2, so_far
from jobtide.operators.daily import entry_mid_share
from jobtide.operators.trend import trend_pct


def market_health(
    market: DataFrame, role_metrics: DataFrame, job_roles: DataFrame, labels: list[str] = fixed.ENTRY_MID_LABELS
) -> DataFrame:
    """(metric_date, score, status); NULL score before seven snapshots.

    All windows run over one row per date.
    """
    diversity = role_metrics.groupBy("metric_date").agg(F.count(F.lit(1)).alias("roles"))
    accessible = entry_mid_share(job_roles, labels).scalar()
    past = so_far()
    # Growth looks at market rows only. A date with roles but no market row
    # still counts in the diversity series, hence the full join afterwards.
    grown = market.select(
        "metric_date", "total_jobs", "unique_companies", "average_applicants",
        F.lit(True).alias("in_market"),
        round2(trend_pct("total_jobs", None, 7)).alias("growth"),
    )
    parts = grown.join(diversity, "metric_date", "full").select(
        "metric_date",
        "in_market",
        F.count("in_market").over(past).alias("snapshots"),
        minmax(F.col("total_jobs"), F.col("total_jobs"), past).alias("volume"),
        F.coalesce(rescale_pct(F.col("growth")), F.lit(50.0)).alias("growth"),
        minmax(F.col("unique_companies"), F.col("unique_companies"), past).alias("companies"),
        F.when(
            F.col("average_applicants").isNotNull(),
            100 - minmax(F.col("average_applicants"), F.col("average_applicants"), past),
        ).otherwise(F.lit(50.0)).alias("competition"),
        minmax(F.coalesce("roles", F.lit(0)), F.col("roles"), past).alias("diversity"),
    )
    score = round2(
        0.30 * F.col("volume")
        + 0.20 * F.col("growth")
        + 0.15 * F.col("companies")
        + 0.15 * F.col("competition")
        + 0.10 * F.col("diversity")
        + 0.10 * clamp(F.coalesce(accessible, F.lit(50.0)), 0, 100)
    )
    return (
        parts.filter("in_market")
        .withColumn("score", F.when(F.col("snapshots") >= 7, score))
        .select("metric_date", "score", bucket_status("score").alias("status"))
    )


def apply_health(market: DataFrame, health: DataFrame) -> DataFrame:
    """Write the scores that exist into the market table, keep the others."""
    new = health.select("metric_date", F.col("score").alias("_score"))
    return (
        market.join(new, "metric_date", "left")
        .withColumn("market_health_score", F.coalesce("_score", "market_health_score"))
        .select(*market.columns)
    )


def upsert_market_row(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace the figures of the given dates, keep an existing health score."""
    figures = ["total_jobs", "unique_companies", "average_applicants"]
    joined = old.alias("o").join(new.alias("n"), "metric_date", "full")
    replaced = F.col("n.total_jobs").isNotNull()
    return joined.select(
        "metric_date",
        *[F.when(replaced, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in figures],
        F.col("o.market_health_score"),
    )
