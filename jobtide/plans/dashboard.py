"""User-facing result sets over the published metric tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobtide.functions.scoring import bucket_status
from jobtide.operators.emerging import emerging_skills
from jobtide.operators.trend import history_slice, jobs_trend, role_trend, skill_trend


def latest_date(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.max("metric_date").alias("metric_date"))


def _on_latest(metrics: DataFrame, history_days: int = 0) -> tuple[DataFrame, Column]:
    """Rows the latest date needs, and the test for that date.

    The date is a scalar subquery on the partition column: older partitions
    are pruned before the scan.
    """
    latest = latest_date(metrics).scalar()
    day = F.col("metric_date")
    return metrics.filter((day >= F.date_sub(latest, history_days)) & (day <= latest)), day == latest


def overview(market: DataFrame, day: str | None = None) -> DataFrame:
    """One row for the date, or the latest; NULL figures when it has no row."""
    asked = (
        market.sparkSession.range(1).select(F.lit(day).cast("date").alias("metric_date")) if day else latest_date(market)
    )
    rows = jobs_trend(market)
    return asked.join(rows, "metric_date", "left").select(
        "metric_date",
        F.col("market_health_score").alias("health_score"),
        bucket_status("market_health_score").alias("health_status"),
        "total_jobs", "change_1d", "change_7d", "change_30d", "unique_companies", "average_applicants",
    )


def skills_ranked(skill_metrics: DataFrame, skills: DataFrame) -> DataFrame:
    """Latest skills with 7 and 30 day change, most demanded first."""
    history, today = _on_latest(skill_metrics, 30)
    names = skills.select(F.col("normalized_name").alias("skill_id"), "name")
    return (
        skill_trend(history)
        .filter(today)
        .join(names, "skill_id")
        .select("metric_date", "name", "job_count", "demand_percentage", "change_7d", "change_30d")
        .orderBy(F.desc("demand_percentage"), "name")
    )


def emerging_ranked(skill_metrics: DataFrame, skills: DataFrame, day: str, **limits) -> DataFrame:
    """Emerging skills, highest score first, unavailable ones last."""
    return emerging_skills(skill_metrics, skills, day, **limits).orderBy(
        F.coalesce("emerging_score", F.lit(-1.0)).desc(), "skill"
    )


def emerging_available(skill_metrics: DataFrame, skills: DataFrame, day: str, **limits) -> DataFrame:
    return emerging_ranked(skill_metrics, skills, day, **limits).filter("available")


def roles_ranked(role_metrics: DataFrame) -> DataFrame:
    history, today = _on_latest(role_metrics, 7)
    return (
        role_trend(history)
        .filter(today)
        .select("metric_date", "role", "job_count", "demand_percentage", F.col("change_7d").alias("trend"))
        .orderBy(F.desc("demand_percentage"), "role")
    )


def capabilities_ranked(capability_metrics: DataFrame, capabilities: DataFrame) -> DataFrame:
    rows, _ = _on_latest(capability_metrics)
    names = capabilities.select(F.col("normalized_name").alias("capability_id"), "name")
    return (
        rows.join(names, "capability_id")
        .select("metric_date", "name", "job_count", "demand_percentage")
        .orderBy(F.desc("demand_percentage"), "name")
    )


def dimension_ranked(metrics: DataFrame, dim: str) -> DataFrame:
    """Latest seniority, location or industry figures."""
    rows, _ = _on_latest(metrics)
    return rows.select("metric_date", dim, "job_count", "demand_percentage").orderBy(F.desc("demand_percentage"), dim)


def jobs_list(jobs: DataFrame, job_roles: DataFrame) -> DataFrame:
    """All jobs with role and seniority, newest posting first."""
    roles = job_roles.select("job_id", "actual_role", "seniority")
    columns = [c for c in jobs.columns if c not in ("job_id", "last_seen_at")]
    return (
        jobs.join(roles, "job_id", "left")
        .select("job_id", *columns, "actual_role", "seniority")
        .orderBy(F.col("posted_at").desc_nulls_last(), F.desc("first_seen_at"), "job_id")
    )


def ranked_bars(rows: DataFrame, label: str, value: str = "demand_percentage", n: int = 12) -> DataFrame:
    """First n rows with the bar width relative to the largest shown value."""
    amount = F.coalesce(F.col(value), F.lit(0.0))
    shown = rows.orderBy(F.col(value).desc_nulls_last(), label).limit(n)
    # The window sees only the n rows left by the limit.
    largest = F.greatest(F.max(amount).over(W.partitionBy()), F.lit(1.0))
    return shown.select(
        F.coalesce(F.col(label), F.lit("Unknown")).alias("label"),
        F.col("job_count").alias("count"),
        amount.alias("value"),
        (amount / largest * 100).alias("width"),
    )


def trends_report(
    market: DataFrame, skill_metrics: DataFrame, skills: DataFrame, health: DataFrame, day: str, top: int = 5
) -> DataFrame:
    """(section, name, metric, value): job trends, top skills, emerging skills, health."""
    today = F.col("metric_date") == F.lit(day).cast("date")

    def facts(df: DataFrame, section: str, name: Column, metrics: dict[str, str]) -> DataFrame:
        pairs = F.array(
            *[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, c in metrics.items()]
        )
        return df.select(F.lit(section).alias("section"), name.alias("name"), F.inline(pairs))

    jobs = jobs_trend(market).filter(today)
    history = history_slice(skill_metrics, day, 30)
    names = skills.select(F.col("normalized_name").alias("skill_id"), "name")
    best = (
        skill_trend(history).filter(today).join(names, "skill_id").orderBy(F.desc("demand_percentage"), "name").limit(top)
    )
    changes = {"change_7d": "change_7d", "change_30d": "change_30d"}
    return reduce(
        DataFrame.unionByName,
        [
            facts(jobs, "jobs", F.lit("all"), {"change_1d": "change_1d", **changes}),
            facts(best, "skills", F.col("name"), changes),
            facts(emerging_skills(skill_metrics, skills, day), "emerging", F.col("skill"), {"score": "emerging_score"}),
            facts(health.filter(today), "health", F.col("status"), {"score": "score"}),
        ],
    )


def snapshot_dates(metric_tables: dict[str, DataFrame]) -> DataFrame:
    """Latest date per table and whether all tables agree."""
    dates = reduce(
        DataFrame.unionByName,
        [latest_date(df).select(F.lit(name).alias("table_name"), "metric_date") for name, df in metric_tables.items()],
    )
    everything = W.partitionBy()  # one row per table
    newest, oldest = F.max("metric_date").over(everything), F.min("metric_date").over(everything)
    filled = F.count("metric_date").over(everything)
    same = (newest == oldest) & (filled == len(metric_tables))
    return dates.withColumn("consistent", F.coalesce(same, F.lit(False)))
