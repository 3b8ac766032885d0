"""Metrics of one date, always bounded to the jobs known on that date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.scoring import share
from jobtide.functions.text import norm_key


def as_date(day: str | dt.date) -> dt.date:
    return day if isinstance(day, dt.date) else dt.date.fromisoformat(day)


def as_of(jobs: DataFrame, day: str | dt.date) -> DataFrame:
    """Jobs first seen before the end of the day; the bound reaches the scan."""
    bound = as_date(day) + dt.timedelta(days=1)
    return jobs.filter(F.col("first_seen_at") < F.lit(str(bound)).cast("timestamp_ntz"))


def total_jobs(jobs: DataFrame, day: str | dt.date) -> DataFrame:
    return as_of(jobs, day).agg(F.count(F.lit(1)).alias("total_jobs"))


def _total(jobs: DataFrame, day: str | dt.date) -> Column:
    return total_jobs(jobs, day).scalar()


def _finish(counts: DataFrame, jobs: DataFrame, day: str | dt.date, dim: str) -> DataFrame:
    rest = [c for c in counts.columns if c not in (dim, "job_count")]
    return counts.select(
        F.lit(as_date(day)).alias("metric_date"),
        dim,
        "job_count",
        share(F.col("job_count"), _total(jobs, day)).alias("demand_percentage"),
        *rest,
    )


def daily_market_metrics(jobs: DataFrame, day: str | dt.date) -> DataFrame:
    # The distinct count is planned as a two-level aggregate; NULL companies
    # and NULL applicants drop out of their aggregates.
    return as_of(jobs, day).agg(
        F.lit(as_date(day)).alias("metric_date"),
        F.count(F.lit(1)).alias("total_jobs"),
        F.count_distinct("company").alias("unique_companies"),
        F.avg("applicants").alias("average_applicants"),
    )


def _known(rows: DataFrame, jobs: DataFrame, day: str | dt.date) -> DataFrame:
    """Rows of jobs known on the date (jobs are unique on job_id)."""
    return rows.join(as_of(jobs, day).select("job_id"), "job_id", "left_semi")


def daily_skill_metrics(job_skills: DataFrame, jobs: DataFrame, day: str | dt.date) -> DataFrame:
    """Jobs per skill, also by priority.

    The bridge holds a (job, skill) pair once, so plain counts equal distinct
    ones and are combined before the shuffle.
    """
    priority = F.col("priority")
    counts = (
        _known(job_skills, jobs, day)
        .groupBy("skill_id")
        .agg(
            F.count(F.lit(1)).alias("job_count"),
            F.count_if(priority == "critical").alias("critical_count"),
            F.count_if(priority == "important").alias("important_count"),
            F.count_if(priority == "preferred").alias("preferred_count"),
        )
    )
    return _finish(counts, jobs, day, "skill_id")


def daily_capability_metrics(job_capabilities: DataFrame, jobs: DataFrame, day: str | dt.date) -> DataFrame:
    counts = _known(job_capabilities, jobs, day).groupBy("capability_id").agg(F.count(F.lit(1)).alias("job_count"))
    return _finish(counts, jobs, day, "capability_id")


def daily_dimension_metrics(rows: DataFrame, jobs: DataFrame, day: str | dt.date, dim: str) -> DataFrame:
    """Jobs per non-NULL value of a one-per-job column."""
    source = as_of(rows, day) if "first_seen_at" in rows.columns else _known(rows, jobs, day)
    counts = source.filter(F.col(dim).isNotNull()).groupBy(dim).agg(F.count(F.lit(1)).alias("job_count"))
    return _finish(counts, jobs, day, dim)


def daily_seniority_metrics(job_roles: DataFrame, jobs: DataFrame, day: str | dt.date) -> DataFrame:
    return daily_dimension_metrics(job_roles, jobs, day, "seniority")


def daily_location_metrics(jobs: DataFrame, day: str | dt.date) -> DataFrame:
    return daily_dimension_metrics(jobs, jobs, day, "city")


def daily_industry_metrics(jobs: DataFrame, day: str | dt.date) -> DataFrame:
    return daily_dimension_metrics(jobs, jobs, day, "industry")


def final_roles(roles: DataFrame) -> DataFrame:
    """(normalized_name, role, multi_hop): every role with its merge target."""
    source, final = roles.alias("s"), roles.alias("f")
    target = F.coalesce(F.col("s.merged_into_id"), F.col("s.normalized_name"))
    return source.join(final, target == F.col("f.normalized_name")).select(
        F.col("s.normalized_name"),
        F.col("f.name").alias("role"),
        F.col("f.merged_into_id").isNotNull().alias("multi_hop"),
    )


def unmatched_roles(job_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """Distinct actual roles without an entry in the roles table."""
    used = job_roles.filter("actual_role IS NOT NULL").select("actual_role").distinct()
    return (
        used.withColumn("normalized_name", norm_key("actual_role"))
        .join(roles.select("normalized_name"), "normalized_name", "left_anti")
        .select("actual_role")
    )


def daily_role_metrics(job_roles: DataFrame, roles: DataFrame, jobs: DataFrame, day: str | dt.date) -> DataFrame:
    """Jobs per role after merges.

    Counted per raw role text first, so the join with the roles table sees
    one row per text. A role without an entry, or a target that is itself
    merged, fails the query.
    """
    texts = _known(job_roles, jobs, day).filter("actual_role IS NOT NULL").groupBy("actual_role").agg(F.count(F.lit(1)).alias("n"))
    return _finish(role_counts(texts, roles), jobs, day, "role")


def role_counts(texts: DataFrame, roles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """job_count per role after merges, out of counts ``n`` per role text (and the columns ``by``)."""
    bad = F.when(F.col("role").isNull(), "actual role without a roles row: ").when(
        F.col("multi_hop"), "role resolved to a merged role: "
    )
    checked = (
        texts.withColumn("normalized_name", norm_key("actual_role"))
        .join(final_roles(roles), "normalized_name", "left")
        .withColumn(
            "role",
            F.when(bad.isNotNull(), F.raise_error(F.concat(bad, "actual_role"))).otherwise(F.col("role")),
        )
    )
    return checked.groupBy(*(by or []), "role").agg(F.sum("n").alias("job_count"))


def entry_mid_share(job_roles: DataFrame, labels: list[str]) -> DataFrame:
    """Share of entry and mid level jobs over all dates, NULL without any. A column ``n`` counts for so many rows."""
    n = F.col("n") if "n" in job_roles.columns else F.lit(1)
    inside = F.coalesce(F.sum(F.when(F.col("seniority").isin(labels), n)), F.lit(0))
    return job_roles.filter("seniority IS NOT NULL").agg((inside / F.nullif(F.sum(n), F.lit(0)) * 100).alias("accessible_pct"))
