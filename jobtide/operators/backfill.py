"""Metrics of every date in one pass over the facts.

The facts are reduced to new counts per (date, value) and summed up over
time, so no job meets a date it does not start on.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobtide.functions.scoring import share, so_far
from jobtide.operators.daily import as_of


def _days(start: str | dt.date, end: str | dt.date) -> tuple[dt.date, dt.date, int]:
    start, end = (d if isinstance(d, dt.date) else dt.date.fromisoformat(d) for d in (start, end))
    return start, end, (end - start).days + 1


def _counted_from(column: Column, start: dt.date) -> Column:
    """Date from which a row counts inside the wanted range."""
    return F.greatest(column.cast("date"), F.lit(start))


def date_spine(df: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    days = F.sequence(F.lit(start), F.lit(end))
    return df.sparkSession.range(1).select(F.explode(days).alias("metric_date"))


def backfill_market(jobs: DataFrame, start: str | dt.date, end: str | dt.date) -> DataFrame:
    """total_jobs, unique_companies and average_applicants of every date."""
    start, end, _ = _days(start, end)
    day = _counted_from(F.col("first_seen_at"), start)
    known = as_of(jobs, end)
    per_day = known.groupBy(day.alias("metric_date")).agg(
        F.count(F.lit(1)).alias("jobs"),
        F.sum("applicants").alias("applicants"),
        F.count("applicants").alias("rated"),
    )
    companies = (
        known.filter("company IS NOT NULL")
        .groupBy("company")
        .agg(F.min("first_seen_at").alias("first_seen_at"))
        .groupBy(day.alias("metric_date"))
        .agg(F.count(F.lit(1)).alias("companies"))
    )
    window = so_far()

    def running(name: str) -> Column:
        return F.coalesce(F.sum(name).over(window), F.lit(0))

    # One row per date from here on: the un-partitioned window is over dates.
    return (
        date_spine(jobs, start, end)
        .join(per_day, "metric_date", "left")
        .join(companies, "metric_date", "left")
        .select(
            "metric_date",
            running("jobs").alias("total_jobs"),
            running("companies").alias("unique_companies"),
            (F.sum("applicants").over(window) / F.nullif(running("rated"), F.lit(0))).alias("average_applicants"),
        )
    )


def backfill_dimension(
    rows: DataFrame, jobs: DataFrame, dim: str, start: str | dt.date, end: str | dt.date,
    flags: dict[str, Column] | None = None,
) -> DataFrame:
    """job_count, demand_percentage and flag counts per (date, value).

    ``rows`` carries dim and, unless it is the jobs table itself, job_id; a
    (job, value) pair occurs once. Values appear from their first job on.
    """
    start, end, n_days = _days(start, end)
    flags = flags or {}
    known = as_of(jobs, end)
    if "first_seen_at" in rows.columns:
        dated = as_of(rows, end)
    else:
        dated = rows.join(known.select("job_id", "first_seen_at"), "job_id")
    day = _counted_from(F.col("first_seen_at"), start)
    new = (
        dated.filter(F.col(dim).isNotNull())
        .groupBy(dim, day.alias("day"))
        .agg(F.count(F.lit(1)).alias("job_count"), *[F.count_if(test).alias(name) for name, test in flags.items()])
    )
    by_value = W.partitionBy(dim).orderBy("day")
    total = by_value.rowsBetween(W.unboundedPreceding, W.currentRow)
    next_day = F.lead("day").over(by_value)
    grown = new.select(
        dim,
        "day",
        F.coalesce(F.date_sub(next_day, 1), F.lit(end)).alias("until"),
        *[F.sum(c).over(total).alias(c) for c in ("job_count", *flags)],
    )
    dense = grown.select(
        F.explode(F.sequence("day", "until")).alias("metric_date"), dim, "job_count", *flags
    )
    totals = _total_per_day(jobs, start, end)
    return dense.join(totals, "metric_date").select(
        "metric_date", dim, "job_count",
        share(F.col("job_count"), F.col("total_jobs")).alias("demand_percentage"),
        *flags,
    )


def _total_per_day(jobs: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    per_day = (
        as_of(jobs, end)
        .groupBy(_counted_from(F.col("first_seen_at"), start).alias("metric_date"))
        .agg(F.count(F.lit(1)).alias("jobs"))
    )
    return (
        date_spine(jobs, start, end)
        .join(per_day, "metric_date", "left")
        .select("metric_date", F.coalesce(F.sum("jobs").over(so_far()), F.lit(0)).alias("total_jobs"))
    )


def backfill_skills(job_skills: DataFrame, jobs: DataFrame, start: str | dt.date, end: str | dt.date) -> DataFrame:
    flags = {f"{p}_count": F.col("priority") == p for p in ("critical", "important", "preferred")}
    return backfill_dimension(job_skills, jobs, "skill_id", start, end, flags)
