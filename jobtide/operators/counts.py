"""Counts per (first day, value): all that the daily metrics need of the facts.

A job counts from the day it was first seen. Kept next to the facts and
renewed with them, these rows give the metrics of any date, or of all dates,
without reading a job or a bridge again. Their number follows the days and
values, not the jobs.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobtide.functions.scoring import share
from jobtide.operators.daily import as_date, role_counts

_SUMS = ["n", "critical", "important", "preferred", "applicants", "rated"]
COUNTS = "dimension string, value string, day date, " + ", ".join(f"{c} long" for c in _SUMS)
#: Metric table, its dimension in the counts, its value column.
_TABLES = [
    ("daily_skill_metrics", "skill", "skill_id"), ("daily_capability_metrics", "capability", "capability_id"),
    ("daily_seniority_metrics", "seniority", "seniority"), ("daily_location_metrics", "city", "city"), ("daily_industry_metrics", "industry", "industry"),
]
_PRIORITIES = ("critical", "important", "preferred")


def job_counts(jobs: DataFrame, job_skills: DataFrame, job_capabilities: DataFrame, job_roles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of jobs (external_job_id, company, city, industry, applicants, first_seen_at) and their bridges.

    ``by`` names columns that all four frames share, such as a bucket: counts are kept apart by them, and a job and its
    bridges meet within them. The jobs are read twice, for their own columns and for the days of the bridges, which are
    read once and together.
    """
    by = by or []
    day = F.col("first_seen_at").cast("date").alias("day")
    none = F.lit(None).cast("string").alias("priority")

    def pair(dimension: str, value: str | Column) -> Column:
        return F.struct(F.lit(dimension).alias("dimension"), (F.col(value) if isinstance(value, str) else value).alias("value"))

    own = F.explode(F.array(pair("job", F.lit("")), pair("company", "company"), pair("city", "city"), pair("industry", "industry")))
    facts = jobs.select(*by, day, F.col("applicants").cast("long").alias("applicants"), own.alias("p"))
    total = F.col("p.dimension") == "job"
    per_job = facts.select(
        *by, "p.dimension", "p.value", "day", none, F.when(total, F.col("applicants")).alias("applicants")
    )
    key = ["job_id", *by]
    roles = job_roles.select(*key, F.explode(F.array(pair("role", "actual_role"), pair("seniority", "seniority"))).alias("p"))
    bridges = (
        job_skills.select(*key, F.lit("skill").alias("dimension"), F.col("skill_id").alias("value"), "priority")
        .unionByName(job_capabilities.select(*key, F.lit("capability").alias("dimension"), F.col("capability_id").alias("value"), none))
        .unionByName(roles.select(*key, "p.dimension", "p.value", none))
    )
    dated = jobs.select(F.col("external_job_id").alias("job_id"), *by, day)
    linked = bridges.filter("value IS NOT NULL").join(dated, key).select(
        *by, "dimension", "value", "day", "priority", F.lit(None).cast("long").alias("applicants")
    )
    flags = [F.count_if(F.col("priority") == p).alias(p) for p in _PRIORITIES]
    return per_job.filter("value IS NOT NULL").unionByName(linked).groupBy(*by, "dimension", "value", "day").agg(
        F.count(F.lit(1)).alias("n"), *flags, F.coalesce(F.sum("applicants"), F.lit(0)).alias("applicants"), F.count("applicants").alias("rated")
    )


def _known(counts: DataFrame, day: str | dt.date) -> DataFrame:
    return counts.filter(F.col("day") <= F.lit(as_date(day)))


def snapshot_from_counts(counts: DataFrame, roles: DataFrame, day: str | dt.date) -> dict[str, DataFrame]:
    """The seven metric frames of a date; a role without an entry, or merged twice, fails the query."""
    date = F.lit(as_date(day)).alias("metric_date")
    known = _known(counts, day)
    total = known.filter("dimension = 'job'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()

    def per_value(dimension: str, name: str, *flags: str) -> DataFrame:
        rows = known.filter(F.col("dimension") == dimension).groupBy(F.col("value").alias(name))
        return rows.agg(F.sum("n").alias("job_count"), *[F.sum(f).alias(f"{f}_count") for f in flags])

    def finish(rows: DataFrame, name: str) -> DataFrame:
        rest = [c for c in rows.columns if c not in (name, "job_count")]
        return rows.select(date, name, "job_count", share(F.col("job_count"), total).alias("demand_percentage"), *rest)

    jobs = F.col("dimension") == "job"
    market = known.filter("dimension IN ('job', 'company')").agg(
        date,
        F.coalesce(F.sum(F.when(jobs, F.col("n"))), F.lit(0)).alias("total_jobs"),
        F.count_distinct(F.when(~jobs, F.col("value"))).alias("unique_companies"),
        (F.sum(F.when(jobs, F.col("applicants"))) / F.nullif(F.sum(F.when(jobs, F.col("rated"))), F.lit(0))).alias("average_applicants"),
    )
    frames = {"daily_market_metrics": market}
    for table, dimension, name in _TABLES:
        frames[table] = finish(per_value(dimension, name, *(_PRIORITIES if dimension == "skill" else ())), name)
    texts = per_value("role", "actual_role").withColumnRenamed("job_count", "n")
    frames["daily_role_metrics"] = finish(role_counts(texts, roles), "role")
    return frames


def snapshots_from_counts(counts: DataFrame, roles: DataFrame, start: str | dt.date, end: str | dt.date) -> dict[str, DataFrame]:
    """The metric frames of every date of a range in one pass; figures as of each date.

    Values are followed from their first day on: one row for each day on which a count grows, spread over the days until
    the next one. A role text is resolved once, and texts of one role are added up before time is.
    """
    first, last = as_date(start), as_date(end)
    since = F.greatest("day", F.lit(first))
    known = _known(counts, last).withColumn("day", since)
    until = F.coalesce(F.date_sub(F.lead("day").over(W.partitionBy("value").orderBy("day")), 1), F.lit(last))

    def dense(grown: DataFrame, columns: list[str]) -> DataFrame:
        so_far = W.partitionBy("value").orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
        steps = grown.select("value", "day", until.alias("until"), *[F.sum(c).over(so_far).alias(c) for c in columns])
        return steps.select(F.explode(F.sequence("day", "until")).alias("metric_date"), "value", *columns)

    def per_day(rows: DataFrame, columns: list[str]) -> DataFrame:
        return rows.groupBy("value", "day").agg(*[F.sum(c).alias(c) for c in columns])

    jobs = known.filter("dimension = 'job'")
    companies = known.filter("dimension = 'company'").groupBy("value").agg(F.min("day").alias("day"))
    series = per_day(jobs.withColumn("value", F.lit("")), ["n", "applicants", "rated"])
    firms = companies.groupBy("day").agg(F.count(F.lit(1)).alias("firms"))
    spine = counts.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    # One row per date: the window without partitions runs over dates alone.
    past = W.orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)

    def running(column: str) -> Column:
        return F.coalesce(F.sum(column).over(past), F.lit(0))

    market = spine.join(series, "day", "left").join(firms, "day", "left").select(
        F.col("day").alias("metric_date"), running("n").alias("total_jobs"), running("firms").alias("unique_companies"),
        (F.sum("applicants").over(past) / F.nullif(running("rated"), F.lit(0))).alias("average_applicants"),
    )
    totals = market.select("metric_date", "total_jobs")
    frames = {"daily_market_metrics": market}

    def finish(rows: DataFrame, name: str, flags: tuple[str, ...] = ()) -> DataFrame:
        return rows.join(totals, "metric_date").select(
            "metric_date", F.col("value").alias(name), F.col("n").alias("job_count"), share(F.col("n"), F.col("total_jobs")).alias("demand_percentage"),
            *[F.col(f).alias(f"{f}_count") for f in flags],
        )

    for table, dimension, name in _TABLES:
        flags = _PRIORITIES if dimension == "skill" else ()
        columns = ["n", *flags]
        frames[table] = finish(dense(per_day(known.filter(F.col("dimension") == dimension), columns), columns), name, flags)
    texts = per_day(known.filter("dimension = 'role'"), ["n"]).withColumnRenamed("value", "actual_role")
    resolved = role_counts(texts, roles, ["day"]).select(F.col("role").alias("value"), "day", F.col("job_count").alias("n"))
    frames["daily_role_metrics"] = finish(dense(resolved, ["n"]), "role")
    return frames
