"""Emerging skills: growing demand on top of a minimum size."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide import fixed
from jobtide.functions.scoring import clamp, rescale_pct, round2
from jobtide.operators.trend import by_day, history_slice, trend_pct


def emerging_skills(
    skill_metrics: DataFrame, skills: DataFrame, day: str | dt.date,
    min_jobs: int = 5, min_share: float = 2, window: int = 14,
) -> DataFrame:
    """Scored skills of one date; rows with a short history are ``available = false``.

    Skills that do not grow over seven days are left out.
    """
    reach = max(window, 30)
    today = F.lit(str(day)).cast("date")
    qualifies = (F.col("job_count") >= min_jobs) & (F.col("demand_percentage") >= min_share)
    candidates = skill_metrics.filter((F.col("metric_date") == today) & qualifies).select("skill_id")
    # Trends look back 30 days, the averages at most `reach`.
    history = history_slice(skill_metrics, day, reach).join(candidates, "skill_id", "left_semi")

    demand = F.col("demand_percentage")
    # Frames in days before today: the week holds 8 days, the recent history
    # window+1; the fetch bound is exclusive, so a frame of the full reach
    # loses its oldest day.
    week = by_day("skill_id", -7, 0)
    month = by_day("skill_id", -29 if reach == 30 else -30, 0)
    recent = by_day("skill_id", -window if window < 30 else 1 - window, 0)

    def relative(value: Column, base: Column) -> Column:
        return F.when(base > 0, rescale_pct((value - base) / base * 100)).otherwise(F.lit(50.0))

    scored = history.select(
        "metric_date",
        "skill_id",
        "job_count",
        "demand_percentage",
        F.avg(demand).over(week).alias("avg7"),
        F.avg(demand).over(month).alias("avg30"),
        F.count(F.lit(1)).over(recent).alias("recent_days"),
        F.count_if(F.col("job_count") > 0).over(recent).alias("active_days"),
        round2(trend_pct("demand_percentage", "skill_id", 7)).alias("growth_7d"),
        round2(trend_pct("demand_percentage", "skill_id", 30)).alias("growth_30d"),
    ).filter(F.col("metric_date") == today)

    score = (
        0.4 * relative(F.col("avg7"), F.col("avg30"))
        + 0.3 * relative(demand, F.col("avg7"))
        + 0.2 * clamp(demand * 5, 0, 100)
        + 0.1 * (F.col("active_days") / window * 100)
    )
    available = F.col("recent_days") >= 7
    named = scored.join(skills.select(F.col("normalized_name").alias("skill_id"), "name"), "skill_id")
    return named.filter(~available | (F.col("growth_7d") > 0)).select(
        F.col("name").alias("skill"),
        available.alias("available"),
        F.when(~available, fixed.INSUFFICIENT).alias("reason"),
        *[F.when(available, F.col(c)).alias(c) for c in ("job_count", "demand_percentage", "growth_7d", "growth_30d")],
        F.when(available, round2(score)).alias("emerging_score"),
    )
