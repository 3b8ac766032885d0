"""Change against the average of the preceding days, as window expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from jobtide.functions.scoring import round2


def by_day(dim: str | None, low: int, high: int, date: str = "metric_date") -> WindowSpec:
    """Rows of the same value between two day offsets."""
    spec = W.partitionBy(dim) if dim else W
    return spec.orderBy(F.unix_date(date)).rangeBetween(low, high)


def previous_average(value: str, dim: str | None, days: int, date: str = "metric_date") -> Column:
    """Average over [d-days, d); NULL unless at least ``days`` rows are there."""
    before = by_day(dim, -days, -1, date)
    rows = F.count(F.lit(1)).over(before)
    return F.when(rows >= days, F.avg(F.coalesce(F.col(value).cast("double"), F.lit(0.0))).over(before))


def trend_pct(value: str, dim: str | None, days: int, date: str = "metric_date") -> Column:
    """Unrounded change in percent; NULL while it cannot be computed."""
    average = previous_average(value, dim, days, date)
    return F.when(average != 0, (F.col(value) - average) / average * 100)


def with_trends(
    metrics: DataFrame, value: str, dim: str | None, windows: tuple[int, ...] = (7, 30), date: str = "metric_date"
) -> DataFrame:
    """Add ``change_<n>d`` columns; one shuffle for all windows."""
    changes = {f"change_{n}d": round2(trend_pct(value, dim, n, date)) for n in windows}
    return metrics.withColumns(changes)


def trend_details(metrics: DataFrame, value: str, dim: str | None, days: int, date: str = "metric_date") -> DataFrame:
    """available, current, previous_period_average and trend_percentage."""
    average = F.col("_average")
    usable = F.col(value).isNotNull() & F.coalesce(average != 0, F.lit(False))
    return metrics.withColumn("_average", previous_average(value, dim, days, date)).select(
        date,
        *([dim] if dim else []),
        usable.alias("available"),
        F.when(usable, F.col(value)).cast("double").alias("current"),
        F.lit(days).alias("window"),
        F.when(usable, round2(average)).alias("previous_period_average"),
        F.when(usable, round2((F.col(value) - average) / average * 100)).alias("trend_percentage"),
    )


def history_slice(metrics: DataFrame, day: str | dt.date, days: int, date: str = "metric_date") -> DataFrame:
    """Only the partitions a window ending on the day can see."""
    day = day if isinstance(day, dt.date) else dt.date.fromisoformat(day)
    first = day - dt.timedelta(days=days)
    return metrics.filter(F.col(date).between(F.lit(first), F.lit(day)))


def trends_on(
    metrics: DataFrame, value: str, dim: str | None, day: str | dt.date, windows: tuple[int, ...] = (7, 30)
) -> DataFrame:
    """Rows of one date with their trends, reading only the needed history."""
    history = history_slice(metrics, day, max(windows))
    return with_trends(history, value, dim, windows).filter(F.col("metric_date") == F.lit(str(day)).cast("date"))


def jobs_trend(market: DataFrame, windows: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    return with_trends(market, "total_jobs", None, windows)


def skill_trend(skill_metrics: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    return with_trends(skill_metrics, "demand_percentage", "skill_id", windows)


def role_trend(role_metrics: DataFrame, windows: tuple[int, ...] = (7,)) -> DataFrame:
    return with_trends(role_metrics, "demand_percentage", "role", windows)
