"""Rounding, clamping and score arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from jobtide import fixed
from jobtide.functions.text import col


def round2(value: Column | str) -> Column:
    """Two decimals, halves upwards (also for negative numbers)."""
    return F.floor(col(value) * 100 + 0.5) / 100


def clamp(value: Column, low: float, high: float) -> Column:
    """Value held inside [low, high]; NULL stays NULL."""
    return F.when(value < low, F.lit(float(low))).when(value > high, F.lit(float(high))).otherwise(value)


def rescale_pct(pct: Column) -> Column:
    """-100 % .. +100 % onto 0 .. 100."""
    return (clamp(pct, -100, 100) + 100) / 2


def bucket_status(score: Column | str) -> Column:
    score = col(score)
    return (
        F.when(score.isNull(), fixed.INSUFFICIENT)
        .when(score >= 70, "Strong")
        .when(score >= 40, "Moderate")
        .otherwise("Weak")
    )


def share(part: Column, total: Column) -> Column:
    """Percentage of a total, 0 when the total is 0."""
    return F.coalesce(F.try_divide(part, total) * 100, F.lit(0.0))


def minmax(value: Column, series: Column, window: WindowSpec) -> Column:
    """Position of value between the smallest and largest of the series, 0..100.

    50 when the value is missing, the series is empty or flat.
    """
    low, high = F.min(series).over(window), F.max(series).over(window)
    spread = (value - low) / (high - low) * 100
    return F.when(value.isNull() | low.isNull() | (low == high), F.lit(50.0)).otherwise(spread)


def so_far(order: str = "metric_date") -> WindowSpec:
    """All rows up to the current date of a one-row-per-date series."""
    return W.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
