"""First, latest and top-n rows per key.

All are ``row_number() <= n``: Spark keeps at most n rows per key in every
input task before the shuffle (WindowGroupLimit), so a key holding a large
part of the table never gathers in one task. Beyond Spark's threshold for
that, rows are cut down in salted parts of their keys first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide import fixed


#: Rows per key up to which Spark cuts down before the shuffle, and parts that a key's rows are dealt into beyond.
GROUP_LIMIT, PARTS = 1000, 32


def top_per_key(df: DataFrame, keys: list, order: list, n: int = 1) -> DataFrame:
    """First n rows of every key in the given order."""

    def first(rows: DataFrame, by: list) -> DataFrame:
        rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
        return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")

    if n > GROUP_LIMIT:
        # The part follows from the row alone, so a task that is run again deals its rows alike.
        plain = [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.StringType, T.DatetimeType, T.BooleanType))]
        part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(PARTS)) if plain else F.lit(0)
        df = first(df.withColumn("_part", part), [*keys, "_part"]).drop("_part")
    return first(df, keys)


def first_per_key(df: DataFrame, keys: list, order: list) -> DataFrame:
    return top_per_key(df, keys, order, 1)


def dedup_postings(postings: DataFrame, key: str = "job_id", order: list | None = None) -> DataFrame:
    """First posting per id over all datasets; rows without an id all stay."""
    order = order or ["dataset_no", "position"]
    has_id = F.coalesce(F.col(key) != "", F.lit(False))
    return first_per_key(postings.filter(has_id), [key], order).unionByName(postings.filter(~has_id))


def latest_valid_config(configs: DataFrame) -> DataFrame:
    """Newest configuration per profile that did not fail."""
    usable = configs.filter(F.col("generation_status") != "failed")
    return first_per_key(usable, ["user_profile_id"], [F.desc("created_at"), F.desc("id")])


def recent_per_key(df: DataFrame, key: str, n: int = 20) -> DataFrame:
    """Latest n rows per key, newest first."""
    return top_per_key(df, [key], [F.desc("created_at"), F.desc("id")], n)


def active_runs(runs: DataFrame, terminal: list[str] = fixed.TERMINAL_STATUSES) -> DataFrame:
    return runs.filter(~F.col("status").isin(terminal))


def active_run(runs: DataFrame) -> DataFrame:
    """Newest active run per profile."""
    return recent_per_key(active_runs(runs), "user_profile_id", 1)


def active_run_violations(runs: DataFrame) -> DataFrame:
    """Profiles with more than one active run."""
    return (
        active_runs(runs)
        .groupBy("user_profile_id")
        .agg(F.count(F.lit(1)).alias("active_runs"))
        .filter("active_runs > 1")
    )


def distinct_list(values: Column) -> Column:
    """Distinct array elements in order of first appearance."""
    return F.array_distinct(values)
