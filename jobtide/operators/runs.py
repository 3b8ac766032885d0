"""Run histories: sparse updates, roll-up and outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPDATABLE = [
    "status", "search_configuration_id", "jobs_scraped", "jobs_analyzed",
    "jobs_processed_successfully", "error_message",
]
SCRAPER_UPDATABLE = ["status", "actor_input", "dataset_id", "result_count", "error_message", "started_at"]


def apply_run_updates(runs: DataFrame, updates: DataFrame, fields: list[str] = UPDATABLE) -> DataFrame:
    """Latest given value per field; fields that are not given stay.

    ``updates``: id, at (order), completed (boolean) and any of ``fields``.
    An update without a single field fails the query.
    """
    given = [c for c in fields if c in updates.columns]
    empty = F.coalesce(*[F.col(c).cast("string") for c in given], F.when(F.col("completed"), "x")).isNull()
    refused = F.raise_error(F.lit("No fields provided to update.")).cast("boolean")
    checked = updates.filter(F.when(empty, refused).otherwise(F.lit(True)))
    latest = checked.groupBy("id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(f"new_{c}") for c in given],
        F.max(F.when(F.col("completed"), F.col("at"))).alias("new_completed_at"),
    )
    changed = {c: F.coalesce(F.col(f"new_{c}"), F.col(c)) for c in given}
    changed["completed_at"] = F.coalesce("new_completed_at", "completed_at")
    return runs.join(latest, "id", "left").withColumns(changed).select(*runs.columns)


def rollup_runs(scraper_runs: DataFrame) -> DataFrame:
    """Per pipeline run: runs, failures, usable datasets and scraped jobs."""
    succeeded = F.col("status") == "succeeded"
    return scraper_runs.groupBy("pipeline_run_id").agg(
        F.count(F.lit(1)).alias("scraper_runs"),
        F.coalesce(F.sum(F.when(succeeded, F.coalesce("result_count", F.lit(0)))), F.lit(0)).alias("jobs_scraped"),
        F.count_if(succeeded & F.col("dataset_id").isNotNull()).alias("datasets"),
        F.bool_or(~succeeded).alias("any_scrape_failed"),
    )


def derive_run_outcome(runs: DataFrame) -> DataFrame:
    """Add ``outcome`` out of the configuration, roll-up and analysis counts.

    ``runs``: search_configuration_id, datasets, any_scrape_failed,
    jobs_analyzed, jobs_processed_successfully, jobs_failed, dataset_fetch_failures.
    """
    scrape_failed = F.coalesce("any_scrape_failed", F.lit(False))
    partial = scrape_failed | (F.coalesce("jobs_failed", F.lit(0)) > 0) | (
        F.coalesce("dataset_fetch_failures", F.lit(0)) > 0
    )
    nothing_usable = (F.col("jobs_analyzed") > 0) & (F.col("jobs_processed_successfully") == 0)
    with_errors, done = F.lit("completed_with_errors"), F.lit("completed")
    outcome = (
        F.when(F.col("search_configuration_id").isNull(), done)
        .when(F.coalesce("datasets", F.lit(0)) == 0, F.when(scrape_failed, with_errors).otherwise(done))
        .when(nothing_usable, F.lit("failed"))
        .when(partial, with_errors)
        .otherwise(done)
    )
    return runs.withColumn("outcome", outcome)
