"""Projections of parsed documents onto the fact, bridge and satellite tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide import fixed
from jobtide.functions.names import capability_rule
from jobtide.functions.text import jtrim, norm_key


def project_jobs(docs: DataFrame) -> DataFrame:
    return docs.select(
        "file",
        F.col("job_id").alias("external_job_id"),
        *[f"job.{c}" for c in ("title", "company", "location", "city", "state", "country")],
        *[f"job.{c}" for c in ("employment_type", "job_function", "industry")],
        F.col("job.applicants").cast("int").alias("applicants"),
        F.col("job.posted_at").try_cast("timestamp_ntz").alias("posted_at"),
        "job.job_url",
    )


def project_analysis(docs: DataFrame, version: str = "v1") -> DataFrame:
    return docs.select("file", "job_id", F.lit(version).alias("analysis_version"), F.col("raw").alias("analysis"))


def project_job_skills(docs: DataFrame) -> DataFrame:
    """(file, job_id, pos, name, normalized_name, category, priority)."""
    return docs.select("file", "job_id", F.posexplode("skills").alias("pos", "s")).select("file", "job_id", "pos", "s.*")


def project_job_capabilities(docs: DataFrame, rules=fixed.CAPABILITY_RULES) -> DataFrame:
    """(file, job_id, pos, raw_value, rule_label, name, normalized_name)."""
    return (
        docs.select("file", "job_id", F.posexplode("capabilities").alias("pos", "raw_value"))
        .withColumn("rule_label", capability_rule("raw_value", rules))
        .withColumn("name", F.coalesce("rule_label", jtrim("raw_value")))
        .withColumn("normalized_name", norm_key("name"))
    )


def project_job_roles(docs: DataFrame) -> DataFrame:
    return docs.select("file", "job_id", "role.*")


def project_job_attributes(docs: DataFrame) -> DataFrame:
    return docs.select("file", "job_id", "attributes.*")


def project_ai_lifecycle(docs: DataFrame) -> DataFrame:
    """Flags plus ``replaces``: false for the flat-array or missing form."""
    return docs.select("file", "job_id", "lifecycle.*")
