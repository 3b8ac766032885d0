"""Daily run: documents to state, state to the published snapshot of a date."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.operators import daily, project, upsert
from jobtide.operators.counts import snapshot_from_counts, snapshots_from_counts
from jobtide.operators.firsts import first_per_key
from jobtide.operators.health import apply_health, market_health, upsert_market_row
from jobtide.operators.taxonomy import novel_queue_rows, queue_novel
from jobtide.session import shuffles_freed
from jobtide.sources import tables
from jobtide.sources.documents import accepted, changed_files, ingest_summary, read_analysis_dir, scratch, stage, stage_documents, statuses


def canon_of(state: dict[str, DataFrame]) -> DataFrame:
    """The three canonical tables as one frame keyed by dimension."""

    def rows(name: str, dimension: str, merged: Column) -> DataFrame:
        return state[name].select(
            F.lit(dimension).alias("dimension"), F.col("normalized_name").alias("id"), "name", "normalized_name",
            merged.alias("merged_into_id"),
        )

    none = F.lit(None).cast("string")
    return (
        rows("skills", "skill", none)
        .unionByName(rows("capabilities", "capability", none))
        .unionByName(rows("roles", "role", F.col("merged_into_id")))
    )


#: Documents from which on a batch is large: its rows would not be broadcast, so that state and batch meet in one full join.
LARGE_BATCH = 20_000
#: The tables that share the job buckets.
JOB_TABLES = [name for name, key in tables.BUCKET_KEYS.items() if key in ("job_id", "external_job_id")]


@dataclass
class Batch:
    """The rows that a batch of accepted documents brings for each table."""

    jobs: DataFrame
    analysis: DataFrame
    skills: DataFrame
    capabilities: DataFrame
    job_roles: DataFrame
    roles: DataFrame
    attributes: DataFrame
    lifecycle: DataFrame

    @classmethod
    def of(cls, docs: DataFrame) -> Batch:
        job_roles = project.project_job_roles(docs)
        roles = job_roles.filter("actual_role IS NOT NULL").select(
            "file", "job_id", F.lit(0).alias("pos"), F.col("actual_role").alias("name"),
            daily.norm_key("actual_role").alias("normalized_name"),
        )
        return cls(
            project.project_jobs(docs), project.project_analysis(docs), project.project_job_skills(docs),
            project.project_job_capabilities(docs), job_roles, roles, project.project_job_attributes(docs), project.project_ai_lifecycle(docs),
        )

    def sightings(self) -> DataFrame:
        """Raw values in the order in which their documents are read."""

        def sighting(df: DataFrame, dimension: str, raw: str) -> DataFrame:
            return df.select(F.lit(dimension).alias("dimension"), F.col(raw).alias("raw_value"), "job_id", "file", "pos")

        return (
            sighting(self.skills, "skill", "name")
            .unionByName(sighting(self.capabilities, "capability", "raw_value"))
            .unionByName(sighting(self.roles, "role", "name"))
        )

    def first_names(self) -> DataFrame:
        """Every text of a dimension once, as first seen: dimension, raw_value, name, normalized_name, category, job_id, file, pos.

        What the review queue and the entities take from a batch follows from these few rows; its documents are read once.
        """

        def named(df: DataFrame, dimension: str, raw: str, category: Column) -> DataFrame:
            return df.select(
                F.lit(dimension).alias("dimension"), F.col(raw).alias("raw_value"), "name", "normalized_name", category.alias("category"),
                "job_id", "file", "pos",
            )

        none = F.lit(None).cast("string")
        rows = (
            named(self.skills, "skill", "name", F.col("category"))
            .unionByName(named(self.capabilities, "capability", "raw_value", none))
            .unionByName(named(self.roles, "role", "name", none))
        )
        # The text first: rows are sorted by it, and texts differ where dimensions are three.
        return first_per_key(rows, ["raw_value", "normalized_name", "dimension"], ["file", "pos"])

    def jobs_upserted(
        self, state: dict[str, DataFrame], now: Column, large: bool = False, repeated: DataFrame | None = None
    ) -> dict[str, DataFrame]:
        """The tables of jobs after the batch; ``repeated`` names its jobs of several documents, where they are few."""
        return {
            "jobs": upsert.upsert_jobs(state["jobs"], self.jobs, now, large, repeated),
            "job_analysis": upsert.upsert_analysis(state["job_analysis"], self.analysis, large, repeated),
            "job_skills": upsert.upsert_job_skills(state["job_skills"], self.skills, large, repeated),
            "job_capabilities": upsert.upsert_job_capabilities(state["job_capabilities"], self.capabilities, large),
            "job_roles": upsert.upsert_satellite(state["job_roles"], self.job_roles, large, repeated),
            "job_attributes": upsert.upsert_satellite(state["job_attributes"], self.attributes, large, repeated),
            "job_ai_lifecycle": upsert.upsert_lifecycle(state["job_ai_lifecycle"], self.lifecycle, large, repeated),
        }

    def upserted(self, state: dict[str, DataFrame], now: Column) -> dict[str, DataFrame]:
        """The tables of the state, but for the review queue, after the batch."""
        return {
            **self.jobs_upserted(state, now),
            "skills": upsert.upsert_skills(state["skills"], self.skills),
            "capabilities": upsert.upsert_entities(state["capabilities"], self.capabilities),
            "roles": upsert.upsert_entities(state["roles"], self.roles),
        }


def apply_documents(state: dict[str, DataFrame], docs: DataFrame, now: Column) -> dict[str, DataFrame]:
    """State after a batch of accepted documents, as if read in file order."""
    batch = Batch.of(docs)
    queue = queue_novel(state["taxonomy_review_queue"], batch.sightings(), canon_of(state), state["taxonomy_aliases"], now)
    return {**state, **batch.upserted(state, now), "taxonomy_review_queue": queue}


def update_state(
    spark: SparkSession, base: str, docs: DataFrame, now: Column, stream: str = "", batch_id: int = -1, buckets: int | None = None,
    ledger: DataFrame | None = None,
) -> int:
    """Publish the state after a batch of accepted documents; only the buckets that the batch changes are written.

    Of the tables of jobs those buckets are read that hold a job of the batch. Names already known change nothing, so
    only the buckets of new ones (and of skills that get their first category) are touched. Rows of ``ledger`` (path,
    modified, length, digest) become part of the same version.

    The rules of capabilities are matched once, and names are cut down to their first sightings once; both are staged.
    """
    # What is staged and shuffled for the batch is in the state once it is published.
    with shuffles_freed(spark), scratch():
        return _updated(spark, base, docs, now, stream, batch_id, buckets, ledger)


def _updated(
    spark: SparkSession, base: str, docs: DataFrame, now: Column, stream: str, batch_id: int, buckets: int | None, ledger: DataFrame | None
) -> int:
    writer = tables.StateWriter(spark, base, buckets)
    state, batch = tables.read_state(spark, base, names=["skills", "capabilities", "roles", "taxonomy_aliases", "taxonomy_review_queue"]), Batch.of(docs)
    batch.capabilities = stage(batch.capabilities)
    first = stage(batch.first_names())
    novel = stage(novel_queue_rows(
        state["taxonomy_review_queue"], first.select("dimension", "raw_value", "job_id", "file", "pos"), canon_of(state), state["taxonomy_aliases"], now
    ))
    entities = {name: first.filter(F.col("dimension") == d) for name, d in (("skills", "skill"), ("capabilities", "capability"), ("roles", "role"))}
    changed = {name: upsert.changed_names(state[name], rows) for name, rows in entities.items()}
    keys = {"jobs": docs.select("job_id"), **changed, "taxonomy_review_queue": novel.select("normalized_raw_value")}
    if ledger is not None:
        keys["file_ledger"] = ledger.select("path")
    touched = tables.touched_buckets(keys, writer.buckets)
    touched |= dict.fromkeys(JOB_TABLES, touched["jobs"])
    held = tables.read_state(spark, base, only=touched, names=list(touched))
    large, repeated = docs.count() >= LARGE_BATCH, None
    if large:
        several = stage(upsert.repeated_jobs(docs))
        many = several.count()
        # Few enough to be broadcast: their rows are told apart without a shuffle. Without any, nothing is joined.
        repeated = (several if many else several.limit(0)) if many < LARGE_BATCH else None
    new = batch.jobs_upserted(held, now, large, repeated)
    for name, rows in entities.items():
        fresh = rows.join(changed[name], "normalized_name", "left_semi")
        new[name] = (upsert.upsert_skills if name == "skills" else upsert.upsert_entities)(held[name], fresh)
    new["taxonomy_review_queue"] = held["taxonomy_review_queue"].unionByName(novel)
    if ledger is not None:
        new["file_ledger"] = upsert.merge_rows(held["file_ledger"], ledger, ["path"], {})
    writer.write_all(new, touched)
    return writer.publish(stream, batch_id)


def ingest_files(
    files: DataFrame, base: str, now: Column, stream: str = "", batch_id: int = -1, buckets: int | None = None
) -> DataFrame:
    """Bring the state at ``base`` up to date; returns the status per file, which alone stays staged."""
    with scratch():
        staged = stage_documents(files)
        update_state(files.sparkSession, base, accepted(staged), now, stream, batch_id, buckets)
        return stage(statuses(staged), keep=True)


def ingest_changes(spark: SparkSession, source_dir: str, base: str, now: Column, buckets: int | None = None) -> DataFrame:
    """Bring the state up to date with a folder whose files may change in place; returns the status per file read.

    The state keeps a ledger of path, time, size and digest of every file. A file that is new, or whose time or size
    differs, is read again, and its document upserted if its content differs; a file that was only touched changes the
    ledger alone. The ledger is published with the state: a run that fails is simply run again.
    """
    known = tables.read_state(spark, base, names=["file_ledger"])["file_ledger"]
    with scratch():
        found = stage(changed_files(spark, source_dir, known))
        rows = found.select(F.col("file").alias("path"), "modified", "length", "digest")
        same = known.select(F.col("path").alias("file"), "digest")
        staged = stage_documents(found.join(same, ["file", "digest"], "left_anti").select("file", "raw"))
        if not found.isEmpty():
            update_state(spark, base, accepted(staged), now, buckets=buckets, ledger=rows)
        return stage(statuses(staged), keep=True)


def snapshot_frames(state: dict[str, DataFrame], day: str) -> dict[str, DataFrame]:
    """The seven metric frames of a date, counted from the facts."""
    jobs = state["jobs"].withColumnRenamed("external_job_id", "job_id")
    market = daily.daily_market_metrics(jobs, day).withColumn("market_health_score", F.lit(None).cast("double"))
    return {
        "daily_market_metrics": market,
        "daily_skill_metrics": daily.daily_skill_metrics(state["job_skills"], jobs, day),
        "daily_role_metrics": daily.daily_role_metrics(state["job_roles"], state["roles"], jobs, day),
        "daily_capability_metrics": daily.daily_capability_metrics(state["job_capabilities"], jobs, day),
        "daily_seniority_metrics": daily.daily_seniority_metrics(state["job_roles"], jobs, day),
        "daily_location_metrics": daily.daily_location_metrics(jobs, day),
        "daily_industry_metrics": daily.daily_industry_metrics(jobs, day),
    }


def aggregate(spark: SparkSession, base: str, start: str, end: str | None = None) -> None:
    """Publish the snapshot of a date, or of every date of a range, then the health scores.

    The figures come from the counts that the state keeps of its facts: neither jobs nor bridges are read.
    """
    end = end or start
    state = tables.read_state(spark, base, names=["job_counts", "roles"])
    counts, roles = state["job_counts"], state["roles"]
    used = counts.filter("dimension = 'role'").select(F.col("value").alias("actual_role"))
    orphans = [r[0] for r in daily.unmatched_roles(used, roles).take(1)]
    if orphans:
        raise ValueError(f"actual role without a roles row: {orphans[0]}")
    frames = snapshot_from_counts(counts, roles, start) if start == end else snapshots_from_counts(counts, roles, start, end)
    market = frames["daily_market_metrics"].withColumn("market_health_score", F.lit(None).cast("double"))
    first, last = daily.as_date(start), daily.as_date(end)
    asked = F.col("metric_date").between(F.lit(first), F.lit(last))
    before = tables.read_metrics(spark, base, "daily_market_metrics").filter(asked)
    frames["daily_market_metrics"] = upsert_market_row(before, market)
    days = [first + dt.timedelta(days=n) for n in range((last - first).days + 1)]
    tables.publish_snapshots(spark, base, frames, days)

    market = tables.read_metrics(spark, base, "daily_market_metrics")
    seniority = counts.filter("dimension = 'seniority'").select(F.col("value").alias("seniority"), "n")
    health = market_health(market, tables.read_metrics(spark, base, "daily_role_metrics"), seniority)
    scored = apply_health(market.filter(asked), health.filter(asked))
    tables.publish_snapshots(spark, base, {"daily_market_metrics": scored}, days)


def run_daily(spark: SparkSession, source_dir: str, base: str, day: str, now: str) -> DataFrame:
    """Ingest a folder, publish the date; returns total, succeeded, failed."""
    files = ingest_files(read_analysis_dir(spark, source_dir), base, F.lit(now).cast("timestamp_ntz"))
    aggregate(spark, base, day)
    return ingest_summary(files)
