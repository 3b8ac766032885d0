"""Keyed upserts: new_state = f(old_state, batch), on plain tables.

``merge_rows`` reads the state twice (once only its keys) but never shuffles
it while the batch is small enough for Spark to broadcast: the state is the
streamed side of a left join and of a left semi join. A large batch would be
worked out and sorted again for each of these joins: with ``large`` it meets
the state in one full join, and both are read and shuffled once. Where a new
row replaces the old one as a whole, only the state is joined, with the keys
of the batch.

Rows of a large batch are cut down to one for each key only where a job comes
with several documents (``repeated``); all others pass without a sort.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.operators.firsts import first_per_key
from jobtide.sources.documents import stage

Merge = Callable[[Column, Column], Column]


def keep_old(old: Column, new: Column) -> Column:
    return old


def take_new(old: Column, new: Column) -> Column:
    return new


def old_else_new(old: Column, new: Column) -> Column:
    return F.coalesce(old, new)


def new_else_old(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


def _match(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys])


def missing_rows(state: DataFrame, batch: DataFrame, keys: list[str], large: bool = False) -> DataFrame:
    """Batch rows whose key is not in the state; unless the batch is large, without shuffling the state."""
    if large:
        return batch.join(state.select(*keys), keys, "left_anti")
    known = state.alias("o").join(batch.select(*keys).alias("n"), _match(keys), "left_semi").select(*keys)
    return batch.join(known, keys, "left_anti")


def insert_missing(state: DataFrame, batch: DataFrame, keys: list[str], large: bool = False) -> DataFrame:
    """ON CONFLICT DO NOTHING; the batch is unique on its keys."""
    return state.unionByName(missing_rows(state, batch, keys, large).select(*state.columns))


def merge_rows(state: DataFrame, batch: DataFrame, keys: list[str], rules: dict[str, Merge], large: bool = False) -> DataFrame:
    """ON CONFLICT DO UPDATE; columns without a rule take the new value."""
    rest = [c for c in state.columns if c not in keys]
    if large:
        return _merged_at_once(state, batch, keys, rules)
    hit = F.col(f"n.{keys[0]}").isNotNull()
    joined = state.alias("o").join(batch.alias("n"), _match(keys), "left")
    updated = joined.select(
        *[F.col(f"o.{k}") for k in keys],
        *[
            F.when(hit, rules.get(c, take_new)(F.col(f"o.{c}"), F.col(f"n.{c}"))).otherwise(F.col(f"o.{c}")).alias(c)
            for c in rest
        ],
    )
    fresh = missing_rows(state, batch, keys).select(*keys, *rest)
    return updated.unionByName(fresh).select(*state.columns)


def replace_rows(state: DataFrame, batch: DataFrame, keys: list[str], large: bool = False) -> DataFrame:
    """``merge_rows`` where every column takes the new value: rows of a large batch pass, those of the state it has keys of go."""
    if not large:
        return merge_rows(state, batch, keys, {})
    return state.join(batch.select(*keys), keys, "left_anti").select(*state.columns).unionByName(batch.select(*state.columns))


def _merged_at_once(state: DataFrame, batch: DataFrame, keys: list[str], rules: dict[str, Merge]) -> DataFrame:
    """``merge_rows`` as one full join; rows of either side without a partner stay as they are."""
    both = state.withColumn("_in", F.lit(True)).alias("o").join(batch.withColumn("_in", F.lit(True)).alias("n"), _match(keys), "full")

    def merged(c: str) -> Column:
        old, new = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keys:
            return F.coalesce(old, new)
        return F.when(F.col("n._in").isNull(), old).when(F.col("o._in").isNull(), new).otherwise(rules.get(c, take_new)(old, new))

    return both.select(*[merged(c).alias(c) for c in state.columns])


def last_document(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of several documents for one key the last file of the batch counts."""
    return first_per_key(rows, keys, [F.desc("file")])


def repeated_jobs(docs: DataFrame) -> DataFrame:
    """job_id of the jobs that come with several documents."""
    return docs.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("job_id")


def _reduced(rows: DataFrame, reduce_: Callable[[DataFrame], DataFrame], repeated: DataFrame | None, key: str = "job_id") -> DataFrame:
    """Rows cut down by ``reduce_``; given the few jobs that are repeated, those of all other jobs stay as they are."""
    if repeated is None:
        return reduce_(rows)
    again = F.broadcast(repeated.select(F.col("job_id").alias("_again")))
    comes_again = F.col(key).eqNullSafe(F.col("_again"))
    alone, several = (rows.join(again, comes_again, how) for how in ("left_anti", "left_semi"))
    cut = reduce_(several)
    return alone.select(*cut.columns).unionByName(cut)


def upsert_jobs(state: DataFrame, jobs: DataFrame, now: Column, large: bool = False, repeated: DataFrame | None = None) -> DataFrame:
    """All columns replaced, first sighting kept, last sighting moved to now."""
    batch = (
        _reduced(jobs, lambda rows: last_document(rows, ["external_job_id"]), repeated, "external_job_id")
        .drop("file")
        .withColumn("first_seen_at", now)
        .withColumn("last_seen_at", now)
    )
    return merge_rows(state, batch, ["external_job_id"], {"first_seen_at": keep_old}, large)


def upsert_analysis(state: DataFrame, analysis: DataFrame, large: bool = False, repeated: DataFrame | None = None) -> DataFrame:
    keys = ["job_id", "analysis_version"]
    return replace_rows(state, _reduced(analysis, lambda rows: last_document(rows, keys), repeated).drop("file"), keys, large)


def upsert_skills(state: DataFrame, job_skills: DataFrame) -> DataFrame:
    """Name of the first sighting kept, category filled in once."""
    batch = first_per_key(job_skills, ["normalized_name"], ["file", "pos"])
    return merge_rows(
        state, batch.select("name", "normalized_name", "category"), ["normalized_name"],
        {"name": keep_old, "category": old_else_new},
    )


def upsert_job_skills(state: DataFrame, job_skills: DataFrame, large: bool = False, repeated: DataFrame | None = None) -> DataFrame:
    """Category replaced, a known priority never lost, absent skills stay. A document has a skill once."""
    order = F.struct("file", "pos")

    def last(rows: DataFrame) -> DataFrame:
        return rows.groupBy("job_id", "skill_id").agg(
            F.max_by("category", order).alias("category"),
            F.max_by("priority", F.when(F.col("priority").isNotNull(), order)).alias("priority"),
        )

    batch = _reduced(job_skills.withColumnRenamed("normalized_name", "skill_id"), last, repeated)
    return merge_rows(state, batch, ["job_id", "skill_id"], {"priority": new_else_old}, large)


def upsert_entities(state: DataFrame, sightings: DataFrame) -> DataFrame:
    """Capabilities and roles: the first name of a key is kept."""
    batch = first_per_key(sightings, ["normalized_name"], ["file", "pos"])
    extra = [c for c in state.columns if c not in ("name", "normalized_name")]
    for column in extra:
        batch = batch.withColumn(column, F.lit(None).cast(state.schema[column].dataType))
    return insert_missing(state, batch, ["normalized_name"])


def changed_names(state: DataFrame, sightings: DataFrame) -> DataFrame:
    """normalized_name of the sightings that ``upsert_skills`` or ``upsert_entities`` would add or fill in."""
    seen = sightings.groupBy("normalized_name")
    if "category" not in state.columns:
        return missing_rows(state, seen.agg(F.count(F.lit(1)).alias("_n")), ["normalized_name"]).select("normalized_name")
    first = seen.agg(F.min_by("category", F.struct("file", "pos")).alias("category"))
    fresh = missing_rows(state, first, ["normalized_name"]).select("normalized_name")
    open_ = state.filter("category IS NULL").select("normalized_name")
    return fresh.union(open_.join(first.filter("category IS NOT NULL"), "normalized_name", "left_semi"))


def upsert_job_capabilities(state: DataFrame, job_capabilities: DataFrame, large: bool = False) -> DataFrame:
    batch = job_capabilities.select("job_id", F.col("normalized_name").alias("capability_id")).dropDuplicates()
    return insert_missing(state, batch, ["job_id", "capability_id"], large)


def upsert_satellite(state: DataFrame, rows: DataFrame, large: bool = False, repeated: DataFrame | None = None) -> DataFrame:
    """Roles and attributes of a job: replaced as a whole."""
    return replace_rows(state, _reduced(rows, lambda r: last_document(r, ["job_id"]), repeated).drop("file"), ["job_id"], large)


def upsert_lifecycle(state: DataFrame, rows: DataFrame, large: bool = False, repeated: DataFrame | None = None) -> DataFrame:
    """Keyed form replaces; flat or missing form only fills an empty place."""
    first = _reduced(rows, lambda r: first_per_key(r, ["job_id"], [F.desc("replaces"), F.desc("file")]), repeated)
    batch = first.filter("replaces IS NOT NULL")

    def if_keyed(old: Column, new: Column) -> Column:
        return F.when(F.col("n.replaces"), new).otherwise(old)

    return merge_rows(state, batch, ["job_id"], {c: if_keyed for c in state.columns if c != "job_id"}, large)


def backfill_key(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """Fill a later-added key column where it is still NULL."""
    return rows.withColumn(key, F.coalesce(F.col(key), value))


def merge_duplicate_skills(
    job_skills: DataFrame, skills: DataFrame, skill_metrics: DataFrame, duplicates: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fold duplicate skills into their canonical skill.

    ``duplicates``: (duplicate_id, canonical_id). Bridge rows are re-pointed,
    those colliding with a canonical row vanish, the duplicates' old metrics
    and entities are removed. Only rows of the skills involved are shuffled.
    Pairs of which either side is missing are ignored.
    """
    ids = skills.select(F.col("normalized_name").alias("id"))
    # The pairs that hold are few and stored: everything below looks them up.
    pairs = stage(
        duplicates.join(ids.withColumnRenamed("id", "duplicate_id"), "duplicate_id", "left_semi")
        .join(ids.withColumnRenamed("id", "canonical_id"), "canonical_id", "left_semi")
        .select("duplicate_id", "canonical_id")
    )
    gone = pairs.select(F.col("duplicate_id").alias("skill_id")).distinct()
    targets = pairs.select(F.col("canonical_id").alias("skill_id"), F.lit(True).alias("_target")).distinct()
    tagged = job_skills.join(pairs.withColumnRenamed("duplicate_id", "skill_id"), "skill_id", "left").join(targets, "skill_id", "left")
    moved = F.col("canonical_id").isNotNull()
    # Rows of no skill involved pass by; the others meet per job and target, the canonical row first.
    apart = tagged.filter(~moved & F.col("_target").isNull()).select(*job_skills.columns)
    involved = tagged.filter(moved | F.col("_target")).withColumns(
        {"_moved": moved, "_from": F.col("skill_id"), "skill_id": F.coalesce("canonical_id", "skill_id")}
    )
    kept = first_per_key(involved, ["job_id", "skill_id"], ["_moved", "_from"]).select(*job_skills.columns)
    names = gone.withColumnRenamed("skill_id", "normalized_name")
    return (
        apart.unionByName(kept),
        skills.join(names, "normalized_name", "left_anti").select(*skills.columns),
        skill_metrics.join(gone, "skill_id", "left_anti").select(*skill_metrics.columns),
    )
