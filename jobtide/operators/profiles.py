"""Profiles, search configurations and search inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide import fixed
from jobtide.functions import variants as V
from jobtide.functions.names import experience_level
from jobtide.functions.text import blank_to_null, jtrim

LIST_FIELDS = ["target_roles", "skills", "tools_technologies", "preferred_industries", "keywords"]
FIELDS = [
    "target_roles", "skills", "tools_technologies", "seniority_level", "years_of_experience",
    "preferred_industries", "education", "location", "keywords",
]
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _clean_texts(items: Column) -> Column:
    """Trimmed non-blank strings of a JSON array, other entries skipped."""
    return F.array_compact(F.transform(V.array(items), lambda v: blank_to_null(V.string(v))))


def _list_or_null(value: Column) -> Column:
    items = _clean_texts(value)
    return F.when(F.size(items) > 0, items)


def _number_or_null(value: Column) -> Column:
    text = jtrim(V.string(value))
    return F.coalesce(V.number(value), F.when(text.rlike(_NUMBER), text.try_cast("double")))


def _education(value: Column) -> Column:
    parts = ("degree", "field", "institution", "year")
    entries = F.transform(
        F.filter(V.array(value), V.is_object),
        lambda e: F.struct(*[blank_to_null(V.string(V.get(e, p))).alias(p) for p in parts]),
    )
    kept = F.filter(entries, lambda e: F.coalesce(*[e[p] for p in parts]).isNotNull())
    return F.when(F.size(kept) > 0, kept)


def _fields(raw: str, names: list[str]) -> Column:
    """Fields of a JSON object as VARIANT; all NULL when the text is no object."""
    schema = ", ".join(f"{name} variant" for name in names)
    is_object = jtrim(raw).startswith("{")
    return F.from_json(F.when(is_object, F.col(raw)).otherwise(F.lit("{}")), schema)


def validate_profiles(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``profile`` (nine typed fields), ``dropped_fields`` and ``enrichment_status``.

    ``raw`` is JSON text. A field of the wrong shape or out of range becomes
    NULL and is listed.
    """
    value = F.col("_fields")
    coerced: dict[str, Column] = {f: _list_or_null(value[f]) for f in LIST_FIELDS}
    seniority = blank_to_null(V.string(value["seniority_level"]))
    coerced["seniority_level"] = F.when(seniority.isin(fixed.SENIORITY_LEVELS), seniority)
    years = _number_or_null(value["years_of_experience"])
    coerced["years_of_experience"] = F.when(years.between(0, 80), years)
    coerced["education"] = _education(value["education"])
    coerced["location"] = blank_to_null(V.string(value["location"]))
    dropped = F.array_compact(
        F.array(
            *[
                F.when(~V.is_nullish(value[f]) & F.col("profile")[f].isNull(), F.lit(f))
                for f in FIELDS
            ]
        )
    )
    return (
        df.withColumn("_fields", _fields(raw, FIELDS))
        .withColumn("profile", F.struct(*[coerced[f].alias(f) for f in FIELDS]))
        .withColumn("dropped_fields", dropped)
        .withColumn("enrichment_status", F.when(F.size("dropped_fields") == 0, "complete").otherwise("partial"))
        .drop("_fields")
    )


def profiles_table(validated: DataFrame) -> DataFrame:
    """Profile rows: a few fields as columns next to the whole document."""
    return validated.select(
        "id", "resume_id",
        F.col("profile.seniority_level").alias("seniority_level"),
        F.col("profile.years_of_experience").alias("years_of_experience"),
        F.col("profile.location").alias("location"),
        F.col("profile").alias("enriched_profile"),
        "enrichment_status", "created_at",
    )


def failed_profiles(failed: DataFrame, like: DataFrame) -> DataFrame:
    """Rows (id, resume_id, created_at) of failed enrichments: an empty profile."""
    kept = {"id", "resume_id", "created_at"}
    status = {"enrichment_status": F.lit("failed")}
    return failed.select(
        *[
            F.col(f.name) if f.name in kept else status.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in like.schema
        ]
    )


def searchable_profiles(profiles: DataFrame) -> DataFrame:
    return profiles.filter(F.col("enrichment_status") != "failed")


def profile_details(profiles: DataFrame, resumes: DataFrame) -> DataFrame:
    """Profile with resume metadata, never its text or storage path."""
    meta = resumes.select(F.col("id").alias("resume_id"), "original_filename", "file_format", "uploaded_at")
    return profiles.join(meta, "resume_id")


def validate_search_queries(df: DataFrame, raw: str = "raw", caps: dict[str, int] = fixed.QUERY_CAPS) -> DataFrame:
    """Add the three query lists, ``dropped_fields`` and ``generation_status``.

    ``raw`` is JSON text.
    """
    value = F.col("_fields")
    notes = []
    lists = {}
    for name, cap in caps.items():
        field = value[name]
        lists[name] = F.slice(F.array_distinct(_clean_texts(field)), 1, cap)
        given = ~V.is_nullish(field)
        invalid = F.size(_clean_texts(field)) != F.size(V.array(field))
        notes.append(
            F.when(given & ~V.is_array(field), F.lit(name)).when(given & invalid, F.lit(f"{name} (some entries invalid)"))
        )
    return (
        df.withColumn("_fields", _fields(raw, list(caps)))
        .withColumns({**lists, "dropped_fields": F.array_compact(F.array(*notes))})
        .withColumn("generation_status", F.when(F.size("dropped_fields") == 0, "complete").otherwise("partial"))
        .drop("_fields")
    )


def build_filters(profiles: DataFrame) -> DataFrame:
    """Search filters carried over from the profile; employment type stays NULL."""
    return profiles.select(
        F.col("id").alias("user_profile_id"),
        F.col("enriched_profile.seniority_level").alias("seniority"),
        F.col("enriched_profile.location").alias("location"),
        F.col("enriched_profile.preferred_industries").alias("industries"),
        F.lit(None).cast("string").alias("employment_type"),
    )


def search_configs_table(queries: DataFrame, filters: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Configuration rows to append.

    ``queries``: id, user_profile_id, created_at and validated lists. A failed
    generation (id, user_profile_id, created_at) still gives a row with empty
    lists and its filters.
    """
    columns = ["id", "user_profile_id", "created_at", *fixed.QUERY_CAPS, "generation_status"]
    rows = queries.select(*columns)
    if failed is not None:
        empty = {name: F.array().cast("array<string>") for name in fixed.QUERY_CAPS}
        rows = rows.unionByName(
            failed.select("id", "user_profile_id", "created_at")
            .withColumns(empty)
            .withColumn("generation_status", F.lit("failed"))
        )
    return rows.join(filters, "user_profile_id")


def remaining_secondary(primary: Column, secondary: Column) -> Column:
    """Secondary queries that equal no primary one (case and outer spaces aside)."""
    def key(text: Column) -> Column:
        return jtrim(F.lower(text))

    keys = F.transform(F.coalesce(primary, F.array().cast("array<string>")), key)
    return F.filter(F.coalesce(secondary, F.array().cast("array<string>")), lambda q: ~F.array_contains(keys, key(q)))


def plan_runs(configs: DataFrame) -> DataFrame:
    """One row per planned run: the secondary queries first, then the primary."""
    runs = F.array(
        F.struct(
            F.lit("secondary").alias("query_type"),
            remaining_secondary(F.col("primary_queries"), F.col("secondary_queries")).alias("queries"),
        ),
        F.struct(F.lit("primary").alias("query_type"), F.coalesce("primary_queries", F.array().cast("array<string>")).alias("queries")),
    )
    planned = configs.select("*", F.inline(F.filter(runs, lambda r: F.size(r["queries"]) > 0)))
    return planned.withColumn("run_no", F.when(F.col("query_type") == "secondary", 1).otherwise(2))


def quoted_or(queries: Column) -> Column:
    """Quoted queries joined by OR, inner quotes removed."""
    return F.array_join(F.transform(queries, lambda q: F.concat(F.lit('"'), F.replace(q, F.lit('"'), F.lit("")), F.lit('"'))), " OR ")


def build_actor_input(runs: DataFrame, max_items: int = 25) -> DataFrame:
    """Add ``actor_input`` (JSON); optional fields without a value are left out."""
    levels = experience_level("seniority")
    return runs.withColumn(
        "actor_input",
        F.to_json(
            F.struct(
                quoted_or(F.col("queries")).alias("keywords"),
                F.lit(max_items).alias("maxItems"),
                F.lit(True).alias("fetchFullDescription"),
                F.nullif("location", F.lit("")).alias("location"),
                F.when(F.size(levels) > 0, levels).alias("experienceLevels"),
                F.when(F.size("keywords") > 0, F.col("keywords")).alias("titleKeywordFilter"),
            )
        ),
    )
