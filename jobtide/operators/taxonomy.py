"""Resolution of raw values against the governed taxonomy.

Tables:
  canon    dimension, id, name, normalized_name, merged_into_id
  aliases  dimension, alias_text, normalized_alias_text, canonical_id, source
  queue    dimension, raw_value, normalized_raw_value, suggested_canonical_id,
           first_seen_job_id, queue_reason, confidence, status, notes, ...

No join carries a broadcast hint: the tables grow with the vocabulary, so
Spark decides by their size, and skewed raw values are split by AQE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide import fixed
from jobtide.functions.names import capability_rule
from jobtide.functions.text import blank_to_null, norm_key, nullify_literal_null
from jobtide.operators.firsts import first_per_key
from jobtide.sources.documents import stage


def follow_merges(roles: DataFrame, max_hops: int = fixed.MAX_MERGE_HOPS) -> DataFrame:
    """(id, final_id, final_name, hops, error) for every role.

    Only merged roles take part. A row knows where a number of hops leads; two
    such rows put together know twice as many, so the joins follow the
    logarithm of the hop limit, and each round's closure is stored. A missing
    target or a chain longer than ``max_hops`` (a cycle, for one) becomes an
    error row.
    """
    active = roles.filter("merged_into_id IS NULL").select(
        "id",
        F.col("id").alias("final_id"),
        F.col("name").alias("final_name"),
        F.lit(0).alias("hops"),
        F.lit(None).cast("string").alias("error"),
    )
    merged = roles.filter("merged_into_id IS NOT NULL").select("id", F.col("merged_into_id").alias("target"))
    targets = roles.select(
        F.col("id").alias("target"), F.col("name").alias("at_name"), F.col("merged_into_id").alias("next"), F.lit(True).alias("found")
    )
    # One hop. ``at`` is the role reached, ``next`` where it is merged into; a lost row has no target to hop to.
    found = F.coalesce("found", F.lit(False))
    closure = stage(
        merged.join(targets, "target", "left").select(
            "id", F.when(found, F.col("target")).otherwise(F.col("id")).alias("at"), "at_name", "next",
            found.cast("int").alias("hops"), (~found).alias("lost"),
        )
    )
    known = 1
    while known <= max_hops:
        further = closure.toDF(*[f"far_{c}" for c in closure.columns])
        moving = F.col("next").isNotNull() & ~F.col("lost")
        joined = closure.join(further, _spread(F.when(moving, F.col("at")), ["id"]) == F.col("far_id"), "left")
        # A row that moves reaches a merged role, which has a row of its own.
        closure = stage(
            joined.select(
                "id",
                F.when(moving, F.col("far_at")).otherwise(F.col("at")).alias("at"),
                F.when(moving, F.coalesce("far_at_name", "at_name")).otherwise(F.col("at_name")).alias("at_name"),
                F.when(moving, F.col("far_next")).otherwise(F.col("next")).alias("next"),
                F.when(moving, F.col("hops") + F.col("far_hops")).otherwise(F.col("hops")).alias("hops"),
                (F.col("lost") | (moving & F.col("far_lost"))).alias("lost"),
            )
        )
        known *= 2
    too_long = F.col("next").isNotNull() & ~F.col("lost") | (F.col("hops") + F.col("lost").cast("int") > max_hops)
    error = F.when(too_long, "too_many_hops").when(F.col("lost"), "missing_target")
    ended = closure.select(
        "id",
        F.when(error.isNull(), F.col("at")).alias("final_id"),
        F.when(error.isNull(), F.col("at_name")).alias("final_name"),
        F.least("hops", F.lit(max_hops)).alias("hops"),
        error.alias("error"),
    )
    return active.unionByName(ended)


def _spread(key: Column, columns: list[str]) -> Column:
    """A key that is never NULL: a NULL becomes one of many keys without a match.

    In an outer join all NULL keys would gather in one shuffle partition.
    """
    return F.coalesce(key, F.concat(F.lit("\x00"), F.xxhash64(*columns).cast("string")))


def active_canon(canon: DataFrame) -> DataFrame:
    """Canonical rows with ``final_id, final_name, error`` after role merges, stored: every consumer reads the result."""
    roles = canon.filter("dimension = 'role'")
    finals = follow_merges(roles).drop("hops")
    others = canon.filter("dimension <> 'role'").withColumns(
        {"final_id": F.col("id"), "final_name": F.col("name"), "error": F.lit(None).cast("string")}
    )
    columns = ["dimension", "id", "name", "normalized_name", "final_id", "final_name", "error"]
    return stage(roles.join(finals, "id").select(*columns).unionByName(others.select(*columns)))


def alias_integrity(aliases: DataFrame, canon: DataFrame) -> DataFrame:
    """Aliases whose target is missing from their dimension's table."""
    ids = canon.select("dimension", F.col("id").alias("canonical_id"))
    return aliases.join(ids, ["dimension", "canonical_id"], "left_anti").select(
        "dimension", "normalized_alias_text", "canonical_id"
    )


def _dropped(raw: Column) -> Column:
    return F.coalesce(blank_to_null(nullify_literal_null(raw)), F.lit("")) == ""


def resolve_taxonomy(
    values: DataFrame, canon: DataFrame, aliases: DataFrame, rules=fixed.CAPABILITY_RULES, strict: bool = True
) -> DataFrame:
    """Add the outcome of every (dimension, raw_value) to ``values``.

    Outcomes in order: dropped_null_like, exact_match, alias_match, rule_match
    or rule_match_entity_missing (capabilities), unresolved. ``error`` names an
    unsupported dimension, a dangling alias or a broken merge chain; with
    ``strict`` such a row fails the query.
    """
    known = active_canon(canon)
    # A value is resolved once, however many rows hold it.
    key = ["dimension", "raw_value"]
    distinct = values.select(*key).distinct()
    raw, dimension = F.col("raw_value"), F.col("dimension")
    exact = known.select(
        "dimension", F.col("normalized_name").alias("_key"),
        F.col("final_id").alias("exact_id"), F.col("final_name").alias("exact_name"),
        F.col("error").alias("exact_error"), F.lit(True).alias("is_exact"),
    )
    targets = known.select("dimension", F.col("id").alias("canonical_id"), "final_id", "final_name", "error")
    by_alias = aliases.join(targets, ["dimension", "canonical_id"], "left").select(
        "dimension", F.col("normalized_alias_text").alias("_key"),
        F.col("final_id").alias("alias_id"), F.col("final_name").alias("alias_name"),
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("final_id").isNull(), "alias_target_missing").alias("alias_error"),
        F.lit(True).alias("is_alias"),
    )
    by_rule = known.filter("dimension = 'capability'").select(
        F.col("normalized_name").alias("_rule_key"), F.col("final_id").alias("rule_id"), F.col("final_name").alias("rule_name")
    )
    rule = F.when((dimension == "capability") & ~F.col("is_dropped"), capability_rule(raw, rules))
    joined = (
        distinct.withColumn("is_dropped", _dropped(raw))
        .withColumn("normalized_value", F.when(~F.col("is_dropped"), norm_key(raw)))
        .withColumn("rule_label", rule)
        .withColumn("_key", _spread(F.col("normalized_value"), key))
        .withColumn("_rule_key", _spread(norm_key("rule_label"), key))
        .join(exact, ["dimension", "_key"], "left")
        .join(by_alias, ["dimension", "_key"], "left")
        .join(by_rule, "_rule_key", "left")
    )
    method = (
        F.when(F.col("is_dropped"), "dropped_null_like")
        .when(F.col("is_exact"), "exact_match")
        .when(F.col("is_alias"), "alias_match")
        .when(F.col("rule_id").isNotNull(), "rule_match")
        .when(F.col("rule_label").isNotNull(), "rule_match_entity_missing")
        .otherwise("unresolved")
    )

    def pick(exact_col: str, alias_col: str, rule_value: Column) -> Column:
        return (
            F.when(F.col("method") == "exact_match", F.col(exact_col))
            .when(F.col("method") == "alias_match", F.col(alias_col))
            .when(F.col("method").startswith("rule_match"), rule_value)
        )

    supported = dimension.isin(list(fixed.CANONICAL_TABLES))
    error = F.when(~F.coalesce(supported, F.lit(False)), "unsupported_dimension").otherwise(
        pick("exact_error", "alias_error", F.lit(None).cast("string"))
    )
    resolved = (
        joined.withColumn("method", method)
        .select(
            *[F.col(c).alias(f"_{c}") for c in key],
            "normalized_value",
            pick("exact_id", "alias_id", F.col("rule_id")).alias("canonical_id"),
            pick("exact_name", "alias_name", F.coalesce("rule_name", "rule_label")).alias("canonical_name"),
            F.col("method").alias("normalization_method"),
            F.col("method").isin("unresolved", "rule_match_entity_missing").alias("requires_review"),
            error.alias("error"),
        )
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    resolved = values.join(resolved, same[0] & same[1]).drop(*[f"_{c}" for c in key])
    if strict:
        # In a filter, which stays in the plan whatever columns are asked for.
        failed = F.raise_error(F.concat_ws(": ", F.lit("taxonomy"), "error", "dimension", "raw_value")).cast("boolean")
        resolved = resolved.filter(F.when(F.col("error").isNotNull(), failed).otherwise(F.lit(True)))
    return resolved


def review_rows(resolved: DataFrame) -> DataFrame:
    """Queue rows for the outcomes that need a review."""
    missing = F.col("normalization_method") == "rule_match_entity_missing"
    note = F.format_string(fixed.RULE_NOTE, "canonical_name")
    job = F.col("job_id").cast("string") if "job_id" in resolved.columns else F.lit(None).cast("string")
    order = [c for c in ("file", "pos") if c in resolved.columns]
    return resolved.filter("requires_review AND error IS NULL").select(
        "dimension",
        "raw_value",
        F.col("normalized_value").alias("normalized_raw_value"),
        F.lit(None).cast("string").alias("suggested_canonical_id"),
        job.alias("first_seen_job_id"),
        F.when(missing, "suggested_alias").otherwise("new_unreviewed").alias("queue_reason"),
        F.when(missing, "medium").otherwise("low").alias("confidence"),
        F.lit("pending").alias("status"),
        F.when(missing, note).alias("notes"),
        *order,
    )


def review_candidates(resolved: DataFrame, queue: DataFrame, order: list[str]) -> DataFrame:
    """New pending rows: one per (dimension, key), none already pending."""
    keys = ["dimension", "normalized_raw_value"]
    rows = first_per_key(review_rows(resolved), keys, order)
    return rows.join(queue.filter("status = 'pending'").select(*keys), keys, "left_anti").select(*rows.columns)


def novel_values(
    sightings: DataFrame, canon: DataFrame, aliases: DataFrame, rules=fixed.CAPABILITY_RULES
) -> DataFrame:
    """Sightings that were unknown at their turn in (file, pos) order.

    Every sighting creates an entity under its own key, or under the rule's
    key for a capability rule. A value is novel when neither the stored
    taxonomy nor an earlier sighting of the batch has created the entity it
    needs, and nothing earlier has its own key.
    """
    order = F.struct("file", "pos")
    # A text seen again changes nothing: only its first sighting goes on.
    sightings = first_per_key(sightings, ["dimension", "raw_value"], ["file", "pos"])
    resolved = resolve_taxonomy(sightings, canon, aliases, rules, strict=False)
    created = F.coalesce(
        F.when(F.col("dimension") == "capability", norm_key(capability_rule("raw_value", rules))), norm_key("raw_value")
    )
    tagged = resolved.withColumn("created_key", created)
    # One row per created entity: the sighting that creates it first.
    first_created = sightings.withColumn("created_key", created).groupBy("dimension", "created_key").agg(
        F.min(order).alias("created_at")
    )
    firsts = first_per_key(
        tagged.filter("requires_review AND error IS NULL"), ["dimension", "created_key"], ["file", "pos"]
    )
    own = first_created.select(
        "dimension", F.col("created_key").alias("normalized_value"), F.col("created_at").alias("own_created_at")
    )
    unknown = (
        firsts.join(first_created, ["dimension", "created_key"])
        .join(own, ["dimension", "normalized_value"], "left")
        .filter(order <= F.col("created_at"))
        .filter(F.col("own_created_at").isNull() | (order <= F.col("own_created_at")))
    )
    return unknown.select(*resolved.columns)


def novel_queue_rows(
    queue: DataFrame, sightings: DataFrame, canon: DataFrame, aliases: DataFrame, now: Column,
    rules=fixed.CAPABILITY_RULES,
) -> DataFrame:
    """What a batch of sightings (dimension, raw_value, job_id, file, pos) adds to the review queue."""
    rows = review_candidates(novel_values(sightings, canon, aliases, rules), queue, ["file", "pos"])
    extra = {
        "id": F.sha2(F.concat_ws("\x1f", "dimension", "normalized_raw_value", now.cast("string")), 256),
        "created_at": now,
        "resolved_at": F.lit(None).cast("timestamp_ntz"),
    }
    return rows.withColumns({k: v for k, v in extra.items() if k in queue.columns}).select(*queue.columns)


def queue_novel(
    queue: DataFrame, sightings: DataFrame, canon: DataFrame, aliases: DataFrame, now: Column,
    rules=fixed.CAPABILITY_RULES,
) -> DataFrame:
    """Review queue after a batch of sightings."""
    return queue.unionByName(novel_queue_rows(queue, sightings, canon, aliases, now, rules))
