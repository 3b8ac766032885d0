"""Decisions on the taxonomy: approvals, rejections and role merges.

Each function takes the current tables and a frame of decisions with a
``seq`` giving their order, and returns the new tables plus the refused
decisions with an ``error_code``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide import fixed
from jobtide.functions.text import append_note, lookup
from jobtide.operators.taxonomy import active_canon


def _first_of_item(decisions: DataFrame) -> DataFrame:
    """Refuse further decisions on an item that an earlier one has resolved."""
    # The winner is a minimum per item, combined before the shuffle; a window
    # would bring all decisions on one item into one task.
    good = decisions.filter("error_code IS NULL")
    winners = good.groupBy("queue_item_id").agg(F.min("seq").alias("_first_seq"))
    late = F.col("error_code").isNull() & (F.col("seq") > F.col("_first_seq"))
    return (
        decisions.join(winners, "queue_item_id", "left")
        .withColumn("error_code", F.when(late, "not_pending").otherwise(F.col("error_code")))
        .drop("_first_seq")
    )


def _with_item(decisions: DataFrame, queue: DataFrame) -> DataFrame:
    item = queue.select(
        F.col("id").alias("queue_item_id"), "dimension", "raw_value", "normalized_raw_value", F.col("status").alias("item_status"),
        F.col("notes").alias("item_notes"), F.lit(True).alias("item_found"),
    )
    return decisions.join(item, "queue_item_id", "left")


def _item_error() -> Column:
    return F.when(F.col("item_found").isNull(), "item_not_found").when(F.col("item_status") != "pending", "not_pending")


def _resolve_items(queue: DataFrame, resolved: DataFrame, now: Column) -> DataFrame:
    """Write new status and notes (queue_item_id, new_status, new_notes)."""
    hit = F.col("new_status").isNotNull()
    joined = queue.join(resolved.withColumnRenamed("queue_item_id", "id"), "id", "left")
    return (
        joined.withColumn("status", F.coalesce("new_status", "status"))
        .withColumn("notes", F.when(hit, F.col("new_notes")).otherwise(F.col("notes")))
        .withColumn("resolved_at", F.when(hit, now).otherwise(F.col("resolved_at")))
        .select(*queue.columns)
    )


def apply_approvals(
    queue: DataFrame, decisions: DataFrame, canon: DataFrame, aliases: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Approve items as aliases: (queue, aliases, errors).

    ``decisions``: seq, queue_item_id, canonical_id, notes. A merged role as
    target is redirected to its active role; an alias pointing elsewhere is a
    conflict; an identical alias is left alone and the item still resolved.
    """
    judged = judge_approvals(queue, decisions, canon, aliases)
    good = judged.filter("error_code IS NULL")
    new_aliases = good.filter("alias_created").select(
        "dimension",
        F.col("raw_value").alias("alias_text"),
        F.col("normalized_raw_value").alias("normalized_alias_text"),
        F.col("final_id").alias("canonical_id"),
        F.lit("human_approved").alias("source"),
    )
    table = lookup(fixed.CANONICAL_TABLES, F.col("dimension"))
    # Fixed formats of the stored audit notes.
    created = F.format_string('Approved as alias of "%s" (%s.id=%s).', "final_name", table, "final_id")
    existed = F.format_string(
        'Approved - alias for "%s" already existed pointing at "%s" (%s.id=%s).',
        "normalized_raw_value", "final_name", table, "final_id",
    )
    redirected = F.format_string(
        ' (requested target "%s" has been merged into "%s" - alias stored pointing at the final active target instead.)',
        "canonical_id", "final_name",
    )
    audit = F.concat(
        F.when(F.col("alias_created"), created).otherwise(existed),
        F.when(F.col("final_id") != F.col("canonical_id"), redirected).otherwise(F.lit("")),
    )
    note = F.concat_ws(" ", audit, F.nullif("decision_notes", F.lit("")))
    resolved = good.select(
        "queue_item_id", F.lit("approved").alias("new_status"), append_note("item_notes", note).alias("new_notes")
    )
    errors = judged.filter("error_code IS NOT NULL").select("seq", "queue_item_id", "canonical_id", "error_code")
    return _resolve_items(queue, resolved, now), aliases.unionByName(new_aliases.select(*aliases.columns)), errors


def judge_approvals(queue: DataFrame, decisions: DataFrame, canon: DataFrame, aliases: DataFrame) -> DataFrame:
    """Decisions with their item, final target, ``alias_created`` and ``error_code``."""
    target = active_canon(canon).select(
        "dimension", F.col("id").alias("canonical_id"), "final_id", "final_name",
        F.col("error").alias("chain_error"), F.lit(True).alias("target_found"),
    )
    existing = aliases.select(
        "dimension", F.col("normalized_alias_text").alias("normalized_raw_value"), F.col("canonical_id").alias("aliased_to")
    )
    joined = (
        _with_item(decisions.withColumnRenamed("notes", "decision_notes"), queue)
        .join(target, ["dimension", "canonical_id"], "left")
        .join(existing, ["dimension", "normalized_raw_value"], "left")
    )
    code = (
        F.when(_item_error().isNotNull(), _item_error())
        .when(~F.col("dimension").isin(list(fixed.CANONICAL_TABLES)), "unsupported_dimension")
        .when(F.col("target_found").isNull(), "target_missing")
        .when(F.col("chain_error").isNotNull(), F.col("chain_error"))
        .when(F.col("aliased_to") != F.col("final_id"), "alias_conflict")
    )
    return _first_of_item(joined.withColumn("error_code", code)).withColumn("alias_created", F.col("aliased_to").isNull())


def apply_resolutions(queue: DataFrame, decisions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Resolve items without an alias: (queue, errors).

    ``decisions``: seq, queue_item_id, status (NULL = rejected), notes.
    """
    status = F.coalesce("status", F.lit("rejected"))
    asked = decisions.select("seq", "queue_item_id", status.alias("new_status"), F.col("notes").alias("decision_notes"))
    code = F.when(~F.col("new_status").isin("approved", "rejected"), "invalid_status").otherwise(_item_error())
    judged = _first_of_item(_with_item(asked, queue).withColumn("error_code", code))
    resolved = judged.filter("error_code IS NULL").select(
        "queue_item_id", "new_status", append_note("item_notes", "decision_notes").alias("new_notes")
    )
    errors = judged.filter("error_code IS NOT NULL").select("seq", "queue_item_id", "error_code")
    return _resolve_items(queue, resolved, now), errors


def judge_role_merges(roles: DataFrame, merges: DataFrame) -> DataFrame:
    """Merges (seq, source_id, target_id) with an ``error_code``.

    A merge collides when an earlier request of the batch, valid on its own,
    moves its source or target or merges into its source: together they would
    build a chain. It can be sent again with the next batch.
    """
    source = roles.select(
        F.col("id").alias("source_id"), F.col("merged_into_id").alias("source_merged"), F.lit(True).alias("source_found")
    )
    target = roles.select(
        F.col("id").alias("target_id"), F.col("merged_into_id").alias("target_merged"), F.lit(True).alias("target_found")
    )
    dependents = roles.filter("merged_into_id IS NOT NULL").select(
        F.col("merged_into_id").alias("source_id"), F.lit(True).alias("has_dependents")
    ).distinct()
    judged = (
        merges.join(source, "source_id", "left")
        .join(target, "target_id", "left")
        .join(dependents, "source_id", "left")
        .withColumn(
            "error_code",
            F.when(F.col("source_id") == F.col("target_id"), "self_merge")
            .when(F.col("source_found").isNull(), "source_missing")
            .when(F.col("target_found").isNull(), "target_missing")
            .when(F.col("source_merged").isNotNull(), "source_already_merged")
            .when(F.col("target_merged").isNotNull(), "target_not_active")
            .when(F.col("has_dependents"), "source_has_dependents"),
        )
        .select("seq", "source_id", "target_id", "error_code")
    )
    valid = judged.filter("error_code IS NULL")
    moved = valid.groupBy(F.col("source_id").alias("role")).agg(F.min("seq").alias("moved_at"))
    extended = valid.groupBy(F.col("target_id").alias("role")).agg(F.min("seq").alias("extended_at"))
    checked = (
        judged.join(moved.toDF("source_id", "source_moved_at"), "source_id", "left")
        .join(extended.toDF("source_id", "source_extended_at"), "source_id", "left")
        .join(moved.toDF("target_id", "target_moved_at"), "target_id", "left")
    )
    earlier = F.least("source_moved_at", "source_extended_at", "target_moved_at") < F.col("seq")
    code = F.when(F.col("error_code").isNull() & earlier, "collides_in_batch").otherwise(F.col("error_code"))
    return checked.select("seq", "source_id", "target_id", code.alias("error_code"))


def apply_role_merges(roles: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roles, errors): accepted merges set the source's pointer, rows stay."""
    judged = judge_role_merges(roles, merges)
    accepted = judged.filter("error_code IS NULL").select(F.col("source_id").alias("id"), F.col("target_id").alias("_into"))
    merged = (
        roles.join(accepted, "id", "left")
        .withColumn("merged_into_id", F.coalesce("merged_into_id", "_into"))
        .select(*roles.columns)
    )
    return merged, judged.filter("error_code IS NOT NULL")
