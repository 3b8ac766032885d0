"""Canonical names for skills, roles, seniority and capabilities.

Alias tables and rules are arguments, so users extend them without code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobtide import fixed
from jobtide.functions.text import blank_to_null, col, jtrim, let, lookup, norm_key


def _alias_keys(aliases: dict[str, str]) -> dict[str, str]:
    return {alias: " ".join(name.lower().split()) for alias, name in aliases.items()}


def normalize_skill(text: Column | str, aliases: dict[str, str] = fixed.SKILL_ALIASES) -> Column:
    """Struct of display name and lookup key (the key of the canonical name)."""
    alias_keys = _alias_keys(aliases)
    return let(
        norm_key(text),
        lambda key: F.struct(
            F.coalesce(lookup(aliases, key), jtrim(text)).alias("name"),
            F.coalesce(lookup(alias_keys, key), key).alias("normalized_name"),
        ),
    )


def skill_key(text: Column | str, aliases: dict[str, str] = fixed.SKILL_ALIASES) -> Column:
    """The lookup key of ``normalize_skill`` alone."""
    alias_keys = _alias_keys(aliases)
    return let(norm_key(text), lambda key: F.coalesce(lookup(alias_keys, key), key))


def role_name(text: Column, aliases: dict[str, str] = fixed.ROLE_ALIASES) -> Column:
    """``normalize_role`` of a text that costs nothing to name twice, such as a column."""
    return F.coalesce(lookup(aliases, norm_key(text)), blank_to_null(text))


def normalize_role(text: Column | str, aliases: dict[str, str] = fixed.ROLE_ALIASES) -> Column:
    return let(col(text), lambda t: role_name(t, aliases))


def seniority_name(trimmed: Column, aliases: dict[str, str] = fixed.SENIORITY_ALIASES) -> Column:
    """``normalize_seniority`` of a text that is trimmed and not empty, and costs nothing to name twice."""
    return F.when(F.lower(trimmed) != "unknown", F.coalesce(lookup(aliases, norm_key(trimmed)), trimmed))


def normalize_seniority(text: Column | str, aliases: dict[str, str] = fixed.SENIORITY_ALIASES) -> Column:
    return let(blank_to_null(text), lambda trimmed: seniority_name(trimmed, aliases))


def capability_rule(text: Column | str, rules: list[tuple[str, str]] = fixed.CAPABILITY_RULES) -> Column:
    """Label of the first matching rule, NULL when none matches."""
    trimmed = jtrim(text)
    label = F.lit(None).cast("string")
    for pattern, name in reversed(rules):
        label = F.when(trimmed.rlike(f"(?i){pattern}"), name).otherwise(label)
    return label


def normalize_capability(text: Column | str, rules: list[tuple[str, str]] = fixed.CAPABILITY_RULES) -> Column:
    return F.coalesce(capability_rule(text, rules), jtrim(text))


def experience_level(seniority: Column | str, levels: dict[str, str] = fixed.EXPERIENCE_LEVELS) -> Column:
    """Search filter values for a seniority; empty array when unknown."""
    level = lookup(levels, col(seniority))
    return F.when(level.isNull(), F.array().cast("array<string>")).otherwise(F.array(level))


def map_run_status(status: Column | str) -> Column:
    return F.coalesce(lookup(fixed.RUN_STATUSES, col(status)), F.lit("failed"))


def run_error_message(status: Column | str) -> Column:
    """Stored error text of a finished remote run, NULL when it succeeded."""
    return F.when(map_run_status(status) != "succeeded", F.concat(F.lit("Apify run ended with status "), col(status)))
