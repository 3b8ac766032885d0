"""Type tests and readers for polymorphic JSON values (VARIANT)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Kinds that are numbers, as a pattern.
NUMBERS = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"


def get(value: Column, *path: str) -> Column:
    """Field of an object as VARIANT; NULL when absent."""
    return F.try_variant_get(value, "$" + "".join(f".{p}" for p in path), "variant")


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


_kind_of = kind


def is_string(value: Column) -> Column:
    return F.coalesce(kind(value) == "STRING", F.lit(False))


def is_number(value: Column) -> Column:
    return F.coalesce(kind(value).rlike(NUMBERS), F.lit(False))


def is_array(value: Column) -> Column:
    return F.coalesce(kind(value).startswith("ARRAY"), F.lit(False))


def is_object(value: Column) -> Column:
    return F.coalesce(kind(value).startswith("OBJECT"), F.lit(False))


def is_nullish(value: Column) -> Column:
    return F.coalesce(kind(value) == "VOID", F.lit(True))


def string(value: Column) -> Column:
    """The text of a JSON string; NULL for every other type."""
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def texts(value: Column) -> Column:
    """Non-empty strings of a JSON array, everything else skipped; an empty array for anything that is no array.

    An array of strings and nulls alone, as most are, is read at once; of another one every element is looked at.
    """
    plain = kind(value) == "ARRAY<STRING>"
    strings = F.when(plain, F.try_variant_get(value, "$", "array<string>")).otherwise(F.transform(array(value), string))
    return F.filter(strings, lambda s: s != "")


def number(value: Column) -> Column:
    return F.when(is_number(value), F.try_variant_get(value, "$", "double"))


def boolean(value: Column) -> Column:
    return F.when(kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))


def array(value: Column) -> Column:
    """Elements of a JSON array, an empty array for anything else."""
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))


def text(value: Column, kind: Column | None = None) -> Column:
    """A scalar as text (whole numbers without a fraction), nested values as JSON; ``kind`` is that of the value, if it is at hand."""
    kind = _kind_of(value) if kind is None else kind
    num = F.try_variant_get(value, "$", "double")
    whole = F.when(num == F.floor(num), F.try_variant_get(value, "$", "decimal(38,0)").cast("string"))
    plain = F.try_variant_get(value, "$", "string")
    return (
        F.when(F.coalesce(kind == "VOID", F.lit(True)), None)
        .when(kind.isin("STRING", "BIGINT"), plain)
        .when(kind.rlike(NUMBERS), F.coalesce(whole, plain))
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.to_json(value))
        .otherwise(plain)
    )


def truthy(value: Column, kind: Column | None = None) -> Column:
    """JavaScript truth of a JSON value; ``kind`` is that of the value, if it is at hand."""
    kind = _kind_of(value) if kind is None else kind
    return (
        F.when(F.coalesce(kind == "VOID", F.lit(True)), False)
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "STRING", F.try_variant_get(value, "$", "string") != "")
        .when(kind.rlike(NUMBERS), F.try_variant_get(value, "$", "double") != 0)
        .otherwise(True)
    )


def unwrap_singleton(value: Column) -> Column:
    """The object inside a one-element array, otherwise the value itself."""
    items = F.try_variant_get(value, "$", "array<variant>")
    return F.when((F.size(items) == 1) & (is_object(F.get(items, 0)) | is_array(F.get(items, 0))), F.get(items, 0)).otherwise(value)
