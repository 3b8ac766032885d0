"""Cleaning expressions for single document fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobtide.functions import variants as V
from jobtide.functions.text import col, jtrim, let, nullify_literal_null


def applicants_in_text(text: Column | str) -> Column:
    """First number in a phrase, thousands separators dropped, as a double."""
    digits = F.regexp_extract(col(text), r"(\d[\d,]*)", 1)
    return F.regexp_replace(digits, ",", "").try_cast("double")


def applicants_number(value: Column, kind: Column | None = None) -> Column:
    """Applicant count as a double so that values beyond INTEGER stay visible; ``kind`` is that of the value, if it is at hand."""
    kind = V.kind(value) if kind is None else kind
    truncated = let(V.number(value), lambda num: F.when(num < 0, F.ceil(num)).otherwise(F.floor(num)).cast("double"))
    return F.when(kind == "STRING", applicants_in_text(V.string(value))).when(kind.rlike(V.NUMBERS), truncated)


def parse_applicants(value: Column) -> Column:
    return applicants_number(value).try_cast("int")


def years_in_text(text: Column | str) -> Column:
    """"3-5" -> (3,5); "8+" -> (8,NULL); "10" -> (10,10); otherwise NULLs."""
    pattern = r"^(\d+)\s*(?:-\s*(\d+)|(\+))?$"

    def years(text: Column) -> Column:
        # A group that is not there is empty, and so no number.
        low, high = (F.regexp_extract(text, pattern, group).try_cast("double") for group in (1, 2))
        return let(low, lambda low: F.struct(
            low.alias("min"), F.when(low.isNotNull(), F.coalesce(high, F.when(F.regexp_extract(text, pattern, 3) == "", low))).alias("max")
        ))

    return let(jtrim(text), years)


def years_text(value: Column, kind: Column) -> Column:
    """The text that years are read from: a text, or the only element of an array as text."""
    only = F.when(F.size(V.array(value)) == 1, F.try_variant_get(value, "$[0]", "variant"))
    scalar = let(only, lambda item: F.when(V.is_string(item) | V.is_number(item), V.text(item)))
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(kind.startswith("ARRAY"), scalar)


def years_of(number: Column, text: Column) -> Column:
    """Years of a number or of a text, one of which is NULL."""
    both = F.struct(number.alias("min"), number.alias("max"))
    return F.when(number.isNotNull(), both).when(text.isNotNull(), years_in_text(text)).otherwise(F.struct(*[F.lit(None).cast("double").alias(n) for n in ("min", "max")]))


def parse_years(value: Column) -> Column:
    """Years of a number or text; an array of one element reads as the text of that element."""
    return let(
        F.struct(V.number(value).alias("number"), let(V.kind(value), lambda kind: years_text(value, kind)).alias("text")),
        lambda y: years_of(y["number"], y["text"]),
    )


def combine_experience(minimum: Column, maximum: Column, preferred: Column) -> Column:
    """Experience range out of three parsed year structs."""
    return let(
        F.struct(minimum.alias("minimum"), maximum.alias("maximum"), preferred.alias("preferred")),
        lambda y: F.struct(
            F.coalesce(y["minimum"]["min"], y["preferred"]["min"], y["maximum"]["min"]).alias("minimum_experience"),
            F.coalesce(y["maximum"]["max"], y["minimum"]["max"], y["preferred"]["max"]).alias("maximum_experience"),
        ),
    )


def coerce_tristate(value: Column, kind: Column | None = None) -> Column:
    """true/false, "implied" as true, arrays by being non-empty, else NULL; ``kind`` is that of the value, if it is at hand."""

    def coerce(kind: Column) -> Column:
        implied = F.lower(jtrim(F.try_variant_get(value, "$", "string"))) == "implied"
        return (
            F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
            .when(kind == "STRING", F.when(implied, True))
            .when(kind.startswith("ARRAY"), F.try_variant_get(value, "$[0]", "variant").isNotNull())
        )

    return let(V.kind(value), coerce) if kind is None else coerce(kind)


def parse_location(location: Column | str, city: Column | str, state: Column | str, country: Column | str) -> Column:
    """Explicit parts win when any is set, else a three-part location is split."""
    names = ("location", "city", "state", "country")
    given = F.struct(*[nullify_literal_null(x).alias(n) for n, x in zip(names, (location, city, state, country))])

    def split(w: Column) -> Column:
        explicit = F.coalesce(*[F.nullif(w[n], F.lit("")) for n in names[1:]]).isNotNull()
        parts = let(F.split(w["location"], ",", -1), lambda p: F.when(F.size(p) == 3, F.transform(p, lambda x: F.nullif(jtrim(x), F.lit("")))))
        three = F.when(explicit, F.array(*[w[n] for n in names[1:]])).otherwise(parts)
        return let(three, lambda p: F.struct(w["location"].alias("location"), *[F.get(p, F.lit(i)).alias(n) for i, n in enumerate(names[1:])]))

    return let(given, split)
