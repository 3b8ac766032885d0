"""Text expressions with JavaScript string semantics, all built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters JavaScript's trim() and \s treat as whitespace.
JS_SPACES = "".join(
    map(chr, [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
)

def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once for a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def jtrim(text: Column | str) -> Column:
    return F.btrim(col(text), F.lit(JS_SPACES))


def norm_key(text: Column | str) -> Column:
    """Lookup key: lower case, trimmed, runs of whitespace collapsed.

    Every kind of whitespace becomes a plain space first: trimming and
    collapsing plain spaces is much cheaper than matching the whole class.
    """
    plain = F.translate(F.lower(col(text)), JS_SPACES, " " * len(JS_SPACES))
    return F.regexp_replace(F.trim(plain), " {2,}", " ")


def _not_literal_null(text: Column) -> Column:
    # Few texts hold the word at all: only those are trimmed.
    return ~F.contains(F.lower(text), F.lit("null")) | (F.lower(jtrim(text)) != "null")


def nullify_literal_null(text: Column | str) -> Column:
    """NULL for the text "null" in any case, otherwise the value unchanged."""
    text = col(text)
    return F.when(_not_literal_null(text), text)


def first_defined(*texts: Column | str) -> Column:
    """First value that is neither NULL, "null" nor empty."""
    return F.coalesce(*[F.when((t != "") & _not_literal_null(t), t) for t in map(col, texts)])


def blank_to_null(text: Column | str) -> Column:
    return F.nullif(jtrim(text), F.lit(""))


def append_note(existing: Column | str, addition: Column | str) -> Column:
    """Join two notes with " | "; a NULL or empty side adds nothing."""
    existing, addition = col(existing), F.nullif(col(addition), F.lit(""))
    joined = F.concat_ws(" | ", F.nullif(existing, F.lit("")), addition)
    return F.when(addition.isNull(), existing).otherwise(joined)


def quoted(text: Column | str) -> Column:
    """A text as a pattern that matches it literally: quoted from \\Q to \\E, an inner \\E on its own."""
    return F.concat(F.lit("\\Q"), F.replace(col(text), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a small literal table, NULL where the key is missing."""
    if not table:
        return F.lit(None).cast("string")
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), key)
