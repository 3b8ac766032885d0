"""Predicates: title filter, date and identifier shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobtide.functions.text import col, jtrim, quoted


def whole_word(term: Column | str) -> Column:
    """Pattern that finds a term as a whole word, whatever its case."""
    return F.concat(F.lit(r"(?i)\b"), quoted(jtrim(term)), F.lit(r"\b"))


def matches_title(title: Column | str, terms: Column | list[str]) -> Column:
    """True when any term occurs in the title as a whole word.

    No terms keep every row, an empty title is dropped, an empty term never
    matches. A list of terms becomes constant patterns; an array column is
    matched per row. For many terms see ``operators.terms``.
    """
    title = col(title)
    has_title = F.coalesce(title != "", F.lit(False))
    if isinstance(terms, list):
        if not terms:
            return F.lit(True)
        # Patterns of literals are folded into constants.
        hits = [F.rlike(title, whole_word(F.lit(t))) for t in terms if t]
        found = hits[0] if hits else F.lit(False)
        for hit in hits[1:]:
            found = found | hit
        return F.when(has_title, found).otherwise(False)

    def hit(term: Column) -> Column:
        return F.coalesce(term != "", F.lit(False)) & F.rlike(title, whole_word(term))

    no_terms = F.coalesce(F.size(terms) <= 0, F.lit(True))
    return F.when(no_terms, True).when(has_title, F.exists(terms, hit)).otherwise(False)


def is_calendar_date(text: Column | str) -> Column:
    """YYYY-MM-DD and a real day of the calendar."""
    text = col(text)
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    real = F.try_to_date(text, "yyyy-MM-dd").isNotNull()
    return F.coalesce(shaped & real, F.lit(False))


def is_uuid(text: Column | str) -> Column:
    shape = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    return F.coalesce(col(text).rlike(shape), F.lit(False))
