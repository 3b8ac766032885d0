"""Search address with encoded parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobtide import fixed
from jobtide.functions.text import col, lookup


def _param(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}="), F.url_encode(value))


def _codes(values: Column, table: dict[str, str]) -> Column:
    """Comma list of known codes, NULL when none is known."""
    known = F.array_compact(F.transform(values, lambda v: lookup(table, v)))
    return F.nullif(F.array_join(known, ","), F.lit(""))


def build_search_url(
    keywords: Column | str,
    location: Column | str,
    start: Column | str,
    date_posted: Column | str,
    experience_levels: Column | str,
    job_types: Column | str,
    remote: Column | str,
    base: str = fixed.SEARCH_URL,
) -> Column:
    """Parameters in fixed order; empty ones and unknown codes are left out."""
    query = F.concat_ws(
        "&",
        _param("keywords", F.coalesce(col(keywords), F.lit(""))),
        _param("location", F.nullif(col(location), F.lit(""))),
        _param("start", col(start).cast("string")),
        _param("f_TPR", lookup(fixed.DATE_POSTED_CODES, col(date_posted))),
        _param("f_E", _codes(col(experience_levels), fixed.EXPERIENCE_CODES)),
        _param("f_JT", _codes(col(job_types), fixed.JOB_TYPE_CODES)),
        _param("f_WT", _codes(col(remote), fixed.REMOTE_CODES)),
    )
    return F.concat(F.lit(f"{base}?"), query)
