"""Selection of postings out of extracted result cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide import fixed
from jobtide.functions.checks import matches_title
from jobtide.operators.firsts import first_per_key, top_per_key


def collect_postings(
    cards: DataFrame, pages: DataFrame, terms: list[str], max_items: int = 100, page_size: int = fixed.PAGE_SIZE
) -> DataFrame:
    """First ``max_items`` matching postings of every search, in page order.

    ``cards``: search_id, page_start, pos, job_id, title, ...; ``pages``:
    search_id, page_start, n_cards. Ids are deduplicated before the title
    filter. Reading stops at an empty page and after a partial page.
    """
    short = pages.filter(F.col("n_cards") < page_size)
    stop = short.groupBy("search_id").agg(F.min("page_start").alias("last_page"))
    seen = (
        cards.filter(F.coalesce(F.col("job_id") != "", F.lit(False)))
        .join(stop, "search_id", "left")
        .filter(F.col("last_page").isNull() | (F.col("page_start") <= F.col("last_page")))
        .drop("last_page")
    )
    unique = first_per_key(seen, ["search_id", "job_id"], ["page_start", "pos"])
    return top_per_key(unique.filter(matches_title("title", terms)), ["search_id"], ["page_start", "pos"], max_items)
