"""Normal form of landed search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fixed
from ..functions.text import last_segment, strip
from .shared import first_n, only_for


def normalise_results(entries: DataFrame, *extra: str) -> DataFrame:
    """Entries of a search service as flat paper rows, with ``extra`` columns as they are.

    ``entries``: entry_id (url), title, summary, authors (array of structs with
    a name), categories (array), published, updated, pdf_url, doi, journal_ref,
    comment. Times are UTC without zone and become ISO texts; a missing update
    stays NULL.
    """

    def iso(time: str) -> Column:
        return F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))

    return entries.select(
        last_segment(F.col("entry_id")).alias("arxiv_id"),
        strip(F.col("title")).alias("title"),
        strip(F.col("summary")).alias("abstract"),
        F.transform("authors", lambda author: author["name"]).alias("authors"),
        "categories",
        iso("published").alias("published_date"),
        iso("updated").alias("updated_date"),
        F.col("entry_id").alias("url"),
        "pdf_url",
        "doi",
        "journal_ref",
        "comment",
        *extra,
    )


def search_papers(
    entries: DataFrame, max_results: int = fixed.SEARCH_MAX_RESULTS, sort_by: str = "submittedDate"
) -> DataFrame:
    """The first results by a sort key; an unknown key falls back to submittedDate.

    ``entries`` may carry a numeric ``relevance``.
    """
    if sort_by not in fixed.SEARCH_SORT_KEYS:
        sort_by = "submittedDate"
    column = {
        "submittedDate": "published_date",
        "lastUpdatedDate": "updated_date",
        "relevance": "relevance",
    }[sort_by]
    rows = normalise_results(entries, "relevance") if sort_by == "relevance" else normalise_results(entries)
    return first_n(rows, [f"-{column}", "arxiv_id"], max_results, unlimited=False)


def search_by_ids(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Results for a list of ids (column arxiv_id)."""
    return only_for(normalise_results(entries), ids, ["arxiv_id"])
