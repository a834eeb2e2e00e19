"""Filling and popping the labeling and download queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fixed
from ..functions.versions import last_version_id, max_version
from .catalog import by_category_tokens, label_versions
from .keyed import new_papers
from .shared import first_n

JOB_KEY = ["metadata_id", "question_id"]


def enqueue_labeling(
    metadata: DataFrame,
    queue: DataFrame,
    question_id: int,
    date_after: str | None = fixed.DEFAULT_DATE_AFTER,
) -> DataFrame:
    """(metadata_id, question_id, is_new) of every selected paper.

    All rows are enqueue attempts; those with ``is_new`` are to be inserted.
    """
    queued = queue.filter(F.col("question_id") == question_id).select(
        "metadata_id", F.lit(True).alias("_queued")
    )
    chosen = by_category_tokens(metadata, date_after).select(F.col("id").alias("metadata_id"))
    return chosen.join(queued, "metadata_id", "left").select(
        "metadata_id",
        F.lit(question_id).alias("question_id"),
        F.col("_queued").isNull().alias("is_new"),
    )


def enqueue_downloads(
    metadata_labels: DataFrame, metadata: DataFrame, queue: DataFrame, label_id: int
) -> DataFrame:
    """(arxiv_id, is_new): distinct highest-version ids of the papers with a label."""
    versioned = F.concat(
        F.col("metadata_id"), F.lit("v"), max_version(F.col("versions")).cast("string")
    )
    wanted = label_versions(metadata_labels, metadata, label_id).select(versioned.alias("arxiv_id"))
    queued = queue.select("arxiv_id", F.lit(True).alias("_queued"))
    return wanted.distinct().join(queued, "arxiv_id", "left").select(
        "arxiv_id", F.col("_queued").isNull().alias("is_new")
    )


def new_downloads(attempts: DataFrame, as_of: Column) -> DataFrame:
    """Queue rows of the new ids, pending."""
    return attempts.filter("is_new").select(
        "arxiv_id",
        F.lit(fixed.DEFAULT_STATUS).alias("download_status"),
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
    )


def pop_jobs(queue: DataFrame, jobs: int = fixed.DEFAULT_LABELING_JOBS) -> DataFrame:
    """The next ``jobs`` jobs, smallest (metadata_id, question_id) first."""
    return first_n(queue.select(*JOB_KEY), JOB_KEY, jobs, unlimited=False)


def remaining_jobs(queue: DataFrame, popped: DataFrame) -> DataFrame:
    """Jobs that were not popped; a missing part of a key is a value like others."""
    taken = popped.select(*[F.col(c).alias(f"_{c}") for c in JOB_KEY])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in JOB_KEY]
    return queue.join(taken, same[0] & same[1], "left_anti")


def prepare_papers(
    metadata: DataFrame, papers: DataFrame, as_of: Column, limit: int | None = None
) -> DataFrame:
    """Paper rows for metadata without one; the limit counts before that check."""
    chosen = first_n(metadata.select("id", "versions"), ["id"], limit)
    incoming = chosen.select(
        last_version_id(F.col("id"), F.col("versions")).alias("arxiv_id"),
        F.col("id").alias("metadata_id"),
    )
    return new_papers(papers, incoming, metadata, as_of)
