"""Lookups, filters, joins and reports over the stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fixed
from ..functions.json_rules import parse_strict
from .shared import first_n, only_for


def existing(keys: DataFrame, table: DataFrame, key: str, table_key: str | None = None) -> DataFrame:
    """The keys that a table holds (batch form of "does this id exist")."""
    known = table.select(F.col(table_key or key).alias(key))
    return keys.select(key).join(known, key, "left_semi")


def missing(keys: DataFrame, table: DataFrame, key: str, table_key: str | None = None) -> DataFrame:
    known = table.select(F.col(table_key or key).alias(key))
    return keys.join(known, key, "left_anti")


def lookup(table: DataFrame, key: str, ids: DataFrame | str | int) -> DataFrame:
    """Rows by id: one literal id, or every id of a DataFrame with column ``key``."""
    if isinstance(ids, DataFrame):
        return only_for(table, ids, [key])
    return table.filter(F.col(key) == F.lit(ids))


def decode_json(metadata: DataFrame) -> DataFrame:
    """Decode ``versions`` and ``authors_parsed`` (non-empty text) to VARIANT."""

    def decoded(name: str) -> Column:
        return F.when(F.col(name) != "", parse_strict(F.col(name), "]")).alias(name)

    nested = ("versions", "authors_parsed")
    return metadata.select(*[decoded(c) if c in nested else F.col(c) for c in metadata.columns])


def title_and_abstract(metadata: DataFrame, ids: DataFrame | str) -> DataFrame:
    return lookup(metadata.select("id", "title", "abstract"), "id", ids)


def by_category_pattern(metadata: DataFrame, category: str) -> DataFrame:
    """Substring match (``%`` and ``_`` are wildcards), newest update first."""
    return metadata.filter(F.col("categories").like(f"%{category}%")).orderBy(
        F.desc("update_date"), "id"
    )


def by_category_tokens(
    metadata: DataFrame,
    date_after: str | None = fixed.DEFAULT_DATE_AFTER,
    tokens: tuple[str, ...] = fixed.LABELING_CATEGORIES,
) -> DataFrame:
    """Any of the exact space-separated tokens, updated strictly after a date."""
    chosen = metadata.filter(
        F.arrays_overlap(F.split("categories", " "), F.array(*[F.lit(t) for t in tokens]))
    )
    if date_after:
        chosen = chosen.filter(F.col("update_date") > F.lit(date_after).cast("date"))
    return chosen


def papers_by_status(
    papers: DataFrame,
    download_status: str | None = None,
    download_type: str | None = None,
    llm_check_status: str | None = None,
) -> DataFrame:
    """All given statuses must match; newest first."""
    wanted = {
        "download_status": download_status,
        "download_type": download_type,
        "llm_check_status": llm_check_status,
    }
    tests = [F.col(name) == value for name, value in wanted.items() if value]
    return papers.filter(reduce(Column.__and__, tests, F.lit(True))).orderBy(
        F.desc("created_at"), "arxiv_id"
    )


def question_by_id(questions: DataFrame, ids: DataFrame | int) -> DataFrame:
    if not isinstance(ids, DataFrame) and (
        isinstance(ids, bool) or not isinstance(ids, int) or ids <= 0
    ):
        raise ValueError("question id must be a positive integer")
    return lookup(questions.select("id", "prompt", "label_id"), "id", ids)


def metadata_ids_by_label(metadata_labels: DataFrame, label_id: int) -> DataFrame:
    _check_label_id(label_id)
    return metadata_labels.filter(F.col("label_id") == label_id).select("metadata_id")


def list_labels(labels: DataFrame) -> DataFrame:
    return labels.select("id", "name").orderBy("name", "id")


def list_questions(questions: DataFrame, labels: DataFrame) -> DataFrame:
    """Questions with the name of their label, in reading order."""
    named = labels.select(F.col("id").alias("label_id"), F.col("name").alias("label_name"))
    return (
        questions.select("id", "name", "label_id")
        .join(named, "label_id")
        .select("id", "name", "label_id", "label_name")
        .orderBy("label_name", "name", "id")
    )


def label_versions(metadata_labels: DataFrame, metadata: DataFrame, label_id: int) -> DataFrame:
    """(metadata_id, versions) of every stored paper that carries a label."""
    labelled = metadata_ids_by_label(metadata_labels, label_id)
    stored = metadata.select(F.col("id").alias("metadata_id"), "versions")
    return labelled.join(stored, "metadata_id")


def pending_downloads(queue: DataFrame, limit: int = fixed.DEFAULT_DOWNLOADS) -> DataFrame:
    """Oldest pending ids; ties of one insert batch fall to the smaller id."""
    pending = queue.filter(F.col("download_status") == "PENDING")
    return first_n(pending, ["created_at", "arxiv_id"], limit, unlimited=False)


def failed_downloads(queue: DataFrame) -> DataFrame:
    return (
        queue.filter(F.col("download_status") == "FAILED")
        .orderBy("created_at", "arxiv_id")
        .select("arxiv_id", "created_at")
    )


def metadata_statistics(metadata: DataFrame) -> DataFrame:
    """Row count, rows with a DOI, rows without submitter, in one pass."""
    return metadata.agg(
        F.count(F.lit(1)).alias("total_metadata"),
        F.count_if(F.col("doi") != "").alias("with_doi"),
        F.count_if(F.col("submitter").isNull()).alias("null_submitter"),
    )


def top_categories(metadata: DataFrame, n: int = fixed.TOP_CATEGORIES) -> DataFrame:
    """Most frequent whole category strings; ties in text order."""
    counted = metadata.groupBy("categories").agg(F.count(F.lit(1)).alias("count"))
    return first_n(counted, ["-count", "categories"], n, unlimited=False)


def table_counts(tables: dict[str, DataFrame | None]) -> DataFrame:
    """Rows per table; a table that does not exist yet (None) counts 0."""
    spark = next(df for df in tables.values() if df is not None).sparkSession
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        if df is not None
        else spark.range(1).select(F.lit(name).alias("table_name"), F.lit(0).cast("long").alias("rows"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def queue_summary(queue: DataFrame) -> DataFrame:
    """Rows per known status, 0 when there are none; unknown statuses are ignored."""
    counts = [
        F.count_if(F.col("download_status") == status).alias(status)
        for status in fixed.QUEUE_STATUSES
    ]
    names = ", ".join(f"'{s}', {s}" for s in fixed.QUEUE_STATUSES)
    return queue.agg(*counts).selectExpr(
        f"stack({len(fixed.QUEUE_STATUSES)}, {names}) AS (download_status, count)"
    )


def _check_label_id(label_id: int) -> None:
    if isinstance(label_id, bool) or not isinstance(label_id, int) or label_id <= 0:
        raise ValueError("label id must be a positive integer")
