"""Keyed writes as pure functions: upsert, update, get-or-create, cascade.

Stored tables are never changed in place. An operator returns the next state or,
where that is enough for an append-only log, only the rows that change.
Changes are reduced to one row per key *before* they meet the table, with
aggregates that combine on the map side, so a key with very many changes is
not a hot spot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fixed
from .shared import dense_ids, first_per_key, max_id, only_for

LABEL_KEY = ["metadata_id", "label_id"]


def latest_labels(changes: DataFrame) -> DataFrame:
    """One change per (metadata_id, label_id): the one with the highest question_id."""
    return changes.groupBy(*LABEL_KEY).agg(
        F.max(F.struct("question_id", "confidence_score"))["confidence_score"].alias(
            "confidence_score"
        )
    )


def changed_labels(current: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """The rows an upsert writes: new ones, and old ones with their created_at kept."""
    old = only_for(current.select(*LABEL_KEY, "created_at"), changes, LABEL_KEY)
    return latest_labels(changes).join(old, LABEL_KEY, "left").select(
        *LABEL_KEY,
        "confidence_score",
        F.coalesce("created_at", as_of).alias("created_at"),
        as_of.alias("updated_at"),
    )


def upsert_labels(current: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """Next state: a change replaces the confidence (also by NULL) and updated_at."""
    new = latest_labels(changes).select(
        *LABEL_KEY, F.col("confidence_score").alias("_score"), F.lit(True).alias("_changed")
    )
    changed = F.col("_changed").isNotNull()
    return current.join(new, LABEL_KEY, "full_outer").select(
        *LABEL_KEY,
        F.when(changed, F.col("_score")).otherwise(F.col("confidence_score")).alias(
            "confidence_score"
        ),
        F.coalesce("created_at", as_of).alias("created_at"),
        F.when(changed, as_of).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def apply_updates(
    current: DataFrame, changes: DataFrame, key: str, fields: Sequence[str], as_of: Column
) -> DataFrame:
    """Set named fields of existing rows; unknown keys change nothing.

    ``changes`` holds the key, an ordering ``seq``, ``set_fields`` (array of the
    fields that the change sets, as NULL is a value, too) and the fields. Per
    field the last change that sets it wins.
    """

    def last_set(field: str) -> Column:
        sets = F.array_contains("set_fields", field)
        return F.max(F.when(sets, F.struct(F.col("seq"), F.col(field).alias("value")))).alias(
            f"_{field}"
        )

    final = changes.groupBy(key).agg(
        F.lit(True).alias("_changed"), *[last_set(field) for field in fields]
    )

    def value(name: str) -> Column:
        if name in fields:
            new = F.col(f"_{name}")
            return F.when(new.isNotNull(), new["value"]).otherwise(F.col(name)).alias(name)
        if name == "updated_at":
            return F.when(F.col("_changed"), as_of).otherwise(F.col(name)).alias(name)
        return F.col(name)

    return current.join(final, key, "left").select([value(c) for c in current.columns])


def enum_violations(df: DataFrame, key: str, field: str, allowed: Sequence[str]) -> DataFrame:
    """Rows whose field is outside its domain (a missing value is outside, too)."""
    bad = ~F.coalesce(F.col(field), F.lit("")).isin(*allowed)
    return df.filter(bad).select(
        F.lit(field).alias("field"), F.col(key).alias("key"), F.col(field).alias("value")
    )


def require_enum(df: DataFrame, field: str, allowed: Sequence[str]) -> DataFrame:
    """Fail the job at the first value outside the domain."""
    ok = F.coalesce(F.col(field), F.lit("")).isin(*allowed)
    message = F.concat(F.lit(f"invalid {field}: "), F.coalesce(F.col(field), F.lit("NULL")))
    return df.withColumn(field, F.when(ok, F.col(field)).otherwise(F.raise_error(message)))


def set_queue_status(queue: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """``changes``: arxiv_id, seq, download_status, all inside the status domain."""
    checked = require_enum(changes, "download_status", fixed.QUEUE_STATUSES).withColumn(
        "set_fields", F.array(F.lit("download_status"))
    )
    return apply_updates(queue, checked, "arxiv_id", ["download_status"], as_of)


PAPER_FIELDS = ["download_status", "download_type", "llm_check_status", "metadata_id"]


def update_papers(papers: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """Next state of the papers after field changes (see :func:`apply_updates`).

    A download type that a change sets must be inside its domain.
    """
    fields = [f for f in PAPER_FIELDS if f in changes.columns]
    if "download_type" in fields:
        kind = F.coalesce("download_type", F.lit("NULL"))
        bad = F.array_contains("set_fields", "download_type") & ~kind.isin(*fixed.DOWNLOAD_TYPES)
        message = F.concat(F.lit("invalid download_type: "), kind)
        changes = changes.withColumn(
            "download_type", F.when(bad, F.raise_error(message)).otherwise(F.col("download_type"))
        )
    return apply_updates(papers, changes, "arxiv_id", fields, as_of)


def get_or_create_labels(labels: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name, created) for every distinct name; empty names are an error."""
    wanted = _non_empty(names.select("name"), "name").distinct()
    found = wanted.join(labels.select("id", "name"), "name", "left")
    new = dense_ids(found.filter("id IS NULL").select("name"), "name", max_id(labels))
    old = found.filter("id IS NOT NULL")
    return old.select("id", "name", F.lit(False).alias("created")).unionByName(
        new.select("id", "name", F.lit(True).alias("created"))
    )


def get_or_create_questions(questions: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, name, prompt, label_id, created), found by (prompt, label_id).

    A new question needs a name; several names for one prompt: the first in
    text order. Several stored rows for one prompt: the smallest id.
    """
    wanted = _non_empty(_non_empty(wanted, "prompt"), "name")
    asked = wanted.groupBy("prompt", "label_id").agg(F.min("name").alias("name"))
    known = questions.groupBy("prompt", "label_id").agg(
        F.min(F.struct("id", "name")).alias("_known")
    )
    found = asked.join(known, ["prompt", "label_id"], "left")
    missing = found.filter("_known IS NULL").select(
        "name", "prompt", "label_id",
        F.concat_ws("\x1f", F.col("label_id").cast("string"), F.col("prompt")).alias("_key"),
    )
    new = dense_ids(missing, "_key", max_id(questions))
    columns = ["id", "name", "prompt", "label_id", "created"]
    old = found.filter("_known IS NOT NULL").select(
        F.col("_known.id").alias("id"), F.col("_known.name").alias("name"), "prompt", "label_id",
        F.lit(False).alias("created"),
    )
    return old.unionByName(new.withColumn("created", F.lit(True)).select(columns))


def derive_metadata_id(papers: DataFrame, metadata: DataFrame) -> DataFrame:
    """Fill ``metadata_id``: an explicit one wins, else the paper's own id if stored."""
    known = metadata.select(F.col("id").alias("arxiv_id"), F.col("id").alias("_matched"))
    return papers.join(known, "arxiv_id", "left").select(
        *[
            F.coalesce("metadata_id", "_matched").alias(c) if c == "metadata_id" else F.col(c)
            for c in papers.columns
        ]
    )


def new_papers(
    papers: DataFrame, incoming: DataFrame, metadata: DataFrame, as_of: Column
) -> DataFrame:
    """Rows to insert for papers not stored yet, with default statuses.

    ``incoming``: arxiv_id, metadata_id and any of the three status columns;
    the first row per id by metadata_id counts.
    """
    statuses = ["download_status", "download_type", "llm_check_status"]
    given = incoming.select(
        "arxiv_id",
        "metadata_id",
        *[
            F.coalesce(F.col(c) if c in incoming.columns else F.lit(None), F.lit(fixed.DEFAULT_STATUS)).alias(c)
            for c in statuses
        ],
    )
    single = first_per_key(given, ["arxiv_id"], [F.asc_nulls_last("metadata_id"), *statuses])
    fresh = single.join(papers.select("arxiv_id"), "arxiv_id", "left_anti")
    return derive_metadata_id(fresh, metadata).select(
        "arxiv_id", *statuses, as_of.alias("created_at"), as_of.alias("updated_at"), "metadata_id"
    )


def _non_empty(df: DataFrame, column: str) -> DataFrame:
    ok = F.coalesce(F.col(column), F.lit("")) != ""
    return df.withColumn(
        column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.lit(f"{column} must not be empty")))
    )
