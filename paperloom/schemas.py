"""Spark schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _TS = T.StringType(), T.IntegerType(), T.TimestampNTZType()


def _table(*columns: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in columns])


METADATA = _table(
    ("id", _S, False),
    ("submitter", _S, True),
    ("authors", _S, False),
    ("title", _S, False),
    ("comments", _S, True),
    ("journal_ref", _S, True),
    ("doi", _S, True),
    ("report_no", _S, True),
    ("categories", _S, False),
    ("license", _S, True),
    ("abstract", _S, False),
    ("versions", _S, False),
    ("update_date", T.DateType(), False),
    ("authors_parsed", _S, False),
    ("created_at", _TS, True),
    ("updated_at", _TS, True),
)
PAPERS = _table(
    ("arxiv_id", _S, False),
    ("download_status", _S, True),
    ("download_type", _S, True),
    ("llm_check_status", _S, True),
    ("created_at", _TS, True),
    ("updated_at", _TS, True),
    ("metadata_id", _S, True),
)
LABELS = _table(("id", _I, False), ("name", _S, False))
QUESTIONS = _table(
    ("id", _I, False),
    ("name", _S, False),
    ("prompt", _S, False),
    ("label_id", _I, False),
    ("created_at", _TS, True),
)
METADATA_LABELS = _table(
    ("metadata_id", _S, False),
    ("label_id", _I, False),
    ("confidence_score", T.DecimalType(3, 2), True),
    ("created_at", _TS, True),
    ("updated_at", _TS, True),
)
LABELING_QUEUE = _table(("metadata_id", _S, False), ("question_id", _I, False))
DOWNLOAD_QUEUE = _table(
    ("arxiv_id", _S, False),
    ("download_status", _S, False),
    ("created_at", _TS, True),
    ("updated_at", _TS, True),
)

# What a download run chose for an id, and the archives that could not be used.
CHOICES = _table(("arxiv_id", _S, False), ("rank", _I, True), ("artifact_id", _S, True), ("kind", _S, True))
REJECTS = _table(("id", _S, False), ("reason", _S, False))

# table -> (schema, key columns)
TABLES: dict[str, tuple[T.StructType, list[str]]] = {
    "metadata": (METADATA, ["id"]),
    "papers": (PAPERS, ["arxiv_id"]),
    "labels": (LABELS, ["id"]),
    "questions": (QUESTIONS, ["id"]),
    "metadata_labels": (METADATA_LABELS, ["metadata_id", "label_id"]),
    "labeling_queue": (LABELING_QUEUE, ["metadata_id", "question_id"]),
    "download_queue": (DOWNLOAD_QUEUE, ["arxiv_id"]),
}
# records that jobs keep beside the tables
RECORDS: dict[str, tuple[T.StructType, list[str]]] = {
    "choices": (CHOICES, ["arxiv_id"]),
    "rejects": (REJECTS, ["id"]),
}
