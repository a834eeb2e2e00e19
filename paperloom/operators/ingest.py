"""From raw JSON lines to metadata rows, and the taxonomy seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fixed
from ..functions.json_rules import boxed, kind, kinds, parse_strict, unboxed, violations
from ..functions.text import strip
from .shared import dense_ids, first_n, first_per_key, max_id, with_computed


def json_lines(lines: DataFrame, order: list[str], max_records: int | None = None) -> DataFrame:
    """Stripped non-blank lines; the cap takes the first ones by ``order``."""
    raw = lines.withColumnRenamed("value", "_raw")
    text = with_computed(raw, "value", strip(F.col("_raw"))).drop("_raw").filter("value <> ''")
    return first_n(text, order, max_records)


def validate(lines: DataFrame) -> DataFrame:
    """Add ``doc`` (VARIANT) and ``violations`` (sorted array, empty when clean).

    A line that is not one JSON object has the single violation ``record:object``.
    """
    # Each step is a column of its own: computed once, and in generated code.
    box = with_computed(lines, "_box", boxed(F.col("value")))
    parsed = with_computed(box, "doc", unboxed(F.col("_box"), F.col("value"))).drop("_box")
    names = list(fixed.METADATA_FIELD_TYPES)
    typed = with_computed(parsed, "_kinds", kinds(F.col("doc"), names))
    found = violations(
        F.col("_kinds"),
        F.try_variant_get(F.col("doc"), "$.id", "string"),
        fixed.METADATA_FIELD_TYPES,
        fixed.METADATA_REQUIRED,
    )
    is_object = F.coalesce(kind(F.col("doc")) == "OBJECT", F.lit(False))
    no_object = F.array(F.lit("record:object"))
    return with_computed(typed, "violations", F.when(is_object, found).otherwise(no_object)).drop("_kinds")


def accept(validated: DataFrame, mode: str = "quarantine") -> DataFrame:
    """The clean records. ``failfast`` fails the job at the first bad record."""
    if mode == "quarantine":
        return validated.filter(F.size("violations") == 0)
    if mode != "failfast":
        raise ValueError("mode must be 'quarantine' or 'failfast'")
    message = F.concat(F.lit("invalid record: "), F.array_join("violations", "; "))
    checked = F.when(F.size("violations") == 0, True).otherwise(F.raise_error(message))
    return validated.filter(checked)


def quarantined(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("violations") > 0).select("value", "violations")


def metadata_rows(accepted: DataFrame, as_of: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records as rows of the metadata table; unknown members are dropped.

    The two lists keep their text (compact, members in order). ``keep`` names
    further columns of the frame to carry along.
    """
    doc = F.col("doc")

    def text(name: str) -> Column:
        return F.try_variant_get(doc, f"$['{name}']", "string")

    # One pass over the line gives the text of both lists.
    lists = accepted.select(
        "*", F.json_tuple("value", "versions", "authors_parsed").alias("versions", "authors_parsed")
    )
    return lists.select(
        text("id").alias("id"),
        text("submitter").alias("submitter"),
        text("authors").alias("authors"),
        text("title").alias("title"),
        text("comments").alias("comments"),
        text("journal-ref").alias("journal_ref"),
        text("doi").alias("doi"),
        text("report-no").alias("report_no"),
        text("categories").alias("categories"),
        text("license").alias("license"),
        text("abstract").alias("abstract"),
        "versions",
        text("update_date").try_cast("date").alias("update_date"),
        "authors_parsed",
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
        *keep,
    )


def dated(rows: DataFrame) -> DataFrame:
    """Rows the metadata table can hold: its update_date must be a date."""
    return rows.filter(F.col("update_date").isNotNull())


def reviewed(rows: DataFrame) -> DataFrame:
    """Rows that carry ``value`` and ``violations``: also blame dates that are none.

    Only bad rows keep their ``value``, for the quarantine.
    """
    no_date = (F.size("violations") == 0) & F.col("update_date").isNull()
    blamed = F.when(no_date, F.array(F.lit("update_date:date"))).otherwise(F.col("violations"))
    judged = rows.withColumn("violations", blamed)
    return judged.withColumn("value", F.when(F.size("violations") > 0, F.col("value")))


def absent_metadata(current: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows to append: ids not stored yet, the first row of each id by ``order``.

    One pass over ``rows``, which are shuffled whole. For rows that are already
    written, :func:`conflicting_ids` and :func:`without_conflicts` do the same
    and only shuffle ids.
    """
    single = first_per_key(rows, ["id"], [F.col(c) for c in order])
    return single.join(current.select("id"), "id", "left_anti").drop(*order)


def conflicting_ids(current: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """(id, first): ids that cannot simply be appended, usually a few.

    ``first`` is the ``order`` of the row to keep, NULL when the id is stored.
    """
    place = F.struct(*order)
    counted = rows.groupBy("id").agg(F.count(F.lit(1)).alias("_rows"), F.min(place).alias("first"))
    stored = current.select("id", F.lit(True).alias("_stored"))
    return (
        counted.join(stored, "id", "left")
        .filter("_stored OR _rows > 1")
        .select("id", F.when(F.col("_stored").isNull(), F.col("first")).alias("first"))
    )


def without_conflicts(rows: DataFrame, conflicts: DataFrame, order: list[str]) -> DataFrame:
    """Rows to append, given the written :func:`conflicting_ids`.

    A small conflict table is broadcast (Spark knows the size of its files),
    and the rows with their long texts stay where they are.
    """
    known = conflicts.withColumn("_conflict", F.lit(True))
    keep = F.col("_conflict").isNull() | F.coalesce(F.struct(*order) == F.col("first"), F.lit(False))
    return rows.join(known, "id", "left").filter(keep).drop(*order, "first", "_conflict")


def metadata_conflicts(current: DataFrame, rows: DataFrame) -> DataFrame:
    """Ids that a strict insert must refuse, with the reason."""
    repeated = rows.groupBy("id").agg(F.count(F.lit(1)).alias("rows"))
    stored = current.select("id", F.lit(True).alias("_stored"))
    return (
        repeated.join(stored, "id", "left")
        .filter("_stored OR rows > 1")
        .select(
            "id",
            F.col("rows"),
            F.when(F.col("_stored"), "stored").otherwise("repeated").alias("reason"),
        )
    )


def insert_strict(current: DataFrame, rows: DataFrame) -> DataFrame:
    """All rows, or a failed job if an id is stored already or occurs twice."""
    refused = metadata_conflicts(current, rows).select("id", "reason")
    message = F.concat(F.lit("duplicate id "), F.col("id"), F.lit(": "), F.col("reason"))
    checked = F.when(F.col("reason").isNull(), F.col("id")).otherwise(F.raise_error(message))
    return rows.join(refused, "id", "left").withColumn("id", checked).select(rows.columns)


def taxonomy_items(documents: DataFrame, order: str) -> DataFrame:
    """(label, question, prompt, seq...) rows of seed documents.

    ``documents``: ``value`` (JSON text, a list of labels with questions) and an
    integer ``order``. Nameless labels are skipped; a question that lacks name
    or prompt fails the job; a label without questions gives one row.
    """
    listed = F.try_variant_get(parse_strict(F.col("value"), "]"), "$", "array<variant>")
    labels = documents.select(order, F.posexplode(listed).alias("label_pos", "item")).select(
        order,
        "label_pos",
        F.try_variant_get("item", "$.name", "string").alias("label"),
        F.try_variant_get("item", "$.questions", "array<variant>").alias("questions"),
    ).filter("coalesce(label, '') <> ''")
    items = labels.select(
        order, "label_pos", "label", F.posexplode_outer("questions").alias("question_pos", "item")
    )

    def required(name: str) -> Column:
        value = F.try_variant_get(F.col("item"), f"$.{name}", "string")
        complete = F.col("question_pos").isNull() | (F.coalesce(value, F.lit("")) != "")
        return F.when(complete, value).otherwise(
            F.raise_error(F.lit("a question needs both name and prompt"))
        ).alias(name)

    return items.select(order, "label_pos", "question_pos", "label", required("name"), required("prompt"))


def seed_labels(labels: DataFrame, items: DataFrame) -> DataFrame:
    """New rows of the labels table; known names are left alone."""
    names = items.select(F.col("label").alias("name")).distinct()
    return dense_ids(names.join(labels.select("name"), "name", "left_anti"), "name", max_id(labels)).select(
        "id", "name"
    )


def seed_questions(
    questions: DataFrame, labels: DataFrame, items: DataFrame, order: str, as_of: Column
) -> DataFrame:
    """New rows of the questions table (``labels`` already seeded).

    The first prompt of a (name, label) counts; stored questions keep theirs.
    """
    named = labels.select(F.col("id").alias("label_id"), F.col("name").alias("label"))
    asked = items.filter("name IS NOT NULL").join(named, "label")
    places = [F.col(c) for c in (order, "label_pos", "question_pos")]
    single = first_per_key(asked, ["name", "label_id"], places)
    fresh = single.join(questions.select("name", "label_id"), ["name", "label_id"], "left_anti")
    keyed = fresh.withColumn("_key", F.concat_ws("\x1f", F.col("label_id").cast("string"), "name"))
    return dense_ids(keyed, "_key", max_id(questions)).select(
        "id", "name", "prompt", "label_id", as_of.alias("created_at")
    )

