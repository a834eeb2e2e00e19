"""Structured evidence records drawn from the texts by a model, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fixed
from ..functions.json_rules import kind, parse_strict
from ..functions.text import strip_code_fence
from .shared import with_computed


def evidence_records(replies: DataFrame) -> DataFrame:
    """(id, record fields..., valid) of (id, reply): the JSON object of each reply.

    ``valid``: an object whose evidence type is one of the known ones, or that
    reports nothing found.
    """
    bodies = with_computed(replies.select("id", "reply"), "_body", strip_code_fence(F.col("reply")))
    is_object = F.coalesce(kind(parse_strict(F.col("_body"))) == "OBJECT", F.lit(False))
    record = F.when(is_object, F.from_json("_body", fixed.EVIDENCE_DDL))
    rows = with_computed(bodies, "_record", record).select(
        "id", F.col("_record").isNotNull().alias("_object"), "_record"
    )
    known = F.coalesce(F.col("_record.type_bewijs").isin(*fixed.EVIDENCE_TYPES), F.lit(False))
    found = F.coalesce(F.col("_record.bewijs_gevonden"), F.lit(False))
    return rows.select("id", "_record.*", (F.col("_object") & (known | ~found)).alias("valid"))


# distinct quotes of one document that are looked up side by side
QUOTES = 1024


def verify_quotes(records: DataFrame, texts: DataFrame) -> DataFrame:
    """Keep the records and add ``quote_found``: is the quote literally in the source text?

    ``texts``: (id, text), one row per id. The distinct quotes of a document are
    brought together first, so its text meets one row with all of them, not a row
    per record; only a document with more than ``QUOTES`` distinct quotes is met
    by one row for each ``QUOTES`` of them.
    """
    quotes = records.filter("direct_citaat <> ''").select("id", "direct_citaat").distinct()
    many = quotes.groupBy("id").agg(F.count(F.lit(1)).alias("_quotes")).filter(F.col("_quotes") > QUOTES)
    parts = F.coalesce(F.ceil(F.col("_quotes") / QUOTES), F.lit(1))
    asked = (
        quotes.join(many, "id", "left")
        .groupBy("id", F.pmod(F.xxhash64("direct_citaat"), parts).alias("_part"))
        .agg(F.collect_list("direct_citaat").alias("_asked"))
    )
    held = F.filter("_asked", lambda quote: F.contains(F.col("_text"), quote))
    found = (
        asked.join(texts.select("id", F.col("text").alias("_text")), "id")
        .select("id", F.explode(held).alias("direct_citaat"))
        .withColumn("_found", F.lit(True))
    )
    kept = records.join(found, ["id", "direct_citaat"], "left")
    return kept.select(*records.columns, F.coalesce("_found", F.lit(False)).alias("quote_found"))


def theme_of(data_point: Column) -> Column:
    """Theme of a data point, NULL for an unknown one."""
    return F.coalesce(
        *[F.when(data_point.isin(*points), F.lit(theme)) for theme, points in fixed.EVIDENCE_THEMES.items()]
    )


def evidence_verdicts(replies: DataFrame) -> DataFrame:
    """(id, datapunt_id, passed, remarks) of validator replies (id, datapunt_id, reply).

    Of several replies for one record all must pass. A reply that is no object
    or has no true ``validatie_geslaagd`` does not. ``remarks``: the distinct
    ones in text order.
    """
    bodies = with_computed(replies, "_body", strip_code_fence(F.col("reply")))
    is_object = F.coalesce(kind(parse_strict(F.col("_body"))) == "OBJECT", F.lit(False))
    verdict = F.when(is_object, F.from_json("_body", fixed.VERDICT_DDL))
    return (
        with_computed(bodies, "_verdict", verdict)
        .groupBy("id", "datapunt_id")
        .agg(
            F.bool_and(F.coalesce("_verdict.validatie_geslaagd", F.lit(False))).alias("passed"),
            F.sort_array(F.collect_set("_verdict.opmerkingen")).alias("remarks"),
        )
    )


def validated(verified: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Found evidence that counts, with its ``theme``: valid, literally quoted, passed by the validator."""
    counts = verified.filter("valid AND bewijs_gevonden AND quote_found")
    passed = verdicts.filter("passed").select("id", "datapunt_id")
    return counts.join(passed, ["id", "datapunt_id"], "left_semi").withColumn("theme", theme_of(F.col("datapunt_id")))


def evidence_summary(counted: DataFrame) -> DataFrame:
    """Counts per theme, data point and evidence type over :func:`validated` records."""
    return counted.groupBy("theme", "datapunt_id", "type_bewijs").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(F.greatest(F.lit(0), F.size("specifieke_metrics")).cast("long")).alias("metrics"),
    )


def evidence_metrics(counted: DataFrame) -> DataFrame:
    """One row per metric of :func:`validated` records, ``place`` from 0."""
    return counted.select(
        "id", "theme", "datapunt_id", F.posexplode("specifieke_metrics").alias("place", "_metric")
    ).select("id", "theme", "datapunt_id", "place", "_metric.*")
