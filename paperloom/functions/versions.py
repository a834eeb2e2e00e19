"""Paper version rules over the stored ``versions`` JSON text.

Two rules exist side by side: downloads take the *highest* number, papers take
the *last* entry. They differ on unordered lists, so both are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as fixed
from .json_rules import is_number, kind, let, member, parse_strict
from .text import strip


def _entries(versions: Column) -> Column:
    return F.try_variant_get(parse_strict(versions, "]"), "$", "array<variant>")


def max_version(versions: Column) -> Column:
    """Highest version number as BIGINT; 1 when nothing usable is found."""

    def number(value: Column) -> Column:
        text = strip(F.try_variant_get(value, "$", "string"))
        digits = F.regexp_extract(text, fixed.VERSION_NUMBER_PATTERN, 1)
        return let(
            kind(value),
            lambda k: F.when(k == "STRING", digits.try_cast("bigint")).when(
                is_number(k), F.try_variant_get(value, "$", "bigint")
            ),
        )

    values = F.transform(_entries(versions), lambda entry: member(entry, "version"))
    return F.greatest(F.lit(1).cast("bigint"), F.array_max(F.transform(values, number)))


def last_version_id(base_id: Column, versions: Column) -> Column:
    """``base_id`` plus the suffix of the last entry, ``v1`` when unusable."""

    def is_set(value: Column) -> Column:
        text = F.try_variant_get(value, "$", "string")
        return let(
            kind(value),
            lambda k: F.when(k == "STRING", text != "")
            .when(k == "BOOLEAN", text == "true")
            .when(is_number(k), F.try_variant_get(value, "$", "double") != 0)
            .otherwise(k.isin("ARRAY", "OBJECT") & ~text.isin("[]", "{}")),
        )

    def named(entry: Column) -> Column:
        return let(
            member(entry, "version"),
            lambda v: F.when(F.coalesce(is_set(v), F.lit(False)), v).otherwise(member(entry, "v")),
        )

    def text(value: Column) -> Column:
        return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))

    def suffix(entry: Column) -> Column:
        # A bare text counts even when empty, a member of an object only with content.
        given = F.when(kind(entry) == "OBJECT", F.nullif(text(named(entry)), F.lit(""))).otherwise(text(entry))
        return let(given, lambda t: F.when(t.startswith("v"), t).otherwise(F.concat(F.lit("v"), t)))

    last = F.transform(F.slice(_entries(versions), -1, 1), suffix)
    return F.concat(base_id, F.coalesce(F.get(last, F.lit(0)), F.lit("v1")))


def previous_version_id(paper_id: Column) -> Column:
    """The id one version back; NULL without a version or at version 1 and below."""
    base = F.regexp_extract(paper_id, fixed.VERSIONED_ID_PATTERN, 1)
    digits = F.regexp_extract(paper_id, fixed.VERSIONED_ID_PATTERN, 2)
    number = digits.try_cast("decimal(38,0)")
    return F.when(number > 1, F.concat(base, F.lit("v"), (number - 1).cast("string")))
