"""From a raw model reply to an answer and a confidence."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as fixed
from .json_rules import is_number, kind, let, member, parse_strict
from .text import strip, strip_code_fence


def reply_document(reply: Column) -> Column:
    """VARIANT object of a reply, out of its code fence; NULL for anything else."""
    return let(
        parse_strict(strip_code_fence(reply)), lambda doc: F.when(kind(doc) == "OBJECT", doc)
    )


def answer(value: Column) -> Column:
    """True / False for JSON booleans and yes-no words; NULL (unknown) otherwise."""

    def by_kind(k: Column) -> Column:
        word = F.lower(strip(F.try_variant_get(value, "$", "string")))
        return F.when(k == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).when(
            k == "STRING",
            let(word, lambda w: F.when(w.isin(*fixed.YES_WORDS), True).when(w.isin(*fixed.NO_WORDS), False)),
        )

    return let(kind(value), by_kind)


def _number(text: Column) -> Column:
    """DOUBLE of a numeric text; underscores may group digits, suffixes are no numbers."""
    plain = F.regexp_replace(strip(text), r"(?<=\d)_(?=\d)", "")
    shape = r"(?i)^[+-]?(inf|infinity|nan|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?)$"
    return let(plain, lambda p: F.when(p.rlike(shape), p.try_cast("double")))


def confidence(value: Column) -> Column:
    """DECIMAL(3,2) in [0, 1]; values in (1, 100] count as percentages."""

    def number(k: Column) -> Column:
        return F.when(k == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double")).when(
            is_number(k) | (k == "STRING"), _number(F.try_variant_get(value, "$", "string"))
        )

    def score(n: Column) -> Column:
        scaled = F.when((n > 1) & (n <= 100), n / 100).otherwise(n)
        return F.when(n.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))

    return let(let(kind(value), number), score).cast("decimal(3,2)")


def parse_reply(reply: Column) -> Column:
    """Struct (answer, confidence); anything unclear answers False."""

    def fields(doc: Column) -> Column:
        return F.struct(
            F.coalesce(answer(member(doc, "answer")), F.lit(False)).alias("answer"),
            confidence(member(doc, "confidence")).alias("confidence"),
        )

    return let(reply_document(reply), fields)
