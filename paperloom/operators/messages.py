"""Chat messages for models that know no system role."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import strip
from .shared import ordered_concat

_KEPT_ROLES = ("user", "model")


def merge_system(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) without system messages.

    All system texts of a conversation, a blank line after each, go in front of
    its first message if that is a user message, else into a new user message
    before it (one turn below the first turn of the conversation). Roles other
    than user and model are dropped.

    Messages stay rows. Only the system texts are joined, run by run, and they
    meet the first message on (conv_id, turn), so a very long conversation is
    no hot key.
    """
    role = F.lower(strip(F.coalesce("role", F.lit("user"))))
    rows = messages.withColumn("_role", role)
    kept = rows.filter(F.col("_role").isin(*_KEPT_ROLES))

    first_kept = F.min(F.when(F.col("_role").isin(*_KEPT_ROLES), F.struct("turn", "role")))
    heads = rows.groupBy("conv_id").agg(
        first_kept.alias("first"),
        F.min("turn").alias("start"),
        F.max(F.col("_role") == "system").alias("has_system"),
    ).filter("has_system")
    system = ordered_concat(
        rows.filter("_role = 'system'"), ["conv_id"], "turn", F.col("text"), "\n\n", "preamble"
    )
    heads = heads.join(system, "conv_id").select(
        "conv_id",
        F.when(F.col("first.role") == "user", F.col("first.turn")).alias("turn"),
        "start",
        F.concat(F.coalesce("preamble", F.lit("")), F.lit("\n\n")).alias("preamble"),
    )
    merged = kept.join(heads.select("conv_id", "turn", "preamble"), ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", F.concat(F.coalesce("preamble", F.lit("")), F.col("text")).alias("text")
    )
    added = heads.filter("turn IS NULL").select(
        "conv_id", (F.col("start") - 1).alias("turn"), F.lit("user").alias("role"),
        F.col("preamble").alias("text"),
    )
    return merged.unionByName(added)
