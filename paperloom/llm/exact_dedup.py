"""Exact deduplication as a stateful stream.

Documents arrive as a stream of small arrivals: digest of the normalised text,
stable identifier, content locator and length. The stream keeps one state row
per digest on disk (RocksDB state store, no watermark, so nothing ever expires):
the smallest identifier seen, its locator, and how often the digest was seen.
A later run with the same ``state`` folder goes on with it.

A digest that was seen more than once is a hit, not yet a duplicate: the full
normalised texts behind its locators are compared, and rows that differ from
the keeper are grouped by their whole text instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import SPACE, scratch_path, stored

_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # many small stores: no disk space ahead of need
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
_ARRIVAL = "digest binary, doc_id long, locator long, n_bytes long"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


def sha256_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def locator(doc_id: Column, text: Column) -> Column:
    """Finds a row again: from its id and its normalised text."""
    return F.xxhash64(doc_id, text)


def digest_state(spark: SparkSession, arrivals: str, state: str) -> DataFrame:
    """Drain the arrivals in folder ``arrivals`` into the keyed state and read it.

    Returns ``(digest, keep_id, locator, n_bytes, seen)``, one row per digest.
    Every batch is written under its number, so a batch that is repeated after
    a failure replaces itself; the newest row of a digest is its state.
    """
    rows = spark.readStream.schema(_ARRIVAL).parquet(arrivals).select("digest", "doc_id", "locator", "n_bytes")
    keyed = rows.groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator", "n_bytes")).alias("keep"),
        F.count("*").alias("seen"),
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/batches/batch={number}")

    before = {key: spark.conf.get(key, None) for key in _STATE_CONF}
    for key, value in _STATE_CONF.items():
        spark.conf.set(key, value)
    try:
        (
            keyed.writeStream.outputMode("update")
            .foreachBatch(write)
            .option("checkpointLocation", f"{state}/checkpoint")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    schema = (
        "digest binary, keep struct<no_id boolean, doc_id long, locator long, n_bytes long>, seen long, batch int"
    )
    return (
        spark.read.schema(schema)
        .parquet(f"{state}/batches")
        # counts only grow, and all fields of a state row change together
        .groupBy("digest")
        .agg(F.max_by(F.struct("keep", "seen"), "batch").alias("now"))
        .select(
            "digest",
            F.col("now.keep.doc_id").alias("keep_id"),
            F.col("now.keep.locator").alias("locator"),
            F.col("now.keep.n_bytes").alias("n_bytes"),
            F.col("now.seen").alias("seen"),
        )
    )


def exact_groups(
    docs: DataFrame,
    digest: Callable[[Column], Column] = sha256_of,
    state: str | None = None,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: its group and whether it stays.

    Returns ``doc_id, keep_id, group_size, kept, digest, locator``. Of equal normalised
    texts the smallest doc_id stays; among rows that repeat doc_id and text one
    stays. A null doc_id counts as greater than all others. Null texts are equal
    to empty ones. An empty table gives an empty result. Other columns are
    ignored. ``state`` continues the state of earlier runs, whose documents then
    count in ``keep_id`` and ``group_size`` too; ``earlier`` are these documents,
    in which locators are looked up. A row whose keeper is not found stays.
    """
    spark = docs.sparkSession
    # the locator tells apart rows that share a doc_id: it is found again from the row
    def located(frame: DataFrame) -> DataFrame:
        texts = frame.select("doc_id", normalised(F.col("text")).alias("text"))
        return texts.select("doc_id", "text", locator(F.col("doc_id"), F.col("text")).alias("locator"))

    rows = located(docs)
    state = state or scratch_path(spark, "state")
    landed = f"{state}/arrivals/run={uuid.uuid4().hex}"
    rows.select(
        digest(F.col("text")).alias("digest"), "doc_id", "locator", F.octet_length("text").cast("long").alias("n_bytes")
    ).write.parquet(landed)
    arrivals = spark.read.schema(_ARRIVAL).parquet(landed)
    states = stored(digest_state(spark, f"{state}/arrivals", state), "states")
    placed = (
        arrivals.groupBy("digest", "doc_id", "locator", "n_bytes")
        .agg(F.count("*").alias("copies"))
        .join(states.withColumnsRenamed({"locator": "keep_locator", "n_bytes": "keep_bytes"}), "digest")
    )
    hits = placed.where("seen > 1").select("digest", "doc_id", "locator", "keep_locator", "copies")
    exact = _compared(rows if earlier is None else rows.union(located(earlier)), stored(hits, "hits"))
    single = placed.where("seen = 1").select(
        "doc_id", "digest", "keep_id", F.col("seen").alias("group_size"), "copies", F.lit(True).alias("first"), "locator"
    )
    groups = single.unionByName(
        exact.join(states.select("digest", "keep_id", "seen", F.col("locator").alias("keep_locator")), "digest").select(
            "doc_id",
            "digest",
            F.when(F.col("same"), F.col("keep_id")).otherwise(F.col("own_id")).alias("keep_id"),
            F.when(F.col("same"), F.col("seen") - F.col("others")).otherwise(F.col("own_size")).alias("group_size"),
            "copies",
            F.when(F.col("same"), F.col("locator") == F.col("keep_locator"))
            .otherwise(F.col("locator") == F.col("own_locator"))
            .alias("first"),
            "locator",
        )
    )
    return groups.select(
        "doc_id",
        "keep_id",
        "group_size",
        "digest",
        "locator",
        "first",
        F.explode(F.sequence(F.lit(1), "copies")).alias("copy"),
    ).select("doc_id", "keep_id", "group_size", (F.col("first") & (F.col("copy") == 1)).alias("kept"), "digest", "locator")


def _compared(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Check the full texts of hits against their keepers.

    ``same`` tells equal texts. Where a digest holds different texts, ``own_*``
    describe the group of the row's own text and ``others`` counts the rows of
    the digest that are not the keeper's. All joins are on locators or digests
    and leave large groups to AQE; nothing is windowed or collected by group.
    """
    texts = rows.select(F.col("locator").alias("at"), "text").join(
        # the plan for large tables at any size
        hits.select(F.col("locator").alias("at")).union(hits.select("keep_locator")).distinct().hint("merge"),
        "at",
        "left_semi",
    )
    texts = stored(texts.dropDuplicates(["at"]), "texts")
    keeper = texts.withColumnsRenamed({"at": "keep_locator", "text": "keep_text"})
    keepers = hits.select("digest", "keep_locator").distinct().join(keeper, "keep_locator").select("digest", "keep_text")
    checked = stored(
        hits.join(texts, F.col("locator") == F.col("at"))
        .join(keepers, "digest", "left")
        .select(
            "digest",
            "doc_id",
            "locator",
            "copies",
            F.col("text").eqNullSafe(F.col("keep_text")).alias("same"),
            F.when(~F.col("text").eqNullSafe(F.col("keep_text")), F.col("text")).alias("own_text"),
        ),
        "checked",
    )
    unlike = checked.where("not same")
    others = unlike.groupBy("digest").agg(F.sum("copies").alias("others"))
    own = (
        unlike.groupBy("digest", "own_text")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator")).alias("least"),
            F.sum("copies").alias("own_size"),
        )
        .select(
            F.col("digest").alias("o_digest"),
            F.col("own_text").alias("o_text"),
            F.col("least.doc_id").alias("own_id"),
            F.col("least.locator").alias("own_locator"),
            "own_size",
        )
    )
    return (
        checked.join(others, "digest", "left")
        .join(own, (F.col("digest") == F.col("o_digest")) & (F.col("own_text") == F.col("o_text")), "left")
        .withColumn("others", F.coalesce("others", F.lit(0)))
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Column names that this function uses itself do not clash with those of ``docs``.
    """
    kept = exact_groups(docs).where("kept").select(F.col("locator").alias("__at"), F.col("doc_id").alias("__id"))
    at = locator(F.col("doc_id"), normalised(F.col("text")))
    here = docs.withColumn("__locator", at)
    return (
        here.join(kept, (F.col("__locator") == F.col("__at")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
        .dropDuplicates(["__locator", "doc_id"])
        .drop("__locator")
    )
