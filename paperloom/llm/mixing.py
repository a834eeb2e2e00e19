"""Mix sources to target weights by weighted fair queueing.

Every source is a queue whose documents wait in shuffled order, once per epoch.
A document's virtual finish time is the cumulative size of its queue up to its
end, divided by the queue's target; virtual time 1 is where the total budget
runs out, for all queues at once. A document that is in service at time 1 waits
as two pieces, up to that time and after it.

The mix is the queue of all pieces, range-sorted by finish time and truncated at
the total budget: the words of each range of the sorted queue are added up, whole
ranges before the budget's end are taken, and only the range that holds the end
is summed piece by piece.

The running sums never gather a source in one task: a queue is cut into buckets
of hash order, bucket sums are added up first, and only the few documents of a
bucket are summed row by row. The number of buckets and of ranges follows the
number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import WORD, stored

#: documents of one queue that share a bucket, on average
BUCKET_ROWS = 4096
#: pieces of the sorted queue that share a range, on average
RANGE_ROWS = 65536
#: epochs per document
EPOCHS = 2


def n_words(text: Column) -> Column:
    """Words between ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    epochs: int = EPOCHS,
) -> DataFrame:
    """``(source, source_size, weight, target)`` for rows of ``(source, size)``.

    Sources in code point order, null last, take the weights in turn. The budget
    is ``share`` of all sizes. A target stops at ``epochs`` times its source's
    size and what is left over is shared again by weight: sorted by the level at
    which a source is full, source k is full if the budget reaches its level
    after the fuller ones are paid off. One row per source is all that meets in
    one task here.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1)
    level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    since = level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.col("level") * F.col("open_weight") + F.col("paid") <= F.col("budget")
    water = (F.col("budget") - F.sum(F.when(full, F.col("most")).otherwise(0.0)).over(everything)) / F.sum(
        F.when(full, 0.0).otherwise(F.col("weight"))
    ).over(everything)
    return (
        per_source.withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(float(epochs)))
        .withColumn("level", F.col("most") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("paid", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(since))
        .withColumn("target", F.when(full, F.col("most")).otherwise(water * F.col("weight")))
        .select("source", "source_size", "weight", "target")
    )


def fair_queue(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    epochs: int = EPOCHS,
    seed: int = 17,
) -> DataFrame:
    """Line up ``(doc_id, source, size)`` rows: one piece per document and epoch, or two.

    Adds ``copy`` (numbers rows that repeat all three values), ``epoch``,
    ``source_size``, ``target``, ``words`` of the piece and its ``start`` and
    ``finish`` (virtual times: words of the queue per whole word of its target);
    ``late`` tells a piece that begins when the budget has run out. Rows of size
    0 are one piece without words; null sizes count 0; a source of size 0 has
    target 0 and null times. Equal hash order falls to doc_id, size and copy.
    Null ids and sources are ordinary values. An empty table gives an empty
    result. ``docs`` is read several times: pass a stored table.
    """
    docs = docs.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    targets = source_targets(docs, weights, share, epochs)
    buckets = docs.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BUCKET_ROWS))).scalar()
    shuffled = (
        docs.groupBy("doc_id", "source", "size")
        .agg(F.count("*").alias("copies"))
        .select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        .withColumn("turn", F.md5(F.concat_ws("-", F.lit(seed), "epoch", "doc_id", "copy").cast("binary")))
        # a bucket is a range of the order, so buckets in turn are the order itself
        .withColumn("bucket", F.floor(F.conv(F.substring("turn", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)))
    )
    key = ["source", "epoch", "bucket"]
    sums = shuffled.groupBy(key).agg(F.sum("size").alias("bucket_size"))
    queue = Window.partitionBy("source").orderBy("epoch", "bucket")
    begins = sums.withColumn("begin", F.sum("bucket_size").over(queue) - F.col("bucket_size")).join(
        targets.withColumnRenamed("source", "queue"), F.col("source").eqNullSafe(F.col("queue"))
    )
    begins = begins.select(
        *(F.col(c).alias(f"b_{c}") for c in key), "begin", "source_size", "target"
    )
    same = [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in key]
    inside = (
        Window.partitionBy(key)
        .orderBy("turn", "doc_id", "size", "copy")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    budget = F.round("target").cast("long")  # of the queue, in whole words
    ahead = F.col("done") - F.col("size")
    until = F.least(F.col("done"), F.greatest(ahead, budget))
    piece = lambda begin, end, late: F.struct(
        begin.alias("begin"), end.alias("end"), F.lit(late).alias("late")
    )
    pieces = F.filter(
        F.array(piece(ahead, until, False), piece(until, F.col("done"), True)),
        lambda p: (p["end"] > p["begin"]) | ((F.col("size") == 0) & ~p["late"]),
    )
    per_time = F.when(budget > 0, budget)
    return (
        shuffled.withColumn("inside", F.sum("size").over(inside))
        .join(begins, same[0] & same[1] & same[2])
        .withColumn("done", F.col("begin") + F.col("inside"))
        .withColumn("piece", F.explode(pieces))
        .select(
            *("doc_id", "source", "size", "copy", "epoch", "source_size", "target"),
            (F.col("piece.end") - F.col("piece.begin")).alias("words"),
            (F.col("piece.begin") / per_time).alias("start"),
            (F.col("piece.end") / per_time).alias("finish"),
            "piece.late",
        )
    )


def _turn() -> list[Column]:
    """Order of service: finish time, then what is due at time 1, then names."""
    return [
        F.col("finish").asc_nulls_last(),
        F.col("late").asc(),
        F.col("source").asc_nulls_last(),
        *(F.col(c).asc() for c in ("doc_id", "size", "copy", "epoch")),
    ]


def truncated(queue: DataFrame, budget: Column) -> DataFrame:
    """The first ``budget`` words of the queue in order of service, as ``served``.

    Every piece is returned; ``served`` is 0 after the end of the budget and a
    part of ``words`` for the piece that crosses it. The pieces are dealt into
    ranges of the order and written once, so that a range keeps its rows; sums
    of the ranges (one row per ``RANGE_ROWS`` pieces) meet in one task. The
    ranges are disjoint and their numbers ascend, as Spark's range partitions do.
    """
    queue = stored(queue, "queue")
    count = max(1, -(-queue.count() // RANGE_ROWS))
    dealt = stored(
        queue.repartitionByRange(count, *_turn()).withColumn("range", F.spark_partition_id()), "ranges"
    )
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("range").agg(F.sum("words").alias("range_words"))
    left = F.greatest(F.lit(0).cast("long"), budget - F.coalesce(F.sum("range_words").over(before), F.lit(0)))
    limits = sums.select(F.col("range").alias("r_range"), "range_words", left.alias("room"))
    ranged = dealt.join(limits, F.col("range") == F.col("r_range"))
    ends = (F.col("room") > 0) & (F.col("room") < F.col("range_words"))
    # at most one range holds the end of the budget
    inside = Window.partitionBy("range").orderBy(*_turn()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = F.col("room") - (F.sum("words").over(inside) - F.col("words"))
    whole = ranged.where(~ends).withColumn("served", F.when(F.col("room") > 0, F.col("words")).otherwise(F.lit(0)))
    crossed = ranged.where(ends).withColumn("served", F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), part)))
    return whole.unionByName(crossed).drop("range", "r_range", "range_words", "room")


def serve(sizes: DataFrame, **options) -> DataFrame:
    """The queue of ``(doc_id, source, size)`` rows with what the total budget serves of each piece."""
    shares = {k: v for k, v in options.items() if k != "seed"}
    budget = source_targets(sizes, **shares).agg(F.coalesce(F.sum(F.round("target").cast("long")), F.lit(0)))
    return truncated(fair_queue(sizes, **options), budget.scalar())


def mix_order(served: DataFrame) -> DataFrame:
    """The mix itself: served pieces, range-sorted by virtual finish time."""
    return served.where("served > 0").orderBy(*_turn())


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``documents``: what the mix takes of it, repeats counted.

    Reads ``doc_id``, ``source`` and the whole ``text`` (null: size 0); other
    columns are ignored. Returns ``doc_id, size, source_size, target, taken`` and
    ``first_finish`` (virtual time at which it first ends, null if not taken).
    """
    sizes = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    return (
        serve(sizes, **options)
        .groupBy("doc_id", "source", "size", "copy", "source_size", "target")
        .agg(
            F.sum("served").alias("taken"),
            F.min(F.when(F.col("served") > 0, F.col("finish"))).alias("first_finish"),
        )
        .select("doc_id", "size", "source_size", "target", "taken", "first_finish")
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns.

    Whole documents are given: one that is taken in part stays if at least half
    of it is taken. Rows that repeat id and size share what is taken of them.
    """
    taken = (
        mix(docs, **options)
        .groupBy("doc_id", "size")
        .agg(F.sum("taken").alias("taken"), F.count("*").alias("rows"))
        .where("size > 0")
        .select(
            F.col("doc_id").alias("__id"),
            F.col("size").alias("__size"),
            F.round(F.col("taken") / F.col("size") / F.col("rows")).cast("int").alias("__times"),
        )
        .where("__times > 0")
    )
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (n_words(F.col("text")) == F.col("__size"))
    return docs.join(taken, same).select(
        *(docs[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), "__times")).alias("__time")
    ).drop("__time")
