"""The labeling job as a stream over the queue.

The stream's checkpoint replaces the destructive pop: a job is consumed when its
micro-batch is committed, and a batch that is run again overwrites its own part
of the reply log, so replays neither lose nor repeat rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import fixed_values as fixed
from ..operators.labeling import ChatModel, classify_jobs, enrich_jobs
from ..operators.queues import JOB_KEY
from ..session import remove_folder

REPLY_LOG = (
    "metadata_id string, question_id int, label_id int, skip_reason string, "
    "reply string, error string"
)
# Papers of a batch that are looked up by a filter.
LOOKED_UP = 1000
_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def reply_log(spark: SparkSession, path: str) -> DataFrame:
    """All stored replies; ``batch`` is the partition column."""
    return spark.read.schema(f"{REPLY_LOG}, batch long").parquet(path)


def papers_of(jobs: DataFrame, metadata: DataFrame) -> DataFrame:
    """The metadata that a batch of jobs can need.

    Of a batch with up to ``LOOKED_UP`` papers their ids reach the scan as a
    filter, so a table sorted by id is read only where they are. A larger batch
    reads the ids of the whole table, and its join picks the papers.
    """
    ids = [r[0] for r in jobs.filter("metadata_id IS NOT NULL").select("metadata_id").distinct().limit(LOOKED_UP + 1).collect()]
    return metadata.filter(F.col("id").isin(ids)) if len(ids) <= LOOKED_UP else metadata


def start_labeling(
    queue: DataFrame,
    questions: DataFrame,
    metadata: DataFrame,
    model: ChatModel,
    log_path: str,
    checkpoint_path: str,
    *,
    in_flight: int = fixed.HOSTED_IN_FLIGHT,
    parallelism: int | None = None,
    remember: str | None = None,
) -> StreamingQuery:
    """Drain what the queue stream holds now, and return the running query.

    The keys of all jobs seen are keyed state on disk in the checkpoint, so a
    job is asked once, and a batch reads neither the log nor earlier jobs. The
    raw replies are written once per batch and parsed by whoever reads the log,
    so no later action repeats a model call. A batch is what a failure repeats:
    bound it where the queue is read (``maxFilesPerTrigger``).

    ``remember`` (an interval, as ``30 days``) bounds the state: a key is forgotten
    that long after the batch in which it was first seen, by the time that the
    checkpoint notes for a batch, so a batch that is run again decides alike. A
    job that comes back later than that is asked anew, and its answer replaces
    the earlier one where replies become labels. Without it no key is forgotten.
    It stays with a checkpoint, as does the number of partitions:
    ``spark.sql.shuffle.partitions`` of the first start stays with the state.
    """
    spark = queue.sparkSession
    empty = spark.createDataFrame([], REPLY_LOG)
    empty.write.mode("overwrite").parquet(f"{log_path}/batch=-1")

    def label(batch: DataFrame, batch_id: int) -> None:
        # Written first: the batch is read several times, its state only once.
        fresh = f"{log_path}-jobs/batch={batch_id}"
        batch.write.mode("overwrite").parquet(fresh)
        jobs = batch.sparkSession.read.schema(batch.schema).parquet(fresh)
        replies = classify_jobs(
            enrich_jobs(jobs, questions, papers_of(jobs, metadata)), model,
            in_flight=in_flight, parallelism=parallelism,
        )
        replies.write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")
        remove_folder(batch.sparkSession, fresh)

    jobs = queue.select(*JOB_KEY)
    if remember is None:
        unseen = jobs.dropDuplicates(JOB_KEY)
    else:
        stamped = jobs.withColumn("_seen", F.current_timestamp()).withWatermark("_seen", remember)
        unseen = stamped.dropDuplicatesWithinWatermark(JOB_KEY).select(*JOB_KEY)
    before = spark.conf.get(_STATE_STORE, None)
    spark.conf.set(_STATE_STORE, _ROCKSDB)
    try:
        return (
            unseen.writeStream.foreachBatch(label)
            .option("checkpointLocation", checkpoint_path)
            .trigger(availableNow=True)
            .start()
        )
    finally:  # a query keeps the settings of its start
        if before is None:
            spark.conf.unset(_STATE_STORE)
        else:
            spark.conf.set(_STATE_STORE, before)
