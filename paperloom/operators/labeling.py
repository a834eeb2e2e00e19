"""The labeling job: enrich queued jobs, ask the model, parse, store positives."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .. import fixed_values as fixed
from ..functions.replies import parse_reply
from ..functions.text import is_blank_input, user_prompt
from .queues import JOB_KEY
from .shared import only_for, with_computed

# Answered rows that leave a task together.
_ROWS_OUT = 64

# A model call: chat messages in, reply text out. It must be picklable.
ChatModel = Callable[[list[dict[str, str]]], str]


def enrich_jobs(jobs: DataFrame, questions: DataFrame, metadata: DataFrame) -> DataFrame:
    """Jobs with prompt, label, title and abstract.

    ``skip_reason`` names what is missing (key, question or paper); such rows
    are to be counted and left out of the model stage. The papers are first
    cut to those of the jobs, folded to one row per paper: where these are few the
    texts are not shuffled, where they are many both joins share one shuffle.
    """
    asked = questions.select(F.col("id").alias("question_id"), "prompt", "label_id")
    papers = metadata.select(
        F.col("id").alias("metadata_id"), "title", "abstract", F.lit(True).alias("_stored")
    )
    papers = only_for(papers, jobs, ["metadata_id"])
    no_key = (F.coalesce("metadata_id", F.lit("")) == "") | F.col("question_id").isNull()
    return (
        jobs.select(*JOB_KEY)
        .join(asked, "question_id", "left")
        .join(papers, "metadata_id", "left")
        .select(
            *JOB_KEY,
            "label_id",
            "prompt",
            "title",
            "abstract",
            F.when(no_key, "key")
            .when(F.col("label_id").isNull(), "question")
            .when(F.col("_stored").isNull(), "paper")
            .alias("skip_reason"),
        )
    )


def ask_model(
    df: DataFrame,
    prompt: str,
    model: ChatModel,
    *,
    system: str | None = None,
    in_flight: int = fixed.HOSTED_IN_FLIGHT,
    parallelism: int | None = None,
) -> DataFrame:
    """Replace the column ``prompt`` by ``reply`` and ``error``; NULL gets no call.

    ``parallelism`` spreads the rows over that many tasks, each with at most
    ``in_flight`` calls at a time, so the two multiply to the load on the model.
    By default it is the number of cores: rows are few and calls are slow, and a
    plan that merges small partitions would leave them to one task. Rows come in
    the order in which they are answered. Select only what is needed first: all
    columns travel to Python and back.
    """
    source = df.repartition(parallelism or df.sparkSession.sparkContext.defaultParallelism)
    kept_fields = [f for f in df.schema.fields if f.name != prompt]
    result = T.StructType(kept_fields).add("reply", "string").add("error", "string")
    preamble = [{"role": "system", "content": system}] if system is not None else []

    def call(text: str | None) -> tuple[str | None, str | None]:
        if text is None:
            return None, None
        try:
            return model([*preamble, {"role": "user", "content": text}]), None
        except Exception as failure:  # one failed call must not lose the batch
            return None, f"{type(failure).__name__}: {failure}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return answered(batches, prompt, call, in_flight)

    return source.mapInArrow(run, result)


def answered(
    batches: Iterator[pa.RecordBatch],
    prompt: str,
    call: Callable[[str | None], tuple[str | None, str | None]],
    in_flight: int,
) -> Iterator[pa.RecordBatch]:
    """The rows of all batches with ``reply`` and ``error`` for ``prompt``, in the order of the answers.

    Whenever a call ends, the next row is asked, also one of a later batch: a
    slow call holds up itself only. Batches are read when their rows are needed.
    """

    def rows() -> Iterator[tuple[pa.RecordBatch, int, str | None]]:
        for batch in batches:
            kept = batch.drop_columns([prompt])
            for place, text in enumerate(batch.column(prompt).to_pylist()):
                yield kept, place, text

    def out(done: list[tuple[pa.RecordBatch, int, str | None, str | None]]) -> pa.RecordBatch:
        kept = pa.concat_batches([batch.slice(place, 1) for batch, place, _, _ in done])
        replies = pa.array([reply for *_, reply, _ in done], pa.string())
        errors = pa.array([error for *_, error in done], pa.string())
        return kept.append_column("reply", replies).append_column("error", errors)

    asked: dict = {}
    done: list[tuple[pa.RecordBatch, int, str | None, str | None]] = []
    with ThreadPoolExecutor(in_flight) as pool:

        def settle() -> None:
            for call_ in wait(asked, return_when=FIRST_COMPLETED).done:
                done.append((*asked.pop(call_), *call_.result()))

        for kept, place, text in rows():
            if len(asked) >= in_flight:
                settle()
            asked[pool.submit(call, text)] = (kept, place)
            if len(done) >= _ROWS_OUT:
                yield out(done)
                done.clear()
        while asked:
            settle()
        for begin in range(0, len(done), _ROWS_OUT):
            yield out(done[begin : begin + _ROWS_OUT])


def classify_jobs(
    enriched: DataFrame,
    model: ChatModel,
    *,
    in_flight: int = fixed.HOSTED_IN_FLIGHT,
    parallelism: int | None = None,
) -> DataFrame:
    """Raw model replies of the enriched jobs; skipped and blank jobs get no call."""
    question, title, abstract = F.col("prompt"), F.col("title"), F.col("abstract")
    askable = F.col("skip_reason").isNull() & ~is_blank_input(question, title, abstract)
    jobs = enriched.select(
        *JOB_KEY,
        "label_id",
        "skip_reason",
        F.when(askable, user_prompt(question, title, abstract)).alias("ask"),
    )
    return ask_model(
        jobs,
        "ask",
        model,
        system=fixed.CLASSIFIER_SYSTEM_TEXT,
        in_flight=in_flight,
        parallelism=parallelism,
    )


def judge_replies(replies: DataFrame) -> DataFrame:
    """Replace the raw reply by ``answer`` and ``confidence_score``.

    A missing or failed call answers False; skipped jobs have no answer.
    """
    parsed = with_computed(replies, "_parsed", parse_reply(F.col("reply")))
    return parsed.select(
        *JOB_KEY,
        "label_id",
        "skip_reason",
        "error",
        F.when(F.col("skip_reason").isNull(), F.col("_parsed.answer")).alias("answer"),
        F.col("_parsed.confidence").alias("confidence_score"),
    )


def positive_labels(judged: DataFrame) -> DataFrame:
    """Label changes of the jobs answered with yes."""
    return judged.filter("answer").select("metadata_id", "label_id", "question_id", "confidence_score")


def labeling_statistics(judged: DataFrame) -> DataFrame:
    """Counts of one run. Failed calls count as processed and as ``model_errors``."""
    return judged.agg(
        F.count_if(F.col("skip_reason").isNull()).alias("processed"),
        F.count_if(F.col("answer")).alias("labeled"),
        F.count_if(F.col("skip_reason").isNotNull()).alias("skipped_missing"),
        F.count_if(F.col("error").isNotNull()).alias("model_errors"),
    )
