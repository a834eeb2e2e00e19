"""The corpus as stored tables, and the jobs that move it forward.

Every job takes a ``run_id`` that grows from job to job. It reads the tables as
they were before that run and writes under its number, so a job that failed is
repeated with the same number and ends in the same state. Rows never pass
through the driver; it only receives counts.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps
from inspect import signature

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed_values as fixed
from ..operators import artifacts, catalog, conversion, ingest, integrity, keyed, labeling, queues
from ..operators.shared import only_for
from ..schemas import RECORDS, TABLES
from ..session import remove_folder
from ..sources import archives, files
from ..sources.changelog import ChangeLog, check_run

_INSERT_ONLY = ("metadata", "labels", "questions")


def _job(method: Callable) -> Callable:
    """A method that writes tables under its ``run_id``.

    Its rows count from the moment it has ended: a marker of the run is written
    last. A number below the newest finished run is refused, as that run would
    read tables that already hold what came after it.
    """
    names = signature(method)

    @wraps(method)
    def run(self: Corpus, *args: object, **options: object) -> object:
        run_id = names.bind(self, *args, **options).arguments["run_id"]
        check_run(run_id)
        newest = max(self.finished_runs(), default=0)
        if run_id < newest:
            raise ValueError(f"run {run_id} is older than run {newest}, which has finished")
        result = method(self, *args, **options)
        self._finish(run_id)
        return result

    return run


@dataclass(frozen=True)
class Corpus:
    spark: SparkSession
    root: str

    def log(self, name: str) -> ChangeLog:
        schema, keys = {**TABLES, **RECORDS}[name]
        return ChangeLog(self.spark, f"{self.root}/{name}", schema, keys, name in _INSERT_ONLY)

    def table(self, name: str, before: int | None = None) -> DataFrame:
        """Rows of all finished runs, or of those before the run ``before``."""
        return self.log(name).current(before, self.finished_runs())

    def create(self) -> None:
        for name in (*TABLES, *RECORDS):
            self.log(name).create()
        self._finish(-1)

    @_job
    def load(self, tables: dict[str, DataFrame], run_id: int) -> None:
        """Store rows that were prepared elsewhere, as they are."""
        for name, rows in tables.items():
            self.log(name).append(rows, run_id)

    def finished_runs(self) -> list[int]:
        """Numbers of the jobs that have ended: one number per job."""
        marks = self.spark.read.schema("run long").option("recursiveFileLookup", True)
        return [r["run"] for r in marks.parquet(f"{self.root}/_finished").collect()]

    def _finish(self, run_id: int) -> None:
        mark = self.spark.createDataFrame([(run_id,)], "run long").coalesce(1)
        mark.write.mode("overwrite").parquet(f"{self.root}/_finished/{run_id}")

    @_job
    def compact(self, name: str, run_id: int) -> None:
        """Make the current rows of a table its base: later reads skip all earlier changes."""
        self.log(name).compact(run_id, self.finished_runs())

    def clean(self, before: int) -> dict[str, int]:
        """Remove what finished runs below ``before`` no longer need; returns folders by kind.

        These are their intermediate tables (with the records, rejects and texts
        that can be asked for by run number) and the changes that a base holds.
        Nothing of a run that has not finished is touched, nor any current row.
        """
        finished = [r for r in self.finished_runs() if 1 <= r < before]
        for run in finished:
            remove_folder(self.spark, f"{self.root}/_runs/{run}")
        logs = [self.log(name).clean(finished) for name in (*TABLES, *RECORDS)]
        return {"runs": len(finished), "changes": sum(map(len, logs))}

    def _stored(self, df: DataFrame, name: str, run_id: int) -> DataFrame:
        """Write an intermediate result and read it back: later steps do not repeat its work."""
        path = f"{self.root}/_runs/{run_id}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    # ---- ingest ---------------------------------------------------------

    @_job
    def import_metadata(
        self,
        path: str,
        run_id: int,
        as_of: str,
        max_records: int | None = None,
        mode: str = "quarantine",
    ) -> dict[str, int]:
        """Validate a JSON Lines dump and add the papers that are not stored yet.

        The lines are parsed once, into a folder of the run. Bad records stay
        there with their violations; ``failfast`` fails at the first one and
        leaves the table alone.
        """
        good = self._records(path, run_id, as_of, max_records, mode)
        stored = only_for(self.table("metadata", run_id).select("id"), good, ["id"])
        conflicts = self._stored(
            ingest.conflicting_ids(stored, good, files.LINE_ORDER), "conflicts", run_id
        )
        new = ingest.without_conflicts(good, conflicts, files.LINE_ORDER)
        self.log("metadata").append(new, run_id)
        return {
            "inserted": self.log("metadata").written(run_id).count(),
            "rejected": self.quarantine(run_id).count(),
        }

    def _records(self, path: str, run_id: int, as_of: str, max_records: int | None, mode: str) -> DataFrame:
        """The good records of a dump as rows of the metadata table, in the folder of the run."""
        lines = ingest.json_lines(files.read_json_lines(self.spark, path), files.LINE_ORDER, max_records)
        checked = ingest.validate(lines)
        extra = (*files.LINE_ORDER, "value", "violations")
        rows = ingest.reviewed(ingest.metadata_rows(checked, _time(as_of), extra))
        if mode != "quarantine":
            rows = ingest.accept(rows, mode)
        return ingest.accept(self._stored(rows, "records", run_id)).drop("value", "violations")

    @_job
    def insert_strict(self, path: str, run_id: int, as_of: str, mode: str = "quarantine") -> dict[str, int]:
        """Add all good records of a dump, or none if an id is stored already or occurs twice.

        The records are staged in the folder of the run, where no reader sees
        them, and audited by their ids alone; only then they are stored, and
        they show when the run has ended. The refused ids stay with the run.
        """
        staged = self._records(path, run_id, as_of, None, mode).drop(*files.LINE_ORDER)
        stored = only_for(self.table("metadata", run_id).select("id"), staged, ["id"])
        refused = self._stored(
            ingest.metadata_conflicts(stored, staged.select("id")), "refused", run_id
        ).count()
        if refused:
            raise ValueError(f"{refused} ids are stored already or occur twice; nothing was inserted")
        self.log("metadata").append(staged, run_id)
        return {
            "inserted": self.log("metadata").written(run_id).count(),
            "rejected": self.quarantine(run_id).count(),
        }

    def refused(self, run_id: int) -> DataFrame:
        """(id, rows, reason) of the ids for which a strict insert stored nothing."""
        return self.spark.read.parquet(f"{self.root}/_runs/{run_id}/refused")

    # ---- deletes --------------------------------------------------------

    @_job
    def delete_metadata(self, ids: DataFrame, run_id: int) -> dict[str, int]:
        """Delete papers' metadata (``ids``: column id) with their labels and queued jobs.

        The papers stay and lose their reference. Returns removed rows by table.
        """
        ids = self._stored(ids.select("id").distinct(), "ids", run_id)
        tables = {name: self.table(name, run_id) for name in ("metadata", "metadata_labels", "labeling_queue")}
        papers = integrity.papers_without_metadata(self.table("papers", run_id), ids)
        self.log("papers").append(papers, run_id)
        return self._remove(integrity.removed_with_metadata(tables, ids), run_id)

    @_job
    def delete_labels(self, ids: DataFrame, run_id: int) -> dict[str, int]:
        """Delete labels (``ids``: column id) with their questions, the jobs for these and the given labels."""
        ids = self._stored(ids.select("id").distinct(), "ids", run_id)
        names = ("labels", "questions", "labeling_queue", "metadata_labels")
        return self._remove(integrity.removed_with_labels({n: self.table(n, run_id) for n in names}, ids), run_id)

    def _remove(self, keys: dict[str, DataFrame], run_id: int) -> dict[str, int]:
        # all keys are looked up before anything is removed: a run reads the tables as of before it
        stored = {name: self._stored(rows, f"removed-{name}", run_id) for name, rows in keys.items()}
        for name, rows in stored.items():
            self.log(name).remove(rows, run_id)
        return {name: rows.count() for name, rows in stored.items()}

    def quarantine(self, run_id: int) -> DataFrame:
        """(value, violations) of the records an import rejected."""
        return ingest.quarantined(self.spark.read.parquet(f"{self.root}/_runs/{run_id}/records"))

    @_job
    def import_taxonomy(self, path: str, run_id: int, as_of: str) -> dict[str, int]:
        """Seed labels and questions from JSON files; what is stored stays as it is."""
        items = self._stored(
            ingest.taxonomy_items(files.read_seed(self.spark, path), "file"), "taxonomy", run_id
        )
        labels, questions = self.table("labels", run_id), self.table("questions", run_id)
        self.log("labels").append(ingest.seed_labels(labels, items), run_id)
        seeded = labels.unionByName(self.log("labels").written(run_id))
        self.log("questions").append(
            ingest.seed_questions(questions, seeded, items, "file", _time(as_of)), run_id
        )
        return {
            "questions": self.log("questions").written(run_id).count(),
            "labels": self.log("labels").written(run_id).count(),
        }

    @_job
    def prepare_papers(self, run_id: int, as_of: str, limit: int | None = None) -> int:
        new = queues.prepare_papers(
            self.table("metadata", run_id), self.table("papers", run_id), _time(as_of), limit
        )
        self.log("papers").append(new, run_id)
        return self.log("papers").written(run_id).count()

    @_job
    def insert_papers(self, incoming: DataFrame, run_id: int, as_of: str) -> int:
        """Add papers that are not stored: arxiv_id, metadata_id and any statuses."""
        new = keyed.new_papers(
            self.table("papers", run_id), incoming, self.table("metadata", run_id), _time(as_of)
        )
        self.log("papers").append(new, run_id)
        return self.log("papers").written(run_id).count()

    @_job
    def update_papers(self, changes: DataFrame, run_id: int, as_of: str) -> int:
        """Set fields of stored papers; returns how many there were."""
        touched = only_for(self.table("papers", run_id), changes, ["arxiv_id"])
        self.log("papers").append(keyed.update_papers(touched, changes, _time(as_of)), run_id)
        return self.log("papers").written(run_id).count()

    # ---- labeling -------------------------------------------------------

    @_job
    def prepare_labeling(
        self, question_id: int, run_id: int, date_after: str | None = fixed.DEFAULT_DATE_AFTER
    ) -> dict[str, int]:
        """Queue one question for the selected papers; the question must be stored."""
        known = catalog.question_by_id(self.table("questions", run_id), question_id)
        if known.isEmpty():
            raise ValueError(f"unknown question {question_id}")
        attempts = queues.enqueue_labeling(
            self.table("metadata", run_id), self.table("labeling_queue", run_id), question_id, date_after
        )
        return self._enqueue(
            "labeling_queue", attempts, lambda rows: rows.filter("is_new").select(*queues.JOB_KEY), run_id
        )

    @_job
    def label(
        self,
        model: labeling.ChatModel,
        run_id: int,
        as_of: str,
        jobs: int = fixed.DEFAULT_LABELING_JOBS,
        in_flight: int = fixed.HOSTED_IN_FLIGHT,
        parallelism: int | None = None,
    ) -> dict[str, int | float]:
        """Drain up to ``jobs`` jobs: each is asked, its answer stored, then dequeued.

        The raw replies are written before anything is parsed, so no step calls
        the model a second time.
        """
        started = time.perf_counter()
        popped = self._stored(queues.pop_jobs(self.table("labeling_queue", run_id), jobs), "jobs", run_id)
        enriched = labeling.enrich_jobs(
            popped, self.table("questions", run_id), self.table("metadata", run_id)
        )
        replies = self._stored(
            labeling.classify_jobs(enriched, model, in_flight=in_flight, parallelism=parallelism),
            "replies", run_id,
        )
        judged = labeling.judge_replies(replies)
        changes = keyed.changed_labels(
            self.table("metadata_labels", run_id), labeling.positive_labels(judged), _time(as_of)
        )
        self.log("metadata_labels").append(changes, run_id)
        self.log("labeling_queue").remove(popped, run_id)
        counts = _counts(labeling.labeling_statistics(judged))
        return {**counts, "elapsed_seconds": round(time.perf_counter() - started, 3)}

    # ---- downloads ------------------------------------------------------

    @_job
    def prepare_downloads(self, label_id: int, run_id: int, as_of: str) -> dict[str, int]:
        attempts = queues.enqueue_downloads(
            self.table("metadata_labels", run_id), self.table("metadata", run_id),
            self.table("download_queue", run_id), label_id,
        )
        return self._enqueue(
            "download_queue", attempts, lambda rows: queues.new_downloads(rows, _time(as_of)), run_id
        )

    @_job
    def resolve_downloads(
        self, available: DataFrame, run_id: int, as_of: str, limit: int = fixed.DEFAULT_DOWNLOADS
    ) -> dict[str, int]:
        """Settle the oldest pending downloads against the artifacts on offer."""
        queue = self.table("download_queue", run_id)
        pending = catalog.pending_downloads(queue, limit)
        return self._settle(queue, pending, available, None, run_id, as_of, limit)

    def _settle(
        self, queue: DataFrame, ids: DataFrame, available: DataFrame, refused: DataFrame | None,
        run_id: int, as_of: str, requested: int,
    ) -> dict[str, int]:
        resolved = self._stored(artifacts.resolve_downloads(ids, available, refused), "resolved", run_id)
        settled = resolved.select("arxiv_id", "download_status")
        changed = queue.drop("download_status", "updated_at").join(settled, "arxiv_id").withColumn(
            "updated_at", _time(as_of)
        )
        self.log("download_queue").append(changed, run_id)
        self.log("choices").append(resolved, run_id)
        return _counts(artifacts.download_statistics(resolved, requested))

    def resolved(self, run_id: int) -> DataFrame:
        """What a download run chose: (arxiv_id, download_status, rank, artifact_id, kind)."""
        return self.spark.read.parquet(f"{self.root}/_runs/{run_id}/resolved")

    @_job
    def unpack(self, archives_path: str, run_id: int) -> int:
        """Store the main TeX file of every archive in a folder; returns their number.

        The archives that cannot be used are recorded: no later choice takes them.
        """
        members = self._stored(
            archives.read_members(files.read_archives(self.spark, archives_path)), "members", run_id
        )
        rejects = self._stored(artifacts.rejected_archives(members), "rejects", run_id)
        self.log("rejects").append(rejects, run_id)
        return self._stored(artifacts.main_tex(members), "tex", run_id).count()

    def rejects(self, run_id: int) -> DataFrame:
        """(id, reason) of the archives that an unpack run could not use."""
        return self.spark.read.parquet(f"{self.root}/_runs/{run_id}/rejects")

    @_job
    def resolve_rejected(self, available: DataFrame, unpack_run: int, run_id: int, as_of: str) -> dict[str, int]:
        """Settle again the downloads whose chosen archive was rejected by unpack runs up to ``unpack_run``.

        The record of choices leads from a rejected archive back to the papers
        that took it, also as their previous version. All rejected sources count
        as not on offer, so each id falls through to its PDF, then to the
        previous version, and fails if there is neither. Repeat it after the
        next unpack run, until nothing is attempted any more.
        """
        if run_id <= unpack_run:
            raise ValueError(f"run {run_id} cannot follow the unpack run {unpack_run}")
        rejects = self.table("rejects", unpack_run + 1)
        queue = self.table("download_queue", run_id)
        lost = self._stored(artifacts.rejected_choices(self.table("choices", run_id), rejects), "again", run_id)
        again = only_for(queue, lost, ["arxiv_id"])
        return self._settle(queue, again, available, artifacts.refused_sources(rejects), run_id, as_of, lost.count())

    def unpacked(self, run_id: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/_runs/{run_id}/tex")

    # ---- conversion -----------------------------------------------------

    @_job
    def convert(
        self,
        tex: DataFrame,
        pdf_pages: DataFrame,
        model: labeling.ChatModel,
        run_id: int,
        converter: Callable[[str], str] | None = None,
        max_chars: int = fixed.HOSTED_CHUNK_CHARS,
        in_flight: int = fixed.HOSTED_IN_FLIGHT,
        parallelism: int | None = None,
    ) -> dict[str, int]:
        """Markdown of every TeX text, else of the PDF pages, that has none yet.

        ``tex``: (id, text); ``pdf_pages``: (id, page_no, text). A TeX text goes
        through ``converter``; what that refuses goes to the model in chunks.
        """
        path = f"{self.root}/markdown"
        self.spark.createDataFrame([], "id string, md string, source string").write.mode(
            "overwrite"
        ).parquet(f"{path}/run=-1")
        done = self._markdown().filter(F.col("run") < run_id).select("id").distinct()

        open_tex = tex.join(done, "id", "left_anti")
        converted, refused = None, open_tex
        if converter is not None:
            tried = self._stored(
                labeling.ask_model(
                    open_tex.select("id", "text"), "text",
                    lambda chat: converter(chat[-1]["content"]), in_flight=1,
                ),
                "converter", run_id,
            )
            converted = tried.filter("error IS NULL").select("id", F.col("reply").alias("md"))
            refused = only_for(open_tex, tried.filter("error IS NOT NULL"), ["id"])
        replies = self._stored(
            conversion.generate_chunks(
                conversion.chunk_texts(refused, max_chars), model,
                in_flight=in_flight, parallelism=parallelism,
            ),
            "chunks", run_id,
        )
        failed = conversion.failed_documents(replies)
        by_model = conversion.reassemble(replies).join(failed, "id", "left_anti")
        from_tex = by_model if converted is None else converted.unionByName(by_model)
        from_pdf = (
            conversion.join_pages(pdf_pages.join(done, "id", "left_anti"))
            .join(from_tex.select("id"), "id", "left_anti")
        )
        markdown = from_tex.withColumn("source", F.lit("tex")).unionByName(
            from_pdf.withColumn("source", F.lit("pdf"))
        )
        files.write_markdown(markdown, path, run_id)

        def sources(ids: DataFrame, kind: str, ok: Column) -> DataFrame:
            return ids.select("id", F.lit(kind).alias("kind"), ok.alias("ok"))

        tex_ok = tex.select("id").join(failed.withColumn("_failed", F.lit(True)), "id", "left")
        plan = conversion.conversion_plan(
            sources(tex_ok, "tex", F.col("_failed").isNull())
            .unionByName(sources(pdf_pages.select("id").distinct(), "pdf", F.lit(True)))
            .unionByName(sources(done, "md", F.lit(True)))
        )
        return _counts(conversion.conversion_statistics(plan))

    def convert_files(
        self,
        model: labeling.ChatModel,
        run_id: int,
        tex_files: str | None = None,
        unpack_run: int | None = None,
        pages: DataFrame | None = None,
        **options: object,
    ) -> dict[str, int]:
        """Markdown from a folder of ``*.tex`` files, from what an unpack run found, or both.

        Files that earlier runs saw are not read again: their texts are kept, and
        those that have their Markdown are left out before any text is looked at.
        An unpacked text goes before a file of the same id, the file that came
        last before others. ``options`` as for :meth:`convert`.
        """
        check_run(run_id)
        spark, none = self.spark, self.spark.createDataFrame([], "id string, text string")
        tex = none if unpack_run is None else self.unpacked(unpack_run).select("id", "text")
        if tex_files is not None:
            table = f"{self.root}/_texts/tex"
            files.collect_texts(spark, tex_files, "*.tex", table, f"{self.root}/_texts/tex-seen")
            collected = files.read_collected(spark, table)
            chosen = conversion.newest_files(collected, tex.select("id"))
            tex = tex.unionByName(collected.join(chosen, ["id", "batch", "path"], "left_semi").select("id", "text"))
        if pages is None:
            pages = spark.createDataFrame([], "id string, page_no int, text string")
        return self.convert(tex, pages, model, run_id, **options)

    def artifacts(self, path: str, pattern: str) -> DataFrame:
        """(id, path, size) of the files in a folder; their content is not read."""
        return files.list_artifacts(self.spark, path, pattern)

    def _markdown(self) -> DataFrame:
        """Markdown of the runs that have ended."""
        return files.read_markdown(self.spark, f"{self.root}/markdown").filter(F.col("run").isin(*self.finished_runs()))

    def markdown(self) -> DataFrame:
        return self._markdown().select("id", "md", "source")

    # ---- reports --------------------------------------------------------

    def table_counts(self) -> DataFrame:
        return catalog.table_counts({name: self.table(name) for name in TABLES})

    def metadata_statistics(self) -> DataFrame:
        return catalog.metadata_statistics(self.table("metadata"))

    def list_labels(self) -> DataFrame:
        return catalog.list_labels(self.table("labels"))

    def list_questions(self) -> DataFrame:
        return catalog.list_questions(self.table("questions"), self.table("labels"))

    def download_summary(self) -> tuple[DataFrame, DataFrame]:
        """Counts per status, and the failed ids from the oldest on."""
        queue = self.table("download_queue")
        return catalog.queue_summary(queue), catalog.failed_downloads(queue)

    def integrity_report(self) -> DataFrame:
        return integrity.integrity_report({name: self.table(name) for name in TABLES})

    def _enqueue(
        self, name: str, attempts: DataFrame, rows: Callable[[DataFrame], DataFrame], run_id: int
    ) -> dict[str, int]:
        stored = self._stored(attempts, "attempts", run_id)
        self.log(name).append(rows(stored), run_id)
        counts = stored.agg(F.count(F.lit(1)).alias("attempted"), F.count_if("is_new").alias("inserted"))
        return _counts(counts)


def _time(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _counts(one_row: DataFrame) -> dict[str, int]:
    return one_row.first().asDict()
