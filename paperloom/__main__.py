"""Run one job: ``python -m paperloom --root FOLDER --run-id N JOB ...``."""

from __future__ import annotations

import argparse
import importlib
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame

from . import fixed_values as fixed
from .plans.corpus import Corpus
from .session import build_session


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="paperloom")
    main.add_argument("--root", required=True, help="folder of the corpus")
    main.add_argument("--run-id", type=int, default=0, help="number of a job that writes, grows from job to job")
    main.add_argument("--as-of", default=f"{datetime.now(timezone.utc):%Y-%m-%d %H:%M:%S}")
    main.add_argument("--output", help="folder for the rows of a report, else they are printed")
    jobs = main.add_subparsers(dest="job", required=True)

    def job(name: str, *arguments: tuple[str, dict]) -> None:
        sub = jobs.add_parser(name)
        for flag, options in arguments:
            sub.add_argument(flag, **options)

    model = ("--model", {"required": True, "help": "module:function that makes the model"})
    in_parallel = ("--parallelism", {"type": int})
    job("create")
    job("clean", ("before", {"type": int, "help": "runs below this number give up what is no longer needed"}))
    job("compact", ("table", {"help": "name of the table"}))
    job("import-metadata", ("path", {}), ("--max-records", {"type": int}), ("--failfast", {"action": "store_true"}), ("--strict", {"action": "store_true", "help": "all or nothing: refuse ids that are stored or repeated"}))
    job("import-labels", ("path", {}))
    job("prepare-papers", ("--limit", {"type": int}))
    job("prepare-labeling", ("question_id", {"type": int}), ("--date-after", {"default": fixed.DEFAULT_DATE_AFTER}))
    job("label", model, ("--jobs", {"type": int, "default": fixed.DEFAULT_LABELING_JOBS}), in_parallel)
    job("prepare-download", ("label_id", {"type": int}))
    job("run-download", ("available", {"help": "Parquet folder of (artifact_id, kind)"}), ("--limit", {"type": int, "default": fixed.DEFAULT_DOWNLOADS}))
    job("unpack", ("archives", {}))
    job("resolve-rejected", ("available", {"help": "Parquet folder of (artifact_id, kind)"}), ("unpack_run", {"type": int, "help": "newest unpack run that counts"}))
    job("delete-metadata", ("ids", {"help": "Parquet folder of (id)"}))
    job("delete-labels", ("ids", {"type": int, "nargs": "+"}))
    job(
        "convert-md", model, ("--tex-files", {"help": "folder of *.tex files; only new ones are read"}),
        ("--unpack-run", {"type": int, "help": "take the texts that this run unpacked"}),
        ("--pages", {"help": "Parquet folder of (id, page_no, text)"}), in_parallel,
    )
    job("list-artifacts", ("folder", {}), ("--pattern", {"default": "*"}))
    for report in ("stats", "metadata-stats", "list-labels", "list-questions", "download-queue", "integrity"):
        job(report)
    return main


def load(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)()


def run(args: argparse.Namespace, corpus: Corpus) -> object:
    read = corpus.spark.read.parquet
    numbered, at = args.run_id, args.as_of
    actions = {
        "create": lambda: corpus.create(),
        "clean": lambda: corpus.clean(args.before),
        "compact": lambda: corpus.compact(args.table, numbered),
        "import-metadata": lambda: import_metadata(args, corpus),
        "import-labels": lambda: corpus.import_taxonomy(args.path, numbered, at),
        "prepare-papers": lambda: corpus.prepare_papers(numbered, at, args.limit),
        "prepare-labeling": lambda: corpus.prepare_labeling(args.question_id, numbered, args.date_after),
        "label": lambda: corpus.label(
            load(args.model), numbered, at, args.jobs, parallelism=args.parallelism
        ),
        "prepare-download": lambda: corpus.prepare_downloads(args.label_id, numbered, at),
        "run-download": lambda: corpus.resolve_downloads(read(args.available), numbered, at, args.limit),
        "unpack": lambda: corpus.unpack(args.archives, numbered),
        "resolve-rejected": lambda: corpus.resolve_rejected(read(args.available), args.unpack_run, numbered, at),
        "delete-metadata": lambda: corpus.delete_metadata(read(args.ids), numbered),
        "delete-labels": lambda: corpus.delete_labels(
            corpus.spark.createDataFrame([(i,) for i in args.ids], "id int"), numbered
        ),
        "convert-md": lambda: corpus.convert_files(
            load(args.model), numbered, args.tex_files, args.unpack_run,
            read(args.pages) if args.pages else None, parallelism=args.parallelism,
        ),
        "list-artifacts": lambda: corpus.artifacts(args.folder, args.pattern),
        "stats": corpus.table_counts,
        "metadata-stats": corpus.metadata_statistics,
        "list-labels": corpus.list_labels,
        "list-questions": corpus.list_questions,
        "download-queue": lambda: corpus.download_summary(),
        "integrity": corpus.integrity_report,
    }
    return actions[args.job]()


def import_metadata(args: argparse.Namespace, corpus: Corpus) -> dict[str, int]:
    mode = "failfast" if args.failfast else "quarantine"
    if not args.strict:
        return corpus.import_metadata(args.path, args.run_id, args.as_of, args.max_records, mode)
    if args.max_records is not None:
        raise SystemExit("--strict loads the whole dump: leave out --max-records")
    return corpus.insert_strict(args.path, args.run_id, args.as_of, mode)


def report(rows: DataFrame, output: str | None) -> None:
    """All rows: as JSON lines in a folder, or one after the other on the console."""
    if output:
        rows.write.mode("append").json(output)
        return
    for row in rows.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    outcome = run(args, Corpus(build_session(), args.root))
    for part in outcome if isinstance(outcome, tuple) else (outcome,):
        if isinstance(part, DataFrame):
            report(part, args.output)
        elif part is not None:
            print(json.dumps(part))


if __name__ == "__main__":
    main()
