"""The stored corpus end to end, repeated runs, and stream against batch."""

from __future__ import annotations

import io
import json
import re
import tarfile

import pytest
from pyspark.sql import functions as F

from paperloom.operators import labeling
from paperloom.plans.corpus import Corpus
from paperloom.plans.queries import rule_model
from paperloom.sources import files
from paperloom.streaming.labeling import reply_log, start_labeling
from test_operators import rows

WHEN = "2025-10-15 12:00:00"


def record(i, **changes):
    base = {
        "id": f"25.{i:03}", "authors": "A", "title": f"title {i}", "categories": "cs.AI x" if i % 2 else "math.CO",
        "abstract": "text " * (i + 1), "versions": [{"created": "Mon", "version": f"v{1 + i % 3}"}],
        "update_date": "2025-09-10", "authors_parsed": [["Müller", "", ""]], "journal-ref": "J",
    }
    return json.dumps({**base, **changes})


@pytest.fixture
def corpus(spark, tmp_path):
    made = Corpus(spark, str(tmp_path / "corpus"))
    made.create()
    return made


def write_dump(path, lines):
    path.write_text("\n".join(lines), encoding="utf-8")
    return str(path)


def test_whole_run(spark, corpus, tmp_path):
    dump = write_dump(
        tmp_path / "dump.jsonl",
        [record(i) for i in range(20)] + ["", "nonsense", record(21, title=3), record(3, title="late"), record(22, update_date="soon")],
    )
    assert corpus.import_metadata(dump, 1, WHEN) == {"inserted": 20, "rejected": 3}
    assert corpus.import_metadata(dump, 1, WHEN) == {"inserted": 20, "rejected": 3}  # repeated run
    assert corpus.import_metadata(dump, 2, WHEN)["inserted"] == 0
    stored = corpus.table("metadata")
    assert rows(stored.filter("id = '25.003'"), "title", "journal_ref", "versions", "authors_parsed") == [
        ("title 3", "J", '[{"created":"Mon","version":"v1"}]', '[["Müller","",""]]')
    ]

    seed = tmp_path / "labels.json"
    seed.write_text(json.dumps([{"name": "money", "questions": [{"name": "q1", "prompt": "About money?"}]}]))
    assert corpus.import_taxonomy(str(seed), 3, WHEN) == {"questions": 1, "labels": 1}
    assert corpus.import_taxonomy(str(seed), 4, WHEN) == {"questions": 0, "labels": 0}
    assert rows(corpus.list_questions()) == [(1, "q1", 1, "money")]

    assert corpus.prepare_papers(5, WHEN, limit=15) == 15
    assert corpus.prepare_papers(6, WHEN) == 5
    assert "25.002v3" in [r[0] for r in rows(corpus.table("papers"), "arxiv_id")]

    assert corpus.prepare_labeling(1, 7) == {"attempted": 10, "inserted": 10}
    assert corpus.prepare_labeling(1, 8) == {"attempted": 10, "inserted": 0}
    with pytest.raises(ValueError, match="unknown question"):
        corpus.prepare_labeling(5, 9)

    def model(chat):
        return '{"answer": true, "confidence": 77}' if "title 1" in chat[-1]["content"] else "no"

    def label(*args, **options):
        stats = corpus.label(model, *args, **options)
        assert stats.pop("elapsed_seconds") > 0
        return stats

    first = label(10, WHEN, jobs=4)
    assert first == {"processed": 4, "labeled": 1, "skipped_missing": 0, "model_errors": 0}
    assert corpus.table("labeling_queue").count() == 6
    assert label(10, WHEN, jobs=4) == first  # repeated run takes the same jobs
    assert label(11, WHEN, jobs=50)["processed"] == 6
    assert corpus.table("labeling_queue").count() == 0
    labelled = [r[0] for r in rows(corpus.table("metadata_labels"), "metadata_id")]
    assert labelled == [f"25.{i:03}" for i in (1, 11, 13, 15, 17, 19)]

    assert corpus.prepare_downloads(1, 12, WHEN) == {"attempted": 6, "inserted": 6}
    offers = spark.createDataFrame([("25.001v2", "src"), ("25.011v2", "pdf")], "artifact_id string, kind string")
    settled = corpus.resolve_downloads(offers, 13, WHEN, limit=3)
    assert settled == {"requested": 3, "attempted": 3, "completed": 2, "failed": 1}
    counts, failed = corpus.download_summary()
    assert rows(counts) == [("COMPLETED", 2), ("FAILED", 1), ("PENDING", 3)]
    assert rows(failed, "arxiv_id") == [("25.013v2",)]

    changes = spark.createDataFrame(
        [("25.002v3", 1, ["download_type"], "SRC"), ("nowhere", 1, ["download_type"], "PDF")],
        "arxiv_id string, seq int, set_fields array<string>, download_type string",
    )
    assert corpus.update_papers(changes, 14, WHEN) == 1
    assert corpus.table("papers").filter("download_type = 'SRC'").count() == 1
    with pytest.raises(Exception, match="invalid download_type: TAR"):
        corpus.update_papers(changes.withColumn("download_type", F.lit("TAR")), 15, WHEN)
    more = spark.createDataFrame([("25.002v3", None), ("x", None), ("25.004", None)], "arxiv_id string, metadata_id string")
    assert corpus.insert_papers(more, 15, WHEN) == 2
    assert rows(corpus.table("papers").filter("arxiv_id = '25.004'"), "metadata_id") == [("25.004",)]

    assert dict(rows(corpus.table_counts()))["metadata"] == 20
    assert corpus.integrity_report().count() == 0
    before = {name: rows(corpus.table(name)) for name in ("download_queue", "labeling_queue", "metadata_labels", "papers")}
    for run_id, name in enumerate(before, 20):
        corpus.compact(name, run_id)
        assert rows(corpus.table(name)) == before[name]
    queue = corpus.log("download_queue")
    queue.remove(failed.select("arxiv_id"), 30)
    queue.append(offers.select(F.lit("new").alias("arxiv_id"), F.lit("FAILED").alias("download_status")).limit(1), 31)
    # runs that have not finished are not seen
    assert rows(corpus.table("download_queue")) == before["download_queue"]
    assert rows(queue.current(before=30)) == before["download_queue"]
    assert rows(queue.current().filter("download_status = 'FAILED'"), "arxiv_id") == [("new",)]
    assert queue.current().count() == 6
    read = corpus.table("papers").inputFiles()
    assert any("/_bases/" in path for path in read)


def test_runs_are_kept_in_order(corpus, tmp_path):
    def dump(name, ids):
        return write_dump(tmp_path / name, [record(i) for i in ids])

    assert corpus.import_metadata(dump("b", (2, 3)), 5, WHEN)["inserted"] == 2
    with pytest.raises(ValueError, match="older than run 5"):
        corpus.import_metadata(dump("a", (1, 2)), 3, WHEN)
    assert corpus.import_metadata(dump("b", (2, 3)), 5, WHEN)["inserted"] == 2
    assert corpus.import_metadata(dump("a", (1, 2)), 6, WHEN)["inserted"] == 1
    corpus.compact("metadata", 7)
    assert corpus.import_metadata(dump("c", (3, 4)), 8, WHEN)["inserted"] == 1
    assert [r[0] for r in rows(corpus.table("metadata"), "id")] == [f"25.{i:03}" for i in (1, 2, 3, 4)]



def test_failfast_writes_nothing(corpus, tmp_path):
    dump = write_dump(tmp_path / "d.jsonl", [record(1), record(2, title=None)])
    with pytest.raises(Exception, match="title:type"):
        corpus.import_metadata(dump, 1, WHEN, mode="failfast")
    assert corpus.table("metadata").count() == 0
    with pytest.raises(Exception, match="update_date:date"):
        corpus.import_metadata(write_dump(tmp_path / "e.jsonl", [record(1, update_date="x")]), 2, WHEN, mode="failfast")


def test_record_cap_follows_the_file(spark, corpus, tmp_path):
    dump = write_dump(tmp_path / "d.jsonl", [record(99 - i) for i in range(50)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert corpus.import_metadata(dump, 1, WHEN, max_records=7)["inserted"] == 7
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r[0] for r in rows(corpus.table("metadata"), "id")] == [f"25.{i:03}" for i in range(93, 100)]


def test_files_to_markdown(spark, corpus, tmp_path):
    archives, pdfs = tmp_path / "tarballs", tmp_path / "pdf"
    archives.mkdir(), pdfs.mkdir()
    for name, text in (("25.001v2", "\\section{One}"), ("25.002v1", "BROKEN" + "x" * 30)):
        with tarfile.open(archives / f"{name}.tar.gz", "w:gz") as tar:
            entry = tarfile.TarInfo("main.tex")
            entry.size = len(text)
            tar.addfile(entry, io.BytesIO(text.encode()))
    (pdfs / "25.003v1.pdf").write_bytes(b"%PDF")
    assert corpus.unpack(str(archives), 1) == 2
    assert rows(files.list_artifacts(spark, str(pdfs), "*.pdf"), "id", "size") == [("25.003v1", 4)]

    def converter(tex):
        if "BROKEN" in tex:
            raise ValueError("cannot read")
        return tex.replace("\\section{", "# ").replace("}", "")

    pages = spark.createDataFrame(
        [("25.003v1", 1, " one "), ("25.003v1", 2, "two"), ("25.001v2", 1, "unused")], "id string, page_no int, text string"
    )
    tex = corpus.unpacked(1).select("id", "text")
    run = dict(converter=converter, max_chars=20)
    stats = corpus.convert(tex, pages, lambda chat: chat[-1]["content"][-3:], 2, **run)
    assert stats == {
        "tex_found": 2, "pdf_found": 2, "converted_tex": 2, "converted_pdf": 1, "skipped_existing": 0, "errors": 0,
    }
    assert rows(corpus.markdown()) == [
        ("25.001v2", "# One", "tex"), ("25.002v1", "xxx\n\nxxx", "tex"), ("25.003v1", "one\n\ntwo", "pdf"),
    ]
    again = corpus.convert(tex, pages, lambda chat: "", 3, **run)
    assert again["skipped_existing"] == 3 and again["converted_tex"] == 0
    assert corpus.markdown().count() == 3


def test_conversion_from_folders(spark, corpus, tmp_path):
    archives, folder = tmp_path / "archives", tmp_path / "tex"
    archives.mkdir(), folder.mkdir()
    with tarfile.open(archives / "25.001v1.tar.gz", "w:gz") as tar:
        entry = tarfile.TarInfo("main.tex")
        entry.size = 6
        tar.addfile(entry, io.BytesIO(b"packed"))
    (folder / "25.001v1.tex").write_text("file")
    (folder / "25.002v1.tex").write_text("two")
    (folder / "notes.txt").write_text("no")
    asked = lambda chat: chat[-1]["content"][-6:].strip()
    corpus.unpack(str(archives), 1)
    stats = corpus.convert_files(asked, 2, str(folder), 1)
    assert stats["converted_tex"] == 2 and rows(corpus.markdown(), "id", "md") == [("25.001v1", "packed"), ("25.002v1", "two")]
    table = f"{corpus.root}/_texts/tex"
    seen = files.read_collected(spark, table)
    assert rows(seen, "id", "size") == [("25.001v1", 4), ("25.002v1", 3)]
    first = {r["batch"] for r in seen.collect()}
    (folder / "25.003v1.tex").write_text("three")
    (folder / "sub").mkdir()
    stats = corpus.convert_files(asked, 3, str(folder))
    assert stats == corpus.convert_files(asked, 3, str(folder))  # a repeated run
    assert stats["tex_found"] == 3 and stats["converted_tex"] == 1 and stats["skipped_existing"] == 2
    new = files.read_collected(spark, table).filter(~F.col("batch").isin(*first))
    assert rows(new, "id", "text") == [("25.003v1", "three")]  # only the new file was read
    assert rows(corpus.markdown(), "id") == [("25.001v1",), ("25.002v1",), ("25.003v1",)]
    assert rows(corpus.artifacts(str(folder), "*.tex"), "id", "size") == [("25.001v1", 4), ("25.002v1", 3), ("25.003v1", 5)]


def test_texts_drop_broken_bytes(spark, tmp_path):
    (tmp_path / "a.tex").write_bytes(b"ok \xff\xfe end")
    (tmp_path / "b.tex").write_bytes("é".encode())
    assert rows(files.read_texts(spark, str(tmp_path))) == [("a", "ok  end"), ("b", "é")]


def test_stream_equals_batch(spark, tmp_path):
    """Several files with repeated jobs, in micro-batches, across a restart."""
    questions = spark.createDataFrame([(1, "Q?", 5), (2, "R?", 5)], "id int, prompt string, label_id int")
    papers = spark.range(40).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"), F.lit("t").alias("title"),
        F.repeat(F.lit("x"), F.col("id").cast("int") + 1).alias("abstract"),
    )
    papers.write.parquet(str(tmp_path / "papers"))
    papers = spark.read.parquet(str(tmp_path / "papers"))
    jobs = papers.select(F.col("id").alias("metadata_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("question_id"))
    source, log, checkpoint = (str(tmp_path / n) for n in ("queue", "log", "checkpoint"))
    jobs.repartition(4).write.parquet(source)
    queue = spark.readStream.schema(jobs.schema).option("maxFilesPerTrigger", 2).parquet(source)

    def drain():
        start_labeling(queue, questions, papers, rule_model(), log, checkpoint).awaitTermination()

    drain()
    assert reply_log(spark, log).select("batch").distinct().count() >= 2
    jobs.limit(30).write.mode("append").parquet(source)  # copies of jobs that are done
    drain()
    replies = reply_log(spark, log)
    assert replies.count() == 120 == replies.select("metadata_id", "question_id").distinct().count()
    streamed = labeling.judge_replies(replies)
    batch = labeling.judge_replies(
        labeling.classify_jobs(labeling.enrich_jobs(jobs, questions, papers), rule_model())
    )
    assert rows(streamed) == rows(batch)


def test_jobs_from_the_shell(spark, tmp_path, capsys, monkeypatch):
    from paperloom import __main__ as shell

    monkeypatch.setattr(shell, "build_session", lambda: spark)
    dump = write_dump(tmp_path / "d.jsonl", [record(1), record(2)])
    where = ["--root", str(tmp_path / "c"), "--as-of", WHEN]
    shell.main([*where, "create"])
    shell.main([*where, "--run-id", "1", "import-metadata", dump, "--max-records", "1"])
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"inserted": 1, "rejected": 0}
    shell.main([*where, "metadata-stats"])
    assert "total_metadata" in capsys.readouterr().out
    with pytest.raises(ValueError, match="start at 1"):
        shell.main([*where, "prepare-papers"])


def test_rejected_archives_fall_through(spark, corpus, tmp_path):
    ids = ["25.001v2", "25.002v2", "25.003v2", "25.004v1"]
    queue = spark.createDataFrame([(i, "PENDING") for i in ids], "arxiv_id string, download_status string")
    corpus.log("download_queue").append(queue, 1)
    corpus._finish(1)
    offers = spark.createDataFrame(
        [(i, "src") for i in ids] + [("25.001v2", "pdf"), ("25.002v1", "src"), ("25.003v1", "pdf")],
        "artifact_id string, kind string",
    )
    assert corpus.resolve_downloads(offers, 2, WHEN)["completed"] == 4
    archives = tmp_path / "archives"
    archives.mkdir()
    for name in ids:
        (archives / f"{name}.tar.gz").write_bytes(b"no archive")
    assert corpus.unpack(str(archives), 3) == 0
    assert rows(corpus.rejects(3), "id") == [(i,) for i in ids]
    settled = corpus.resolve_rejected(offers, 3, 4, WHEN)
    assert settled == {"requested": 4, "attempted": 4, "completed": 3, "failed": 1}
    assert rows(corpus.resolved(4), "arxiv_id", "rank", "artifact_id") == [
        ("25.001v2", 2, "25.001v2"), ("25.002v2", 3, "25.002v1"), ("25.003v2", 4, "25.003v1"), ("25.004v1", None, None),
    ]
    counts = dict(rows(corpus.download_summary()[0]))
    assert counts == {"COMPLETED": 3, "FAILED": 1, "PENDING": 0}


def test_a_rejected_fallback_falls_on(spark, corpus, tmp_path):
    """The archive of a previous version is filed under another id than the paper that took it."""
    ids = ["25.001v2", "25.002v2", "25.001v1"]
    queue = spark.createDataFrame([(i, "PENDING") for i in ids], "arxiv_id string, download_status string")
    corpus.load({"download_queue": queue}, 1)
    offers = spark.createDataFrame(
        [("25.001v1", "src"), ("25.001v1", "pdf"), ("25.002v2", "stored"), ("25.002v1", "src")], "artifact_id string, kind string"
    )
    corpus.resolve_downloads(offers, 2, WHEN)
    assert rows(corpus.table("choices"), "arxiv_id", "rank", "artifact_id") == [
        ("25.001v1", 1, "25.001v1"), ("25.001v2", 3, "25.001v1"), ("25.002v2", 0, "25.002v2"),
    ]
    first, second = tmp_path / "first", tmp_path / "second"
    for folder, names in ((first, ("25.001v1", "25.002v2")), (second, ("25.002v1",))):
        folder.mkdir()
        for name in names:
            (folder / f"{name}.tar.gz").write_bytes(b"no archive")
    corpus.unpack(str(first), 3)
    with pytest.raises(ValueError, match="cannot follow"):
        corpus.resolve_rejected(offers, 4, 4, WHEN)
    for _ in range(2):  # a repeated run ends alike
        assert corpus.resolve_rejected(offers, 3, 4, WHEN) == {"requested": 3, "attempted": 3, "completed": 3, "failed": 0}
    assert rows(corpus.table("choices"), "arxiv_id", "rank", "artifact_id") == [
        ("25.001v1", 2, "25.001v1"), ("25.001v2", 4, "25.001v1"), ("25.002v2", 3, "25.002v1"),
    ]
    corpus.unpack(str(second), 5)
    assert corpus.resolve_rejected(offers, 5, 6, WHEN) == {"requested": 1, "attempted": 1, "completed": 0, "failed": 1}
    assert corpus.resolve_rejected(offers, 5, 7, WHEN)["attempted"] == 0
    assert dict(rows(corpus.download_summary()[0])) == {"COMPLETED": 2, "FAILED": 1, "PENDING": 0}


def test_strict_insert_is_all_or_nothing(spark, corpus, tmp_path):
    def dump(name, ids):
        return write_dump(tmp_path / name, [record(i) for i in ids])

    assert corpus.insert_strict(dump("a", (1, 2)), 1, WHEN) == {"inserted": 2, "rejected": 0}
    reader = corpus.table("metadata")
    for name, ids, wrong in (("b", (2, 3), [("25.002", "stored")]), ("c", (4, 5, 4), [("25.004", "repeated")])):
        with pytest.raises(ValueError, match="1 ids are stored already or occur twice"):
            corpus.insert_strict(dump(name, ids), 2, WHEN)
        assert rows(corpus.refused(2), "id", "reason") == wrong
        assert reader.count() == corpus.table("metadata").count() == 2 and 2 not in corpus.finished_runs()
    # rows that were written by a run that did not end are not seen either
    corpus.log("metadata").append(reader.withColumn("id", F.concat("id", F.lit("x"))), 3)
    assert corpus.table("metadata").count() == 2
    assert corpus.insert_strict(dump("d", (3, 4)), 4, WHEN)["inserted"] == 2
    assert corpus.insert_strict(dump("d", (3, 4)), 4, WHEN)["inserted"] == 2  # repeated run
    assert corpus.table("metadata").count() == 4


def test_deletes_are_jobs(spark, corpus, tmp_path):
    papers = spark.createDataFrame([("25.001v1", "25.001"), ("25.002v1", "25.002")], "arxiv_id string, metadata_id string")
    corpus.import_metadata(write_dump(tmp_path / "d.jsonl", [record(i) for i in (1, 2, 3)]), 1, WHEN)
    corpus.load(
        {
            "papers": papers,
            "labels": spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string"),
            "questions": spark.createDataFrame([(1, "q", "p", 1), (2, "r", "p", 2)], "id int, name string, prompt string, label_id int"),
            "metadata_labels": spark.createDataFrame([("25.001", 1), ("25.002", 1), ("25.002", 2)], "metadata_id string, label_id int"),
            "labeling_queue": spark.createDataFrame([("25.001", 1), ("25.002", 2), ("25.003", 1)], "metadata_id string, question_id int"),
        },
        2,
    )
    corpus.compact("metadata", 3)
    gone = spark.createDataFrame([("25.001",), ("25.009",), ("25.001",)], "id string")
    for _ in range(2):  # a repeated run ends alike
        assert corpus.delete_metadata(gone, 4) == {"metadata": 1, "metadata_labels": 1, "labeling_queue": 1}
    assert rows(corpus.table("metadata"), "id") == [("25.002",), ("25.003",)]
    assert rows(corpus.table("papers"), "arxiv_id", "metadata_id") == [("25.001v1", None), ("25.002v1", "25.002")]
    for _ in range(2):
        assert corpus.delete_labels(spark.createDataFrame([(1,)], "id int"), 5) == {
            "labels": 1, "questions": 1, "labeling_queue": 1, "metadata_labels": 1,
        }
    assert rows(corpus.table("questions"), "id") == rows(corpus.table("labels"), "id") == [(2,)]
    assert rows(corpus.table("metadata_labels"), "metadata_id", "label_id") == [("25.002", 2)]
    assert rows(corpus.table("labeling_queue")) == [("25.002", 2)]
    assert corpus.integrity_report().count() == 0
    # the rows themselves are neither windowed nor shuffled, only the removed keys
    text = corpus.table("metadata")._jdf.queryExecution().executedPlan().toString()
    shuffled = re.findall(r"Exchange hashpartitioning.*\n.*", text)
    assert shuffled and all("partial_max(run" in part for part in shuffled) and "BroadcastHashJoin" in text
    assert not re.search(r"- Window \[|SortMergeJoin", text)
    # a deleted id can come back, and a compaction leaves nothing of what is gone
    assert corpus.import_metadata(write_dump(tmp_path / "e.jsonl", [record(1)]), 6, WHEN)["inserted"] == 1
    corpus.delete_metadata(spark.createDataFrame([("25.003",)], "id string"), 7)
    corpus.compact("metadata", 8)
    assert rows(corpus.table("metadata"), "id") == [("25.001",), ("25.002",)]
    assert spark.read.parquet(f"{corpus.root}/metadata/_bases/8").count() == 2


def test_unfinished_conversions_are_not_seen(spark, corpus):
    tex = spark.createDataFrame([("a", "x")], "id string, text string")
    pages = spark.createDataFrame([], "id string, page_no int, text string")
    corpus.convert(tex, pages, lambda chat: "y", 3)
    with pytest.raises(ValueError, match="older than run 3"):
        corpus.convert(tex, pages, lambda chat: "y", 2)
    files.write_markdown(spark.createDataFrame([("b", "z", "tex")], "id string, md string, source string"), f"{corpus.root}/markdown", 4)
    assert rows(corpus.markdown(), "id") == [("a",)]


def test_reports_are_whole(spark, tmp_path, capsys):
    from paperloom.__main__ import report

    report(spark.range(1500).select("id"), None)
    assert len(capsys.readouterr().out.splitlines()) == 1500
    report(spark.range(1500).select("id"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1500


def test_clean_leaves_the_tables_as_they_are(spark, corpus, tmp_path):
    for run in (1, 2, 4):
        corpus.import_metadata(write_dump(tmp_path / f"{run}.jsonl", [record(run), record(run + 10)]), run, WHEN)
    before = rows(corpus.table("metadata"))
    corpus.compact("metadata", 5)
    corpus.compact("metadata", 6)
    corpus.import_metadata(write_dump(tmp_path / "7.jsonl", [record(30)]), 7, WHEN)
    after = rows(corpus.table("metadata"))
    assert len(after) == len(before) + 1
    assert corpus.clean(3) == {"runs": 2, "changes": 2}  # only the one table with a base gives up changes
    assert rows(corpus.table("metadata")) == after and corpus.quarantine(4).count() == 0
    corpus.clean(8)
    assert rows(corpus.table("metadata")) == after
    folder = tmp_path / "corpus" / "metadata"
    assert sorted(f.name for f in folder.iterdir() if f.name.startswith("run=")) == ["run=-1", "run=7"]
    assert [f.name for f in (folder / "_bases").iterdir() if f.is_dir()] == ["6"]
    assert corpus.import_metadata(write_dump(tmp_path / "8.jsonl", [record(1), record(31)]), 8, WHEN)["inserted"] == 1
