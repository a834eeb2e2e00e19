"""The plans are the intended ones: no Python, no cross joins, pushed filters, split skew."""

from __future__ import annotations

import re

import pytest

from conftest import SF_DIR
from paperloom.plans.queries import QUERIES

WITH_PYTHON = {
    "labeling_stats", "chunk_reassemble", "tex_fallback", "label_jobs", "labeling_flagship",
}


def plan(spark, name):
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"label_stream"}))
def test_operators_used(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert bool(re.search(r"MapInArrow|PythonUDF|ArrowEvalPython", text)) == (name in WITH_PYTHON)


def test_projection_reaches_the_scan(spark):
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plan(spark, "list_labels") or (
        "ReadSchema: struct<source:string>" in plan(spark, "list_labels")
    )
    assert "text" not in re.search(r"ReadSchema: (\S+)", plan(spark, "metadata_exists"))[1]


def test_limits_are_top_k(spark):
    for name in ("pending_downloads", "jobs_pop", "top_categories", "record_cap", "search_papers"):
        assert "TakeOrderedAndProject" in plan(spark, name)


def test_first_per_key_prunes_before_the_shuffle(spark):
    for name in ("metadata_append", "paper_insert"):
        text = plan(spark, name)
        assert "WindowGroupLimit" in text and "Partial" in text


def test_lines_are_parsed_once(spark):
    """The strict parse sits below one Generate and nowhere else."""
    text = plan(spark, "metadata_project")
    boxed = [line for line in text.splitlines() if "concat([[" in line]
    assert len(boxed) == 1 and "Generate explode" in boxed[0]


def test_labeling_shuffles_the_papers_at_most_once(spark):
    """Also when nothing is small enough to broadcast."""
    from paperloom.operators.labeling import enrich_jobs
    from paperloom.plans.views import view

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frames = [view(spark, SF_DIR, name) for name in ("labeling_queue", "questions", "metadata")]
        text = enrich_jobs(*frames)._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"ReadSchema: struct<doc_id:bigint,text:string>", text)) == 1
        assert len(re.findall(r"Exchange hashpartitioning", text)) == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_taxonomy_reads_what_it_wrote(spark):
    assert len(re.findall(r"Exchange hashpartitioning", plan(spark, "taxonomy_seed"))) <= 12


def test_stream_keeps_seen_jobs_in_state(spark, tmp_path):
    """No batch reads the reply log."""
    from paperloom.plans.queries import rule_model
    from paperloom.streaming.labeling import start_labeling

    jobs = spark.createDataFrame([("a", 1), ("a", 1), (None, 1)], "metadata_id string, question_id int")
    jobs.write.parquet(str(tmp_path / "queue"))
    stream = start_labeling(
        spark.readStream.schema(jobs.schema).parquet(str(tmp_path / "queue")),
        spark.createDataFrame([(1, "Q?", 5)], "id int, prompt string, label_id int"),
        spark.createDataFrame([("a", "t", "x")], "id string, title string, abstract string"),
        rule_model(), str(tmp_path / "log"), str(tmp_path / "checkpoint"),
    )
    stream.awaitTermination()
    state = stream.recentProgress[0]["stateOperators"]
    assert [s["operatorName"] for s in state] == ["dedupe"] and state[0]["numRowsTotal"] == 2
    assert any("rocksdb" in name for name in state[0]["customMetrics"])
    assert [s["description"].count("log") for s in stream.recentProgress[0]["sources"]] == [0]


def test_a_text_meets_all_its_quotes_at_once(spark):
    """The distinct quotes of a document are one row before its text is joined; records never meet texts."""
    text = plan(spark, "quote_check_many")
    assert text.count("abstract") == 0 or len(re.findall(r"contains\(_text", text)) == 1
    assert "collect_list(direct_citaat" in text and len(re.findall(r"text#\d+ AS _text", text)) == 1


def test_prefixes_are_as_many_as_id_lengths(spark):
    text = plan(spark, "already_downloaded")
    assert "collect_set(char_length" in text and "sequence(1" not in text


def test_integrity_reads_each_table_once(spark):
    """Seven views over five base tables: one scan per view's use of a base table, and one shuffle."""
    text = plan(spark, "integrity_report")
    assert len(re.findall(r"Exchange hashpartitioning\(domain", text)) == 1
    assert not re.search(r"Join", text)
    assert text.count("Generate inline") == 8


def test_stream_state_ends(spark, tmp_path):
    """Keys are forgotten some time after they were seen: the state does not grow with the batches."""
    from paperloom.plans.queries import rule_model
    from paperloom.streaming.labeling import reply_log, start_labeling

    source = str(tmp_path / "queue")
    jobs = spark.range(120).selectExpr("concat('p', id % 100) AS metadata_id", "1 AS question_id", "id")
    jobs.repartitionByRange(12, "id").drop("id").write.parquet(source)
    stream = start_labeling(
        spark.readStream.schema("metadata_id string, question_id int").option("maxFilesPerTrigger", 1).parquet(source),
        spark.createDataFrame([(1, "Q?", 5)], "id int, prompt string, label_id int"),
        spark.range(100).selectExpr("concat('p', id) AS id", "'t' AS title", "'x' AS abstract"),
        rule_model(), str(tmp_path / "log"), str(tmp_path / "checkpoint"), remember="1 second",
    )
    stream.awaitTermination()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in stream.recentProgress if p["stateOperators"]]
    assert len(state) >= 12 and max(state) < 100 and state[-1] < 60
    replies = reply_log(spark, str(tmp_path / "log"))
    assert {r[0] for r in replies.select("metadata_id").distinct().collect()} == {f"p{i}" for i in range(100)}
    assert 100 <= replies.count() <= 120
    assert not [f for f in (tmp_path / "log-jobs").iterdir() if not f.name.startswith(".")]


def test_a_batch_reads_the_papers_of_its_jobs(spark, tmp_path):
    from paperloom.streaming import labeling as stream

    papers = spark.range(40_000).selectExpr("lpad(id, 6, '0') AS id", "'t' AS title", "repeat(md5(cast(id as string)), 20) AS abstract")
    folder = str(tmp_path / "papers")
    papers.repartitionByRange(8, "id").sortWithinPartitions("id").write.parquet(folder)
    jobs = spark.createDataFrame([(f"{i:06}", 1) for i in range(9000, 9030)] + [(None, 1)], "metadata_id string, question_id int")
    read = stream.papers_of(jobs, spark.read.parquet(folder))
    assert read.count() == 30
    physical = read._jdf.queryExecution().executedPlan()
    assert "PushedFilters: [In(id" in physical.toString()
    many = jobs.unionByName(spark.range(2000).selectExpr("cast(id as string) AS metadata_id", "1 AS question_id"))
    assert stream.papers_of(many, spark.read.parquet(folder)).count() == 40_000
