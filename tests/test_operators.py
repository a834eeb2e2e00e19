"""Operators on small fixtures: golden cases, idempotence, large limits, hot keys."""

from __future__ import annotations

import io
import json
import tarfile
from decimal import Decimal

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from paperloom.sources import files
from paperloom.sources.archives import read_members
from paperloom.operators import (
    artifacts, catalog, conversion, ingest, integrity, keyed, labeling, messages, queues, search, shared,
)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


def as_of(text="2025-10-15 12:00:00"):
    return F.lit(text).cast("timestamp_ntz")


# ---- shared -------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 7, 999, 1000, 5000])
def test_first_n_keeps_the_order(spark, n):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v"))
    assert [r["k"] for r in shared.first_n(df, ["k"], n).collect()] == list(range(min(n, 1000)))
    top = [r["k"] for r in shared.first_n(df, ["-k"], n).collect()]
    assert top == list(range(999, 999 - min(n, 1000), -1))


@pytest.mark.parametrize("n", [99_999, 100_001, 1_000_000])
def test_first_n_of_many_rows(spark, n):
    """No step brings the keys or the rows to one task, and none joins them back."""
    total = n + 20_000
    df = spark.range(total).select(((F.col("id") * 7919) % total).alias("k"), F.md5(F.col("id").cast("string")).alias("v"))
    first = shared.first_n(df, ["k"], n)
    assert [r["k"] for r in first.select("k").toLocalIterator()] == list(range(n))
    text = first._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in text and "Window" not in text and "Join" not in text and text.count("Range (") == 1
    last = shared.first_n(df, ["-k"], n)
    assert last.agg(F.min("k"), F.count("k"), F.count_distinct("v")).first()[:] == (total - n, n, n)


def test_first_n_leaves_no_folder(spark, tmp_path, monkeypatch):
    used = []
    monkeypatch.setattr(shared, "shared_folder", lambda spark, name: used.append(str(tmp_path / name)) or used[-1])
    assert shared.first_n(spark.range(3000), ["id"], 2000).count() == 2000
    assert len(used) == 1 and not list(tmp_path.iterdir())


@pytest.mark.parametrize("n", [1, 4, 7, 13])
def test_first_n_by_several_columns_with_ties(spark, n, monkeypatch):
    monkeypatch.setattr(shared, "SMALL", 0)
    stamp = "2025-10-15 12:00:0{}.000001"
    given = [
        (a, b, c) for a, b, c in (
            (None, 1.5, "x"), (None, float("nan"), "y"), (None, None, "z"), (1, 1.5, "a"), (1, 1.5, "b"), (1, 1.5, "b"),
            (1, 2.5, "c"), (1, 2.5, "c"), (2, None, "d"), (2, -1.0, None), (2, -1.0, None), (3, 0.0, "f"),
        )
    ]
    df = spark.createDataFrame(given, "a int, b double, c string").repartition(3)
    df = df.withColumn("t", F.when(F.col("a") < 9, F.lit(stamp.format(1))).cast("timestamp_ntz"))
    for order in (["a", "b"], ["a", "-b"], ["-a", "b"], ["t", "-c"], ["t", "a", "b", "c"], ["-t", "-a"]):
        keys = [F.desc(o[1:]) if o.startswith("-") else F.asc(o) for o in order]
        names = [o.removeprefix("-") for o in order]
        whole = [tuple(map(str, r)) for r in df.orderBy(*keys).select(*names).collect()]
        mine = shared.first_n(df, order, n)
        assert [tuple(map(str, r)) for r in mine.select(*names).collect()] == whole[:n]
        left = [tuple(map(str, r)) for r in df.collect()]
        for row in mine.collect():  # rows of the table, none more often than there
            left.remove(tuple(map(str, row)))
        assert mine.count() == min(n, 12)
    keys_only = df.select("a")
    assert [r["a"] for r in shared.first_n(keys_only, ["a"], n).collect()] == ([None] * 3 + [1] * 5 + [2] * 3 + [3])[:n]


def test_first_n_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c"), (1, "d"), (1, "d"), (2, "e")], "k int, v string")
    for n, keys in ((1, [None]), (3, [None, None, 1]), (5, [None, None, 1, 1, 1])):
        assert [r["k"] for r in shared.first_n(df, ["k"], n).collect()] == keys


def test_first_n_without_limit(spark):
    assert shared.first_n(spark.range(5), ["id"], None).count() == 5
    assert shared.first_n(spark.range(5), ["id"], 0).count() == 5
    assert shared.first_n(spark.range(5), ["id"], 0, unlimited=False).count() == 0


def test_dense_ids_are_gapless_and_repeatable(spark):
    df = spark.range(3000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    numbered = shared.dense_ids(df, "name", F.lit(10))
    got = rows(numbered, "id", "name")
    assert sorted(i for i, _ in got) == list(range(11, 3011))
    again = shared.dense_ids(df.repartition(5), "name", F.lit(10))
    assert rows(again, "id", "name") == got


def test_ordered_concat_of_a_long_group(spark):
    df = spark.range(5000).select(
        (F.col("id") % 3).cast("int").alias("g"),
        F.col("id").alias("pos"),
        F.when(F.col("id") % 4 > 0, F.col("id").cast("string")).alias("t"),
    )
    got = dict(rows(shared.ordered_concat(df.repartition(7), ["g"], "pos", F.col("t"), "-", "all"), "g", "all"))
    for g in range(3):
        assert got[g] == "-".join(str(i) for i in range(5000) if i % 3 == g and i % 4 > 0)


# ---- ingest -------------------------------------------------------------

GOOD = (
    '{"id":"%s","authors":"A","title":"%s","categories":"cs.AI","abstract":"x","versions":[{"version":"v1"}],'
    '"update_date":"2025-09-10","authors_parsed":[],"other":1}'
)


def lines(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row long, value string")


def test_validation_rules(spark):
    bad_type = GOOD.replace('"title":"%s"', '"title":5,"doi":[]') % "b"
    missing = GOOD.replace('"abstract":"x",', "") % ("c", "t")
    df = lines(spark, GOOD % ("a", "t"), bad_type, missing, GOOD % ("", "t"), "[1]", "  ", GOOD % ("d", "t") + " }", " ")
    checked = ingest.validate(ingest.json_lines(df, ["row"]))
    assert rows(checked, "row", "violations") == [
        (0, []), (1, ["doi:type", "title:type"]), (2, ["abstract:required"]), (3, ["id:empty"]),
        (4, ["record:object"]), (6, ["record:object"]),
    ]
    assert ingest.accept(checked).count() == 1
    assert ingest.quarantined(checked).count() == 5
    with pytest.raises(PySparkException, match="doi:type; title:type|invalid record"):
        ingest.accept(checked, "failfast").collect()
    with pytest.raises(ValueError):
        ingest.accept(checked, "other")


def test_append_is_idempotent_and_first_line_wins(spark):
    df = lines(spark, GOOD % ("a", "first"), GOOD % ("b", "t"), GOOD % ("a", "second"))
    checked = ingest.validate(ingest.json_lines(df, ["row"]))
    new = ingest.metadata_rows(ingest.accept(checked), as_of(), keep=("row",))
    empty = spark.createDataFrame([], "id string")
    stored = ingest.absent_metadata(empty, new, ["row"])
    assert rows(stored, "id", "title") == [("a", "first"), ("b", "t")]
    assert rows(stored.filter("id = 'a'"), "versions", "authors_parsed") == [('[{"version":"v1"}]', "[]")]
    assert ingest.absent_metadata(stored, new, ["row"]).count() == 0
    for current in (empty, stored, stored.filter("id = 'a'")):
        conflicts = ingest.conflicting_ids(current, new, ["row"])
        narrow = ingest.without_conflicts(new, conflicts, ["row"])
        assert rows(narrow) == rows(ingest.absent_metadata(current, new, ["row"]))
    assert rows(ingest.metadata_conflicts(stored.filter("id='b'"), new)) == [
        ("a", 2, "repeated"), ("b", 1, "stored"),
    ]
    assert ingest.insert_strict(empty, stored).count() == 2
    for current in (empty, stored):
        with pytest.raises(PySparkException, match="duplicate id"):
            ingest.insert_strict(current, new).collect()


def test_taxonomy_seed(spark):
    seed = (
        '[{"name":"money","questions":[{"name":"q1","prompt":"p1"},{"name":"q2","prompt":"p2"}]},'
        '{"name":"","questions":[{"name":"x","prompt":"y"}]},{"name":"bare"},'
        '{"name":"money","questions":[{"name":"q1","prompt":"other"}]}]'
    )
    items = ingest.taxonomy_items(spark.createDataFrame([(0, seed)], "seq int, value string"), "seq")
    labels = spark.createDataFrame([(4, "bare")], "id int, name string")
    new = ingest.seed_labels(labels, items)
    assert rows(new) == [(5, "money")]
    questions = spark.createDataFrame([], "id int, name string, prompt string, label_id int")
    asked = ingest.seed_questions(questions, labels.unionByName(new), items, "seq", as_of())
    assert sorted(r[1:] for r in rows(asked, "id", "name", "prompt", "label_id")) == [
        ("q1", "p1", 5), ("q2", "p2", 5),
    ]
    stored = asked.select("id", "name", "prompt", "label_id")
    again = ingest.seed_questions(stored, labels.unionByName(new), items, "seq", as_of())
    assert again.count() == 0
    broken = spark.createDataFrame([(0, '[{"name":"a","questions":[{"name":"q"}]}]')], "seq int, value string")
    with pytest.raises(PySparkException, match="both name and prompt"):
        ingest.taxonomy_items(broken, "seq").collect()


# ---- keyed writes -------------------------------------------------------


def labels_table(spark, *data):
    df = spark.createDataFrame(
        [(m, l, None if s is None else Decimal(s)) for m, l, s in data],
        "metadata_id string, label_id int, confidence_score decimal(3,2)",
    )
    return df.withColumn("created_at", as_of("2025-01-01 00:00:00")).withColumn("updated_at", F.col("created_at"))


def label_change(spark, *data):
    return spark.createDataFrame(
        [(m, l, q, None if s is None else Decimal(s)) for m, l, q, s in data],
        "metadata_id string, label_id int, question_id int, confidence_score decimal(3,2)",
    )


def test_upsert_labels(spark):
    current = labels_table(spark, ("A", 3, "0.50"), ("B", 3, "0.60"))
    changes = label_change(spark, ("B", 3, 7, None), ("C", 3, 7, "0.10"), ("C", 3, 9, "0.20"))
    state = keyed.upsert_labels(current, changes, as_of())
    text = state.select("metadata_id", F.col("confidence_score").cast("string"), F.year("created_at"), F.month("created_at"), F.month("updated_at"))
    assert rows(text) == [("A", "0.50", 2025, 1, 1), ("B", None, 2025, 1, 10), ("C", "0.20", 2025, 10, 10)]
    assert rows(keyed.upsert_labels(state, changes, as_of())) == rows(state)
    delta = keyed.changed_labels(current, changes, as_of())
    assert rows(delta) == rows(state.filter("metadata_id <> 'A'"))


def test_updates_apply_in_order(spark):
    current = spark.createDataFrame([("a", "P", "x", None), ("b", "P", "y", None)], "k string, s string, t string, updated_at timestamp_ntz")
    changes = spark.createDataFrame(
        [("a", 1, ["s"], "Q", None), ("a", 2, ["t"], None, None), ("a", 3, ["s"], "R", "z"), ("zz", 1, ["s"], "Q", None)],
        "k string, seq int, set_fields array<string>, s string, t string",
    )
    got = keyed.apply_updates(current, changes, "k", ["s", "t"], as_of())
    assert rows(got, "k", "s", "t") == [("a", "R", None), ("b", "P", "y")]
    assert got.filter("updated_at IS NOT NULL").count() == 1


def test_status_domain_is_checked(spark):
    queue = spark.createDataFrame([("a", "PENDING")], "arxiv_id string, download_status string")
    bad = spark.createDataFrame([("a", 1, "DONE")], "arxiv_id string, seq int, download_status string")
    with pytest.raises(PySparkException, match="invalid download_status: DONE"):
        keyed.set_queue_status(queue, bad, as_of()).collect()


def test_get_or_create(spark):
    labels = spark.createDataFrame([(1, "a")], "id int, name string")
    got = keyed.get_or_create_labels(labels, spark.createDataFrame([("a",), ("b",), ("b",)], "name string"))
    assert rows(got) == [(1, "a", False), (2, "b", True)]
    # two stages meet the error; which exception wins is open
    with pytest.raises((PySparkException, Py4JJavaError), match="name must not be empty"):
        keyed.get_or_create_labels(labels, spark.createDataFrame([("",)], "name string")).collect()


def test_new_papers(spark):
    metadata = spark.createDataFrame([("m1",), ("p2",)], "id string")
    papers = spark.createDataFrame([("p1",)], "arxiv_id string")
    incoming = spark.createDataFrame(
        [("p1", "m1", None), ("p2", None, "SRC"), ("p3", "m1", None), ("p4", None, None)],
        "arxiv_id string, metadata_id string, download_type string",
    )
    got = keyed.new_papers(papers, incoming, metadata, as_of())
    assert rows(got, "arxiv_id", "download_type", "llm_check_status", "metadata_id") == [
        ("p2", "SRC", "PENDING", "p2"), ("p3", "PENDING", "PENDING", "m1"), ("p4", "PENDING", "PENDING", None),
    ]


def test_cascade(spark):
    tables = {
        "metadata": spark.createDataFrame([("m1",), ("m2",)], "id string"),
        "papers": spark.createDataFrame([("p1", "m1"), ("p2", "m2"), ("p3", None)], "arxiv_id string, metadata_id string"),
        "labels": spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string"),
        "questions": spark.createDataFrame([(1, 1), (2, 2)], "id int, label_id int"),
        "metadata_labels": spark.createDataFrame([("m1", 1), ("m2", 1), ("m2", 2)], "metadata_id string, label_id int"),
        "labeling_queue": spark.createDataFrame([("m1", 1), ("m2", 1), ("m2", 2)], "metadata_id string, question_id int"),
    }
    gone = integrity.delete_metadata(tables, spark.createDataFrame([("m1",)], "id string"))
    assert rows(gone["papers"]) == [("p1", None), ("p2", "m2"), ("p3", None)]
    assert rows(gone["metadata_labels"]) == [("m2", 1), ("m2", 2)]
    gone = integrity.delete_labels(gone, spark.createDataFrame([(1,)], "id int"))
    assert rows(gone["labeling_queue"], "metadata_id", "question_id") == [("m2", 2)]
    assert rows(gone["metadata_labels"], "metadata_id", "label_id") == [("m2", 2)]


# ---- catalog ------------------------------------------------------------


def test_argument_checks(spark):
    df = spark.createDataFrame([(1, "p", 1)], "id int, prompt string, label_id int")
    for bad in (0, -1, True, "1"):
        with pytest.raises(ValueError):
            catalog.question_by_id(df, bad)
        with pytest.raises(ValueError):
            catalog.metadata_ids_by_label(df, bad)
    assert rows(catalog.question_by_id(df, 1)) == [(1, "p", 1)]


def test_category_rules_differ(spark):
    df = spark.createDataFrame([("a", "cs.AIx"), ("b", "math.CO cs.AI"), ("c", "cs.SE")], "id string, categories string").withColumn(
        "update_date", F.lit("2025-09-01").cast("date")
    )
    assert rows(catalog.by_category_pattern(df, "cs.AI"), "id") == [("a",), ("b",)]
    assert rows(catalog.by_category_tokens(df, None), "id") == [("b",), ("c",)]
    assert catalog.by_category_tokens(df, "2025-09-01").count() == 0


def test_table_counts_with_missing_table(spark):
    got = catalog.table_counts({"a": spark.range(3), "b": None})
    assert rows(got) == [("a", 3), ("b", 0)]


# ---- labeling -----------------------------------------------------------


def test_labeling_golden(spark):
    jobs = spark.createDataFrame(
        [("A", 7), ("B", 7), ("C", 7), ("D", 7), ("E", 7), ("X", 7), ("A", 8), ("", 7), ("A", None)],
        "metadata_id string, question_id int",
    )
    questions = spark.createDataFrame([(7, "Is about X?", 3)], "id int, prompt string, label_id int")
    papers = spark.createDataFrame(
        [("A", "t1", "a"), ("B", "t2", "a"), ("C", "t3", "a"), ("D", "", "a"), ("E", "boom", "a")],
        "id string, title string, abstract string",
    )
    enriched = labeling.enrich_jobs(jobs, questions, papers)
    reasons = [r for (r,) in rows(enriched, "skip_reason") if r]
    assert sorted(reasons) == ["key", "key", "paper", "question"]
    assert rows(labeling.enrich_jobs(jobs.repartition(3), questions, papers)) == rows(enriched)

    def reply(chat):
        title = chat[-1]["content"].split("TITLE: ")[1].split("\n")[0]
        if title == "boom":
            raise RuntimeError("no model")
        assert chat[0]["role"] == "system" and title != ""
        return '{"answer": true, "confidence": 0.9}' if title == "t2" else '{"answer": false}'

    judged = labeling.judge_replies(labeling.classify_jobs(enriched, reply, parallelism=3))
    assert rows(labeling.positive_labels(judged)) == [("B", 3, 7, Decimal("0.90"))]
    assert rows(labeling.labeling_statistics(judged)) == [(5, 1, 4, 1)]


def test_enqueue_is_idempotent(spark):
    metadata = spark.createDataFrame([("a", "cs.AI"), ("b", "cs.SE x"), ("c", "q")], "id string, categories string").withColumn(
        "update_date", F.lit("2025-10-01").cast("date")
    )
    queue = spark.createDataFrame([("a", 1), ("a", 2)], "metadata_id string, question_id int")
    got = queues.enqueue_labeling(metadata, queue, 1)
    assert rows(got) == [("a", 1, False), ("b", 1, True)]
    full = queue.unionByName(got.filter("is_new").select("metadata_id", "question_id"))
    assert queues.enqueue_labeling(metadata, full, 1).filter("is_new").count() == 0


# ---- messages, pages, conversion ----------------------------------------


def merged(spark, *chat):
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(chat)], "conv_id int, turn int, role string, text string")
    got = messages.merge_system(df).orderBy("turn").collect()
    return [(m["role"], m["text"]) for m in got]


def test_merge_system_golden(spark):
    assert merged(spark, ("system", "S"), ("user", "U")) == [("user", "S\n\nU")]
    assert merged(spark, ("system", "S1"), ("user", "U"), ("system", "S2"), ("model", "M")) == [
        ("user", "S1\n\nS2\n\nU"), ("model", "M"),
    ]
    assert merged(spark, ("system", "S"), ("model", "M")) == [("user", "S\n\n"), ("model", "M")]
    assert merged(spark, ("model", "M"), ("system", "S")) == [("user", "S\n\n"), ("model", "M")]
    assert merged(spark, ("system", "S")) == [("user", "S\n\n")]
    assert merged(spark, ("user", "U"), ("assistant", "A")) == [("user", "U")]
    assert merged(spark, (" System", "S"), ("User", "U")) == [("user", "S\n\n"), ("User", "U")]


def test_join_pages(spark):
    df = spark.createDataFrame(
        [("a", 2, " two "), ("a", 1, "one\n"), ("a", 3, ""), ("a", 4, "  "), ("a", 5, "five"), ("b", 1, "")],
        "id string, page_no int, text string",
    )
    assert rows(conversion.join_pages(df)) == [("a", "one\n\ntwo\n\n\n\nfive"), ("b", "")]


def test_generate_and_reassemble(spark):
    docs = spark.createDataFrame([("a", "x" * 30), ("b", ""), ("c", "boom" + "y" * 30)], "id string, text string")

    def model(chat):
        text = chat[-1]["content"].removeprefix("DO\n\n")
        if "boom" in text:
            raise RuntimeError
        return f" {text.upper()} "

    replies = conversion.generate_chunks(conversion.chunk_texts(docs, 20), model, instructions="DO")
    assert rows(conversion.failed_documents(replies)) == [("c",)]
    md = dict(rows(conversion.reassemble(replies)))
    assert md["a"] == "X" * 20 + "\n\n" + "X" * 10 and md["b"] == ""


PLANS = [
    # tex, pdf, md, tex ok -> actions
    (True, False, True, True, ("skip_existing", None)),
    (True, True, True, True, ("skip_existing", "covered")),
    (True, False, False, True, ("convert", None)),
    (True, True, False, True, ("convert", "covered")),
    (True, True, False, False, ("error", "convert")),
    (False, True, True, True, (None, "skip_existing")),
    (False, True, False, True, (None, "convert")),
]


def test_conversion_plan(spark):
    data = []
    for i, (tex, pdf, md, tex_ok, _) in enumerate(PLANS):
        data += [(i, "tex", tex_ok)] * tex + [(i, "pdf", True)] * pdf + [(i, "md", True)] * md
    data.append((99, "md", True))
    plan = conversion.conversion_plan(spark.createDataFrame(data, "id int, kind string, ok boolean"))
    assert rows(plan) == [(i, *want) for i, (*_, want) in enumerate(PLANS)]
    stats = conversion.conversion_statistics(plan).first().asDict()
    assert stats == {"tex_found": 5, "pdf_found": 5, "converted_tex": 2, "converted_pdf": 2, "skipped_existing": 3, "errors": 1}


# ---- artifacts ----------------------------------------------------------

OFFERS = [
    ([("xv3", "src"), ("xv3", "pdf")], "xv3", ("COMPLETED", 1, "xv3")),
    ([("xv3", "pdf"), ("xv2", "src")], "xv3", ("COMPLETED", 2, "xv3")),
    ([("xv2", "src"), ("xv2", "pdf")], "xv3", ("COMPLETED", 3, "xv2")),
    ([("xv2", "pdf")], "xv3", ("COMPLETED", 4, "xv2")),
    ([("xv1", "src")], "xv3", ("FAILED", None, None)),
    ([("q", "src")], "xv1", ("FAILED", None, None)),
    ([("xv3", "stored"), ("xv2", "stored")], "xv3", ("COMPLETED", 0, "xv3")),
    ([("xv2", "stored")], "xv3", ("FAILED", None, None)),
]


def test_resolve_downloads(spark):
    for offers, wanted, (status, rank, filed) in OFFERS:
        available = spark.createDataFrame(offers, "artifact_id string, kind string")
        got = artifacts.resolve_downloads(spark.createDataFrame([(wanted,)], "arxiv_id string"), available)
        assert rows(got, "download_status", "rank", "artifact_id") == [(status, rank, filed)]


def test_already_downloaded_rules(spark):
    ids = spark.createDataFrame([("av1",), ("av10",), ("2510.01v2",)], "arxiv_id string")
    files = spark.createDataFrame([("x/av10.tar.gz",), ("x/2510.01v2.Some_Title.tar.gz",)], "path string")
    assert rows(artifacts.already_downloaded(ids, files)) == [("2510.01v2",), ("av10",)]
    assert rows(artifacts.already_downloaded(ids, files, literal_prefix=True)) == [("2510.01v2",), ("av1",), ("av10",)]


def make_tar(mode="w:gz", **members):
    target = io.BytesIO()
    with tarfile.open(fileobj=target, mode=mode) as tar:
        for path, data in members.items():
            entry = tarfile.TarInfo(path.replace("__", "/").replace("UP", ".."))
            entry.size = len(data)
            tar.addfile(entry, io.BytesIO(data))
    return bytearray(target.getvalue())


def test_archives(spark):
    data = [
        ("a", make_tar(**{"small.tex": b"1", "sub__big.TEX": b"22\xff", "z.bib": b"999"})),
        ("b", make_tar("w", **{"x.txt": b"1"})),
        ("c", make_tar("w:bz2", **{"UP__evil.tex": b"1", "ok.tex": b"1"})),
        ("d", bytearray(b"no archive")),
        ("e", make_tar("w:xz", **{"m.tex": b"1", "n.tex": b"2"})),
    ]
    gz = bytearray(make_tar(**{"f.tex": bytes(range(256)) * 400}))
    gz[len(gz) // 2] ^= 0xFF
    xz = bytearray(make_tar("w:xz", **{"f.tex": bytes(range(256)) * 400}))
    xz[len(xz) // 2] ^= 0xFF
    short = make_tar("w:bz2", **{"f.tex": b"y" * 5000})
    data += [("f", gz), ("g", xz), ("h", bytearray(short[: len(short) // 2])), ("i", None)]
    twice = io.BytesIO()
    with tarfile.open(fileobj=twice, mode="w") as tar:
        for text in (b"longer", b"short"):
            entry = tarfile.TarInfo("same.tex")
            entry.size = len(text)
            tar.addfile(entry, io.BytesIO(text))
    data.append(("j", bytearray(twice.getvalue())))
    members = read_members(spark.createDataFrame(data, "id string, content binary")).cache()
    rejected = {r["id"]: r["reason"] for r in artifacts.rejected_archives(members).collect()}
    assert set(rejected) == {"c", "d", "f", "g", "h", "i"} and rejected["c"] == "escaping member"
    assert rows(artifacts.archive_members(members).filter("id < 'j'").select("id", "path", "size")) == [
        ("a", "small.tex", 1), ("a", "sub/big.TEX", 3), ("a", "z.bib", 3), ("b", "x.txt", 1),
        ("e", "m.tex", 1), ("e", "n.tex", 1),
    ]
    assert rows(artifacts.main_tex(members)) == [
        ("a", "sub/big.TEX", "22"), ("e", "n.tex", "2"), ("j", "same.tex", "longer"),
    ]


def test_text_repair_keeps_genuine_marks(spark):
    data = [(bytearray("a\ufffdb".encode() + b"\xff" + b"c"),), (bytearray("\ufffd".encode()),), (bytearray(b"ok"),)]
    df = spark.createDataFrame(data, "content binary").select(files.utf8(F.col("content")).alias("text"))
    assert [r["text"] for r in df.collect()] == ["a\ufffdbc", "\ufffd", "ok"]


# ---- search -------------------------------------------------------------


def test_search_fallback_sort(spark):
    df = spark.createDataFrame(
        [("http://x/abs/1v1", " T ", "s", [("A B",)], ["cs.AI"], "2025-01-02 03:04:05", None),
         ("http://x/abs/2v1", "U", "s", [("C",)], [], "2025-02-02 00:00:00", "2025-03-01 00:00:00")],
        "entry_id string, title string, summary string, authors array<struct<name:string>>, categories array<string>, published string, updated string",
    )
    for c in ("published", "updated"):
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    for c in ("pdf_url", "doi", "journal_ref", "comment"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    df = df.withColumn("relevance", F.lit(1.0))
    got = search.search_papers(df, 1, "unknown").first()
    assert (got["arxiv_id"], got["published_date"]) == ("2v1", "2025-02-02T00:00:00+00:00")
    first = search.search_by_ids(df, spark.createDataFrame([("1v1",)], "arxiv_id string")).first()
    assert (first["title"], first["authors"], first["updated_date"]) == ("T", ["A B"], None)
    assert search.search_papers(df, 5, "relevance").count() == 2
    assert search.search_papers(df.union(df), 5, "relevance").count() == 4


def test_only_validated_evidence_counts(spark):
    from paperloom.operators import evidence

    def reply(point, **changes):
        record = {
            "datapunt_id": point, "bewijs_gevonden": True, "type_bewijs": "kwalitatief", "direct_citaat": "a quote",
            "specifieke_metrics": [{"metric_naam": "m", "waarde": "1"}, {"metric_naam": "n", "waarde": "2"}],
        }
        return json.dumps({**record, **changes})

    records = evidence.evidence_records(spark.createDataFrame(
        [("p", reply("CODE_CHURN")), ("p", reply("ONBOARDING")), ("p", reply("X", specifieke_metrics=None)),
         ("p", reply("TEST_COVERAGE", direct_citaat="made up")), ("q", reply("CODE_CHURN")), ("r", reply("CODE_CHURN"))],
        "id string, reply string",
    ))
    texts = spark.createDataFrame([(i, "with a quote inside") for i in "pqr"], "id string, text string")
    yes, no = '{"validatie_geslaagd": true, "opmerkingen": "ok"}', '{"validatie_geslaagd": false, "opmerkingen": "no"}'
    verdicts = evidence.evidence_verdicts(spark.createDataFrame(
        [("p", "CODE_CHURN", f"```json\n{yes}\n```"), ("p", "ONBOARDING", yes), ("p", "X", yes), ("p", "TEST_COVERAGE", yes),
         ("q", "CODE_CHURN", yes), ("q", "CODE_CHURN", no), ("p", "OTHER", None)],
        "id string, datapunt_id string, reply string",
    ))
    assert rows(verdicts.filter("not passed"), "id", "datapunt_id", "remarks") == [
        ("p", "OTHER", []), ("q", "CODE_CHURN", ["no", "ok"])
    ]
    counted = evidence.validated(evidence.verify_quotes(records, texts), verdicts)
    assert rows(evidence.evidence_summary(counted), "datapunt_id", "theme", "records", "metrics") == [
        ("CODE_CHURN", "productivity", 1, 2), ("ONBOARDING", "human_factor", 1, 2), ("X", None, 1, 0)
    ]
    assert rows(evidence.evidence_metrics(counted), "datapunt_id", "place", "waarde") == [
        ("CODE_CHURN", 0, "1"), ("CODE_CHURN", 1, "2"), ("ONBOARDING", 0, "1"), ("ONBOARDING", 1, "2")
    ]


def test_quotes_of_a_document_with_very_many(spark, monkeypatch):
    from paperloom.operators import evidence

    monkeypatch.setattr(evidence, "QUOTES", 10)
    text = " ".join(f"w{i}" for i in range(200))
    quotes = [("a", f"w{i} w{i + 1}") for i in range(150)] + [("a", f"x{i}") for i in range(50)] + [("a", "w1 w2")] * 3
    quotes += [("b", "only"), ("b", ""), ("b", None), ("none", "w1"), (None, "w1")]
    records = spark.createDataFrame(quotes, "id string, direct_citaat string").withColumn("n", F.lit(1))
    found = evidence.verify_quotes(records, spark.createDataFrame([("a", text), ("b", None)], "id string, text string"))
    assert found.columns == ["id", "direct_citaat", "n", "quote_found"] and found.count() == len(quotes)
    for r in found.collect():
        assert r.quote_found == (r.id == "a" and r.direct_citaat in text)


def test_prefix_rule_with_ids_of_many_lengths(spark):
    ids = spark.createDataFrame([("a",), ("ab",), ("abcdef",), ("x",), ("",)], "arxiv_id string")
    paths = spark.createDataFrame([("s/abc.tar",), ("t/",), ("x",)], "path string")
    assert rows(artifacts.already_downloaded(ids, paths, literal_prefix=True)) == [("",), ("a",), ("ab",), ("x",)]


# ---- model calls --------------------------------------------------------


def _batches(texts, size):
    import pyarrow as pa

    for begin in range(0, len(texts), size):
        part = texts[begin : begin + size]
        yield pa.RecordBatch.from_pydict({"n": list(range(begin, begin + len(part))), "ask": part})


def test_a_slow_call_holds_up_itself_only():
    import threading
    import time

    running, most, lock = 0, 0, threading.Lock()

    def call(text):
        nonlocal running, most
        with lock:
            running, most = running + 1, max(most, running + 1)
        time.sleep(0.4 if text == "slow" else 0.002)
        with lock:
            running -= 1
        return text, None

    # ten slow calls, each in another batch
    texts = ["slow" if i % 100 == 50 else "fast" for i in range(1000)]
    started = time.perf_counter()
    rows = [r for b in labeling.answered(_batches(texts, 100), "ask", call, 12) for r in b.to_pylist()]
    assert time.perf_counter() - started < 2  # one after the other they take 4 s
    assert 8 <= most <= 12
    assert sorted(r["n"] for r in rows) == list(range(1000))
    assert all(r["reply"] == texts[r["n"]] and r["error"] is None for r in rows)
    assert next(i for i, r in enumerate(rows) if r["reply"] == "slow") > 60  # answers leave as they come


def test_answers_of_no_rows_and_of_one():
    assert list(labeling.answered(iter([]), "ask", lambda t: (t, None), 3)) == []
    assert list(labeling.answered(_batches([None], 5), "ask", lambda t: (None, "e"), 1))[0].to_pylist() == [
        {"n": 0, "reply": None, "error": "e"}
    ]


def test_calls_are_spread_over_the_cores(spark):
    asked = labeling.ask_model(spark.createDataFrame([("a",)] * 40, "ask string"), "ask", lambda chat: "x")
    assert asked.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
