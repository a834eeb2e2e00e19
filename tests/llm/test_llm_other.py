"""Operators on pages, vectors and conversations, and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from conftest import SF_DIR
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.llm import chat, html_crf, topk
from paperloom.llm.html_blocks import leaf_blocks


def rows_of(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


# --- pages -----------------------------------------------------------------


def test_formulas_drawings_and_fallbacks_stay_text():
    texts = lambda page: [b.text for b in leaf_blocks(page)]
    formula = "<p>So <math><mi>x</mi><mo>=</mo><mspace/><mn>1</mn></math> holds.</p><p>b</p>"
    assert texts(formula) == ["So x=1 holds.", "b"]
    assert {b.parent for b in leaf_blocks(formula)} == {"p"}
    assert texts("<p>a <svg><path d='M0'/><text>one</text><text>two</text></svg> c</p>") == ["a one two c"]
    assert texts("<p>a<object data=x><param name=y>other</object>b</p>") == ["a other b"]
    assert texts("<p>a<object data=x><p>other</p></object>b</p>") == ["a", "other", "b"]
    assert texts("<noscript><article><p>a</p><p>b</p></article></noscript><iframe>c</iframe>") == ["a", "b", "c"]
    assert texts("<svg><foreignObject><div>a</div></foreignObject><text>b</text></svg>") == ["a", "b"]
    assert texts("<svg><style>x</style><script>y</script></svg>a<template><p>x<template>y</template></p></template>b") == ["ab"]
    for tag in ("svg", "math", "object", "noscript", "iframe", "template"):  # no end tag
        blocks = leaf_blocks(f"<p>a<{tag}><p>b</p><div>c</div><p>d</p>")
        assert [b.text for b in blocks] == ["a", "b", "c", "d"]


def test_texts_in_formulas_and_fallbacks_are_extracted():
    body = "".join(f"<p>This is sentence {i} of an article about many things.</p>" for i in range(4))
    more = "<p>The formula <math><mi>y</mi><mo>=</mo><mn>2</mn></math> is the main result of it.</p>"
    page = f"<html><body><article><h1>A title</h1>{body}{more}<object><p>A long fallback text stands here.</p></object></article></body></html>"
    text = html_crf.main_text(html_crf.trained_field(), page)
    assert "The formula y=2 is the main result of it." in text and "A long fallback text stands here." in text
    hidden = f"<html><body><noscript><article><h1>A title</h1>{body}</article></noscript></body></html>"
    assert html_crf.main_text(html_crf.trained_field(), hidden).count("sentence") == 4


def test_leaf_blocks_of_broken_markup():
    page = (
        "<title>t</title><p>a <b>b<br>c&amp;amp &lt<p>d&#233;<ul><li>e<li>f</ul>1 < 2"
        "<script>x<p></script><!-- <p>g --><a href='>'>h</a> i<td>j</p></div>k<p cla"
    )
    assert [b.text for b in leaf_blocks(page)] == ["t", "a b c&amp <", "dé", "e", "f", "1 < 2h i", "j", "k"]
    assert leaf_blocks(None) == leaf_blocks("") == leaf_blocks("<p> \n </p>") == []
    assert len(leaf_blocks("<div>" * 20_000 + "x" + "<p>y" * 20_000)) == 20_001


def test_viterbi_is_the_best_labelling():
    field = html_crf.trained_field()
    for page, _ in html_crf.training_pages(30, seed=5):
        blocks = leaf_blocks(page)[:9]
        scores = field.scores(blocks)
        best = max(
            range(2 ** len(blocks)),
            key=lambda m: sum(s for i, s in enumerate(scores) if m >> i & 1)
            + sum(field.pairs[m >> i & 1, m >> (i + 1) & 1] for i in range(len(blocks) - 1)),
        )
        assert field.viterbi(blocks) == [best >> i & 1 for i in range(len(blocks))]


@pytest.mark.parametrize("varied, least", [((0, 0, 0), 0.985), (html_crf.VARIED, 0.975)])
def test_held_out_pages_are_labelled_well(monkeypatch, varied, least):
    field = html_crf.trained_field()
    monkeypatch.setattr(html_crf, "VARIED", varied)
    right = wrong = 0
    for blocks, labels in html_crf.labelled(html_crf.training_pages(200, seed=404)):
        for a, b in zip(field.viterbi(blocks), labels, strict=True):
            right, wrong = right + (a == b), wrong + (a != b)
    assert right >= least * (right + wrong)


def test_main_text_leaves_out_the_rest():
    page = """<html><head><title>News</title></head><body><div class="cookie-banner">We use cookies.</div>
    <header><h1>Site</h1></header><div class="post-body"><h1>A title</h1><p>First   paragraph
    of the text.</p><div class="ad-slot">Buy now!</div><p>Second one &amp; last.</p></div>
    <section id="comments"><h3>Comments</h3><div class="comment"><p>I do not agree with this text at all.</p></div></section>
    <footer>&copy; Site</footer></body></html>"""
    assert html_crf.main_text(html_crf.trained_field(), page) == "A title\nFirst paragraph of the text.\nSecond one & last."


def test_extract_odd_pages(spark):
    rows = [
        (1, "u", None),
        (2, None, ""),
        (None, "u", "plain words only"),
        (3, "u", "<article><p>x</p><p>" + "long text " * 50_000 + "</p></article>"),
        (3, "u", "<nav><ul><li><a href='/'>menu</a></li></ul></nav>"),
        (3, "u", "<nav><ul><li><a href='/'>menu</a></li></ul></nav>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {(r.page_id, r.url): r for r in html_crf.extract(pages).collect()}
    assert html_crf.extract(pages).count() == 6
    assert got[(1, "u")].text == "" and got[(2, None)].n_chars == 0
    assert got[(None, "u")].text == "plain words only"
    long = [r for r in html_crf.extract(pages).collect() if r.n_chars > 100]
    assert long[0].text == "x\n" + ("long text " * 50_000).strip()
    assert html_crf.extract(pages.limit(0)).count() == 0


def test_given_pages_give_their_articles(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    for row in html_crf.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", row.html, re.DOTALL)[1]
        parts = re.split(r"<[^>]*>", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
        assert row.text == "\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)


# --- vectors ---------------------------------------------------------------


def naive_top_k(rows, k):
    usable = {}
    for vec_id, v in rows:
        if vec_id is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable[(vec_id, tuple(math.floor(1024 * float(np.float32(x))) for x in v))] = None
    result = []
    for query, q in usable:
        if query % 100 == 0:
            scored = sorted(
                (-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in usable if i != query and len(v) == len(q)
            )
            result += [(query, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(result)


def test_large_components_slow_no_other_pair(monkeypatch):
    rng = np.random.default_rng(4)
    queries, rows = rng.integers(-2000, 2000, (30, 32)), rng.integers(-2000, 2000, (4000, 32))
    rows[7, 3], rows[8, 5], queries[2, 1] = 2**50, -(2**51), 2**45
    large = []
    scored = topk._large_scores
    monkeypatch.setattr(topk, "_large_scores", lambda *a: large.append(len(a[2])) or scored(*a))
    ids = np.arange(4000)
    of, found, scores = topk.block_top_k(-1 - np.arange(30), queries, ids, rows, 10)
    exact = queries.astype(object) @ rows.astype(object).T
    want = [(i, -s, j) for i in range(30) for s, j in sorted((-exact[i, j], j) for j in range(4000))[:10]]
    assert list(zip(of.tolist(), scores.tolist(), found.tolist(), strict=True)) == want
    assert sum(large) < 4000 + 2 * 30 + 1


def test_repeated_query_ids_ask_once(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 3.0]), (0, [1.0, 0.0])]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        table = spark.createDataFrame(order, schema).repartition(3)
        got = topk.top_k(table, F.col("vec_id") % 100 == 0).orderBy("rank").collect()
        assert [(r.vec_id, r.score) for r in got] == [(2, 3 * 1024 * 1024), (1, 0)]


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + rng.normal(size=16) * 0.1).tolist()) for i in range(900)]
    rows += [(i, rows[7][1]) for i in range(1000, 1100)]  # many ties
    rows += [(2000, None), (2100, [None] * 16), (2101, [float("nan")] * 16), (2102, [float("inf")] + [0.0] * 15)]
    rows += [(None, rows[0][1]), (0, rows[0][1]), (3000, [1.0, 2.0]), (3001, [0.5, -1.0]), (3100, []), (3002, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    is_query = F.col("vec_id") % 100 == 0
    want = naive_top_k(rows, 10)
    columns = ("query_id", "rank", "vec_id", "score")
    assert sorted(rows_of(topk.top_k(vectors, is_query), *columns)) == want
    cut = topk.top_k(vectors, is_query, block_rows=100, block_queries=3)
    assert sorted(rows_of(cut, *columns)) == want
    assert topk.top_k(vectors.limit(0), is_query).count() == 0


def test_bounds_never_hide_a_row():
    rng = np.random.default_rng(3)
    rows = (rng.normal(size=(5000, 64)) * 50).astype(np.int64) + (np.arange(5000) % 7)[:, None] * 20
    queries, ids = rows[:40], np.arange(5000)
    q, found, scores = topk.block_top_k(ids[:40], queries, ids, rows, 10)
    exact = queries @ rows.T
    exact[np.arange(40), np.arange(40)] = -(2**62)
    order = np.lexsort((np.broadcast_to(ids, exact.shape), -exact), axis=1)[:, :10]
    assert (found.reshape(40, 10) == order).all() and (scores.reshape(40, 10) == np.take_along_axis(exact, order, 1)).all()


# --- conversations ---------------------------------------------------------

_PIECES = st.sampled_from(["</turn>", "### User: ", "### Assistant: ", "### @x: ", "\\", "\n", " ", "a", "###", "é🎉", "\n</turn>\n"])
_TEXT = st.lists(_PIECES, max_size=12).map("".join)
_ROLE = st.one_of(st.sampled_from(["user", "assistant", "system", "", "tool :x\n", "Assistant"]), _TEXT)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(_ROLE, _TEXT), max_size=5))
def test_formatting_round_trip(turns):
    formatted, spans = chat.format_conversation(turns)
    assert [(r, t) for r, t, _, _ in chat.parse(formatted)] == turns
    masked = [chat.unescape(formatted[b:e]) for b, e in spans]
    assert masked == [t for r, t in turns if r == "assistant"]


def test_plain_texts_are_not_touched_and_long_runs_are_linear():
    assert chat.format_conversation([("user", "hi\nthere")])[0] == "### User: hi\nthere\n</turn>\n"
    with pytest.raises(ValueError):
        chat.parse("### User: open")
    text = "\\" * 500_000 + "</turn>"
    assert chat.parse(chat.format_turn("user", text)[0])[0][1] == text


def test_digests_of_odd_conversations(spark):
    rows = [
        (1, 1, "assistant", r"\### Assistant: </turn> ok"),
        (1, 0, "user", None),
        (1, 1, "assistant", "b"),  # a tie of turns
        (2, None, None, "x" * 200_000),
        (2, None, None, "x" * 200_000),
        (None, 0, "assistant", "nobody's"),
    ] + [(3, i, "assistant", f"turn {i}") for i in range(3000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit(1))
    got = {r.conv_id: r for r in chat.format_digests(table.repartition(4)).collect()}
    low = lambda v: (v is not None, v)
    for conv in (1, 2, 3, None):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: [low(v) for v in r[1:]])
        text = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in mine)
        loss = "".join(t for _, _, r, t in mine if r == "assistant")
        row = got[conv]
        assert row.n_turns == len(mine) and row.loss_chars == len(loss)
        assert row.turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert row.formatted_chars == len(chat.format_conversation([(r, t) for _, _, r, t in mine])[0])
    assert chat.format_digests(table.limit(0)).count() == 0
    parts = chat.formatted_turns(table).where("conv_id = 1").orderBy("position").collect()
    whole = "".join(p.formatted for p in parts)
    assert [whole[p.loss_start : p.loss_end] for p in parts if p.loss_start is not None][1] == "b"


# --- pipeline --------------------------------------------------------------


def test_pipeline_stages_on_odd_documents(spark):
    import corpus_pipeline
    from test_llm_documents import SCHEMA, naive_components, odd_rows

    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(corpus_pipeline.stored(stage(spark, frames[-1], ""), name))
    assert all(f.columns == docs.columns for f in frames[:-1])
    after_language, after_exact, after_near, after_mix, pieces = frames[1:]
    lettered = [r for r in odd_rows() if r[1] and any(map(str.isalpha, r[1]))]
    assert rows_of(after_language, "doc_id", "text") == sorted(((r[0], r[1]) for r in lettered), key=repr)
    first = {}
    for row in sorted(lettered, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(" ".join(row[1].split(" ")).replace("\n", " "), row)
    assert after_exact.count() == len(first)
    components = naive_components([tuple(r) for r in after_exact.collect()], 5, 80)
    assert sorted(r.doc_id for r in after_near.collect()) == sorted(i for i, _, c in components if c == i)
    ids = {r.doc_id for r in after_mix.collect()}
    assert ids <= {r.doc_id for r in after_near.collect()} and {r.doc_id for r in pieces.select("doc_id").collect()} == ids


def test_pipeline_of_an_empty_table(spark):
    import corpus_pipeline
    from test_llm_documents import SCHEMA

    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, ""), name)
    assert docs.count() == 0


def test_pipeline_keeps_documents_without_labels(spark, tmp_path):
    import zlib

    import corpus_pipeline
    from test_llm_documents import SCHEMA, odd_rows

    def labelled(lang):
        return [(i, text, lang(i), *rest) for i, text, _, *rest in odd_rows()]

    want = sorted(((r[0], r[1]) for r in odd_rows() if r[1] and any(map(str.isalpha, r[1]))), key=repr)
    held_out = lambda i: "en" if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else None
    for lang in (lambda i: None, held_out):
        docs = spark.createDataFrame(labelled(lang), SCHEMA)
        assert rows_of(corpus_pipeline.language(spark, docs, ""), "doc_id", "text") == want
    # with labels, what has none gets the verdict and what has one keeps it
    given = [(i, ("ab " if i % 2 else "cd ") * 30, ("x", "y")[i % 2] if i < 40 else None, "a", 9) for i in range(50)]
    given.append((60, "ab ab ab ab", "z", "a", 9))
    named = corpus_pipeline.language(spark, spark.createDataFrame(given, SCHEMA), "")
    assert named.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert {(r.doc_id, r.lang) for r in named.collect()} == {(i, ("x", "y")[i % 2]) for i in range(50)} | {(60, "z")}
    rows = [(i, f"a plain text number {i} of a table without labels", None, "a", 9) for i in range(3)] + [(3, "123 --", None, "a", 9)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    packed = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert packed and packed <= {0, 1, 2}


def test_language_verdicts_do_not_depend_on_order():
    rng = random.Random(1)
    from paperloom.llm.langid import LanguageModel

    model = LanguageModel({"a": ["ab " * 300], "b": ["cd " * 300]})
    texts = [rng.choice(("ab ", "cd ")) * rng.randint(1, 3000) for _ in range(50)]
    whole = model.predict(texts)
    assert whole == tuple([x for part in (model.predict([t]) for t in texts) for x in part[i]] for i in range(2))
