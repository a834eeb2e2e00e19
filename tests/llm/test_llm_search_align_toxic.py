"""Lexical search, token alignment and toxicity against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from paperloom.llm import lexical_scan, token_alignment, toxicity
from paperloom.llm.registry import QUERIES, both_tokenizers

TEXT = "doc_id long, text string"


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


# --- lexical search ----------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked_by_hand(docs, items, k):
    texts = [(i, Counter(terms(t))) for i, t in docs]
    texts = [(i, c) for i, c in texts if c]
    total, length = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    wanted = defaultdict(Counter)
    for item, text in items:
        if item is not None:
            wanted[item].update(terms(text))
    result = []
    for item, asked in wanted.items():
        scores = []
        for doc, c in texts:
            m = 25 + 75 * sum(c.values()) * total // length
            score = sum(
                n * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t, n in asked.items()
            )
            if score > 0 and doc is not None:
                scores.append((-score, doc))
        result += [(item, r, doc, -s) for r, (s, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(result, key=repr)


def search_tables(rng):
    words = ["the", "The", "a", "art", "cart", "x1", "é", "日本", "naïve", "ÀB", "\x85", "\xa0", " ", "art-cart", "_z_"]
    blanks = [" ", "\n", "\t", ", ", "...", "\x00", "'"]
    text = lambda n: "".join(rng.choice(words) + rng.choice(blanks) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 40))) for i in range(60)]
    docs += [(61, docs[3][1]), (61, docs[3][1]), (62, None), (63, ""), (64, "-- \n"), (65, "art"), (None, "art cart"), (66, text(3000))]
    items = [(i, text(rng.randrange(1, 9))) for i in range(12)]
    return docs, items + [(2, "art the"), (20, None), (21, ""), (None, "art"), (22, "unheard of"), (23, "art art art")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_search_equals_scores_by_hand(spark, block_bytes):
    docs, items = search_tables(random.Random(7))
    frame = spark.createDataFrame(docs, TEXT).withColumn("terms", F.lit("x")).withColumn("score", F.lit(1)).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0))
    found = lexical_scan.rank_documents(frame, asked, k=4, block_bytes=block_bytes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(found) == ranked_by_hand(docs, items, 4)


def test_search_in_small_tables_of_cells(spark, monkeypatch):
    docs, items = search_tables(random.Random(8))
    monkeypatch.setattr(lexical_scan, "CELLS", 30)  # few documents are summed at once
    found = lexical_scan.rank_documents(spark.createDataFrame(docs, TEXT), spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(found) == ranked_by_hand(docs, items, 10)


def test_search_without_documents_or_items(spark):
    nothing, no_items = spark.createDataFrame([], TEXT), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], TEXT)
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for docs, items in ((nothing, asked), (one, no_items), (spark.createDataFrame([(1, None)], TEXT), asked)):
        assert rows_of(lexical_scan.rank_documents(docs, items)) == []


# --- token alignment ---------------------------------------------------------


def aligned_by_hand(known, docs):
    """Whole texts, with the byte positions of decoded tokens alone."""
    shapes, per_doc = [], []
    for doc, text in docs:
        whole = (" " + (text or "")).encode()
        a = known.a.encode(" " + (text or ""), add_special_tokens=False).ids
        b = known.b.encode(text or "")
        sides = [(a, known.a_bytes), (b, known.b_bytes)]
        if not text or any(b"".join(d[t] for t in ids) != whole for ids, d in sides):
            shapes.append((doc, 0, 0, 0, 0, ""))
            per_doc.append(Counter())
            continue
        spans = []
        for ids, decoded in sides:
            at, own = 0, []
            for t in ids:
                own.append((at, at + len(decoded[t]), t))
                at += len(decoded[t])
            spans.append(own)
        links = Counter()
        for begin, end, t in spans[0]:
            for other, stop, u in spans[1]:
                if begin < stop and other < end:
                    links[t, u] += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(t) for s, e, t in own if low <= s and e <= cut) for own in spans))
            low = cut
        shapes.append((doc, len(a), len(b), len(groups), sum(links.values()), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        per_doc.append(links)
    counts = Counter(pair for links in per_doc for pair in links)
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return sorted(
        (
            (doc, n_a, n_b, n_groups, n_links, sum(n for p, n in links.items() if counts[p] == most[p[0]]),
             sum(n * counts[p] for p, n in links.items()), digest)
            for (doc, n_a, n_b, n_groups, n_links, digest), links in zip(shapes, per_doc, strict=True)
        ),
        key=repr,
    )


@pytest.fixture(scope="module")
def known():
    return token_alignment.Tokenizers(*both_tokenizers())


def alignment_texts(rng):
    alphabet = [
        "a", "b", "th", "ing", "tion", "1", "23", " ", " ", " ", " ", "  ", "\n", "\t", "\r\n", "é", "ß", "日", "本語", "\U0001f600",
        "ﾊﾟ", "é", "́", "​", "\xa0", "　", "\x00", "\x1c", "\x7f", "\x85", ".", ",", "'s", "<s>", "<0x41>",
        "<|endoftext|>", "ﬁ", "﻿", " ", "-", "กำ", " ", "᠎",
    ]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    return [*texts, "a ▁b", "a▁b c", "▁", None, "", " ", "  ", "x", " x", "x ", "the the the the", "the the the the"]


def test_alignment_equals_whole_texts_by_hand(spark, known):
    docs = list(enumerate(alignment_texts(random.Random(3)))) + [(5, "repeated id"), (None, "no id"), (900, "long word " * 3000)]
    frame = spark.createDataFrame(docs, TEXT).withColumn("chunk", F.lit(0)).withColumn("n_a", F.lit("x")).repartition(3)
    whole = aligned_by_hand(known, docs[:-1] + [(900, "long word " * 200)])
    mine = token_alignment.align_documents(frame.where("doc_id IS NULL OR doc_id < 900"), both_tokenizers)
    assert mine.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    short = spark.createDataFrame([(900, "long word " * 200)], TEXT)
    again = token_alignment.align_documents(frame.where("doc_id < 900 OR doc_id IS NULL").select("doc_id", "text").union(short), both_tokenizers, chunk_links=50)
    assert rows_of(again) == whole
    assert rows_of(mine) == aligned_by_hand(known, docs[:-1])


def test_segments_are_tokenised_as_in_the_whole(known):
    rng = random.Random(11)
    for text in alignment_texts(rng):
        if not text:
            continue
        parts = token_alignment.segments(text)
        assert " " + text == "".join(" " + p for p in parts)
        whole = known.a.encode(" " + text, add_special_tokens=False).ids
        assert known.encode_a(parts).ids.tolist() == whole
        assert known.encode_b(parts).ids.tolist() == known.b.encode(text)


def test_coarse_cuts_are_refined_to_the_decoded_bytes(known):
    rng = random.Random(12)
    for text in alignment_texts(rng):
        for part in token_alignment.segments(text or "x"):
            for encode, decoded in ((known.encode_a, known.a_bytes), (known.encode_b, known.b_bytes)):
                tokens = encode([part])
                ids = tokens.ids.tolist()
                if b"".join(decoded[t] for t in ids) == b" " + part.encode():
                    assert tokens.ends.tolist() == np.cumsum([len(decoded[t]) for t in ids]).tolist(), (part, ids)


def test_no_piece_goes_on_behind_a_blank(known):
    # what lets texts be cut at single blanks
    pieces = [known.b.id_to_piece(i) for i in range(known.b.get_piece_size())]
    assert not [p for p in pieces if re.search("[^▁]▁", p)]


def test_alignment_forgets_segments_and_takes_empty_tables(spark, known, monkeypatch):
    assert rows_of(token_alignment.align_documents(spark.createDataFrame([], TEXT), both_tokenizers)) == []
    monkeypatch.setattr(token_alignment, "MEMORY", 1)
    nothing = spark.createDataFrame([(1, None), (2, "")], TEXT)
    assert rows_of(token_alignment.align_documents(nothing, both_tokenizers)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    table = token_alignment.SegmentTable(known)
    first = list(token_alignment.aligned_texts(table, ["a b a", None]))
    for keep in (2, 1, 0):
        table.forget(keep)
        assert len(table.number) == len(table.groups) == keep
        assert [x[:2] for x in token_alignment.aligned_texts(table, ["a b a", None])] == [x[:2] for x in first]


def test_forgetting_between_texts_changes_nothing(spark, known, monkeypatch):
    docs = list(enumerate(alignment_texts(random.Random(4))))
    monkeypatch.setattr(token_alignment, "MEMORY", 100)
    monkeypatch.setattr(token_alignment, "_LEARN", 7)
    table = token_alignment.SegmentTable(known)
    wanted = {d: (sizes, digest) for d, *sizes, _, _, digest in aligned_by_hand(known, docs)}
    for doc, text in docs:
        for sizes, digest, numbers, times in token_alignment.aligned_texts(table, [text]):
            assert (sizes, digest) == wanted[doc] and int(times.sum()) == sizes[3] and len(numbers) == len(set(numbers.tolist()))
        if len(table.number) > 100:
            table.forget(30)


def test_given_documents_are_aligned(spark, known):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").limit(40)
    kept = [tuple(r) for r in docs.collect()]
    mine = token_alignment.align_documents(spark.createDataFrame(kept, TEXT), both_tokenizers)
    assert rows_of(mine) == aligned_by_hand(known, kept)


# --- toxicity ----------------------------------------------------------------


def random_vectors(rng, n, n_terms, most):
    sizes = rng.integers(0, most, n)
    sizes[: n // 3] = 1
    found = [np.sort(rng.choice(n_terms, s, replace=False)) for s in sizes]
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64)
    return toxicity.weighted(at, flat, rng.integers(1, 5, len(flat)), np.linspace(1, 4, n_terms))


def dense(vectors, n_terms):
    table = np.zeros((len(vectors), n_terms))
    table[np.repeat(np.arange(len(vectors)), np.diff(vectors.at)), vectors.terms] = vectors.weights
    return table


@pytest.mark.parametrize("seed", range(6))
def test_neighbours_are_exact(seed):
    rng = np.random.default_rng(seed)
    examples, queries = random_vectors(rng, 150, 30, 9), random_vectors(rng, 80, 30, 12)
    index = toxicity.BlockMaxIndex(examples, 30, block=8)
    left = rng.integers(0, 150, 80)
    for leave in (None, left):
        cosines, numbers = index.nearest(queries, 7, leave)
        full = np.round(dense(queries, 30) @ dense(examples, 30).T, 12)
        if leave is not None:
            full[np.arange(80), leave] = 0
        for i in range(80):
            order = [j for j in np.lexsort((np.arange(150), -full[i])) if full[i, j] > 0][:7]
            assert np.allclose(cosines[i][: len(order)], full[i][order])
            assert (cosines[i][len(order) :] == 0).all() and (numbers[i][len(order) :] == 150).all()
            # equal but for rounding: any order of the sums is right
            assert np.allclose(full[i][numbers[i][: len(order)]], full[i][order])


def test_blocks_out_of_reach_stay_closed(monkeypatch):
    rng = np.random.default_rng(1)
    at = np.arange(0, 2 * 640 + 1, 2)
    flat = np.sort(np.stack([np.repeat(np.arange(10), 64), rng.integers(10, 40, 640)], 1), axis=1).ravel()
    examples = toxicity.weighted(at, flat, np.ones(1280, int), np.ones(40))
    index = toxicity.BlockMaxIndex(examples, 40, block=64)
    opened = []
    given = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda *a, **k: opened.append(1) or given(*a, **k))
    index.nearest(examples.rows(0, 1), 1)
    assert len(opened) == 1 < index.blocks


def test_calibration_is_monotone_and_between_0_and_1():
    rng = np.random.default_rng(2)
    x = rng.random(500).round(2)
    left, value = toxicity.monotone(x, (rng.random(500) < x).astype(float), np.ones(500))
    assert (np.diff(left) > 0).all() and (np.diff(value) >= 0).all() and 0 <= value[0] < 0.3 and 0.7 < value[-1] <= 1


def toxic_tables(n=600, seed=5):
    rng = random.Random(seed)
    syllables = ["ba", "ke", "lo", "mi", "nu", "pra", "sto", "tri", "ven", "zul"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(8, 60))]
        bad = i % 8 == 0
        for _ in range(3 if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["grobian", "fiesling", "schurke"]) + rng.choice(["", *syllables])
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_toxic_texts_are_found_and_clean_ones_left_alone(spark):
    docs, labels = toxic_tables()
    more = [(1001, None), (1002, ""), (1003, "?! ."), (None, "grobian schurke fiesling"), (1004, docs[0][1]), (1004, docs[1][1]), (1005, "x " * 50_000 + "grobian schurkelo fiesling ")]
    frame = spark.createDataFrame(docs + more, TEXT).withColumn("toxic", F.lit(9)).withColumn("terms", F.lit("")).repartition(3)
    marked = spark.createDataFrame(labels + [(None, 1), (3, None), (2000, 1)], "doc_id long, toxic int").withColumn("text", F.lit("z"))
    scored = toxicity.score_toxicity(frame, marked)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted", "evidence"]
    rows = scored.collect()
    assert len(rows) == len(docs) + len(more)
    truth, by_text = dict(labels), dict(docs + more)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    hits = [r.predicted == truth[r.doc_id] for r in held]
    assert len(held) > 150 and sum(hits) >= 0.97 * len(hits)
    least = {r.doc_id: r for r in rows}
    assert least[1001].score == least[1002].score == least[1003].score < 0.2 and least[1002].evidence == []
    assert least[None].predicted == 1 and not least[None].held_out and least[1005].predicted == 1
    assert {r.score for r in rows if r.doc_id == 1004} == {least[0].score, least[1].score}
    near = [e for r in rows if r.predicted for e in r.evidence]
    assert near and all(e.doc_id in by_text and 0 < e.cosine <= 1 + 1e-9 for e in near)
    again = toxicity.score_toxicity(frame.repartition(1), marked)
    assert rows_of(again.select("doc_id", "score")) == rows_of(scored.select("doc_id", "score"))


def test_a_score_depends_on_the_text_alone(spark):
    docs, labels = toxic_tables(400, seed=6)
    marked = spark.createDataFrame(labels, "doc_id long, toxic int")
    moved = docs + [(i + 5000, t) for i, t in docs]
    scored = toxicity.score_toxicity(spark.createDataFrame(moved, TEXT), marked)
    score = {r.doc_id: r.score for r in scored.collect()}
    assert all(score[i] == score[i + 5000] for i, _ in docs)


def test_toxicity_without_labels_or_documents(spark):
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], TEXT)
    assert rows_of(toxicity.score_toxicity(docs, no_labels).select("doc_id", "score", "predicted")) == [(1, 0.0, 0), (2, 0.0, 0)]
    clean = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score_toxicity(docs, clean).collect()} == {0}
    assert toxicity.score_toxicity(spark.createDataFrame([], TEXT), clean).collect() == []


def test_near_copies_are_one_example(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(i, text if i < 30 else f"{text} {i}", 1, 1.0) for i in range(40)] + [(50, "other words", 0, 0.5), (51, "", 0, 1.0)]
    kept = toxicity.one_per_copy(spark.createDataFrame(rows, "doc_id long, text string, toxic int, drawn double"))
    found = sorted((r.doc_id, r.toxic, r.stands_for) for r in kept.collect())
    assert found[0][0] == 0 and len(found) <= 6 and sum(r[2] for r in found) == 43.0 and (50, 0.0, 2.0) in found


def test_examples_are_bounded(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)], TEXT)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    drawn = toxicity.draw_examples(docs, labels, max_examples=20).collect()
    assert Counter(r.toxic for r in drawn) == {0: 20, 1: 20}
    assert {(r.toxic, round(r.drawn, 6)) for r in drawn} == {(1, 0.4), (0, round(20 / 150, 6))}


def test_registered_queries(spark):
    for name in ("op12_token_alignment", "op13_toxicity"):
        assert QUERIES[name](spark, SF_DIR).count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
