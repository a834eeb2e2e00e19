"""Operators on documents: brute-force results, and rows that are null, empty, long, tied or repeated."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import common, exact_dedup, langid, mixing, ngram_join, packing, substring, tokens
from paperloom.llm.registry import byte_bpe

public = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: columns whose names the operators use inside
CLASHING = "size n key head block prefix path digest locator keep_id target epoch draw shared batch group".split()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng: random.Random, words: int) -> str:
    return " ".join(rng.choice(("the of and to in a is that it was".split())) + rng.choice("abcdefghij") * rng.randint(0, 3) + str(rng.randint(0, 400)) for _ in range(words))


def odd_rows() -> list[tuple]:
    rng = random.Random(3)
    base = prose(rng, 120)
    words = base.split()
    rows = [
        (1, base, "en", "a", 1),
        (2, base.replace(" ", "\n", 1), "en", "a", 1),  # equal after white space is folded
        (3, " ".join(words[:60] + ["x"] + words[61:]), "en", "b", None),
        (4, None, "en", None, None),
        (5, "", None, "", 0),
        (6, " \n\t ", "de", "b", 3),
        (7, "two words", "fr", None, 9),
        (8, "TWO Words", "fr", "c", 9),
        (9, "?!? 123 ---", "xx", "c", 9),
        (10, "<|endoftext|> </s> ### é 日本語   🎉 \x00  x", "en", "c", 9),
        (11, prose(rng, 6000), "en", "a", 9),
        (11, "another text under the same id", "en", "a", 9),
        (12, "w" * 5000 + " " + "\\" * 3000, "en", "a", 9),
        (None, base, "en", "a", 9),
        (None, None, None, None, None),
        (13, prose(rng, 300), "en", "a", 9),
        (13, prose(rng, 300), "en", "a", 9),
    ]
    rows.append(rows[0])  # a row that repeats
    rows.append((14, " ".join(rows[10][1].split()[500:560]), "en", "b", 9))
    for i in range(40):  # a group of near copies and one of copies
        changed = words[:]
        changed[rng.randrange(120)] = f"edit{i}"
        if i % 3 == 0:
            changed[rng.randrange(120)] = f"more{i}"
        rows += [(100 + i, " ".join(changed), "en", "hot", 9), (200 + i, "all the same words here", "en", "hot", 9)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(odd_rows(), SCHEMA)
    return frame.select("*", *(F.lit("clash").alias(c) for c in CLASHING)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def test_word_and_run_hashes_depend_on_words_only():
    texts = ["a bc  d\x0be", None, "", "bc d " + "long" * 800, "a\nbc\td"]
    hashes, offsets = common.word_hashes(texts)
    assert offsets.tolist() == [0, 4, 4, 4, 7, 10]
    assert hashes[:3].tolist() == hashes[7:].tolist() and hashes[1] == hashes[4]
    assert len(set(hashes.tolist())) == 5
    runs = common.run_hashes(hashes, 2)
    assert runs[0] == runs[7] and runs[1] == runs[4] and len(common.run_hashes(hashes, 11)) == 0


# --- token counts ----------------------------------------------------------


def test_token_counts_equal_the_library(spark, docs, empty):
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = rows_of(tokens.token_counts(docs, path), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = []
    for doc_id, text, *_ in odd_rows():
        n = len(library.encode(text or ""))
        want.append((doc_id, len((text or "").encode()), n, n > 4096))
    assert got == sorted(want, key=repr)
    assert tokens.token_counts(empty, path).count() == 0


def in_turn(table, pairs, symbols):
    """The merges one after another: best rank, then leftmost."""
    symbols = list(symbols)
    while True:
        found = [
            (*pairs[a * table.size + b], i)
            for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))
            if a >= 0 and b >= 0 and a * table.size + b in pairs
        ]
        if not found:
            return sum(1 if s >= 0 else -s for s in symbols)
        _, piece, i = min(found, key=lambda f: (f[0], f[2]))
        symbols[i : i + 2] = [piece]


def test_rounds_merge_as_in_turn():
    table = tokens.pair_table(public.path("piece_bpe_32k.model"))
    rng = random.Random(5)
    kinds = ("theingaé日 \t", "a", "ab", "etaoinshr", "=-", "01", "the", "zq")
    words = ["▁" + "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    words += ["".join(rng.choice(kind) for _ in range(rng.randint(1, 200))) for kind in kinds for _ in range(30)]
    pairs = dict(zip(table.keys.tolist(), zip(table.ranks.tolist(), table.merged.tolist(), strict=True), strict=True))
    assert tokens._rounds(table, [table.symbols(w) for w in words]).tolist() == [
        in_turn(table, pairs, table.symbols(w)) for w in words
    ]


def test_long_pretokens_stay_in_the_arrays():
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    library, table = sentencepiece.SentencePieceProcessor(model_file=path), tokens.pair_table(path)
    rng = random.Random(6)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = ["a" * 30_001, draw("ab", 9000), draw("0123456789abcdef", 20_000), draw("日本語中文字", 20_000)]
    texts += [draw("abcdefghijklmnopqrstuvwxyz", 20_000), "=" * 5000 + draw("etaoin", 5000), "-=" * 4000]
    assert tokens.count_tokens(table, texts) == [len(library.encode(t)) for t in texts]


# --- packing ---------------------------------------------------------------


def check_packing(rows, pieces):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    crcs = Counter()
    for doc_id, text, *_ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for begin in range(0, len(ids), 1024):
            part = ids[begin : begin + 1024]
            crcs[(doc_id, begin, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == crcs
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_packing_places_every_id_once(spark, docs, empty):
    packed = packing.pack_pieces(packing.tokenised_pieces(docs, byte_bpe()))
    check_packing(odd_rows(), packed.collect())
    assert packing.pack_pieces(packing.tokenised_pieces(empty, byte_bpe())).count() == 0
    # small windows close sequences early and lose nothing
    check_packing(odd_rows(), packing.pack_pieces(packing.tokenised_pieces(docs, byte_bpe()), window=8).collect())


def pieces_of(spark, lengths):
    rows = [(i, 0, n, n, i, n) for i, n in enumerate(lengths)]
    ddl = "doc_id long, start long, length long, loss long, ids_crc32 long, doc_tokens long"
    return spark.createDataFrame(rows, ddl).coalesce(1)


def test_pieces_that_leave_room_do_not_pile_up(spark):
    """600 of 1024 tokens: no second piece fits, so what waits is bounded, and nothing is packed again and again."""
    import pandas as pd

    chunk = pd.DataFrame({"length": [600] * 100, "loss": [600] * 100})
    done, left = packing._place(chunk, packing.LIMITS, 0, waiting=32)
    assert len(left) == 32 and done["sequence_id"].nunique() == len(done) == 68
    placed = packing.pack_pieces(pieces_of(spark, [600] * 3000), window=64).collect()
    assert len(placed) == len({r.sequence_id for r in placed}) == 3000
    # small pieces that come later still fill the room of those that wait
    mixed = packing.pack_pieces(pieces_of(spark, ([600] * 20 + [400] * 20) * 50), window=256).collect()
    assert len(mixed) == 2000 and len({r.sequence_id for r in mixed}) < 1100


@pytest.mark.parametrize("lengths", [[2] * 6000, [3, 5, 11] * 1500, [7, 40, 13, 30, 2] * 2000])
def test_short_documents_leave_little_padding(spark, lengths):
    placed = packing.pack_pieces(pieces_of(spark, lengths).repartition(1)).collect()
    sequences = len({r.sequence_id for r in placed})
    full = sum(lengths) / 1024
    assert sequences <= full / 0.95 + spark.sparkContext.defaultParallelism + 8


def test_vector_packing_keeps_all_limits():
    rng = np.random.default_rng(4)
    demands = np.stack([rng.integers(1, 400, 3000), np.ones(3000, int), rng.integers(0, 200, 3000)], axis=1)
    limits = (1024, 6, 500)
    bins = packing.pack_vectors(demands, limits)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    totals = np.array([demands[b].sum(axis=0) for b in bins])
    assert (totals <= limits).all()
    need = (demands.sum(axis=0) / np.array(limits)).max()
    assert len(bins) < 1.1 * need + 1  # need is a bound that no packing may reach
    assert packing.pack_vectors(np.zeros((0, 3), int), limits) == []
    with pytest.raises(ValueError):
        packing.pack_vectors(np.array([[2000, 1, 1]]), limits)


def test_fast_ids_equal_the_tokenizer_file():
    encode = packing.encoder(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    rng = random.Random(8)
    base = [chr(i) for i in range(0x250)] + list("    abst'\n ") * 15 + ["<|endoftext|>", "日本", "　", "🎉"]
    for _ in range(1500):
        text = "".join(rng.choice(base) for _ in range(rng.randint(0, 40)))
        assert encode.ids(text).tolist() == encode.full.encode(text, add_special_tokens=False).ids
    assert len(encode.ids(" " * 300_000)) and len(encode.ids("q" * 50_000))


# --- languages -------------------------------------------------------------


def naive_phrases(sample: str, text: str) -> int:
    """Greedy longest phrases of the whole text that occur in sample."""
    fold = lambda t: re.sub(r"[^a-zéä]+", " ", t.lower())
    sample, text, count, at = fold(sample), fold(text).lstrip(" "), 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        at = max(end - 1, at + 1)
        count += 1
    return count


@pytest.mark.parametrize("strip, batch", [(512, 1 << 20), (7, 1 << 20), (1, 40), (16, 100), (5, 3)])
def test_phrases_equal_naive_cross_parsing(monkeypatch, strip, batch):
    monkeypatch.setattr(langid, "STRIP", strip)
    monkeypatch.setattr(langid, "BATCH", batch)
    rng = random.Random(2)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))
    samples = {"x": [make("abcé", 200)], "y": [make("bcdä", 200)]}
    model = langid.LanguageModel(samples)
    texts = [make("abcé", 3), make("bcdä", 150), "", " 1 2", make("abcdé", 400), "zzz", "a", samples["x"][0] * 2, "a" + "1" * 99 + "b"]
    got = model.phrases(texts)
    want = [[naive_phrases(samples[k][0] + " ", t) for k in ("x", "y")] for t in texts]
    assert got.tolist() == want
    assert model.predict(texts[:2])[0] == ["x", "y"]


def test_size_of_automata_does_not_grow_with_letters():
    import pickle

    rng = random.Random(3)
    letters = lambda n, first: [chr(first + i) for i in range(n)]
    for count in (1000, 5000):
        alphabets = [letters(count, 0x4E00 + 700 * k) for k in range(4)]
        samples = {
            f"l{k}": ["".join(rng.choice(own) + " " * (rng.random() < 0.2) for _ in range(25_000))]
            for k, own in enumerate(alphabets)
        }
        model = langid.LanguageModel(samples)
        assert len(pickle.dumps(model)) < 25_000_000
        texts = [samples[k][0][500:900] for k in sorted(samples)]
        assert model.predict(texts)[0] == sorted(samples)


def test_languages_of_odd_rows(spark, docs, empty):
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(docs).collect()}
    assert {(4, "und"), (5, "und"), (6, "und"), (9, "und"), (None, "und")} <= got
    result = langid.identify(docs)
    assert result.count() == docs.count()
    assert result.where("score < 0 OR score > 1 OR lang_pred IS NULL OR held_out IS NULL").count() == 0
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_held_out_accuracy(spark):
    from conftest import SF_DIR

    table = spark.read.parquet(f"{SF_DIR.rsplit('/', 1)[0]}/sf0.01/documents.parquet")
    joined = langid.identify(table).where("held_out").join(table.select("doc_id", "lang"), "doc_id")
    right, total = joined.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert total > 150 and right >= 0.97 * total
    want = {i for (i,) in table.select("doc_id").collect() if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {r.doc_id for r in joined.select("doc_id").collect()} == want


# --- exact copies ----------------------------------------------------------


def naive_groups(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    result = []
    for text, ids in groups.items():
        named = sorted(i for i in ids if i is not None)
        keep = named[0] if named else None
        stays = Counter({keep: 1})
        for i in sorted(ids, key=repr):
            result.append((i, keep, len(ids), stays[i] > 0, hashlib.sha256(text.encode()).hexdigest()))
            stays[i] -= 1
    return sorted(result, key=repr)


def test_exact_groups(spark, docs, empty):
    columns = ("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")))
    assert rows_of(exact_dedup.exact_groups(docs), *columns) == naive_groups(odd_rows())
    assert exact_dedup.exact_groups(empty).count() == 0
    left = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns
    kept = [(r[0],) for r in naive_groups(odd_rows()) if r[3]]
    assert rows_of(left, "doc_id") == sorted(kept, key=repr)


def test_full_texts_decide_when_digests_collide(spark, docs):
    weak = lambda text: F.encode((F.length(text) % 3).cast("string"), "UTF-8")
    got = rows_of(exact_dedup.exact_groups(docs, digest=weak), "doc_id", "keep_id", "group_size", "kept")
    assert got == sorted((r[:4] for r in naive_groups(odd_rows())), key=repr)


def test_state_goes_on_in_a_later_run(spark, docs):
    state = common.scratch_path(spark, "kept-state")
    first = docs.where("doc_id < 150")
    exact_dedup.exact_groups(first, state=state)
    more = spark.createDataFrame([(900, "two words"), (901, "all new")], "doc_id long, text string")
    again = exact_dedup.exact_groups(more, state=state, earlier=first)
    assert rows_of(again, "doc_id", "keep_id", "group_size", "kept") == [(900, 7, 2, False), (901, 901, 1, True)]
    # a keeper whose text cannot be compared drops nothing
    third = spark.createDataFrame([(950, "two words")], "doc_id long, text string")
    assert rows_of(exact_dedup.exact_groups(third, state=state), "doc_id", "keep_id", "kept") == [(950, 950, True)]


# --- near copies -----------------------------------------------------------


def naive_components(rows, words, percent):
    sets = []
    for _, text, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = WORD.findall(low)
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for x, (a, *_) in enumerate(rows):
        for y, (b, *_) in enumerate(rows[:x]):
            if a is None or b is None or not sets[x] or not sets[y]:
                continue
            if 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return sorted(
        ((i, len(s), None if i is None else (root(i) if s else i)) for (i, *_), s in zip(rows, sets, strict=True)), key=repr
    )


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_jaccard_components(spark, docs, words, percent):
    got = rows_of(ngram_join.jaccard_components(docs, words, percent), "doc_id", "n_shingles", "component_id")
    assert got == naive_components(odd_rows(), words, percent)


def test_small_cells_and_blocks_find_the_same_links(spark, docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_KEYS", 500)
    monkeypatch.setattr(ngram_join.links, "__defaults__", (5,))
    got = rows_of(ngram_join.jaccard_components(docs, 3, 90), "doc_id", "n_shingles", "component_id")
    assert got == naive_components(odd_rows(), 3, 90)


def descending_rows() -> list[tuple]:
    """Classes of equal sets whose smallest document comes last, and near copies of them."""
    rng = random.Random(6)
    rows = []
    for group in range(6):
        base = prose(rng, 60)
        near = base.split()
        near[30] = "edit"
        ids = range(100 * group + 5, 100 * group + 35, 5)
        rows += [(i, base.upper() if i % 2 else base, "en", "a", 9) for i in ids]
        rows.append((100 * group + 40 + group % 2, " ".join(near), "en", "a", 9))
    return sorted(rows, reverse=True)


@pytest.mark.parametrize("slices", [1, 3])
def test_classes_link_when_documents_descend(spark, slices):
    rows = descending_rows()
    frame = spark.createDataFrame(rows, SCHEMA).coalesce(1) if slices == 1 else spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = rows_of(ngram_join.jaccard_components(frame, 3, 80), "doc_id", "n_shingles", "component_id")
    assert got == naive_components(rows, 3, 80)
    assert {component for _, _, component in got} == {100 * group + 5 for group in range(6)}
    assert rows_of(ngram_join.drop_near_copies(frame, 3, 80), "doc_id") == sorted(((100 * g + 5,) for g in range(6)), key=repr)


def tables_without_grams() -> dict[str, list[tuple]]:
    """Tables of which a batch has no n-gram, or none in the first count."""
    rng = random.Random(12)
    near = prose(rng, 80).split()
    normal = [(i, prose(rng, 60), "en", "a", 9) for i in range(36)]
    normal += [(40 + i, " ".join([*near[:40], str(i), *near[40:]]), "en", "a", 9) for i in range(4)]
    blank = [(100, None, "en", "a", 0), (101, "", "en", "a", 0), (102, " \t\n", None, None, 3)]
    return {
        "blank": blank,
        "hello": [(1, "hello", "en", "a", 5)],
        "blank file": normal + blank,
        "long": [(1, "word " * 1_200_000, "en", "a", 9), (2, " ", "en", "a", 1), (3, "one two three four five six", "en", "a", 9)],
    }


@pytest.mark.parametrize("name", list(tables_without_grams()))
def test_slices_without_grams(spark, name, tmp_path):
    rows = tables_without_grams()[name]
    blank = spark.createDataFrame([r for r in rows if r[0] >= 100] or rows, SCHEMA).coalesce(1)
    blank.write.parquet(f"{tmp_path}/t")
    if len(rows) > 10:
        spark.createDataFrame(rows[:-3], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    assert docs.count() == len(rows)
    for words, percent in ((3, 90), (5, 80)):
        got = rows_of(ngram_join.jaccard_components(docs, words, percent), "doc_id", "n_shingles", "component_id")
        assert got == naive_components(rows, words, percent)
    first = {c for _, n, c in naive_components(rows, 5, 80) if n} | {r[0] for r in rows if r[0] >= 100}
    kept = {r[0] for r in ngram_join.drop_near_copies(docs).select("doc_id").collect()}
    assert kept == first | {i for i, n, _ in naive_components(rows, 5, 80) if not n}


def test_short_documents_alone_in_their_slice(spark):
    for i in range(5):
        docs = spark.createDataFrame([(i, f"just {i}", "en", "a", 6)], SCHEMA)
        assert rows_of(ngram_join.jaccard_components(docs, 5, 80), "doc_id", "n_shingles", "component_id") == [(i, 1, i)]


def test_classes_that_share_half_a_signature_are_two():
    """Two near copies whose signatures agree in 32 bits: their n-grams are shared."""
    import pandas as pd

    sig = np.array([7 << 32 | 1, 7 << 32 | 2], np.uint64)
    posted = [{"single": np.array([5], np.uint32).tobytes(), "several": b"", "sig": sig[i : i + 1].tobytes(), "times": b""} for i in (0, 1, 1)]
    assert [one.tolist() for one, _ in ngram_join._frequencies(pd.DataFrame(posted))] == [[2], [2], [2]]


def test_near_copies_of_nothing(spark, empty):
    assert ngram_join.jaccard_components(empty).count() == 0
    assert ngram_join.drop_near_copies(empty).columns == empty.columns


# --- repeated passages -----------------------------------------------------


def naive_removal(rows, window):
    cut = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    least = {}
    for doc_id, w in cut:
        for at in range(len(w) - window + 1):
            key = tuple(w[at : at + window])
            if doc_id is not None:
                least[key] = min(least.get(key, doc_id), doc_id)
    result = []
    for doc_id, w in cut:
        gone = [False] * len(w)
        for at in range(len(w) - window + 1):
            if doc_id is not None and least[tuple(w[at : at + window])] < doc_id:
                gone[at : at + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        result.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(result, key=repr)


def test_words_whose_hashes_agree_are_not_taken_for_repeats(spark):
    """Two texts that differ in one word, written so that the fixed hash of both words is the same."""
    twins = ["mntyadvywordtail", "tfxhqggjdqrMhTAF"]
    assert len(set(common.word_hashes(twins)[0].tolist())) == 1
    assert len(set(common.word_hashes(twins, key=5)[0].tolist())) == 2
    words = [f"w{i}" for i in range(59)]
    texts = [" ".join([*words[:25], twin, *words[25:]]) for twin in twins]
    rows = [(1, texts[0], "en", "a", 9), (2, texts[1], "en", "a", 9), (3, texts[1], "en", "a", 9)]
    got = rows_of(substring.remove_repeats(spark.createDataFrame(rows, SCHEMA)), "doc_id", "n_removed")
    assert got == [(1, 0), (2, 0), (3, 60)]


@pytest.mark.parametrize("window", [50, 7, 1])
def test_repeated_windows_are_removed(spark, docs, window):
    got = substring.remove_repeats(docs, window, with_text=True)
    want = naive_removal(odd_rows(), window)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text") == want


def test_small_groups_and_long_prefixes_remove_the_same(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(substring, "GROUP_SUFFIXES", 3)
    monkeypatch.setattr(substring, "GROUP_PATHS", 100)
    got = rows_of(substring.remove_repeats(docs, 50), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == [r[:4] for r in naive_removal(odd_rows(), 50)]
    assert substring.remove_repeats(empty).count() == 0


# --- mixing ----------------------------------------------------------------


def test_mixing_meets_its_targets(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    got = mixing.mix(docs).collect()
    assert len(got) == len(odd_rows())
    sizes = defaultdict(int)
    for _, text, _, source, _ in odd_rows():
        sizes[source] += len(WORD.findall(text or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted((s for s in sizes if s is not None)) + [None])}
    targets, budget, free = {}, 1.5 * sum(sizes.values()), set(sizes)
    while True:  # share again by weight what exceeds twice a source
        share = {s: (budget - sum(targets.values())) * weights[s] / sum(weights[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            break
        targets |= {s: 2.0 * sizes[s] for s in over}
        free -= set(over)
    targets |= share
    found = {r.source_size: r.target for r in got}
    for source, size in sizes.items():
        assert found[size] == pytest.approx(targets[source])
    for size in {r.source_size for r in got}:
        assert sum(r.taken for r in got if r.source_size == size) == pytest.approx(found[size], abs=1)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert sorted(got, key=repr) == sorted(mixing.mix(docs.repartition(5)).collect(), key=repr)
    assert mixing.mix(empty).count() == 0


def test_mix_order_is_fair(spark, docs):
    sizes = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    queue = mixing.mix_order(mixing.serve(sizes)).collect()
    assert [r.finish for r in queue] == sorted(r.finish for r in queue) and all(r.start < 1 for r in queue)


def test_the_queue_is_cut_at_the_budget(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)
    sizes = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    queue = mixing.fair_queue(sizes)
    ordered = queue.orderBy(*mixing._turn()).collect()
    total = sum(r.words for r in ordered)
    for budget in (0, 1, total // 3, total - 1, total, total + 5):
        left, want = budget, Counter()
        for r in ordered:
            want[(r.doc_id, r.source, r.copy, r.epoch, r.finish, min(left, r.words))] += 1
            left -= min(left, r.words)
        got = mixing.truncated(queue, F.lit(budget).cast("long")).collect()
        assert Counter((r.doc_id, r.source, r.copy, r.epoch, r.finish, r.served) for r in got) == want


def test_mixed_rows_repeat_documents(spark, docs, empty):
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixing.mixed_rows(empty).columns == empty.columns
    times = Counter(r.text for r in mixed.collect())
    assert max(times[t] / n for t, n in Counter(t for _, t, *_ in odd_rows()).items()) <= 2
