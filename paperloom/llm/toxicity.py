"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

A text is a vector over character n-grams (insults are inflected and misspelt, so
whole words are too rare). Of all n-grams of the labelled examples those are
terms whose document frequency differs between the labels beyond doubt; their
weights are ``(1 + ln tf) * idf`` with frequencies over all documents, and
vectors have length one. The examples stand in an inverted index whose postings
are cut into blocks of examples, with the largest weight of each term in each
block: a block whose bound does not reach the k-th best cosine so far is never
opened, so the neighbours are exact.

The votes of the neighbours, weighted by how near they are, give a raw score; a
monotone calibration, learned by leaving each example out, turns it into the
share of toxic examples at that score.

Learning takes at most ``max_examples`` labelled rows of each label and
``max_terms`` terms (parameters). Document frequencies and scores cover all rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import run_hashes, slices, stored, word_hashes

#: lengths of the character n-grams
LENGTHS = (3, 5)
#: labelled rows of each label, terms and neighbours of a model
MAX_EXAMPLES, MAX_TERMS, NEIGHBOURS = 8192, 512, 24
#: least document frequency of a term
LEAST_DOCS = 4
#: examples of a block of the index, and documents that are looked up together
BLOCK, BATCH = 64, 256
#: votes of the base rate, in votes of an example at cosine 1
PRIOR = 1.0
#: score from which a text is toxic
THRESHOLD = 0.7
_PARTIAL = 200_000
#: vectors that a task scores, about
_ROWS = 10_000
_VECTORS = "terms array<int>, tfs array<int>"


def plain(text: str | None) -> str:
    """Lower-cased, one blank for any white space, blanks around all."""
    return f" {' '.join((text or '').lower().split())} "


def grams(line: str, lengths: tuple[int, ...] = LENGTHS) -> set[str]:
    return {line[i : i + n] for n in lengths for i in range(len(line) - n + 1)}


# --- examples ----------------------------------------------------------------


def draw_examples(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """``text, toxic, drawn``: at most ``max_examples`` labelled rows of each label, by a hash of their id.

    ``labels(doc_id, toxic)``: of several rows of an id the largest label counts,
    null ids and labels teach nothing. ``drawn`` is the share of its label's rows
    that a row stands for.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
        .withColumn("draw", F.xxhash64("doc_id"))
    )
    counts = dict(known.groupBy("toxic").count().collect())  # two rows
    parts = [known.where(F.col("toxic") == t).orderBy("draw", "doc_id").limit(max_examples) for t in (0, 1)]
    ids = parts[0].unionByName(parts[1]).select(F.col("doc_id").alias("example"), "toxic")
    # at most twice max_examples ids
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("example"))
    share = F.when(F.col("toxic") == 1, _share(counts.get(1, 0), max_examples)).otherwise(
        _share(counts.get(0, 0), max_examples)
    )
    return texts.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic")).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic", share.alias("drawn")
    )


def _share(count: int, most: int) -> Column:
    return F.lit(min(1.0, most / count) if count else 1.0)


def _copies_key(texts: list[str]) -> np.ndarray:
    """The smallest hash of five words in a row: near copies share it, other texts do not."""
    hashes, offsets = word_hashes(texts, lower=True)
    keys = np.zeros(len(texts), np.uint64)
    for i in range(len(texts)):
        own = hashes[offsets[i] : offsets[i + 1]]
        runs = run_hashes(own, min(5, max(1, len(own))))
        keys[i] = runs.min() if len(runs) else 0
    return keys.view(np.int64)


def one_per_copy(examples: DataFrame) -> DataFrame:
    """One of the examples that are near copies of each other, with their mean label as ``toxic``.

    Without this the n-grams of one text that was copied often would all look typical.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(_copies_key(batch.column("text").to_pylist()))], [*batch.schema.names, "copies"]
            )

    keyed = examples.mapInArrow(run, "doc_id long, text string, toxic int, drawn double, copies long")
    return keyed.groupBy("copies").agg(
        F.min("doc_id").alias("doc_id"),
        F.min_by("text", "doc_id").alias("text"),
        F.avg("toxic").alias("toxic"),
        F.sum(1 / F.col("drawn")).alias("stands_for"),
    )


def choose_terms(
    examples: DataFrame, lengths: tuple[int, ...] = LENGTHS, max_terms: int = MAX_TERMS
) -> list[str]:
    """N-grams whose document frequency differs between toxic and other ``examples(text, toxic)``.

    The difference is told by the log-likelihood ratio, at a level at which one of
    all n-grams of ``LEAST_DOCS`` examples or more would pass by chance.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = (Counter(), Counter())

        def partial() -> pa.RecordBatch:
            names = list(tallies[0] | tallies[1])
            columns = [pa.array([t[n] for n in names], pa.int64()) for t in tallies]
            for t in tallies:
                t.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *columns], ["term", "clean", "toxic"])

        for batch in slices(batches, "text"):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                tallies[toxic >= 0.5].update(grams(plain(text), lengths))
                if len(tallies[0]) + len(tallies[1]) > _PARTIAL:
                    yield partial()
        yield partial()

    counted = examples.select("text", "toxic").mapInArrow(run, "term string, clean long, toxic long")
    sizes = examples.agg(
        F.sum((F.col("toxic") >= 0.5).cast("long")).alias("toxic"), F.count("*").alias("n")
    ).first()
    if not sizes["toxic"] or sizes["toxic"] == sizes["n"]:
        return []
    rate = sizes["toxic"] / sizes["n"]
    held = F.col("toxic") + F.col("clean")
    part = lambda n, share: F.when(n > 0, n * F.log(n / (held * share))).otherwise(0.0)
    ratio = 2 * (part(F.col("toxic"), rate) + part(F.col("clean"), 1 - rate))
    tested = stored(
        counted.groupBy("term")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(held >= LEAST_DOCS)
        .select("term", F.round(ratio, 6).alias("ratio")),
        "toxicity_terms",
    )
    least = NormalDist().inv_cdf(1 - 0.5 / max(2, tested.count())) ** 2
    chosen = tested.where(F.col("ratio") >= least).orderBy(F.desc("ratio"), "term").limit(max_terms)
    return sorted(r["term"] for r in chosen.collect())


# --- vectors -----------------------------------------------------------------


def term_automaton(terms: list[str]):  # noqa: ANN201
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        automaton.add_word(term, number)
    automaton.make_automaton()
    return automaton


def with_terms(rows: DataFrame, terms: list[str], columns: str) -> DataFrame:
    """``columns`` (names and types) of ``rows``, and the terms of ``text`` with their counts."""
    shared = rows.sparkSession.sparkContext.broadcast(term_automaton(terms) if terms else None)  # max_terms n-grams
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in slices(batches, "text"):
            found, times = [], []
            for text in batch.column("text").to_pylist():
                tally = Counter(n for _, n in automaton.iter(plain(text))) if automaton is not None else {}
                order = sorted(tally)
                found.append(order)
                times.append([tally[n] for n in order])
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in names],
                    pa.array(found, pa.list_(pa.int32())),
                    pa.array(times, pa.list_(pa.int32())),
                ],
                [*names, "terms", "tfs"],
            )

    return rows.select(*names, "text").mapInArrow(run, f"{columns}, {_VECTORS}")


@dataclass
class Vectors:
    """Sparse rows: ``terms[at[i]:at[i + 1]]`` ascending, with their weights."""

    at: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def rows(self, begin: int, end: int) -> Vectors:
        low, high = self.at[begin], self.at[end]
        return Vectors(self.at[begin : end + 1] - low, self.terms[low:high], self.weights[low:high])


def weighted(at: np.ndarray, terms: np.ndarray, tfs: np.ndarray, idf: np.ndarray) -> Vectors:
    """TF-IDF vectors of length one."""
    weights = (1 + np.log(tfs.astype(float))) * idf[terms]
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    length = np.sqrt(np.bincount(of, weights=weights * weights, minlength=len(at) - 1))
    return Vectors(at, terms, weights / length[of])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


# --- index -------------------------------------------------------------------


class BlockMaxIndex:
    """Inverted index of example vectors, cut into blocks of examples.

    ``peaks[term, block]`` is the largest weight of a term in a block, so the
    peaks bound the cosine of every example of a block from above.
    """

    def __init__(self, examples: Vectors, n_terms: int, block: int = BLOCK) -> None:
        of = np.repeat(np.arange(len(examples)), np.diff(examples.at))
        self.size, self.block, self.n_terms = len(examples), block, n_terms
        self.blocks = -(-self.size // block)
        key = of // block * n_terms + examples.terms
        order = np.argsort(key, kind="stable")
        self.local = (of % block).astype(np.int16)[order]
        self.weights = examples.weights[order]
        self.start = np.searchsorted(key[order], np.arange(self.blocks * n_terms + 1))
        self.peaks = np.zeros((n_terms, self.blocks))
        np.maximum.at(self.peaks, (examples.terms, of // block), examples.weights)

    def nearest(self, queries: Vectors, k: int, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and numbers of the k nearest examples, one row per query, best first.

        Ties fall to the smaller number; places without an example at a cosine
        above 0 hold cosine 0. ``leave`` names an example that a query must not meet.
        """
        n = len(queries)
        best = np.zeros((n, k))
        number = np.full((n, k), self.size)
        if not n or not self.size:
            return best, number
        of = np.repeat(np.arange(n), np.diff(queries.at))
        used, column = np.unique(queries.terms, return_inverse=True)
        dense = np.zeros((n, len(used)))
        dense[of, column] = queries.weights
        bounds = dense @ self.peaks[used]
        bounds += bounds * 1e-9  # rounding never hides a tie
        order = np.argsort(-bounds, axis=1, kind="stable")
        for step in range(self.blocks):
            block = order[:, step]
            bound = bounds[np.arange(n), block]
            live = np.flatnonzero((bound > 0) & (bound >= best[:, -1]))
            if not len(live):
                break
            fan = np.diff(queries.at)[live]
            place = np.repeat(queries.at[live] - np.cumsum(fan) + fan, fan) + np.arange(int(fan.sum()))
            slot = np.repeat(np.arange(len(live)), fan)
            cell = block[live][slot] * self.n_terms + queries.terms[place]
            run = self.start[cell + 1] - self.start[cell]
            at = np.repeat(self.start[cell] - np.cumsum(run) + run, run) + np.arange(int(run.sum()))
            sums = np.bincount(
                np.repeat(slot, run) * self.block + self.local[at],
                weights=np.repeat(queries.weights[place], run) * self.weights[at],
                minlength=len(live) * self.block,
            ).reshape(len(live), self.block)
            found = block[live][:, None] * self.block + np.arange(self.block)
            if leave is not None:
                sums[found == leave[live][:, None]] = 0
            found[sums <= 0] = self.size
            cosines = np.concatenate([best[live], sums], axis=1)
            numbers = np.concatenate([number[live], found], axis=1)
            first = np.lexsort((numbers, -cosines), axis=1)[:, :k]
            best[live] = np.take_along_axis(cosines, first, axis=1)
            number[live] = np.take_along_axis(numbers, first, axis=1)
        return best, number


def monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step function nearest to ``y``: left ends of its steps and their values.

    Equal x are one point; values are shrunk to the mean by one observation's weight.
    """
    levels, of = np.unique(x, return_inverse=True)
    total = np.bincount(of, weights=weight)
    good = np.bincount(of, weights=weight * y)
    mean, unit = good.sum() / total.sum(), weight.mean()
    steps: list[list[float]] = []
    for at, t, g in zip(levels.tolist(), total.tolist(), good.tolist(), strict=True):
        steps.append([at, t, g])
        while len(steps) > 1 and steps[-2][2] * steps[-1][1] >= steps[-1][2] * steps[-2][1]:
            _, t, g = steps.pop()
            steps[-1][1] += t
            steps[-1][2] += g
    values = [(g + unit * mean) / (t + unit) for _, t, g in steps]
    return np.array([s[0] for s in steps]), np.maximum.accumulate(np.array(values))


class ToxicityModel:
    """Index, votes and calibration; bounded by the numbers of examples and terms."""

    def __init__(self, vectors: Vectors, idf: np.ndarray, table: pd.DataFrame, k: int = NEIGHBOURS) -> None:
        """``table``: ``toxic`` and ``stands_for`` of each vector's example, and its ``doc_id``."""
        self.idf, self.k = idf, k
        of_all = table["stands_for"].to_numpy()
        self.base = float((table["toxic"].to_numpy() * of_all).sum() / of_all.sum()) if len(table) else 0.0
        # examples of equal vectors are one entry; entries of one leading term stand together
        rows = [
            (tuple(vectors.terms[a:b].tolist()), tuple(vectors.weights[a:b].tolist()))
            for a, b in zip(vectors.at, vectors.at[1:], strict=False)
        ]
        lead = lambda row: (row[0][int(np.argmax(row[1]))], *row) if row[0] else ()
        entries = sorted(set(r for r in rows if r[0]), key=lead)
        entry = {row: i for i, row in enumerate(entries)}
        self.entry_of = np.array([entry.get(r, -1) for r in rows], np.int64)
        sizes = [len(t) for t, _ in entries]
        self.index = BlockMaxIndex(
            Vectors(
                np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
                np.array([t for terms, _ in entries for t in terms], np.int64),
                np.array([w for _, weights in entries for w in weights], float),
            ),
            max(1, len(idf)),
        )
        # toxic and all examples of each entry; the last place is for "no neighbour"
        self.toxic, self.all = np.zeros(len(entries) + 1), np.zeros(len(entries) + 1)
        self.example = np.full(len(entries) + 1, -1, np.int64)
        held = self.entry_of >= 0
        np.add.at(self.toxic, self.entry_of[held], (table["toxic"].to_numpy() * of_all)[held])
        np.add.at(self.all, self.entry_of[held], of_all[held])
        ids = table["doc_id"].to_numpy(np.int64)
        for i in np.flatnonzero(held)[::-1]:
            self.example[self.entry_of[i]] = ids[i]
        self.unit = float(of_all.mean()) if len(table) else 1.0
        self.left, self.value = np.zeros(1), np.full(1, self.base)

    def votes(self, cosines: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        near = cosines**2
        toxic = (near * self.toxic[numbers]).sum(axis=1) + PRIOR * self.unit * self.base
        return np.round(toxic / ((near * self.all[numbers]).sum(axis=1) + PRIOR * self.unit), 9)

    def calibrate(self, raw: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> None:
        if len(raw):
            self.left, self.value = monotone(raw, toxic, weight)

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return self.value[np.maximum(0, np.searchsorted(self.left, raw, side="right") - 1)]

    def raw(self, queries: Vectors, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Raw scores, and cosines and entries of the neighbours."""
        cosines, numbers = self.index.nearest(queries, self.k, leave)
        return self.votes(cosines, numbers), cosines, numbers


# --- learning and scoring ----------------------------------------------------


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == fold, F.lit(False))


def _left_out(spark: SparkSession, model: ToxicityModel, vectors: Vectors) -> np.ndarray:
    """Raw score of each example among the others, in parallel over the bounded examples."""
    shared = spark.sparkContext.broadcast((model, vectors))
    n = len(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows = shared.value
        for batch in batches:
            for begin in batch.column("begin").to_pylist():
                end = min(n, begin + BATCH)
                raw, _, _ = known.raw(rows.rows(begin, end), known.entry_of[begin:end])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(begin, end)), pa.array(raw)], ["example", "raw"]
                )

    starts = spark.range(0, n, BATCH).select(F.col("id").alias("begin"))
    found = starts.mapInArrow(run, "example long, raw double").toPandas()
    return found.sort_values("example")["raw"].to_numpy()


def learn(spark: SparkSession, examples: DataFrame, terms: list[str], idf: np.ndarray) -> ToxicityModel:
    """A model of ``examples(doc_id, text, toxic, stands_for)``, a bounded frame."""
    rows = with_terms(examples, terms, "doc_id long, toxic double, stands_for double").toPandas().sort_values("doc_id")
    at = np.concatenate([[0], np.cumsum([len(t) for t in rows["terms"]])]).astype(np.int64)
    flat = [np.concatenate([np.zeros(0, np.int64), *rows[c]]).astype(np.int64) for c in ("terms", "tfs")]
    vectors = weighted(at, *flat, idf)
    model = ToxicityModel(vectors, idf, rows[["doc_id", "toxic", "stands_for"]].reset_index(drop=True))
    if len(rows):
        raw = _left_out(spark, model, vectors)
        model.calibrate(raw, rows["toxic"].to_numpy(float), rows["stands_for"].to_numpy(float))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """Score every row of ``docs(doc_id, text)`` from ``labels(doc_id, toxic)`` outside the held-out fold.

    Returns ``doc_id, held_out, score, predicted, evidence``; evidence are up to
    three nearest examples, one of each distinct vector, as ``(doc_id, cosine,
    toxic)``, nearest first. Only the text is an input of a score. Null and empty
    texts, and texts without any term, get the calibrated base rate; without
    labelled rows of both kinds every text gets the base rate. Rows are
    independent, repeated and null ids included; an empty table gives an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    learned = labels.where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    examples = stored(one_per_copy(draw_examples(docs, learned, max_examples)), "toxicity_examples")
    terms = choose_terms(examples)
    flagged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    vectors = stored(with_terms(flagged, terms, "doc_id long, held_out boolean"), "toxicity_vectors")
    held = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toPandas()  # at most max_terms rows
    df = np.zeros(len(terms))
    df[held["term"].to_numpy(np.int64)] = held["count"]
    rows = vectors.count()
    idf = np.log((1 + rows) / (1 + df)) + 1
    model = spark.sparkContext.broadcast(learn(spark, examples, terms, idf))  # max_examples, max_terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        nothing = float(known.calibrated(known.votes(np.zeros((1, 1)), np.full((1, 1), known.index.size)))[0])
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.float64())]))
        for batch in batches:
            at, flat = _lists(batch.column("terms"))
            _, tfs = _lists(batch.column("tfs"))
            told = np.flatnonzero(np.diff(at))
            queries = weighted(np.concatenate([[0], at[told + 1]]), flat.astype(np.int64), tfs, known.idf)
            scores = np.full(batch.num_rows, nothing)
            evidence: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for begin in range(0, len(told), BATCH):
                rows = told[begin : begin + BATCH]
                raw, cosines, numbers = known.raw(queries.rows(begin, begin + len(rows)))
                scores[rows] = known.calibrated(raw)
                for row, near, entry in zip(rows.tolist(), cosines[:, :3].tolist(), numbers[:, :3].tolist(), strict=True):
                    evidence[row] = [
                        {"doc_id": int(known.example[e]), "cosine": c, "toxic": float(known.toxic[e] / known.all[e])}
                        for c, e in zip(near, entry, strict=True)
                        if c > 0
                    ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(scores),
                    pa.array((scores >= THRESHOLD).astype(np.int32)),
                    pa.array(evidence, kind),
                ],
                ["doc_id", "held_out", "score", "predicted", "evidence"],
            )

    # vectors are small beside the work they make: deal them out by rows, not by bytes
    return vectors.repartition(1 + rows // _ROWS).mapInArrow(
        run,
        "doc_id long, held_out boolean, score double, predicted int, "
        "evidence array<struct<doc_id: long, cosine: double, toxic: double>>",
    )
