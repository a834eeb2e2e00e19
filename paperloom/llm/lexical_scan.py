"""Ranked lexical search without a document index: an automaton of all item terms.

The terms of the items become one Aho-Corasick automaton; every term stands
between two blanks in it, so a match is a whole term and never part of one. Each
document is folded byte by byte (letters A-Z lower, every other ASCII character
that is no digit or letter a blank) and run through the automaton once; its
outputs are the term frequencies. What is kept of a document are its length and
those counts. The counts give document frequencies, and a second pass over the
counts alone maps automaton outputs to items, sums their scores and keeps the
best documents of each item in every task.

Items are taken in blocks whose terms have at most ``block_bytes`` bytes on
average, so an automaton is bounded however many items there are; the texts are
read once per block.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import slices, stored

#: bytes of term text in one automaton
BLOCK_BYTES = 8 << 20
#: cells of the item by document table that a task sums at once
CELLS = 1 << 21
_COUNTS = "doc_id long, n long, terms array<int>, tfs array<long>"


def _fold_table() -> bytes:
    table = bytearray(range(256))
    for byte in range(128):
        char = chr(byte)
        table[byte] = ord(char.lower()) if char.isalnum() else 0x20
    return bytes(table)


_FOLD = _fold_table()


def folded(text: str) -> str:
    """The text's UTF-8 bytes as characters: terms apart by blanks, blanks around all."""
    return f" {text.encode('utf-8', 'surrogatepass').translate(_FOLD).decode('latin-1')} "


def terms_of(text: str | None) -> list[str]:
    """All terms in order, in the form of :func:`folded`."""
    return [t for t in folded(text or "").split(" ") if t]


def term_count(line: str) -> int:
    """Number of terms of a folded text."""
    blank = np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20
    return int(np.count_nonzero(blank[:-1] & ~blank[1:]))


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term, times`` of ``items(item_id, text)``; rows of one id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, found, times = [], [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for term, n in sorted(Counter(terms_of(text)).items()):
                    ids.append(item)
                    found.append(term)
                    times.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(found, pa.string()), pa.array(times, pa.int64())],
                ["item_id", "term", "times"],
            )

    rows = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    found = rows.mapInArrow(run, "item_id long, term string, times long")
    return found.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def guarded_automaton(terms: list[str]):  # noqa: ANN201
    """Finds the numbers of all ``terms`` that stand between blanks."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        automaton.add_word(f" {term} ", number)
    automaton.make_automaton()
    return automaton


def scan(docs: DataFrame, terms: list[str]) -> DataFrame:
    """``doc_id, n, terms, tfs`` of every document that has a term at all.

    ``n`` counts all its terms; ``terms`` are the numbers of those of the
    automaton that occur, ``tfs`` how often.
    """
    shared = docs.sparkSession.sparkContext.broadcast(guarded_automaton(terms))  # bounded by the block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in slices(batches, "text"):
            ids, sizes, found, times = [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                line = folded(text)
                n = term_count(line)
                if not n:
                    continue
                tally = Counter(number for _, number in automaton.iter(line))
                ids.append(doc)
                sizes.append(n)
                found.append(list(tally))
                times.append(list(tally.values()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(found, pa.list_(pa.int32())),
                    pa.array(times, pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "terms", "tfs"],
            )

    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, _COUNTS)


class ItemScores:
    """Scores of documents for all items of a block, and the best of each item so far."""

    def __init__(
        self,
        weights: np.ndarray,
        item_ids: np.ndarray,
        of_term: np.ndarray,
        items: np.ndarray,
        times: np.ndarray,
        n_docs: int,
        n_terms: int,
    ) -> None:
        order = np.argsort(of_term, kind="stable")
        self.weights, self.item_ids = weights, item_ids
        self.items, self.times = items[order], times[order]
        self.start = np.searchsorted(of_term[order], np.arange(len(weights) + 1))
        self.n_docs, self.n_terms = n_docs, n_terms

    def add(
        self, best: tuple[np.ndarray, ...], k: int, docs: np.ndarray, sizes: list[int], at: np.ndarray,
        terms: np.ndarray, tfs: np.ndarray,
    ) -> tuple[np.ndarray, ...]:
        """``best`` (item number, doc_id, score) after some more documents; all sums in 64 bits."""
        m = np.array([25 + 75 * n * self.n_docs // self.n_terms for n in sizes], np.int64)
        of = np.repeat(np.arange(len(docs)), np.diff(at))
        part = self.weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[of]))
        fan = self.start[terms + 1] - self.start[terms]
        place = np.repeat(self.start[terms] - np.cumsum(fan) + fan, fan) + np.arange(int(fan.sum()))
        sums = np.zeros(len(self.item_ids) * len(docs), np.int64)
        np.add.at(sums, self.items[place] * len(docs) + np.repeat(of, fan), self.times[place] * np.repeat(part, fan))
        sums = sums.reshape(len(self.item_ids), len(docs))
        least = np.ones(len(self.item_ids), np.int64)
        counts = np.bincount(best[0], minlength=len(least))
        full = np.flatnonzero(counts >= k)
        least[full] = np.maximum(1, best[2][np.cumsum(counts)[full] - 1])
        item, column = np.nonzero(sums >= least[:, None])
        return first_k(
            np.concatenate([best[0], item]),
            np.concatenate([best[1], docs[column]]),
            np.concatenate([best[2], sums[item, column]]),
            k,
        )


def first_k(items: np.ndarray, docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best documents of each item, items ascending, best first."""
    order = np.lexsort((docs, -scores, items))
    items, docs, scores = items[order], docs[order], scores[order]
    keep = np.arange(len(items)) - np.searchsorted(items, items) < k
    return items[keep], docs[keep], scores[keep]


def _best_of_tasks(counts: DataFrame, scores: ItemScores, k: int) -> DataFrame:
    shared = counts.sparkSession.sparkContext.broadcast(scores)  # bounded by the block of items
    rows = max(1, CELLS // max(1, len(scores.item_ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        best = (np.zeros(0, np.int64),) * 3
        for whole in batches:
            for begin in range(0, whole.num_rows, rows):
                batch = whole.slice(begin, rows)
                lists = batch.column("terms")
                at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
                best = table.add(
                    best,
                    k,
                    batch.column("doc_id").to_numpy(zero_copy_only=False),
                    batch.column("n").to_pylist(),
                    at,
                    lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                    batch.column("tfs").flatten().to_numpy(zero_copy_only=False),
                )
        yield pa.RecordBatch.from_arrays(
            [pa.array(table.item_ids[best[0]]), pa.array(best[1]), pa.array(best[2])], ["item_id", "doc_id", "score"]
        )

    return counts.where("size(terms) > 0 AND doc_id IS NOT NULL").mapInArrow(run, "item_id long, doc_id long, score long")


def _ranked_block(docs: DataFrame, terms: DataFrame, k: int) -> DataFrame | None:
    rows = terms.toPandas()  # one block of items
    if rows.empty:
        return None
    names = sorted(rows["term"].unique())
    number = {name: i for i, name in enumerate(names)}
    counts = stored(scan(docs, names), "term_counts")
    total = counts.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    held = counts.select(F.explode("terms").alias("term")).groupBy("term").count().toPandas()  # at most the block's terms
    df = np.zeros(len(names), np.int64)
    df[held["term"].to_numpy(np.int64)] = held["count"]
    weights = np.array(
        [math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * d + 1))) for d in df.tolist()], np.int64
    )
    item_ids, item = np.unique(rows["item_id"].to_numpy(np.int64), return_inverse=True)
    scores = ItemScores(
        weights, item_ids, rows["term"].map(number).to_numpy(np.int64), item.astype(np.int64),
        rows["times"].to_numpy(np.int64), total["docs"], max(1, total["terms"] or 0),
    )
    return _best_of_tasks(counts, scores, k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` best documents of ``docs(doc_id, text)`` for each of ``items(item_id, text)``.

    Returns ``item_id, rank, doc_id, score``: rank from 1, highest score first,
    equal scores by ascending doc_id, only scores above 0. Null texts, and texts
    without a letter, a digit or a character beyond ASCII, have no terms; items
    without terms, or with a null id, give no rows. Rows that repeat an item_id
    are one item of all their terms; rows that repeat a doc_id are documents of
    their own; a null doc_id counts in the statistics and is not ranked. Empty
    tables give an empty result; other columns are ignored.
    """
    terms = stored(item_terms(items), "item_terms")
    size = terms.agg(F.sum(F.octet_length("term")).alias("bytes")).first()["bytes"] or 0
    blocks = -(-size // block_bytes)
    block = F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks)))
    found = [_ranked_block(docs, terms.where(block == b), k) for b in range(blocks)]
    found = [part for part in found if part is not None]
    if not found:
        empty = "item_id long, rank int, doc_id long, score long"
        return docs.sparkSession.createDataFrame([], empty)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
