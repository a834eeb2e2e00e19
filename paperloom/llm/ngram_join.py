"""Jaccard self-join on word n-grams as a blocked sparse matrix product.

The incidence matrix has a row per text class (equal n-gram sets are one class)
and a column per n-gram. Two classes link when ``100 * overlap >= percent *
union``; then each misses at most ``errors(n) = n - ceil(percent * n / 100)`` of
the other's n-grams, and the two together at most ``(100 - percent) * (n + m) /
(100 + percent)``. These size-derived bounds thin out rows, columns and pairs
before any product is formed:

1. Rows. N-grams are counted in column blocks (by hash). A class with more
   n-grams of its own than ``errors(n)`` links to nothing. The first count looks
   at a hash range of the n-grams of all texts, which rejects most texts; the
   second at all n-grams of the remaining ones.
2. Columns. Of a class only the ``errors(n) + 1`` rarest columns are kept: two
   linked classes share at least one of them, whatever the counts are.
3. Pairs. Classes that share a kept column meet in a block: rows are dealt out
   by the smallest document of their column, in cells of bounded size. A cell
   multiplies one row at a time with the rows that it may still link to, so the
   overlap counts of a row are one sparse product; pairs whose positions in the
   kept columns exceed the bounds, and pairs that are connected already, are
   left out. Only links go back to Spark, where components are found by joins.

Column keys are shortened hashes. Two n-grams that share a key only make more
candidates; the products are on 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import mix, numbered_slices, run_hashes, slices, stored, word_hashes

#: the first count looks at so many times the part of n-grams that linked sets may lack
FIRST_PART = 2.5
#: n-grams that a column block holds, on average
BLOCK_KEYS = 2_000_000
#: classes per side of a cell
CELL_ROWS = 1024


def errors(n: np.ndarray, percent: int) -> np.ndarray:
    """N-grams of a set of size n that a linked set may lack."""
    return n - -(-(n * percent) // 100)


def gram_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, and the offset of each text's first."""
    hashes, offsets = word_hashes(texts, lower=True)
    runs = run_hashes(hashes, words)
    sets = []
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if end - begin >= words:
            sets.append(np.unique(runs[begin : end - words + 1]))
        elif end > begin:  # fewer words: the whole sequence is the only n-gram
            sets.append(mix(run_hashes(hashes[begin:end], end - begin) + np.uint64(end - begin)))
        else:
            sets.append(np.zeros(0, np.uint64))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def _signatures(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit values that depend on the set only (0 for the empty set)."""
    result = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(flat ^ np.uint64(salt)), dtype=np.uint64)])
        result.append(total[offsets[1:]] - total[offsets[:-1]])
    return result[0], result[1]


def set_signatures(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n, sig_a, sig_b`` of every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            flat, offsets = gram_sets(batch.column("text").to_pylist(), words)
            sig_a, sig_b = _signatures(flat, offsets)
            arrays = [np.diff(offsets), sig_a.view(np.int64), sig_b.view(np.int64)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, arrays)], ["doc_id", "n", "sig_a", "sig_b"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sig_a long, sig_b long")


class _Slice:
    """Postings of one batch of texts, by column block.

    ``single`` are keys of one class of the batch, ``several`` keys of more than
    one: these are known to be shared and are counted before they leave.
    """

    def __init__(self, texts: list[str | None], ids: np.ndarray, words: int, part: float, blocks: int) -> None:
        flat, offsets = gram_sets(texts, words)
        sig, _ = _signatures(flat, offsets)
        self.n = np.diff(offsets)
        self.sig = sig
        by_id = np.argsort(ids, kind="stable")
        _, first = np.unique(sig[by_id], return_index=True)
        head = np.zeros(len(texts), bool)
        head[by_id[first]] = True
        head &= self.n > 0
        self.head = head  # one row per class, its smallest document in the batch
        row = np.repeat(np.arange(len(texts)), self.n)
        keep = head[row]
        if part < 1:
            keep &= flat < np.uint64(int(part * 2**64))
        key, row = mix(flat[keep] + np.uint64(0x452821E638D01377)), row[keep]
        high, low = key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)
        block = (high * np.uint64(blocks)) >> np.uint64(32)
        short = (block << np.uint64(32)) | low
        order = np.argsort(short, kind="stable")
        self.key, self.row = short[order], row[order]
        starts = np.flatnonzero(np.concatenate([[True], self.key[1:] != self.key[:-1]])) if len(self.key) else np.zeros(0, int)
        self.starts, self.counts = starts, np.diff(np.append(starts, len(self.key)))
        self.blocks = blocks

    def rows(self) -> Iterator[dict]:
        """What each column block gets of this batch."""
        keys = self.key[self.starts]
        if not len(keys):  # no text with a word, or none of its n-grams in this part
            return
        sent, begins = np.unique(keys >> np.uint64(32), return_index=True)
        ends = np.append(begins[1:], len(keys))
        for block, begin, end in zip(sent.tolist(), begins.tolist(), ends.tolist(), strict=True):
            low = (keys[begin:end] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            one = self.counts[begin:end] == 1
            row = self.row[self.starts[begin:end][one]]
            yield {
                "block": block,
                "single": low[one].tobytes(),
                "row": row.astype(np.uint16).tobytes(),
                "sig": self.sig[row].tobytes(),
                "several": low[~one].tobytes(),
                "times": self.counts[begin:end][~one].astype(np.uint32).tobytes(),
            }


def _frequencies(frame: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per batch how many classes hold each of its single and its several keys."""
    single = [np.frombuffer(v, np.uint32) for v in frame["single"]]
    several = [np.frombuffer(v, np.uint32) for v in frame["several"]]
    sigs = np.concatenate([np.frombuffer(v, np.uint64) for v in frame["sig"]])
    times = [np.frombuffer(v, np.uint32) for v in frame["times"]]
    alone = np.concatenate(single)
    order = np.lexsort((sigs, alone))
    alone, sigs = alone[order], sigs[order]
    new = np.ones(len(alone), bool)  # one class counts once for a key, in however many batches it is
    new[1:] = (alone[1:] != alone[:-1]) | (sigs[1:] != sigs[:-1])
    alone = alone[new]
    keys = np.concatenate([alone, *several])
    weights = np.concatenate([np.ones(len(alone), np.int64), *times]).astype(np.int64)
    known, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, weights=weights, minlength=len(known)).astype(np.int64)
    look = lambda k: total[np.searchsorted(known, k)] if len(k) else np.zeros(0, np.int64)
    return [(look(a), look(b)) for a, b in zip(single, several, strict=True)]


def not_alone(docs: DataFrame, words: int, percent: int, blocks: int, part: float) -> DataFrame:
    """``doc_id`` of the smallest document per batch and class that may link to another class."""

    columns = _POSTED + ", ids binary, n binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in numbered_slices(batches, "text"):
            ids = np.array(batch.column("doc_id").to_pylist(), np.int64)
            cut = _Slice(batch.column("text").to_pylist(), ids, words, part, blocks)
            n = np.where(cut.head, cut.n, -1).astype(np.int32)
            # who is in the batch takes the way through any block
            home = {"batch": number, "block": number % blocks, "ids": ids.tobytes(), "n": n.tobytes()}
            yield pa.RecordBatch.from_pylist([home, *({"batch": number, **r} for r in cut.rows())], schema=_arrow(columns))

    def judge(frame: pd.DataFrame) -> pd.DataFrame:
        home = frame["ids"].notna()
        posted = frame[~home]
        rows, own = [], []
        if len(posted):
            for (single, _), row in zip(_frequencies(posted), posted["row"], strict=True):
                at, times = np.unique(np.frombuffer(row, np.uint16)[single == 1], return_counts=True)
                rows.append(at.tobytes())
                own.append(times.astype(np.uint32).tobytes())
        replies = pd.DataFrame({"batch": posted["batch"], "ids": None, "n": None, "row": rows, "own": own})
        return pd.concat([frame.loc[home, ["batch", "ids", "n"]], replies], ignore_index=True)[
            ["batch", "ids", "n", "row", "own"]
        ]

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        home = frame[frame["ids"].notna()].iloc[0]
        replies = frame[frame["ids"].isna()]
        n = np.frombuffer(home["n"], np.int32).astype(np.int64)
        own = np.zeros(len(n), np.int64)
        for row, times in zip(replies["row"], replies["own"], strict=True):
            own[np.frombuffer(row, np.uint16)] += np.frombuffer(times, np.uint32)
        ids = np.frombuffer(home["ids"], np.int64)
        return pd.DataFrame({"doc_id": ids[(n > 0) & (own <= errors(n, percent))]})

    sent = docs.select("doc_id", "text").mapInArrow(send, columns)
    judged = sent.groupBy("block").applyInPandas(judge, "batch long, ids binary, n binary, row binary, own binary")
    return judged.groupBy("batch").applyInPandas(gather, "doc_id long")


_POSTED = "batch long, block int, single binary, row binary, sig binary, several binary, times binary"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def rarest_columns(docs: DataFrame, words: int, percent: int, blocks: int) -> DataFrame:
    """``doc_id, n, place, key``: the columns kept of each class that may link.

    ``place`` is the position of a column in its class by rarity; columns that
    no other class has come first and are left out.
    """
    posted = _POSTED
    home = "batch long, ids binary, n binary, key binary, row binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in numbered_slices(batches, "text"):
            ids = np.array(batch.column("doc_id").to_pylist(), np.int64)
            cut = _Slice(batch.column("text").to_pylist(), ids, words, 1, blocks)
            yield pa.RecordBatch.from_pylist([row | {"batch": number} for row in cut.rows()], schema=_arrow(posted))

    def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in numbered_slices(batches, "text"):
            ids = np.array(batch.column("doc_id").to_pylist(), np.int64)
            cut = _Slice(batch.column("text").to_pylist(), ids, words, 1, blocks)
            row = {
                "batch": number,
                "ids": ids.tobytes(),
                "n": np.where(cut.head, cut.n, -1).astype(np.int32).tobytes(),
                "key": cut.key.tobytes(),
                "row": cut.row.astype(np.uint16).tobytes(),
            }
            yield pa.RecordBatch.from_pylist([row], schema=_arrow(home))

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        keys, counts = [], []
        block = np.uint64(int(frame["block"].iloc[0])) << np.uint64(32)
        for (one, more), single, several in zip(_frequencies(frame), frame["single"], frame["several"], strict=True):
            low = np.concatenate([np.frombuffer(single, np.uint32), np.frombuffer(several, np.uint32)])
            total = np.concatenate([one, more])
            keys.append((low[total > 1] | block).tobytes())
            counts.append(total[total > 1].tobytes())
        return pd.DataFrame({"batch": frame["batch"], "shared": keys, "total": counts})

    def choose(mine: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        empty = {"doc_id": [], "n": [], "place": [], "key": []}
        if mine.empty:
            return pd.DataFrame(empty).astype("int64")
        ids, n = np.frombuffer(mine["ids"].iloc[0], np.int64), np.frombuffer(mine["n"].iloc[0], np.int32).astype(np.int64)
        key, row = np.frombuffer(mine["key"].iloc[0], np.uint64), np.frombuffer(mine["row"].iloc[0], np.uint16).astype(np.int64)
        shared = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(v, np.uint64) for v in replies["shared"])])
        total = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(v, np.int64) for v in replies["total"])])
        order = np.argsort(shared)
        shared, total = np.append(shared[order], np.uint64(2**64 - 1)), np.append(total[order], 0)
        at = np.searchsorted(shared, key)
        frequency = np.where(shared[at] == key, total[at], 1)
        order = np.lexsort((key, frequency, row))
        key, row, frequency = key[order], row[order], frequency[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        own = np.bincount(row[frequency == 1], minlength=len(n))
        allowed = errors(n, percent)
        keep = (frequency > 1) & (own <= allowed)[row] & (place <= allowed[row])
        return pd.DataFrame(
            {"doc_id": ids[row[keep]], "n": n[row[keep]], "place": place[keep], "key": key[keep].view(np.int64)}
        )

    texts = docs.select("doc_id", "text")
    replies = (
        texts.mapInArrow(send, posted)
        .groupBy("block")
        .applyInPandas(count, "batch long, shared binary, total binary")
    )
    return (
        texts.mapInArrow(stay, home)
        .groupBy("batch")
        .cogroup(replies.groupBy("batch"))
        .applyInPandas(choose, "doc_id long, n long, place long, key long")
    )


def cell_links(
    ids: np.ndarray, sets: list[np.ndarray], keys: list[np.ndarray], places: list[np.ndarray], percent: int
) -> list[tuple[int, int]]:
    """Links that connect the rows of a cell like all links of the cell do."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    columns, flat = np.unique(np.concatenate(sets), return_inverse=True)
    offsets = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(ids)), [len(k) for k in keys])
    key, place = np.concatenate(keys), np.concatenate(places)
    order = np.argsort(key, kind="stable")
    key, place, owner = key[order], place[order], owner[order]
    lists = np.split(np.arange(len(key)), np.flatnonzero(key[1:] != key[:-1]) + 1)
    of_row: list[list[int]] = [[] for _ in ids]
    for number, members in enumerate(lists):
        if len(members) > 1:
            for member in members.tolist():
                of_row[owner[member]].append(number)
    group = np.arange(len(ids))
    mark = np.zeros(len(columns), bool)
    links = []
    for x in range(len(ids)):
        near = []
        for number in of_row[x]:
            members = lists[number]
            others = owner[members]
            here = place[members[np.searchsorted(others, x)]]  # members are in the order of the rows
            fits = (here + place[members]) * (100 + percent) <= (n[x] + n[others]) * (100 - percent)
            near.append(others[fits & (others > x)])
        if not near:
            continue
        others = np.unique(np.concatenate(near))
        others = others[group[others] != group[x]]
        others = others[np.minimum(n[others], n[x]) * 100 >= percent * np.maximum(n[others], n[x])]
        if not len(others):
            continue
        mark[flat[offsets[x] : offsets[x + 1]]] = True
        sizes = n[others]
        starts = np.cumsum(sizes) - sizes
        inside = np.arange(sizes.sum()) - np.repeat(starts - offsets[others], sizes)
        overlap = np.add.reduceat(mark[flat[inside]].astype(np.int64), starts)
        mark[flat[offsets[x] : offsets[x + 1]]] = False
        for y in others[overlap * 100 >= percent * (n[x] + sizes - overlap)].tolist():
            if group[y] != group[x]:
                links.append((int(ids[x]), int(ids[y])))
                group[group == group[y]] = group[x]
    return links


def links(texts: DataFrame, kept: DataFrame, words: int, percent: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``a, b``: enough links between documents to connect what all links connect."""
    heads = kept.groupBy("key").agg(F.min("doc_id").alias("head"), F.count("*").alias("size")).where("size > 1")
    members = stored(
        kept.join(heads, "key")
        .groupBy("head", "doc_id", "n")
        .agg(F.collect_list(F.struct("key", "place")).alias("columns")),
        "members",
    )
    blocks = members.groupBy("head").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("blocks"))
    placed = (
        members.join(blocks, "head")
        .withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "head",
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
            "doc_id",
            F.col("columns.key").alias("key"),
            F.col("columns.place").alias("place"),
        )
    )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            flat, offsets = gram_sets(batch.column("text").to_pylist(), words)
            values = [flat[b:e].tobytes() for b, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.binary())], ["of", "grams"])

    grams = (
        texts.join(members.select(F.col("doc_id").alias("of")).distinct(), F.col("doc_id") == F.col("of"), "left_semi")
        .select("doc_id", "text")
        .mapInArrow(sets, "of long, grams binary")
    )

    def cell(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id", kind="stable")
        found = cell_links(
            frame["doc_id"].to_numpy(np.int64),
            [np.frombuffer(v, np.uint64) for v in frame["grams"]],
            [np.asarray(v, np.int64) for v in frame["key"]],
            [np.asarray(v, np.int64) for v in frame["place"]],
            percent,
        )
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return (
        placed.join(grams, F.col("doc_id") == F.col("of"))
        .groupBy("head", "low", "high")
        .applyInPandas(cell, "a long, b long")
        .where("a <> b")
    )


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest reachable node) of every node of ``edges(a, b)``.

    Alternates two steps until nothing changes: every node hands its larger
    neighbours to its smallest one, then its smaller ones.
    """
    now = stored(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    state = None
    while True:
        both = now.union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        )
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        handed = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(handed.union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        totals = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if totals == state:
            break
        state = totals
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )


def jaccard_components(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id reachable by links, the row's own
    included. Equal sets are linked; empty sets (null text or no word) are linked
    with nothing. A document is its doc_id: rows that share one are linked by it.
    A row with a null doc_id has a null component_id and links to nothing. Rows
    that repeat give rows of their own; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text")
    named = rows.where("doc_id IS NOT NULL")
    sets = stored(set_signatures(rows, words), "sets")
    linkable = sets.where("doc_id IS NOT NULL AND n > 0")
    classes = linkable.groupBy("sig_a", "sig_b", "n").agg(F.min("doc_id").alias("head"))
    grams = linkable.agg(F.sum("n")).first()[0] or 0
    blocks = lambda total: max(1, round(total / BLOCK_KEYS))
    part = min(1.0, FIRST_PART * (100 - percent) / 100)
    first = not_alone(named, words, percent, blocks(grams * part), part)
    heads = stored(
        first.distinct().join(classes.select(F.col("head").alias("doc_id")).distinct(), "doc_id", "left_semi"), "heads"
    )
    texts = stored(named.join(heads, "doc_id", "left_semi"), "texts")
    left = sets.join(heads, "doc_id", "left_semi").agg(F.sum("n")).first()[0] or 0
    kept = stored(rarest_columns(texts, words, percent, blocks(left)), "kept")
    found = links(texts, kept, words, percent)
    copies = (
        linkable.join(classes, ["sig_a", "sig_b", "n"]).where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    )
    # copies hang on their class as leaves; only classes that share a document connect through them
    shared_ids = linkable.groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1").select("doc_id")
    bridges = copies.join(shared_ids, F.col("a") == F.col("doc_id"), "left_semi")
    found = components(found.union(bridges)).withColumnRenamed("node", "head")
    placed = classes.join(found, "head", "left").select(
        "sig_a", "sig_b", "n", F.coalesce("component", "head").alias("component_id")
    )
    return linkable.join(placed, ["sig_a", "sig_b", "n"]).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id"
    ).union(
        sets.where("doc_id IS NULL OR n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    )


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its component, with all their columns."""
    found = jaccard_components(docs, words, percent)
    dropped = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(dropped, F.col("doc_id") == F.col("__id"), "left_anti")
