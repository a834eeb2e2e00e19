"""Pack token sequences into fixed-size training sequences.

Placement is vector bin packing with the dot-product heuristic: a sequence has
a capacity in several dimensions at once (tokens, segments, loss-bearing
tokens), and of all pieces that fit it takes the one whose demand has the
largest weighted dot product with what is still free, until nothing fits.

Documents are tokenised where they are read and cut into pieces of one full
sequence plus a rest; only the pieces' sizes are shuffled. Pieces are dealt out
by hash, so no document, source or hot key meets in one task, and a task packs a
bounded window of pieces at a time.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import slices

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: tokens, segments and loss-bearing tokens of one sequence; from two tokens a piece on, segments leave no room empty
LIMITS = (1024, 512, 1024)
#: pieces that are open for placement at once in one task
WINDOW = 1 << 15
#: characters whose classes are the same in every version of Unicode
_PLAIN = re.compile(r"[\x00-ɏ]*")
_LONG_RUN = 2000


def _plain(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _PLAIN.fullmatch(text) is not None
    return True


def _short_runs(text: str) -> bool:
    """No long stretch without, or of, white space."""
    words = text.split()
    longest = max(map(len, words), default=0)
    return longest < _LONG_RUN and len(text) - sum(map(len, words)) - len(words) < _LONG_RUN


def pack_vectors(demands: np.ndarray, limits: tuple[int, ...]) -> list[list[int]]:
    """Bins of item numbers for ``demands`` (one row per item, one column per limit).

    Every item must fit into an empty bin. Items of equal demand are one type
    and are taken in the order given, so the result is a function of the input.
    """
    if not len(demands):
        return []
    capacity = np.asarray(limits, np.float64)
    types, of = np.unique(demands, axis=0, return_inverse=True)
    of = of.reshape(-1)
    if (types > capacity).any():
        raise ValueError("an item exceeds the limits of an empty bin")
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of, minlength=len(types)))
    taken = np.concatenate([[0], ends[:-1]])
    share = types / capacity
    weight = share[of].sum(axis=0) + 1e-9  # scarce dimensions weigh more
    weighted = share * (weight / weight.sum())
    bins: list[list[int]] = []
    # what fills a dimension that every item needs is a bin of its own
    needed = (types > 0).all(axis=0)
    alone = ((types == capacity) & needed).any(axis=1)
    for number in np.flatnonzero(alone).tolist():
        bins += [[i] for i in order[taken[number] : ends[number]].tolist()]
    taken[alone] = ends[alone]
    live = np.flatnonzero(~alone)
    while len(live):
        free, used = capacity.copy(), {}
        fit = live
        while True:
            fit = fit[(types[fit] <= free).all(axis=1)]
            spent = [n for n, times in used.items() if taken[n] + times >= ends[n]]
            open_types = fit[~np.isin(fit, spent)] if spent else fit
            if not len(open_types):
                break
            best = int(open_types[np.argmax(weighted[open_types] @ (free / capacity))])
            used[best] = used.get(best, 0) + 1
            free -= types[best]
        # the choices stay the same until one of these types runs out
        again = min(int(ends[n] - taken[n]) // times for n, times in used.items())
        shares = [order[taken[n] : taken[n] + times * again].reshape(again, times) for n, times in used.items()]
        bins += np.concatenate(shares, axis=1).tolist()
        for n, times in used.items():
            taken[n] += times * again
        live = live[taken[live] < ends[live]]
    return bins


class Encoder:
    """Token ids as the ``tokenizers`` file gives them.

    With ``ranks_file`` (the same vocabulary as byte ranks) texts whose
    characters have the same classes everywhere are encoded from the ranks, which
    is several times faster and gives the same ids; all others go through the
    tokenizer file itself.
    """

    def __init__(self, tokenizer_file: str, ranks_file: str | None, pattern: str | None) -> None:
        self.file = tokenizer_file
        self.fast = None
        if ranks_file and pattern:
            import base64

            import tiktoken

            with open(ranks_file, "rb") as lines:
                ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, lines)}
            with open(tokenizer_file, encoding="utf-8") as file:
                special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
            self.fast = tiktoken.Encoding(ranks_file, pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    @cached_property
    def full(self) -> Tokenizer:
        """The tokenizer file itself: loaded where a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.file)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and _plain(text) and _short_runs(text):
            return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(tokenizer_file: str, ranks_file: str | None, pattern: str | None) -> Encoder:
    return Encoder(tokenizer_file, ranks_file, pattern)


def tokenised_pieces(
    docs: DataFrame, encode: Callable[[], Callable[[str], np.ndarray]], room: int = LIMITS[0], end_id: int = 0
) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: full sequences, then the rest of each document.

    ``encode`` makes the encoding function inside a task. Every document ends
    with ``end_id``, so a null or empty text is one piece of one id. Returns
    ``doc_id, start, length, loss, ids_crc32, doc_tokens``; all ids but a
    document's first bear loss. Rows are independent (repeated rows and null ids
    are documents of their own).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encode()
        for batch in slices(batches, "text"):
            row, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(ids_of(text or ""), end_id).astype("<u4")
                for begin in range(0, len(ids), room):
                    piece = ids[begin : begin + room]
                    row.append(i)
                    start.append(begin)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(ids))
            starts, lengths = pa.array(start, pa.int64()), pa.array(length, pa.int64())
            loss = pa.array([n - (b == 0) for b, n in zip(start, length, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row, pa.int64())),
                    starts,
                    lengths,
                    loss,
                    pa.array(crc, pa.int64()),
                    pa.array(total, pa.int64()),
                ],
                ["doc_id", "start", "length", "loss", "ids_crc32", "doc_tokens"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        cut, "doc_id long, start long, length long, loss long, ids_crc32 long, doc_tokens long"
    )


def pack_pieces(pieces: DataFrame, limits: tuple[int, int, int] = LIMITS, window: int = WINDOW) -> DataFrame:
    """Give each piece (``length`` tokens, ``loss`` loss-bearing ones) a place.

    Adds ``sequence_id`` and ``offset`` (gapless from 0 in every sequence). A
    task sorts its share, so it places the same pieces alike when it is repeated.
    It packs about ``window`` pieces at a time and closes the full sequences; of
    the others those wait for pieces that still fit, up to half a window of
    pieces, the fullest are closed beyond that. An empty table gives an empty result.
    """
    schema = pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, made = TaskContext.get().partitionId() << 36, 0
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) >= window:
                chunk = pd.concat(held, ignore_index=True)
                done, left = _place(chunk, limits, base + made, waiting=window // 2)
                made += int(done["sequence_id"].nunique())
                held = [left]
                yield done
        if held:
            yield _place(pd.concat(held, ignore_index=True), limits, base + made, waiting=0)[0]

    return (
        pieces.repartition(F.xxhash64("doc_id", "start", "ids_crc32"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "start", "ids_crc32")
        .mapInPandas(place, schema)
    )


def _place(
    chunk: pd.DataFrame, limits: tuple[int, int, int], base: int, waiting: int
) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Place a window of pieces; up to ``waiting`` pieces in sequences with much free room are left."""
    lengths = chunk["length"].to_numpy(np.int64)
    demands = np.stack([lengths, np.ones_like(lengths), chunk["loss"].to_numpy(np.int64)], axis=1)
    number, offset = np.full(len(chunk), -1, np.int64), np.zeros(len(chunk), np.int64)
    made, left = 0, 0
    bins = pack_vectors(demands, limits)
    fill = np.array([int(lengths[items].sum()) for items in bins], np.int64)
    for place in np.argsort(fill, kind="stable").tolist():  # the emptiest wait first
        items = bins[place]
        if left + len(items) <= waiting and fill[place] < limits[0] - limits[0] // 64:
            left += len(items)
            continue
        sizes = lengths[items]
        number[items] = base + made
        offset[items] = np.cumsum(sizes) - sizes
        made += 1
    done = number >= 0
    placed = chunk[done].assign(sequence_id=number[done], offset=offset[done])
    return placed, chunk[~done]
