"""Token counts of a SentencePiece BPE vocabulary by rank-synchronous merging.

A batch's distinct pre-tokens are held as one ragged array of symbol ids. In
each round every row applies its best pair (best score, then leftmost), all rows
at the same time; pairs are looked up in a sorted table of all pairs that the
vocabulary can merge. When no row has a pair left, the surviving symbols are
counted: one token per known symbol, one per UTF-8 byte of an unknown character.

Two things keep long rows short and few, without changing what is merged:

* A row is cut between two characters that stand side by side in no piece of the
  vocabulary: no merged symbol can ever hold both.
* A round applies all occurrences of the best rank up to the first whose merged
  symbol makes a pair of the same or a better rank with a neighbour. Until then
  the next merge of the sequential order is the next occurrence to the right.

Pre-tokens end before a word mark that follows another character, and around
line feeds; no piece of the vocabulary reaches over these places, which is
checked when the table is built.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from paperloom.llm.common import slices

MARK = "▁"
_CACHE = 1 << 20
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PairTable:
    """All pairs that can merge: left and right piece to (rank, merged piece)."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        skip = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        ids = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not skip(i)}
        self.size = model.get_piece_size()
        self.normalise = model.normalize
        self.single = {p: i for p, i in ids.items() if len(p) == 1}
        scores = sorted({-model.get_score(i) for i in ids.values()})
        rank = {s: r for r, s in enumerate(scores)}
        many = [p for p in ids if len(p) > 1]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in many):
            raise ValueError("pieces reach over the places where texts are cut")
        pairs = {}
        for piece in many:
            entry = (rank[-model.get_score(ids[piece])], ids[piece])
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = entry
        beside = {
            self.single[a] * self.size + self.single[b]
            for piece in many
            for a, b in zip(piece, piece[1:], strict=False)
            if a in self.single and b in self.single
        }
        self.beside = np.array(sorted(beside), np.int64)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)
        self.cache: dict[str, int] = {}

    def symbols(self, word: str) -> list[int]:
        """Piece ids of the characters; an unknown one as minus its bytes."""
        single = self.single
        return [single[c] if c in single else -len(c.encode("utf-8", "surrogatepass")) for c in word]

    def joinable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two characters stand side by side in some piece."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
        return (self.beside[at] == key) & (left >= 0) & (right >= 0)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (a large value: no merge) and merged piece of each pair."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.ranks[at], _NONE), self.merged[at]


_NONE = np.int32(2**31 - 1)


@lru_cache(maxsize=2)
def pair_table(model_file: str) -> PairTable:
    return PairTable(model_file)


def merged_counts(table: PairTable, words: list[str]) -> list[int]:
    """Tokens of each pre-token."""
    return _rounds(table, [table.symbols(w) for w in words]).tolist()


def _weight(symbols: np.ndarray) -> np.ndarray:
    return np.where(symbols < 0, -symbols.astype(np.int64), 1)


def _rounds(table: PairTable, lists: list[list[int]]) -> np.ndarray:
    """Tokens of ragged rows of symbols, merged in rounds."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    symbols = np.fromiter((s for row in lists for s in row), np.int32, int(sizes.sum()))
    result = np.zeros(len(lists), np.int64)
    if not len(symbols):
        return result
    owner = np.repeat(np.arange(len(lists)), sizes)
    # rows end where no merge can cross, and where a pre-token ends
    last = np.ones(len(symbols), bool)
    last[:-1] = (owner[1:] != owner[:-1]) | ~table.joinable(symbols[:-1], symbols[1:])
    ends = np.flatnonzero(last)
    lengths = np.diff(ends, prepend=-1)
    row_ids = owner[ends]  # the pre-token of each row
    row_of = np.repeat(np.arange(len(ends)), lengths)
    following = np.append(symbols[1:], np.int32(-1))
    ranks, merged = table.lookup(symbols, following)
    ranks[last] = _NONE
    while len(symbols):
        starts = np.cumsum(lengths) - lengths
        best = np.minimum.reduceat(ranks, starts)
        over = best == _NONE
        if over.any():  # finished rows leave the arrays
            np.add.at(result, row_ids[over], np.add.reduceat(_weight(symbols), starts)[over])
            keep = ~over[row_of]
            symbols, ranks, merged, last = symbols[keep], ranks[keep], merged[keep], last[keep]
            row_ids, lengths, best = row_ids[~over], lengths[~over], best[~over]
            row_of = np.repeat(np.arange(len(row_ids)), lengths)
            if not len(symbols):
                break
        at = _applied(table, symbols, ranks, merged, row_of, last, best)
        symbols[at] = merged[at]
        last[at] = last[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        lengths = lengths - np.bincount(row_of[at], minlength=len(lengths))
        at = at - np.arange(len(at))  # where the merged symbols end up
        symbols, ranks, merged, last = symbols[keep], ranks[keep], merged[keep], last[keep]
        row_of = row_of[keep]
        for place in (at, at - 1):  # the pairs on both sides of a merged symbol are new
            place = place[place >= 0]
            place = place[~last[place]]
            ranks[place], merged[place] = table.lookup(symbols[place], symbols[place + 1])
        ranks[last] = _NONE
    return result


def _applied(
    table: PairTable,
    symbols: np.ndarray,
    ranks: np.ndarray,
    merged: np.ndarray,
    row_of: np.ndarray,
    last: np.ndarray,
    best: np.ndarray,
) -> np.ndarray:
    """Places of the pairs that a round merges: those of best rank that come next in each row."""
    at = np.flatnonzero(ranks == best[row_of])
    # of pairs that overlap in a chain, every second is gone once the one before it is merged
    chain = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    behind = np.arange(len(at)) - np.repeat(chain, np.diff(chain, append=len(at)))
    at = at[behind % 2 == 0]
    row = row_of[at]
    first = np.ones(len(at), bool)
    first[1:] = row[1:] != row[:-1]
    if first.all():
        return at
    # the neighbours as they are when the pair's turn comes: the left one may just have been merged
    new = merged[at]
    left = symbols[np.maximum(at - 1, 0)].copy()
    touching = np.zeros(len(at), bool)
    touching[1:] = (at[1:] - at[:-1] == 2) & ~first[1:]
    left[touching] = new[np.flatnonzero(touching) - 1]
    has_left = (at > 0) & ~last[np.maximum(at - 1, 0)]
    has_right = ~last[at + 1]
    right = symbols[np.minimum(at + 2, len(symbols) - 1)]
    limit = best[row]
    stops = (has_left & (table.lookup(left, new)[0] <= limit)) | (has_right & (table.lookup(new, right)[0] <= limit))
    # a pair is merged now if none before it in its row stops the round
    stopped = np.cumsum(stops) - stops
    begin = np.flatnonzero(first)
    return at[stopped == np.repeat(stopped[begin], np.diff(begin, append=len(at)))]


def _pretokens(table: PairTable, text: str) -> tuple[list[str], int]:
    """Pre-tokens of a text and the number of its line feeds (a byte token each)."""
    marked = table.normalise(text) if text else ""
    lines = marked.split("\n")
    words: list[str] = []
    for line in lines:
        if MARK + MARK in line:
            words += _SEGMENT.findall(line)
        elif line:
            first, *rest = line.split(MARK)
            if first:
                words.append(first)
            words += [MARK + w for w in rest]
    return words, len(lines) - 1


def count_tokens(table: PairTable, texts: list[str | None]) -> list[int]:
    """Tokens of whole texts, without begin or end tokens."""
    cut = [_pretokens(table, t or "") for t in texts]
    cache = table.cache
    new = list({w for words, _ in cut for w in words if w not in cache})
    if len(cache) + len(new) > _CACHE:
        cache.clear()
        new = list({w for words, _ in cut for w in words})
    cache.update(zip(new, merged_counts(table, new), strict=True))
    return [sum(map(cache.__getitem__, words)) + feeds for words, feeds in cut]


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs(doc_id, text)``.

    Null and empty texts have no bytes and no tokens. Rows are independent:
    repeated rows and null ids give rows of their own, other columns are ignored,
    an empty table gives an empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pair_table(model_file)
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            tokens = pa.array(count_tokens(table, texts.to_pylist()), pa.int64())
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            over = pc.greater(tokens, limit)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), sizes, tokens, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.select("doc_id", "text").mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
