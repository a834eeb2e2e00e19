"""Alignment of two tokenizers over the same bytes.

Both tokenizers say which part of the text a token comes from: ``tokenizers`` in
characters, ``sentencepiece`` in the spans of its proto (bytes). These are the
coarse cuts. Where several tokens share one character (pieces of a multibyte
character, byte-fallback tokens) the cuts between them are refined with the
decoded bytes of the tokens.

Neither tokenizer joins anything across a single blank between two characters
that are no white space, so a text is aligned in segments cut at such blanks.
Segments repeat, and each is aligned once per worker while it is remembered.

Counting is a join on id pairs that never moves one row per document and pair:
documents are put together in chunks of a bounded number of links, the distinct
pairs of a chunk are counted and looked up, and the documents of a chunk then
read their counts by place.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import slices, stored

#: distinct (document, pair) entries of a chunk; one document is never cut
CHUNK_LINKS = 1 << 22
#: segments that a worker remembers
MEMORY = 300_000
#: segments that are aligned at once, and those of a line; distinct pairs of a chunk in one row
_LEARN, _LINE, _ROW = 1 << 14, 256, 1 << 15
# a blank between two characters that no definition of white space holds
_EDGE = r"[^\s\x00-\x1f\x7f-\x9f\u180e\u200b-\u200f\u2028-\u202f\u205f-\u206f\u2581\ufeff]"
_CUT = re.compile(rf" (?<={_EDGE} )(?={_EDGE})")
_INNER = re.compile(rf"{_EDGE}(?:.*{_EDGE})?\Z", re.DOTALL)


def segments(text: str) -> list[str]:
    """``" " + text`` is the segments with one blank in front of each."""
    return _CUT.split(text)


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary.

    Printable bytes stand for themselves, the others are numbered from 256.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """A byte-level BPE of ``tokenizers`` (A) beside a ``sentencepiece`` model (B)."""

    def __init__(self, a_path: str, b_path: str) -> None:
        # a task has one core: threads of their own would only take those of other tasks
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        alphabet = _byte_alphabet()
        self.a_bytes = [
            bytes(alphabet[c] for c in self.a.id_to_token(i)) if set(self.a.id_to_token(i)) <= alphabet.keys() else b""
            for i in range(self.a.get_vocab_size())
        ]
        self.b_bytes = [self._piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (
            np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes)
        )
        self.is_byte = np.array([self.b.is_byte(i) for i in range(self.b.get_piece_size())], bool)

    @staticmethod
    def _piece_bytes(piece: str) -> bytes:
        if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("\u2581", " ").encode("utf-8", "surrogatepass")

    def encode_a(self, parts: list[str]) -> Tokens:
        """Tokens of a blank and each part."""
        lines = joined(parts)
        found = self.a.encode_batch(lines, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable([e.ids for e in found]), np.int64)
        spans = np.fromiter(chain.from_iterable(chain.from_iterable([e.offsets for e in found])), np.int64).reshape(-1, 2)
        points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        byte = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])
        spans += np.repeat(_before(lines), [len(e) for e in found])[:, None]
        stops = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        owner = np.searchsorted(stops, spans[:, 1])
        ends = byte[spans[:, 1]] - byte[np.concatenate([[0], stops])[owner]]
        # tokens that share a character with the next one end inside it
        shared = np.zeros(len(ends), bool)
        shared[:-1] = (owner[:-1] == owner[1:]) & (spans[1:, 0] < spans[:-1, 1])
        return Tokens(ids, ends, np.bincount(owner, minlength=len(parts))).refined(shared, self.a_size)

    def encode_b(self, parts: list[str]) -> Tokens:
        """As :meth:`encode_a`; the model itself puts the blank in front of a line."""
        lines = joined(parts)
        found = [self.b.encode(line[1:], return_type="proto").pieces for line in lines]
        ids = np.array([p.id for pieces in found for p in pieces], np.int64)
        ends = np.array([p.end + 1 for pieces in found for p in pieces], np.int64)
        ends += np.repeat(_before([line.encode("utf-8", "surrogatepass") for line in lines]), list(map(len, found)))
        stops = np.cumsum(np.array([len(p.encode("utf-8", "surrogatepass")) + 1 for p in parts], np.int64))
        owner = np.searchsorted(stops, ends)
        ends -= np.concatenate([[0], stops])[owner]
        # only the last byte of a character has a span that moves on
        return Tokens(ids, ends, np.bincount(owner, minlength=len(parts))).refined(self.is_byte[ids], self.b_size)


def joined(parts: list[str]) -> list[str]:
    """The parts, a blank in front of each, in lines of several; those with white space at an end stay alone."""
    lines, line = [], []
    for part in parts:
        if _INNER.match(part):
            line.append(part)
            if len(line) < _LINE:
                continue
            part = ""
        if line:
            lines.append(" " + " ".join(line))
            line = []
        if part or not lines:
            lines.append(" " + part)
    if line:
        lines.append(" " + " ".join(line))
    return lines


def _before(lines: list[str] | list[bytes]) -> np.ndarray:
    """Length of all lines before each line."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    return np.cumsum(sizes) - sizes


class Tokens:
    """Tokens of many parts in a row: ids, the byte of the part where each ends, tokens of each part."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> None:
        self.ids, self.ends, self.counts = ids, ends, counts

    def refined(self, shared: np.ndarray, size: np.ndarray) -> Tokens:
        """With the ends of ``shared`` tokens told by decoded sizes from the last certain end on."""
        if shared.any():
            place = np.arange(len(shared))
            begin = np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
            certain = np.maximum.accumulate(np.where(shared, -1, place))
            certain = np.where(certain >= begin, certain, begin - 1)
            total = np.concatenate([[0], np.cumsum(size[self.ids])])
            base = np.where(certain >= begin, self.ends[certain], 0)
            self.ends = np.where(shared, base + total[place + 1] - total[certain + 1], self.ends)
        return self

    def of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def faithful(self, decoded: list[bytes], size: np.ndarray, expected: list[bytes]) -> np.ndarray:
        """Whether the tokens of each part give its bytes back; spans that do not fit them give way."""
        sizes = np.fromiter(map(len, expected), np.int64, len(expected))
        last = np.cumsum(self.counts)
        total = np.concatenate([[0], np.cumsum(size[self.ids])])
        first = total[last - self.counts]
        same = total[last] - first == sizes
        pieces = list(map(decoded.__getitem__, self.ids.tolist()))
        if not same.all() or b"".join(pieces) != b"".join(expected):
            cuts = zip(last.tolist(), self.counts.tolist(), expected, strict=True)
            same = np.array([b"".join(pieces[c - n : c]) == e for c, n, e in cuts], bool)
        ends = total[1:] - np.repeat(first, self.counts)
        odd = np.zeros(len(sizes), bool)
        odd[self.of()[self.ends != ends]] = True
        self.ends = np.where(odd[self.of()], ends, self.ends)
        return same

    def only(self, parts: np.ndarray) -> Tokens:
        held = parts[self.of()]
        return Tokens(self.ids[held], self.ends[held], np.where(parts, self.counts, 0))


def align(a: Tokens, b: Tokens, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Groups and links of two cuts of the same parts, ``sizes`` bytes each.

    Returns A ids and B ids of all links in order, the numbers of groups and of
    links per part, and the groups of each part as ``a1,a2|b1;a3|b2`` (parts of
    size 0 are left out there).
    """
    base = np.cumsum(sizes) - sizes
    a_end, b_end = a.ends + base[a.of()], b.ends + base[b.of()]
    # between two cuts of any side lies one link
    cuts = np.union1d(a_end, b_end)
    links = a.ids[np.searchsorted(a_end, cuts)], b.ids[np.searchsorted(b_end, cuts)]
    common = np.intersect1d(a_end, b_end, assume_unique=True)
    part_ends = base + sizes
    per_part = [
        np.bincount(np.searchsorted(part_ends, x), minlength=len(sizes)) for x in (common, cuts)
    ]
    a_group, b_group = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
    a_sep = (a_end == common[a_group]).astype(np.int64)
    b_last = b_end == common[b_group]
    b_sep = np.where(b_last, np.where(np.isin(b_end, part_ends), 2, 1), 0)
    order = np.argsort(np.concatenate([a_group * 2, b_group * 2 + 1]), kind="stable")
    number = np.concatenate([a.ids, b.ids])[order].tolist()
    separator = np.array([",", "|", ";", "\n"], object)
    after = separator[np.concatenate([a_sep, np.array([0, 2, 3])[b_sep]])[order]].tolist()
    text = "".join([f"{n}{s}" for n, s in zip(number, after, strict=True)])
    return *links, *per_part, text.split("\n")[:-1]


class SegmentTable:
    """Alignments of segments, each computed once while it is remembered."""

    def __init__(self, tokenizers: Tokenizers) -> None:
        self.tokenizers = tokenizers
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.used = np.zeros(0, np.int64)  # times that each segment was asked for
        self.sizes = array("q")  # A tokens, B tokens, groups, links, 0 if the bytes differ
        self.pairs = array("i")  # numbers of pairs, in the order of links
        self.begin = array("q", [0])
        self.pair_number: dict[int, int] = {}

    def forget(self, keep: int) -> None:
        """Keep the ``keep`` segments asked for most often; pairs get new numbers."""
        used, names, groups = self.used, list(self.number), self.groups
        sizes, begin = np.array(self.sizes, np.int64).reshape(-1, 5), np.array(self.begin, np.int64)
        keys = np.fromiter(self.pair_number, np.int64, len(self.pair_number))[np.array(self.pairs, np.int64)]
        kept = np.sort(np.argsort(-used, kind="stable")[:keep])
        self.clear()
        self.number = {names[i]: n for n, i in enumerate(kept.tolist())}
        self.groups = [groups[i] for i in kept.tolist()]
        self.used = used[kept]
        links = sizes[kept, 3]
        place = np.repeat(begin[kept] - np.cumsum(links) + links, links) + np.arange(int(links.sum()))
        self._add(sizes[kept], keys[place])

    def _add(self, sizes: np.ndarray, keys: np.ndarray) -> None:
        pairs, place = np.unique(keys, return_inverse=True)
        number = self.pair_number
        numbers = np.array([number.setdefault(p, len(number)) for p in pairs.tolist()], np.int32)
        self.sizes.frombytes(sizes.astype(np.int64).tobytes())
        self.pairs.frombytes(numbers[place].tobytes())
        self.begin.frombytes((self.begin[-1] + np.cumsum(sizes[:, 3])).astype(np.int64).tobytes())

    def learn(self, parts: list[str]) -> None:
        known = self.tokenizers
        expected = [b" " + p.encode("utf-8", "surrogatepass") for p in parts]
        a, b = known.encode_a(parts), known.encode_b(parts)
        same = a.faithful(known.a_bytes, known.a_size, expected) & b.faithful(known.b_bytes, known.b_size, expected)
        a, b = a.only(same), b.only(same)
        sizes = np.where(same, np.fromiter(map(len, expected), np.int64, len(expected)), 0)
        left, right, n_groups, n_links, groups = align(a, b, sizes)
        first = len(self.groups)
        self.number.update(zip(parts, range(first, first + len(parts)), strict=True))
        given = iter(groups)
        self.groups += [next(given) if ok else "" for ok in same.tolist()]
        self._add(np.stack([a.counts, b.counts, n_groups, n_links, same], axis=1), left << 32 | right)

    def numbers(self, parts: list[str]) -> np.ndarray:
        fresh = [p for p in dict.fromkeys(parts) if p not in self.number]
        for begin in range(0, len(fresh), _LEARN):
            self.learn(fresh[begin : begin + _LEARN])
        numbers = np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts))
        self.used = np.concatenate([self.used, np.zeros(len(self.groups) - len(self.used), np.int64)])
        self.used += np.bincount(numbers, minlength=len(self.used))
        return numbers

    def joined_bytes_agree(self, text: str) -> bool:
        """Whether the bytes of the whole text agree although those of a segment do not."""
        expected = b" " + text.encode("utf-8", "surrogatepass")
        for encode, decoded in (
            (self.tokenizers.encode_a, self.tokenizers.a_bytes),
            (self.tokenizers.encode_b, self.tokenizers.b_bytes),
        ):
            if b"".join(decoded[t] for t in encode(segments(text)).ids.tolist()) != expected:
                return False
        return True


def aligned_texts(table: SegmentTable, texts: list[str | None]) -> Iterator[tuple[list[int], str, np.ndarray, np.ndarray]]:
    """Per text: A tokens, B tokens, groups and links; the groups' digest; numbers and times of its pairs."""
    parts = [segments(t) if t else [] for t in texts]
    flat = table.numbers([p for one in parts for p in one])
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    sizes = np.frombuffer(table.sizes, np.int64).reshape(-1, 5)
    bad = {i for i in range(len(texts)) if not sizes[flat[at[i] : at[i + 1]], 4].all()}
    del sizes  # the table cannot grow while it is looked at
    if bad:
        whole = {i: [texts[i]] for i in bad if table.joined_bytes_agree(texts[i])}
        parts = [whole.get(i, []) if i in bad else p for i, p in enumerate(parts)]
        flat = table.numbers([p for one in parts for p in one])
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    sizes = np.frombuffer(table.sizes, np.int64).reshape(-1, 5)
    begin = np.frombuffer(table.begin, np.int64)
    pairs = np.frombuffer(table.pairs, np.int32) if len(table.pairs) else np.zeros(0, np.int32)
    totals = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(sizes[flat, :4], axis=0)])
    totals = totals[at[1:]] - totals[at[:-1]]
    links = sizes[flat, 3]
    place = np.repeat(begin[flat] - np.cumsum(links) + links, links) + np.arange(int(links.sum()))
    owner = np.repeat(np.repeat(np.arange(len(texts)), np.diff(at)), links)
    width = np.int64(len(table.pair_number) + 1)
    keys, times = np.unique(owner * width + pairs[place], return_counts=True)
    cuts = np.searchsorted(keys, np.arange(len(texts) + 1) * width)
    for i, numbers in enumerate(parts):
        digest = ""
        if numbers:
            text = ";".join([table.groups[n] for n in flat[at[i] : at[i + 1]].tolist()])
            digest = hashlib.sha256(text.encode()).hexdigest()
        own = slice(cuts[i], cuts[i + 1])
        yield totals[i].tolist(), digest, keys[own] - i * width, times[own]


_CHUNKS = pa.schema(
    [
        ("chunk", pa.int64()),
        ("doc_id", pa.int64()),
        ("sizes", pa.list_(pa.int64())),
        ("groups_sha256", pa.string()),
        ("places", pa.list_(pa.int32())),
        ("times", pa.list_(pa.int32())),
        ("begin", pa.int32()),
        ("pairs", pa.list_(pa.int64())),
        ("docs", pa.list_(pa.int32())),
    ]
)
_CHUNKS_DDL = (
    "chunk long, doc_id long, sizes array<long>, groups_sha256 string, places array<int>, times array<int>, "
    "begin int, pairs array<long>, docs array<int>"
)


def _chunk_rows(chunk: int, rows: list[tuple], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The documents of a chunk, then its distinct pairs with the documents that hold them.

    ``keys[number]`` is the pair of that number.
    """
    docs = np.zeros(len(keys), np.int32)
    for *_, numbers, _ in rows:
        docs[numbers] += 1  # the numbers of one document are distinct
    held = np.flatnonzero(docs)
    held = held[np.argsort(keys[held], kind="stable")]
    place = np.zeros(len(keys), np.int32)
    place[held] = np.arange(len(held))
    for begin in range(0, len(rows), 4096):
        part = rows[begin : begin + 4096]
        ids, sizes, digests, numbers, times = zip(*part, strict=True)
        columns = {
            "chunk": [chunk] * len(part),
            "doc_id": ids,
            "sizes": sizes,
            "groups_sha256": digests,
            "places": [place[n] for n in numbers],
            "times": [t.astype(np.int32) for t in times],
        }
        yield _batch(columns, len(part))
    starts = range(0, len(held), _ROW)
    if held.size:
        columns = {
            "chunk": [chunk] * len(starts),
            "begin": list(starts),
            "pairs": [keys[held[s : s + _ROW]] for s in starts],
            "docs": [docs[held[s : s + _ROW]] for s in starts],
        }
        yield _batch(columns, len(starts))


def _batch(columns: dict, rows: int) -> pa.RecordBatch:
    arrays = [
        pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _CHUNKS
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=_CHUNKS)


@lru_cache(maxsize=2)
def _segment_table(a_path: str, b_path: str) -> SegmentTable:
    return SegmentTable(Tokenizers(a_path, b_path))


def aligned_chunks(docs: DataFrame, paths: Callable[[], tuple[str, str]], chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """Documents in chunks, and the distinct id pairs of each chunk, in one frame.

    ``paths`` names the files of both tokenizers inside a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _segment_table(*paths())
        chunk = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        held = 0

        def closed() -> Iterator[pa.RecordBatch]:
            keys = np.fromiter(table.pair_number, np.int64, len(table.pair_number))
            yield from _chunk_rows(chunk, rows, keys)

        for batch in slices(batches, "text", 1 << 20):
            texts = batch.column("text").to_pylist()
            for doc, found in zip(batch.column("doc_id").to_pylist(), aligned_texts(table, texts), strict=True):
                rows.append((doc, *found))
                held += len(found[2])
            if held >= chunk_links or len(table.number) >= MEMORY:
                yield from closed()
                chunk, rows, held = chunk + 1, [], 0
                if len(table.number) >= MEMORY:
                    table.forget(MEMORY // 3)
        yield from closed()

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, _CHUNKS_DDL)


def _document_sums(documents: pa.Table, counts: pa.Table) -> pa.Table:
    """Count sums and best links of the documents of one chunk."""
    size = counts.num_rows
    value, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    at = counts.column("place").to_numpy()
    value[at] = counts.column("docs").to_numpy()
    best[at] = counts.column("best").to_numpy()
    documents = documents.combine_chunks()
    lists = documents.column("places").combine_chunks()
    places = lists.flatten().to_numpy(zero_copy_only=False)
    times = documents.column("times").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    at = np.concatenate([[0], ends]).astype(np.int64)
    sums = [np.concatenate([[0], np.cumsum(x[places] * times)]) for x in (best, value)]
    sizes = documents.column("sizes").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
    columns = [
        documents.column("doc_id"),
        *[pa.array(sizes[:, i]) for i in range(4)],
        *[pa.array(s[at[1:]] - s[at[:-1]]) for s in sums],
        documents.column("groups_sha256"),
    ]
    return pa.table(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def pair_counts(chunks: DataFrame) -> DataFrame:
    """``pair, docs, best``: documents that hold a linked id pair, and whether no pair of its A id has more.

    ``pair`` holds the A id in its upper and the B id in its lower 32 bits.
    """
    held = chunks.where("pairs IS NOT NULL").select(F.inline(F.arrays_zip("pairs", "docs")))
    counts = stored(held.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("docs")), "pair_counts")
    a_id = F.shiftright("pair", 32)
    # one row per id of vocabulary A
    most = counts.groupBy(a_id.alias("a_id")).agg(F.max("docs").alias("most"))
    joined = counts.join(F.broadcast(most), a_id == most["a_id"])
    return joined.select("pair", "docs", (F.col("docs") == F.col("most")).cast("int").alias("best"))


def align_documents(
    docs: DataFrame, paths: Callable[[], tuple[str, str]], chunk_links: int = CHUNK_LINKS
) -> DataFrame:
    """Alignment of both tokenizers for every row of ``docs(doc_id, text)``.

    Returns ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256``. Null and empty texts, and texts that one of the tokenizers
    does not give back byte by byte, have no tokens: zeros and an empty digest.
    Each row counts on its own, also where doc_id or text is repeated or doc_id
    is null. An empty table gives an empty result; other columns are ignored.
    """
    chunks = stored(aligned_chunks(docs, paths, chunk_links), "aligned")
    looked_up = (
        chunks.where("pairs IS NOT NULL")
        .select("chunk", "begin", F.posexplode("pairs").alias("next", "pair"))
        .select("chunk", (F.col("begin") + F.col("next")).alias("place"), "pair")
        .join(pair_counts(chunks), "pair")
        .select(F.col("chunk").alias("of_chunk"), "place", "docs", "best")
    )
    documents = chunks.where("sizes IS NOT NULL").select("chunk", "doc_id", "sizes", "groups_sha256", "places", "times")
    both = documents.groupBy("chunk").cogroup(looked_up.groupBy("of_chunk"))
    return both.applyInArrow(
        _document_sums,
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string",
    )
