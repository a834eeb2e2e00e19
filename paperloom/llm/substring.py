"""Substring deduplication with prefix-partitioned suffix trees.

A suffix is a word position, its path the words that follow. Only repeats of at
least ``window`` words count, so every subtree is cut at that depth: a node at
the cut with suffixes of several documents is a maximal repeat.

1. Prefixes. Every window is named after its smallest run of ``PREFIX`` words,
   so equal windows have equal names, and neighbouring windows share one.
   Suffixes start at these places; a prefix that only one document has can be
   dropped before any path is formed.
2. Groups. The windows of the remaining prefixes are dealt out by prefix to
   memory-sized groups. A prefix with more than ``GROUP_SUFFIXES`` suffixes is
   made longer, to the whole path. Each batch of texts sends a path once, with
   its smallest document, so a passage that is everywhere stays small.
3. Subtrees. A group sorts its paths; runs of equal paths are the nodes at the
   cut, and each batch learns which of its paths start in a smaller document.

Paths are compared by 128 bits made of all their words: a fixed 64-bit fingerprint
by which they are sorted, and a second one under a random key of the run, which
no text can have been written for. The trees are kept as sorted arrays: paths all
have the depth of the cut, so the nodes above it would decide nothing.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import mix, numbered_slices, run_hashes, slices, stored, word_hashes

#: words of a prefix; at most the window
PREFIX = 16
#: suffixes of one prefix beyond which it is made longer
GROUP_SUFFIXES = 10_000
#: paths that a group holds, on average
GROUP_PATHS = 200_000
_PLACE = np.uint64((1 << 24) - 1)


class _Suffixes:
    """All windows of a batch: row, first word, path fingerprint and prefix; with a ``key`` the second fingerprint."""

    def __init__(self, texts: list[str | None], window: int, key: int = 0) -> None:
        prefix = min(PREFIX, window)
        check = run_hashes(word_hashes(texts, key=key)[0], window) if key else None
        hashes, self.offsets = word_hashes(texts)
        path = run_hashes(hashes, window)
        row = np.repeat(np.arange(len(texts)), np.diff(self.offsets))
        inside = np.flatnonzero(row[: len(path)] == row[window - 1 :]) if len(path) else np.zeros(0, np.int64)
        runs = run_hashes(hashes, prefix)
        # value in the high bits, place in the low ones: a minimum is a leftmost argmin
        least = (mix(runs) & ~_PLACE) | (np.arange(len(runs), dtype=np.uint64) & _PLACE)
        span, width = window - prefix + 1, 1
        while width * 2 <= span and len(least) > width:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span and len(least) > span - width:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        place = least[inside] & _PLACE
        name = inside + ((place - inside.astype(np.uint64)) & _PLACE).astype(np.int64)
        self.row, self.first, self.path = row[inside], inside - self.offsets[row[inside]], path[inside]
        self.prefix, self.name = runs[name] if len(inside) else np.zeros(0, np.uint64), name
        self.check = self.path if check is None else check[inside]

    def only(self, keep: np.ndarray) -> None:
        self.row, self.first, self.path = self.row[keep], self.first[keep], self.path[keep]
        self.prefix, self.name, self.check = self.prefix[keep], self.name[keep], self.check[keep]


def prefixes(docs: DataFrame, window: int) -> DataFrame:
    """``prefix, doc_id``: the suffixes' prefixes, once per place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = _Suffixes(batch.column("text").to_pylist(), window)
            _, once = np.unique(found.name, return_index=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.prefix[once].view(np.int64)), batch.column("doc_id").take(pa.array(found.row[once]))],
                ["prefix", "doc_id"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "prefix long, doc_id long")


def _shared_suffixes(
    texts: list, window: int, key: int, shared: list[np.ndarray], long: list[np.ndarray]
) -> tuple[_Suffixes, np.ndarray]:
    """The suffixes with a shared prefix, and the prefix by which each is dealt out."""
    found = _Suffixes(texts, window, key)
    keep, extended = np.zeros(len(found.row), bool), np.zeros(len(found.row), bool)
    bounds = np.searchsorted(found.row, np.arange(len(texts) + 1))
    for i, (begin, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if end > begin and len(shared[i]):
            keep[begin:end] = np.isin(found.prefix[begin:end], shared[i])
            if len(long[i]):
                extended[begin:end] = np.isin(found.prefix[begin:end], long[i])
    dealt = np.where(extended, found.path, found.prefix)[keep]
    found.only(keep)
    return found, mix(dealt)


def _paths(found: _Suffixes, dealt: np.ndarray, ids: np.ndarray, groups: int) -> tuple[np.ndarray, ...]:
    """Distinct paths in order: group, both fingerprints, smallest document, and where each suffix went."""
    group = ((dealt >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
    order = np.lexsort((ids[found.row], found.check, found.path, group))
    path, check, group = found.path[order], found.check[order], group[order]
    new = np.ones(len(path), bool)
    new[1:] = (path[1:] != path[:-1]) | (check[1:] != check[:-1]) | (group[1:] != group[:-1])
    number = np.empty(len(path), np.int64)
    number[order] = np.cumsum(new) - 1
    return group[new].astype(np.int64), path[new], check[new], ids[found.row][order][new], number


def deep_nodes(path: np.ndarray, check: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Per path the smallest document of its node at the cut of the subtree."""
    order = np.lexsort((doc, check, path))
    path, check, doc = path[order], check[order], doc[order]
    new = np.ones(len(path), bool)
    new[1:] = (path[1:] != path[:-1]) | (check[1:] != check[:-1])
    least = np.empty(len(path), doc.dtype)
    least[order] = doc[new][np.cumsum(new) - 1]
    return least


_NUMBERED = "batch long, doc_id long, text string, shared array<long>, long array<long>"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for number, batch in numbered_slices(batches, "text"):
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(batch.num_rows, number)), *batch.columns], ["batch", *batch.schema.names]
        )


def _summary(words: list[bytes], removed: np.ndarray | None) -> tuple[int, int, str, str]:
    if removed is not None:
        kept = [w for w, gone in zip(words, removed.tolist(), strict=True) if not gone]
    else:
        kept = words
    text = b" ".join(kept)
    return len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "surrogatepass")


_COLUMNS = ["doc_id", "n_words", "n_removed", "kept_sha256"]
_DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_RESULT = _DIGEST + ", kept_text string"


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _whole(docs: DataFrame, with_text: bool) -> DataFrame:
    """The result for documents from which nothing is removed."""
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())[: 3 + with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [_summary(_split(t), None) for t in batch.column("text").to_pylist()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns], [*_COLUMNS, "kept_text"][: 4 + with_text]
            )

    return docs.select("doc_id", "text").mapInArrow(run, _RESULT if with_text else _DIGEST)


def remove_repeats(docs: DataFrame, window: int = 50, with_text: bool = False) -> DataFrame:
    """Remove words of windows that also start in a document with a smaller doc_id.

    Returns ``doc_id, n_words, n_removed, kept_sha256`` and, ``with_text``, the
    kept words joined by one space as ``kept_text``. Null texts have no words. A null doc_id is neither
    smaller nor greater than others: such rows stay whole and count nowhere.
    Rows that share a doc_id are parts of one document: none is smaller than the
    other. An empty table gives an empty result; other columns are ignored.
    """
    candidates, spans = _repeated(docs, window, with_text)
    affected = candidates.select("doc_id").distinct()
    rest = _whole(docs, with_text).join(affected, "doc_id", "left_anti")
    return rest.union(spans)


def _repeated(docs: DataFrame, window: int, with_text: bool) -> tuple[DataFrame, DataFrame]:
    """Documents with a shared prefix, and their results."""
    rows = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    named = stored(prefixes(rows, window), "prefixes")
    shared = (
        named.groupBy("prefix")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("suffixes"))
        .where("least < most")
        .select("prefix", F.when(F.col("suffixes") > GROUP_SUFFIXES, F.col("prefix")).alias("long"))
    )
    of_doc = stored(
        named.distinct()
        .join(shared, "prefix")
        .groupBy("doc_id")
        .agg(F.collect_list("prefix").alias("shared"), F.collect_list("long").alias("long")),
        "shared",
    )
    candidates = stored(rows.join(of_doc, "doc_id"), "candidates")
    total = of_doc.agg(F.sum(F.size("shared"))).first()[0] or 0
    # neighbouring windows share a prefix: about half the words between two prefixes
    groups = max(1, round(total * (window - PREFIX + 2) / 2 / GROUP_PATHS))
    texts = candidates.select("doc_id", "text", "shared", "long")
    key = secrets.randbits(64) | 1

    names = [*_COLUMNS, "kept_text"][: 4 + with_text]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("group", pa.int64()), ("batch", pa.int64()), ("path", pa.binary()), ("check", pa.binary()), ("least", pa.binary())]
        )
        for number, batch in numbered_slices(batches, "text"):
            ids = np.array(batch.column("doc_id").to_pylist(), np.int64)
            found, dealt = _shared_suffixes(batch.column("text").to_pylist(), window, key, *_lists(batch))
            group, path, check, least, _ = _paths(found, dealt, ids, groups)
            sent, begins = np.unique(group, return_index=True)
            ends = np.append(begins[1:], len(group))
            rows = [
                {
                    "group": g, "batch": number, "path": path[b:e].tobytes(), "check": check[b:e].tobytes(),
                    "least": least[b:e].tobytes(),
                }
                for g, b, e in zip(sent.tolist(), begins.tolist(), ends.tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def subtree(frame: pd.DataFrame) -> pd.DataFrame:
        paths = [np.frombuffer(v, np.uint64) for v in frame["path"]]
        check = np.concatenate([np.frombuffer(v, np.uint64) for v in frame["check"]])
        doc = np.concatenate([np.frombuffer(v, np.int64) for v in frame["least"]])
        earlier = np.split(deep_nodes(np.concatenate(paths), check, doc) < doc, np.cumsum([len(p) for p in paths])[:-1])
        return pd.DataFrame(
            {
                "batch": frame["batch"],
                "group": frame["group"],
                "size": [len(e) for e in earlier],
                "earlier": [np.packbits(e).tobytes() for e in earlier],
            }
        )

    def finish(texts: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if texts.empty:
            return pd.DataFrame(columns=names)
        texts = texts.reset_index(drop=True)
        ids = texts["doc_id"].to_numpy(np.int64)
        lists = [[np.asarray(v, np.int64).view(np.uint64) for v in texts[c]] for c in ("shared", "long")]
        found, dealt = _shared_suffixes(texts["text"].tolist(), window, key, *lists)
        *_, least, number = _paths(found, dealt, ids, groups)
        replies = replies.sort_values("group")
        flags = [
            np.unpackbits(np.frombuffer(v, np.uint8), count=n).astype(bool)
            for v, n in zip(replies["earlier"], replies["size"], strict=True)
        ]
        earlier = np.concatenate([np.zeros(0, bool), *flags])
        gone = earlier[number] | (ids[found.row] > least[number])
        order = np.argsort(found.row[gone], kind="stable")
        row, first = found.row[gone][order], found.first[gone][order]
        bounds = np.searchsorted(row, np.arange(len(texts) + 1))
        result = []
        for i, text in enumerate(texts["text"]):
            words = _split(text)
            starts = first[bounds[i] : bounds[i + 1]]
            edge = np.zeros(len(words) + window + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + window, -1)
            result.append((ids[i], *_summary(words, np.cumsum(edge)[: len(words)] > 0)))
        return pd.DataFrame(result, columns=[*_COLUMNS, "kept_text"])[names]

    replies = (
        texts.mapInArrow(send, "group long, batch long, path binary, check binary, least binary")
        .groupBy("group")
        .applyInPandas(subtree, "batch long, group long, size long, earlier binary")
    )
    done = texts.mapInArrow(_numbered, _NUMBERED).groupBy("batch").cogroup(replies.groupBy("batch")).applyInPandas(
        finish, _RESULT if with_text else _DIGEST
    )
    return candidates, done


def _lists(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The shared and the long prefixes of each row of a batch."""
    result = []
    for name in ("shared", "long"):
        sizes = pc.list_value_length(batch.column(name)).to_numpy(zero_copy_only=False)
        values = batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        result.append(np.split(values, np.cumsum(sizes)[:-1]))
    return result[0], result[1]
