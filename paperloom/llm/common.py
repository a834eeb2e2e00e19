"""Shared helpers: scratch tables, Arrow batches and fingerprints of words.

Word fingerprints are computed for a whole batch of texts at once: a word is
read eight bytes at a time and mixed into 64 bits, runs of words are then
combined by doubling. Texts are cut on ASCII white space (``[\\x20\\x09-\\x0D]``).
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space, as a class inside a regular expression
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LONG_WORD = 1024


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share.

    ``spark.checkpoint.dir`` names the folder; only a local session without
    that setting falls back to a folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a scratch table and read it back: cuts the lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` (strings) holds about ``limit`` bytes each.

    A row is never cut, so one very long text makes a slice of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = [s or 0 for s in pc.binary_length(batch.column(column)).to_pylist()]
        begin, total = 0, 0
        for row, size in enumerate(sizes):
            if row > begin and total + size > limit:
                yield batch.slice(begin, row - begin)
                begin, total = row, 0
            total += size
        yield batch.slice(begin)


def numbered_slices(
    batches: Iterator[pa.RecordBatch], column: str, rows: int = 60_000
) -> Iterator[tuple[int, pa.RecordBatch]]:
    """``slices`` with numbers that are unique in a stage and the same when a task is repeated."""
    number = TaskContext.get().partitionId() << 32
    for batch in slices(batches, column):
        for begin in range(0, batch.num_rows, rows):
            yield number, batch.slice(begin, rows)
            number += 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values (a finaliser of two multiplications)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def word_hashes(
    texts: list[str | None], lower: bool = False, key: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the offset of each text's first word.

    ``lower`` folds A-Z only. The offsets have one entry more than the texts.
    With a random ``key`` nobody can write words beforehand whose hashes agree.
    """
    parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    if lower:
        parts = [p.lower() for p in parts]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    raw = np.frombuffer(b" " + b" ".join(parts) + b" " * 9, np.uint8)
    space = _IS_SPACE[raw]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    first = np.concatenate([[0], np.cumsum(lengths + 1)]) + 1
    offsets = np.searchsorted(starts, first)
    offsets[-1] = len(starts)
    sizes = ends - starts
    eight = np.lib.stride_tricks.sliding_window_view(raw, 8)
    hashes = mix((sizes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(key))
    live = np.flatnonzero(sizes <= _LONG_WORD)
    at = starts[live]
    left = sizes[live]
    while len(live):
        block = np.ascontiguousarray(eight[at]).view("<u8")[:, 0]
        short = left < 8
        keep = (np.uint64(1) << (np.where(short, left, 0) * 8).astype(np.uint64)) - np.uint64(1)
        block = np.where(short, block & keep, block)
        hashes[live] = mix((hashes[live] ^ block) * np.uint64(0x9FB21C651E98DF25))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(sizes > _LONG_WORD):
        digest = hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8, key=key.to_bytes(8) if key else b"").digest()
        hashes[i] = int.from_bytes(digest, "little")
    return hashes, offsets


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` consecutive words (empty if there are fewer)."""
    total = len(hashes) - length + 1
    if total <= 0:
        return np.zeros(0, np.uint64)
    result, done = None, 0
    power, step = hashes, 1
    rest = length
    while rest:
        if rest & 1:
            part = power[done : done + total]
            result = part if result is None else mix(result * np.uint64(0xC2B2AE3D27D4EB4F) + part)
            done += step
        rest >>= 1
        if rest:
            power = mix(power[:-step] * np.uint64(0x9E3779B185EBCA87) + power[step:])
            step *= 2
    return result
