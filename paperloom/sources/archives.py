"""Reader of stored tar archives: one pass, one row per member, never the bytes."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

_FIELDS = {
    "place": ("long", pa.int64()),
    "path": ("string", pa.string()),
    "size": ("long", pa.int64()),
    "text": ("string", pa.string()),
    "error": ("string", pa.string()),
}


def read_members(archives: DataFrame) -> DataFrame:
    """(id, place, path, size, text, error) of (id, content) archives of any tar compression.

    Text is read for TeX files only; bytes that are no UTF-8 are left out. An
    archive is read to its end, so that checksums are tested; whatever fails
    ends its rows with one that has an ``error``.
    """
    schema = T.StructType([archives.schema["id"]])
    for name, (kind, _) in _FIELDS.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in range(batch.num_rows):
                one = batch.slice(place, 1)
                rows = list(_members(one.column("content")[0].as_py() or b""))
                columns = [pa.array([r.get(name) for r in rows], kind) for name, (_, kind) in _FIELDS.items()]
                ids = one.column("id").take(pa.array([0] * len(rows), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *columns], ["id", *_FIELDS])

    return archives.select("id", "content").mapInArrow(run, schema)


def _members(content: bytes) -> Iterator[dict]:
    try:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
            for place, member in enumerate(tar):
                row = {"place": place, "path": member.name, "size": member.size if member.isfile() else None}
                if member.isfile() and member.name.lower().endswith(".tex"):
                    row["text"] = tar.extractfile(member).read().decode("utf-8", errors="ignore")
                yield row
            while tar.fileobj.read(1 << 20):
                pass
    except Exception as failure:  # damaged archives fail in many ways: each is a reject
        yield {"error": type(failure).__name__}
