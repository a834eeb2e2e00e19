"""A keyed table as a log of changed rows in Parquet folders.

Every run writes the rows it changes into a folder of its own; the newest row of
a key is its current one. Repeating a run replaces that folder only, so a job
that died half way is simply run again with the same number. Compaction writes
the current rows as a base with unique keys and then publishes it in a manifest:
readers take the newest base and the runs after it, so the base is never
shuffled by a window and old changes are not read again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.shared import first_per_key
from ..session import remove_folder


@dataclass(frozen=True)
class ChangeLog:
    """``insert_only`` tables never change a stored row.

    Reading them needs no window and no shuffle of their rows: only the removed
    keys are folded, and the rows are anti-joined with them.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: list[str]
    insert_only: bool = False

    def create(self) -> None:
        """Make the empty table; an existing one is left alone."""
        self._write(self.spark.createDataFrame([], self._nullable()), -1, deleted=0)
        self._publish(-1)

    def append(self, rows: DataFrame, run_id: int) -> None:
        """Store new and changed rows; columns that ``rows`` lacks become NULL."""
        check_run(run_id)
        columns = [
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in self.schema.fields
        ]
        self._write(rows.select(columns), run_id, deleted=0)

    def remove(self, keys: DataFrame, run_id: int) -> None:
        """Store the keys of removed rows. In an insert-only table they hide the rows of earlier runs."""
        check_run(run_id)
        self._write(keys.select(self.keys), run_id, deleted=1)

    def current(self, before: int | None = None, runs: Sequence[int] | None = None) -> DataFrame:
        """Rows as of now, or as the run with number ``before`` found them.

        ``runs`` names the runs that count, for logs whose owner keeps a record
        of finished runs.
        """
        columns = self.schema.fieldNames()
        since, base = self._base(before)
        log = self._log().filter(F.col("run") > since)
        if before is not None:
            log = log.filter(F.col("run") < before)
        if runs is not None:
            log = log.filter(F.col("run").isin(*[r for r in runs if r > since]))
        if self.insert_only:
            return without_removed(base.select(*columns, F.lit(since).cast("long").alias("run")), log, self.keys)
        return merged(base.select(columns), log, self.keys)

    def written(self, run_id: int) -> DataFrame:
        """The rows that one run stored."""
        return self._log().filter((F.col("run") == run_id) & (F.col("deleted") == 0)).select(
            self.schema.fieldNames()
        )

    def compact(self, run_id: int, runs: Sequence[int] | None = None) -> None:
        """Write the rows that run ``run_id`` finds as the base, then publish it.

        The base is sorted by the keys, so a reader that asks for some keys skips
        the row groups without them. The runs that the base holds stay until
        :meth:`clean`; nothing reads them any more.
        """
        check_run(run_id)
        rows = self.current(run_id, runs).repartitionByRange(*self.keys).sortWithinPartitions(*self.keys)
        rows.write.mode("overwrite").parquet(f"{self.path}/_bases/{run_id}")
        self._publish(run_id)

    def clean(self, runs: Sequence[int]) -> list[int]:
        """Remove what the newest base has replaced: those of ``runs`` that it holds, and older bases.

        Returns the numbers whose folders went. Readers that started before the
        newest base was published must have ended.
        """
        newest, _ = self._base(None)
        old = sorted(r for r in runs if 1 <= r < newest)
        for run in old:
            for folder in (f"run={run}", f"_bases/{run}", f"_manifests/{run}"):
                remove_folder(self.spark, f"{self.path}/{folder}")
        return old

    def _publish(self, run_id: int) -> None:
        row = self.spark.createDataFrame([(run_id,)], "base long").coalesce(1)
        row.write.mode("overwrite").parquet(f"{self.path}/_manifests/{run_id}")

    def _base(self, before: int | None) -> tuple[int, DataFrame]:
        """The newest base that a run may read, and the run that wrote it."""
        published = self.spark.read.schema("base long").option("recursiveFileLookup", True)
        bases = published.parquet(f"{self.path}/_manifests")
        if before is not None:
            bases = bases.filter(F.col("base") < before)
        newest = bases.agg(F.max("base")).first()[0]
        if newest is None or newest < 1:
            return -1, self.spark.createDataFrame([], self._nullable())
        return newest, self.spark.read.schema(self._nullable()).parquet(f"{self.path}/_bases/{newest}")

    def _nullable(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in self.schema.fields])

    def _log(self) -> DataFrame:
        schema = self._nullable().add("run", "long").add("deleted", "integer")
        return self.spark.read.schema(schema).parquet(self.path)

    def _write(self, rows: DataFrame, run_id: int, deleted: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/run={run_id}/deleted={deleted}")


def merged(base: DataFrame, log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a base with unique keys after the changes of a log (``run``, ``deleted``).

    The newest change of a key counts; of a change and a removal in one run the
    removal. Only changes are windowed; the base is anti-joined with their keys.
    """
    newest = first_per_key(log, keys, [F.desc("run"), F.desc("deleted")])
    untouched = base.join(newest.select(*keys), list(keys), "left_anti")
    return untouched.unionByName(newest.filter("deleted = 0").select(base.columns))


def without_removed(base: DataFrame, log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of an insert-only table (``base`` with the ``run`` that wrote it, then the log), without removed ones.

    A removal hides the rows of its key that were stored by its run or before;
    what a later run inserts counts again. Few removals are broadcast.
    """
    columns = [c for c in base.columns if c != "run"]
    rows = base.unionByName(log.filter("deleted = 0").select(*columns, "run"))
    removed = log.filter("deleted = 1").groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("run").alias("_removed"))
    gone = reduce(and_, [F.col(k) == F.col(f"_{k}") for k in keys]) & (F.col("_removed") >= F.col("run"))
    return rows.join(removed, gone, "left_anti").select(columns)


def check_run(run_id: int) -> None:
    if run_id < 1:
        raise ValueError("run numbers start at 1")
