"""Building blocks used by several operators: ids, first-N, ordered joins of text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import remove_folder, shared_folder

# Rows up to which an ordered limit is cut in each task and then in one.
SMALL = 1000
_TIE = "_tie"
# Rows per partial list when a long ordered list is put together.
RUN_LENGTH = 1024
_HASH_DIGITS = 3  # 16 ** 3 = 4096 id buckets


def first_n(df: DataFrame, order: Sequence[str], n: int | None, unlimited: bool = True) -> DataFrame:
    """First ``n`` rows by the order ``order`` (names, ``-name`` for descending), in that order.

    ``None`` or a number below 1 means no limit, or no rows if ``unlimited`` is
    off. Up to ``SMALL`` rows every task keeps its own first ones. For more, the
    order columns alone are dealt out by range and the one row is looked up behind
    which the limit falls; the result is the rows up to it, found by a filter and
    never brought to one task. Which of several rows that agree in all order
    columns is taken is open.
    """
    if n is None or n <= 0:
        return df if unlimited else df.limit(0)
    names = [o.removeprefix("-") for o in order]
    keys = [F.desc(name) if o.startswith("-") else F.asc(name) for o, name in zip(order, names, strict=True)]
    if n <= SMALL:
        return df.orderBy(*keys).limit(n)
    cut = _last_key(df, names, keys, n)
    if cut is None:
        return df.orderBy(*keys)
    last, taken, tied = cut
    before, same = _before(order, names, last), _same(names, last)
    if taken == tied:
        return df.filter(before | same).orderBy(*keys)
    if set(df.columns) == set(names):  # the tied rows are all alike
        again = F.when(same, F.sequence(F.lit(1), F.lit(taken))).otherwise(F.array(F.lit(1)))
        first = first_per_key(df.filter(same), names, [F.lit(1)])
        rows = df.filter(before).unionByName(first)
        return rows.select(*df.columns, F.explode(again).alias("_again")).drop("_again").orderBy(*keys)
    if _TIE in df.columns:
        some = df.filter(same).limit(taken)
    else:
        plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        marked = df.filter(same).withColumn(_TIE, F.xxhash64(*plain))
        some = first_n(marked, [_TIE], taken).drop(_TIE)
    return df.filter(before).unionByName(some).orderBy(*keys)


def _last_key(
    df: DataFrame, names: list[str], keys: list[Column], n: int
) -> tuple[dict[str, Column], int, int] | None:
    """The order columns of the n-th row, how many rows with them are among the first n, and how many there are.

    The order columns are written once, in ranges. The driver gets one count per
    range; only the range that holds the n-th row is looked into, and there rows
    that agree are counted before anything is numbered. None: there are not more
    than ``n`` rows.
    """
    spark = df.sparkSession
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = shared_folder(spark, "order")
    dealt = df.select(*names).repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id())
    dealt.write.parquet(folder)
    written = spark.read.schema(dealt.schema).parquet(folder)
    before, last = 0, None
    for part, rows in sorted(map(tuple, written.groupBy("_range").count().collect())):  # one row per range
        if before + rows >= n:
            last = part
            break
        before += rows
    cut = None
    if last is not None:
        border = written.filter(F.col("_range") == last).groupBy("_range", *names).agg(F.count(F.lit(1)).alias("_tied"))
        upto = F.sum("_tied").over(Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
        reached = border.withColumn("_upto", upto).filter(F.col("_upto") >= n - before).orderBy("_upto")
        found = reached.select(*[F.col(name).cast("string").alias(name) for name in names], "_upto", "_tied").first()
        values = {name: F.lit(found[name]).cast(df.schema[name].dataType) for name in names}
        cut = values, n - before - (found["_upto"] - found["_tied"]), found["_tied"]
    remove_folder(spark, folder)
    return cut


def _same(names: Sequence[str], last: dict[str, Column]) -> Column:
    return reduce(and_, [F.col(name).eqNullSafe(last[name]) for name in names])


def _before(order: Sequence[str], names: Sequence[str], last: dict[str, Column]) -> Column:
    """Rows in front of ``last``; a missing value comes first, and last in a descending order."""
    found = F.lit(False)
    for o, name in reversed(list(zip(order, names, strict=True))):
        value, column = last[name], F.col(name)
        if o.startswith("-"):
            ahead = (column > value) | (column.isNotNull() & value.isNull())
        else:
            ahead = (column < value) | (column.isNull() & value.isNotNull())
        found = F.coalesce(ahead, F.lit(False)) | (column.eqNullSafe(value) & found)
    return found


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters and projections do not compute again.

    A plain projection is merged into what follows (a filter on it is pushed
    below and repeats the expression); rows made by a generator are not.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def only_for(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of a table whose key occurs in ``keys``.

    Copies of a key are folded before they are shuffled; the join then needs no
    shuffle of its own for them. Also of use in front of an outer join, which
    cannot broadcast a small left side and would shuffle the whole table: this
    semi join can. When ``keys`` is large, too, both joins share one shuffle.
    """
    return table.join(keys.select(*on).distinct(), list(on), "left_semi")


def dense_ids(df: DataFrame, key: str, start: Column, id_column: str = "id") -> DataFrame:
    """Number rows with distinct ``key`` values ``start + 1, start + 2, ...``.

    The order is that of ``md5(key)``: even buckets by its first digits are
    numbered side by side and shifted by the size of the buckets before them,
    so no task sees more than its share. ``key`` must be a string column.
    """
    digest = F.md5(F.col(key))
    hashed = df.withColumn("_digest", digest).withColumn(
        "_bucket", F.substring(digest, 1, _HASH_DIGITS)
    )
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (  # at most 4096 rows
        hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
        .select("_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_digest", key))
    numbered = hashed.withColumn("_rank", rank).join(F.broadcast(offsets), "_bucket")
    return numbered.withColumn(
        id_column, (start + F.col("_offset") + F.col("_rank")).cast("int")
    ).drop("_digest", "_bucket", "_rows", "_offset", "_rank")


def max_id(df: DataFrame, column: str = "id") -> Column:
    """Largest id of a table as a scalar subquery, 0 for an empty table."""
    return df.agg(F.coalesce(F.max(column), F.lit(0)).alias("max_id")).scalar()


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by ``order``.

    The ``== 1`` filter lets Spark keep one row per key and task before the
    shuffle, so copies of one key do not pile up in a task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def ordered_concat(
    df: DataFrame, keys: Sequence[str], order: str, text: Column, separator: str, output: str
) -> DataFrame:
    """Join the texts of a group in ``order``; NULL texts are left out, '' counts.

    Runs of the integer ``order`` are joined first, then the joined runs: a
    group with very many rows is sorted and joined by many tasks, and the last
    step only sees one string per run.
    """

    def joined(position: str, value: Column) -> Column:
        kept = F.sort_array(
            F.collect_list(F.when(value.isNotNull(), F.struct(F.col(position), value.alias("_t"))))
        )
        return F.when(
            F.size(kept) > 0, F.array_join(F.transform(kept, lambda row: row["_t"]), separator)
        )

    runs = (
        df.withColumn("_run", F.floor(F.col(order) / RUN_LENGTH))
        .groupBy(*keys, "_run")
        .agg(joined(order, text).alias("_piece"))
    )
    return runs.groupBy(*keys).agg(joined("_run", F.col("_piece")).alias(output))
