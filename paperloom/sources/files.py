"""JSON Lines, seed files, TeX / PDF / archive files, Markdown output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import file_stem
from ..operators.artifacts import archive_id

# Columns of read_json_lines that put lines into the order of their files.
LINE_ORDER = ["file", "block", "row"]


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, row): one row per line; the last three give file order.

    Files are read in splits. Inside a split ``row`` grows with the line, and
    ``block`` is the offset of the split in its file.
    """
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """(value, file) of taxonomy files, each one JSON list of labels with questions."""
    return spark.read.text(path, wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("file")
    )


def list_artifacts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(id, path, size) of files like ``*.tex``; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(file_stem(F.col("path")).alias("id"), "path", F.col("length").alias("size"))


def read_archives(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(id, content) of stored archives, the id taken from the file name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(archive_id(F.col("path")).alias("id"), "content")


def read_texts(spark: SparkSession, path: str, pattern: str = "*.tex") -> DataFrame:
    """(id, text) of text files; bytes that are no UTF-8 are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(file_stem(F.col("path")).alias("id"), utf8(F.col("content")).alias("text"))


def collect_texts(
    spark: SparkSession, path: str, pattern: str, table: str, checkpoint: str, max_bytes: int = 64 << 30
) -> None:
    """Add the text files of a folder that were not seen before to the Parquet folder ``table``.

    The checkpoint keeps which files were seen, so a later run lists the folder
    and reads the new ones only, about ``max_bytes`` of them at a time. Readers
    of a batch get files by their sizes. A batch that is repeated replaces itself.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = (
        spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern)
        .option("maxBytesPerTrigger", str(max_bytes)).option("maxFileAge", "36500d").load(path)
    )
    rows = found.select(
        file_stem(F.col("path")).alias("id"), "path", F.col("length").alias("size"), utf8(F.col("content")).alias("text")
    )

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    empty = spark.createDataFrame([], rows.schema)
    empty.write.mode("overwrite").parquet(f"{table}/batch=-1")
    rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_collected(spark: SparkSession, table: str) -> DataFrame:
    """(id, path, size, text, batch) of all files that :func:`collect_texts` has added."""
    return spark.read.schema("id string, path string, size long, text string, batch long").parquet(table)


def utf8(content: Column) -> Column:
    raw = content.cast("string")
    # genuine replacement characters step aside while bad bytes become and leave as such
    aside, mark = F.lit("\ufdd0"), F.lit("\ufffd")
    valid = F.make_valid_utf8(F.replace(raw, mark, aside))
    repaired = F.replace(F.replace(valid, mark, F.lit("")), aside, mark)
    return F.when(F.is_valid_utf8(raw), raw).otherwise(repaired)


def write_markdown(markdown: DataFrame, path: str, run_id: int) -> None:
    """Store (id, md, source); a run that is repeated replaces its own rows."""
    markdown.select("id", "md", "source").write.mode("overwrite").parquet(f"{path}/run={run_id}")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, md string, source string, run long").parquet(path)
