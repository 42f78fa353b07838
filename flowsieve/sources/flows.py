"""Reading and writing flow tables."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.records import quoted
from ..session import task_count

CORRUPT = "_corrupt_record"


def trim_headers(df: DataFrame) -> DataFrame:
    """Drop blanks around column names, which flow CSVs often carry."""
    return df.toDF(*[c.strip() for c in df.columns])


def read_flows(
    spark: SparkSession,
    paths: str | Sequence[str],
    format: str = "csv",
    types: Mapping[str, str] | None = None,
    corrupt: bool = False,
) -> DataFrame:
    """Flow table from one or more files or folders.

    Files of one layout are read together, and layouts are aligned by name,
    with nulls where a layout lacks a column. The layout of a CSV file is its
    header, so a folder may hold files whose columns differ or stand in another
    order. A line with too many or too few fields lacks values or is cut; with
    `corrupt` its text is in `_corrupt_record` (`malformed_lines` counts
    them). CSV columns arrive as
    text, and `types` names those to cast: no inference pass over the data, and
    a bad number is null.
    """
    sources = [paths] if isinstance(paths, str) else list(paths)
    if format == "csv":
        parts = [_csv_layout(spark, files, corrupt) for files in _layouts(spark, sources)]
    else:
        parts = [trim_headers(spark.read.format(format).load(p)) for p in sources]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    for name, kind in (types or {}).items():
        if name in df.columns:
            df = df.withColumn(name, F.trim(quoted(name).cast("string")).try_cast(kind))
    return df


_HEAD_BYTES = 1 << 14


def header_lines(spark: SparkSession, sources: Sequence[str]) -> DataFrame:
    """(file, header): the first line of every text file that has one.

    The names are dealt to tasks, which open each file and read up to its first line end. Stores that Arrow has no file
    system for are read by Spark, which passes over whole files for it.
    """
    files = spark.read.text(list(sources)).inputFiles()
    try:
        for store in {f.partition("://")[0] for f in files}:
            pafs.FileSystem.from_uri(next(f for f in files if f.startswith(store)))
    except (OSError, ValueError, NotImplementedError):
        return _lines_of_blocks(spark, sources)
    head = _HEAD_BYTES

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            names, lines = [], []
            for name in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(name)
                with store.open_input_stream(path, compression="detect") as stream:
                    text = b""
                    while b"\n" not in text and b"\r" not in text and (more := stream.read(head)):
                        text += more
                if text:
                    names.append(name)
                    lines.append(re.split(rb"\r\n|\n|\r", text, maxsplit=1)[0].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(lines, pa.string())], names=["file", "header"])

    named = spark.createDataFrame([(f,) for f in files], "file string")
    return named.repartition(min(max(1, len(files)), task_count(spark)), "file").mapInArrow(read, "file string, header string")


def _lines_of_blocks(spark: SparkSession, sources: Sequence[str]) -> DataFrame:
    lines = spark.read.text(list(sources)).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
    )
    first = F.min_by("value", "line")  # the lines of a block are numbered in their order
    return lines.where("start = 0").groupBy("file").agg(first.alias("header"))


def _layouts(spark: SparkSession, sources: Sequence[str]) -> list[list[str]]:
    """CSV files grouped by the text of their header; to the driver go the names of the files, which it lists anyway."""
    found: dict[str, list[str]] = {}

    def place(row) -> tuple:
        return next((i for i, s in enumerate(sources) if s.rstrip("/") in row["file"]), len(sources)), row["file"]

    for row in sorted(header_lines(spark, sources).collect(), key=place):
        # Spark names files as URIs, and takes them as plain paths.
        found.setdefault(row["header"].lstrip("\ufeff"), []).append(unquote(row["file"]))
    return list(found.values())


def _csv_layout(spark: SparkSession, files: list[str], corrupt: bool) -> DataFrame:
    reader = spark.read.option("header", True).option("enforceSchema", False)
    names = spark.read.option("header", True).csv(files[0]).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, *[CORRUPT] * corrupt]])
    return trim_headers(reader.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).csv(sorted(files)))


def malformed_lines(flows: DataFrame) -> int:
    """How many CSV lines did not have the number of fields of their header."""
    if CORRUPT not in flows.columns:
        return 0
    others = [F.max(quoted(c)) for c in flows.columns if c != CORRUPT]  # Spark parses a line only for its fields
    return flows.agg(F.count_if(F.col(CORRUPT).isNotNull()), *others).first()[0]


def stream_flows(spark: SparkSession, path: str, schema, format: str = "parquet", **options) -> DataFrame:
    """The same table as an unbounded stream of files (or of Kafka, with its package)."""
    reader = spark.readStream.format(format).schema(schema)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(path)


def head_rows(df: DataFrame, n: int, order: str | Sequence[str] = "seq") -> DataFrame:
    """The first `n` rows in arrival order: a top-n per task, then one merge."""
    keys = [order] if isinstance(order, str) else list(order)
    return df.orderBy(*keys).limit(n)


def write_result(df: DataFrame, path: str) -> None:
    """One CSV file for a result table (a handful of rows, never raw data)."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
