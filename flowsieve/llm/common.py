"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: What a row without an id sorts as: below every id.
NO_ID = -(1 << 63)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and bytes of text, to size partitions from the data itself: one narrow aggregation."""
    row = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    return row["n"], row["b"] or 0


def pieces(amount: int, each: int) -> int:
    """How many pieces of at most about `each` hold `amount`; at least one, no upper limit."""
    return max(1, -(-amount // each))


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def decoded(data: bytes | None) -> str:
    """Null is an empty text; bytes that are not UTF-8 become U+FFFD."""
    return data.decode("utf-8", "replace") if data else ""


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it (names match in any letter case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def trimmed(run: Callable) -> Callable:
    """`run` for mapInArrow, after which the worker gives freed memory back to the system.

    Workers are reused by later stages; without this each keeps the most that any stage has needed.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    """Freed memory of this worker goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def by_bytes(batch: pa.RecordBatch, column: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of `batch` with about `size` bytes in the column, so that what is made from them stays small."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, length in enumerate(lengths.tolist()):
        if held and held + length > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += length
    if start < batch.num_rows:
        yield batch.slice(start)
