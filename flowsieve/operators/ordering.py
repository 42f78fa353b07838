"""Global order without a single-task sort: dense index and split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..session import written

# monotonically_increasing_id() is (partition << 33) + row number in partition.
_ROW_BITS = 33


def in_order(df: DataFrame, order: Sequence[str], pieces: int | None = None) -> DataFrame:
    """Range partitioned and sorted: partition by partition, the global order.

    Without `pieces` adaptive execution merges neighbouring small ranges, which
    keeps the order and fits the number of tasks to the data.
    """
    ranged = df.repartitionByRange(pieces, *order) if pieces else df.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order)


def dense_index(
    df: DataFrame, order: Sequence[str], out: str = "idx", pieces: int | None = None
) -> tuple[DataFrame, int]:
    """Number all rows 0..n-1 in `order`; returns the frame and n.

    The rows are range partitioned and sorted, each gets its row number within
    its partition, and the partition offsets are added. Only one count per
    partition passes through the driver. The placed rows are written first:
    row numbers must not change between the counting and the reading pass.
    `order` should be unique per row, else ties are numbered arbitrarily.
    """
    spark = df.sparkSession
    placed = written(
        in_order(df, order, pieces)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_piece", F.shiftright("_at", _ROW_BITS).cast("int")),
        "ordered",
    )
    sizes = {r["_piece"]: r["n"] for r in placed.groupBy("_piece").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for piece in sorted(sizes):
        offsets.append((piece, total - (piece << _ROW_BITS)))
        total += sizes[piece]
    shift = spark.createDataFrame(offsets or [(0, 0)], "_piece int, _shift bigint")
    indexed = (
        placed.join(F.broadcast(shift), "_piece")  # one row per partition
        .withColumn(out, F.col("_at") + F.col("_shift"))
        .drop("_piece", "_at", "_shift")
    )
    return indexed, total


def chronological_split(
    df: DataFrame, total: int, idx: str = "idx", train_tenths: int = 7, validation_tenths: int = 1
) -> DataFrame:
    """Mark rows train / validation / test by position in time."""
    train_end = total * train_tenths // 10
    validation_end = total * (train_tenths + validation_tenths) // 10
    split = (
        F.when(F.col(idx) < train_end, "train")
        .when(F.col(idx) < validation_end, "validation")
        .otherwise("test")
    )
    return df.withColumn("split", split)
