"""Routing records to workers, and dedupe that runs per worker."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.records import SCOPE, hex_digits, md5_slot
from ..session import written
from .dedupe import first_seen, register_dedupe
from .report import percent, verdict_stats
from .windowed import dedupe_scoped_rotating


def worker_column(workers: int, strategy: str = "tenant", salt: int = 42, seq: str = "seq") -> Column:
    """Worker number by tenant, by fingerprint, or at random but repeatably."""
    if workers == 1:
        return F.lit(0)
    if strategy == "tenant":
        key = F.col("tenant")
    elif strategy == "hash":
        key = hex_digits(F.col("fp"))
    elif strategy == "random":
        key = F.concat_ws(":", F.lit(salt).cast("string"), F.col(seq).cast("string"))
    else:
        raise ValueError(f"unknown routing strategy: {strategy}")
    return md5_slot(key, workers)


def route(df: DataFrame, workers: int, strategy: str = "tenant", **options) -> DataFrame:
    return df.withColumn("worker_id", worker_column(workers, strategy, **options))


def dedupe_partitioned(
    df: DataFrame, workers: int = 4, window: int = 100_000, scope: Sequence[str] = SCOPE, seq: str = "seq"
) -> DataFrame:
    """Rotating-window dedupe on independent workers, routed by tenant.

    A scope never spans two workers, so the verdicts are those of one worker.
    """
    return dedupe_scoped_rotating(route(df, workers, "tenant", seq=seq), window, scope=scope, seq=seq)


def partition_rollup(routed: DataFrame, verdicts: DataFrame, seq: str = "seq") -> DataFrame:
    """Dedupe counters per worker, and their total as worker -1, with the records of the busiest worker.

    The total adds up the workers' rows, one a worker.
    """
    per_worker = written(verdict_stats(routed, verdicts, ["worker_id"], seq).drop("dedupe_rate_pct"), "workers")
    counters = ["total_records", "duplicates", "false_positives", "evaluations"]
    total = per_worker.agg(
        F.lit(-1).alias("worker_id"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in counters],
        F.coalesce(F.max("total_records"), F.lit(0)).alias("largest_worker"),
    )
    rows = per_worker.withColumn("largest_worker", F.col("total_records")).unionByName(total)
    return rows.withColumn("dedupe_rate_pct", percent(F.col("duplicates"), F.col("total_records")))


def dedupe_two_level(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Worker-local check, then a global exact check of everything forwarded.

    Both hits and misses are forwarded, so the global check alone decides;
    `local_repeat` tells what the worker had seen before. The global minimum is
    taken over the workers' minima. A row without an arrival number is new at
    both levels; rows that share one are new together, if any of them is.
    """
    local = df.where(F.col(seq).isNotNull()).groupBy("worker_id", "fp").agg(F.min(seq).alias(seq))
    overall = first_seen(local, ["fp"], seq)
    both = local.select(seq, F.lit(True).alias("_again")).unionByName(overall.select(seq, F.lit(False).alias("_again")))
    marks = both.groupBy(seq).agg(F.min("_again").alias("_again"))
    return (
        df.join(marks.hint("merge"), seq, "left")
        .withColumn("local_repeat", F.col("_again").isNull() & F.col(seq).isNotNull())
        .withColumn("is_dup", F.coalesce("_again", F.col(seq).isNotNull()))
        .drop("_again")
    )


register_dedupe("partitioned", dedupe_partitioned)
register_dedupe("two_level", dedupe_two_level)
