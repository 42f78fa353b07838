"""The streaming operators run over the event flows until the source is drained."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.records import flow_view
from ..operators.report import percent
from ..plans.event_flows import event_flows
from ..session import age_by_name, new_table_path
from ..sources.flows import stream_flows
from .dedupe import (
    FifoBatches,
    batch_stats,
    stream_scoped_fifo,
    stream_scoped_rotating,
    stream_signatures,
    stream_ttl,
    stream_ttl_expiring,
)

_WINDOW = 16
_TTL_SECONDS = 6 * 3600
#: A replay's files: so many rows each at most, and so many files at least, for several micro-batches of a small table.
FILE_ROWS = 1 << 18
LEAST_FILES = 4
#: Rows of a micro-batch of the queries, whose fixed costs are those of hundreds of thousands of rows.
BATCH_ROWS = 1 << 22


def replayed(
    view: DataFrame,
    file_rows: int = FILE_ROWS,
    files_per_batch: int = 1,
    least_files: int = LEAST_FILES,
    *,
    batch_rows: int = 0,
    by: Sequence[str] = ("seq",),
) -> DataFrame:
    """A table as a stream in the order of `by`: written once, a file per range of arrivals, and admitted by files.

    The number of jobs does not depend on the rows; a micro-batch has about
    `file_rows * files_per_batch` rows, an argument of the caller's, or up to `batch_rows`
    where that leaves `least_files` micro-batches.
    """
    spark, path = view.sparkSession, new_table_path(view.sparkSession, "arrivals")
    files = max(least_files, -(-view.count() // file_rows))
    files_per_batch = max(files_per_batch, min(batch_rows // file_rows, files // least_files))
    view.repartitionByRange(files, *by).sortWithinPartitions(*by).write.parquet(path)
    age_by_name(spark, path)
    return stream_flows(spark, path, view.schema, maxFilesPerTrigger=files_per_batch)


def _flow_stream(spark, sf: str, columns: list[str], by: Sequence[str] = ("seq",)) -> DataFrame:
    return replayed(flow_view(event_flows(spark, sf), keep=columns), batch_rows=BATCH_ROWS, by=by)


def _drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run to the end of the source into Parquet; returns the written rows."""
    spark = stream.sparkSession
    path = new_table_path(spark, "stream")
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def _in_batches(stream: DataFrame, sink) -> None:
    query = (
        stream.writeStream.option("checkpointLocation", f"{sink.path}/progress")
        .foreachBatch(sink)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stream_fifo(spark, sf):
    """The records come through with their verdict; a scope's micro-batch is spread over tasks."""
    stream = _flow_stream(spark, sf, ["Destination IP"])
    sink = FifoBatches(new_table_path(spark, "stream-fifo"), _WINDOW)
    _in_batches(stream, sink)
    schema = stream.schema.add("is_dup", "boolean")
    rows = spark.read.schema(schema).parquet(sink.rows_path())
    return rows.select("seq", "tenant", "is_dup", F.col("Destination IP").alias("destination"))


def stream_fifo_state(spark, sf):
    """The same with a scope's window as keyed state."""
    out = _drained(stream_scoped_fifo(_flow_stream(spark, sf, []), _WINDOW))
    return out.select("seq", "tenant", "is_dup")


def stream_rotating(spark, sf):
    out = _drained(stream_scoped_rotating(_flow_stream(spark, sf, []), _WINDOW))
    return out.select("seq", "tenant", "is_dup", "outcome")


def stream_ttl_dedupe(spark, sf):
    out = _drained(stream_ttl(_flow_stream(spark, sf, ["ts"]), _TTL_SECONDS))
    return out.select("seq", "tenant", "is_dup")


def stream_ttl_bounded_state(spark, sf):
    """Keys are forgotten as the watermark passes; the records arrive in the order of their time."""
    stream = _flow_stream(spark, sf, ["ts"], by=("ts", "seq"))
    out = _drained(stream_ttl_expiring(stream, _TTL_SECONDS, delay_seconds=3600))
    return out.select("seq", "tenant", "is_dup")


def stream_signature_rules(spark, sf):
    stream = _flow_stream(spark, sf, ["Destination Port", "Total Backward Packets"])
    return _drained(stream_signatures(stream).select("seq", "signature"))


def stream_dedupe_stats(spark, sf):
    """Counters added up over the micro-batches."""
    flagged = stream_scoped_fifo(_flow_stream(spark, sf, []), _WINDOW)
    path = new_table_path(spark, "batch-stats")
    query = (
        flagged.writeStream.option("checkpointLocation", f"{path}/progress")
        .foreachBatch(batch_stats(f"{path}/rows"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    names = ["total_records", "duplicates", "false_positives", "evaluations"]
    totals = spark.read.parquet(f"{path}/rows").agg(*[F.sum(n).cast("bigint").alias(n) for n in names])
    return totals.withColumn("dedupe_rate_pct", percent(F.col("duplicates"), F.col("total_records")))


def queries():
    return {
        f.__name__: f
        for f in (
            stream_fifo,
            stream_fifo_state,
            stream_rotating,
            stream_ttl_dedupe,
            stream_ttl_bounded_state,
            stream_signature_rules,
            stream_dedupe_stats,
        )
    }
