"""Structured Streaming forms of the dedupe and signature operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.records import SCOPE, digest_bytes
from ..functions.rules import signature_rule
from ..operators.dedupe import OUTCOMES, flag_duplicates
from ..operators.report import dedupe_stats
from ..operators.windowed import FifoWindow, ScreenedWindow, continue_scopes, fifo_verdicts, last_accepted, scope_text
from ..operators.window_state import continue_keys, expire_keys
from ..session import delete_path, own_tables, written


#: Groups of a stream's keyed state, each with the state of many scopes or keys: a group costs some 50 ms a micro-batch.
BUCKETS = 256


def _digest(df: DataFrame, names: Sequence[str]) -> Column:
    """32 bytes that tell the values of some columns from all others, nulls included."""
    return F.unhex(F.sha2(F.to_json(F.array(*[scope_text(df, c) for c in names])), 256))


def _by_bucket(stream: DataFrame, key: str):
    return stream.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")).groupBy("_bucket")


def _fields(stream: DataFrame) -> str:
    return ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in stream.columns)


def _windowed(stream: DataFrame, new_window: Callable, scope: Sequence[str]) -> DataFrame:
    """All columns of the stream, with outcome and is_dup."""
    fp = F.coalesce(digest_bytes(F.col("fp").cast("binary")), F.lit(bytes(32)))
    keyed = stream.withColumn("_fp", fp).withColumn("_scope", _digest(stream, scope))
    own = ["_fp", "_scope", "_bucket"]
    return _by_bucket(keyed, "_scope").applyInPandasWithState(
        partial(continue_scopes, new_window=new_window, outcomes=OUTCOMES, own_columns=own),
        f"{_fields(stream)}, outcome string, is_dup boolean",
        "windows binary",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def _by_time(stream: DataFrame, verdicts: Callable, ttl_seconds: int, time: str, scope: Sequence[str], timeout: str) -> DataFrame:
    """All columns of the stream, with is_dup."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    keyed = stream.withColumns(
        {"_key": _digest(stream, [*scope, "fp"]), "_timed": at.isNotNull(), "_at": F.coalesce(at, F.lit(0).cast("bigint"))}
    )
    own = ["_key", "_timed", "_at", "_bucket"]
    return _by_bucket(keyed, "_key").applyInPandasWithState(
        partial(verdicts, ttl_micros=ttl_seconds * 1_000_000, own_columns=own),
        f"{_fields(stream)}, is_dup boolean",
        "last binary",
        "append",
        timeout,
    )


def stream_scoped_fifo(stream: DataFrame, window: int = 100_000, scope: Sequence[str] = SCOPE) -> DataFrame:
    """`dedupe_scoped_fifo` on a stream: a scope's window is kept as state.

    The stream's other columns come through. Rows of a scope must reach later
    micro-batches in `seq` order; within a micro-batch they are sorted. State is
    at most one window per scope, kept by buckets of scopes. A bucket's is rewritten
    when a row is accepted, and a task holds a bucket's windows and its rows of one
    micro-batch: bound these by a number of rows at the source (maxFilesPerTrigger,
    maxOffsetsPerTrigger).
    """
    return _windowed(stream, partial(FifoWindow, window), scope)


def stream_scoped_rotating(stream: DataFrame, window: int = 100_000, scope: Sequence[str] = SCOPE) -> DataFrame:
    """`dedupe_scoped_rotating` on a stream, with its filter generation in the state."""
    return _windowed(stream, partial(ScreenedWindow, window, window, None), scope)


def stream_ttl(stream: DataFrame, ttl_seconds: int, time: str = "ts", scope: Sequence[str] = SCOPE) -> DataFrame:
    """`dedupe_ttl` on a stream: the time of each key's last row is kept as state.

    State is kept by buckets of scopes and fingerprints, so a large scope spreads
    over all tasks; a bucket's is rewritten with each micro-batch that has a row for it.
    Within a micro-batch rows are in the order of their time. A row that
    comes later than one of its key with a greater time is compared with that
    one; no row is dropped for being late. A row without a time is kept.
    """
    return _by_time(stream, continue_keys, ttl_seconds, time, scope, GroupStateTimeout.NoTimeout)


def stream_ttl_expiring(
    stream: DataFrame, ttl_seconds: int, delay_seconds: int, time: str = "ts", scope: Sequence[str] = SCOPE
) -> DataFrame:
    """`stream_ttl` with state that goes: a key is forgotten once no row can be within the time to live of it.

    That is when the watermark, `delay_seconds` behind the greatest time, has
    passed its last row by `ttl_seconds`. The rule: rows not more than the delay
    behind get the verdicts of `stream_ttl`; Spark drops rows that are later (it
    reports their number as numRowsDroppedByWatermark), so the delay has to cover
    the source's disorder. Rows without a time are kept, beside the state.
    """
    timed = stream.where(F.col(time).isNotNull()).withWatermark(time, f"{delay_seconds} seconds")
    flagged = _by_time(timed, expire_keys, ttl_seconds, time, scope, GroupStateTimeout.EventTimeTimeout)
    return flagged.unionByName(stream.where(F.col(time).isNull()).withColumn("is_dup", F.lit(False)))


def stream_first_within(stream: DataFrame, ttl_seconds: int, time: str = "ts", scope: Sequence[str] = SCOPE) -> DataFrame:
    """The bounded form with Spark's own operator: first rows of a key, which it forgets after the time to live.

    A repeat within `ttl_seconds` of the first row is dropped for certain; how
    much longer it is dropped depends on how far the watermark has come. Late and timeless rows
    go as Spark's operator has them go.
    """
    return stream.withWatermark(time, f"{ttl_seconds} seconds").dropDuplicatesWithinWatermark([*scope, "fp"])


class FifoBatches:
    """A foreachBatch sink: `dedupe_scoped_fifo` on a stream, a scope's micro-batch spread over many tasks.

    The window of every scope is a table of rows (scope, seq, fp), written as a
    new version with each micro-batch. A micro-batch is the batch operator on the
    rows of the version before and its own: feeding a window's rows to an empty window
    restores it. Rows have to reach later micro-batches in `seq` order.

    Verdicts and version are folders with the number of the micro-batch: one that
    is replayed reads the same version as before and replaces what it had
    written. Versions that no replay can ask for any more are deleted.
    """

    def __init__(self, path: str, window: int = 100_000, scope: Sequence[str] = SCOPE):
        self.path, self.window, self.scope = path, window, tuple(scope)

    def rows_path(self) -> str:
        return f"{self.path}/rows"

    def version_path(self, batch_id: int) -> str:
        return f"{self.path}/windows/version={batch_id}"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with own_tables(spark):  # a stream leaves nothing behind but its rows and the last windows
            self._run(written(batch, "micro-batch"), batch_id)
        if batch_id > 1:
            delete_path(spark, self.version_path(batch_id - 2))

    def _run(self, batch: DataFrame, batch_id: int) -> None:
        fp = F.coalesce(digest_bytes(F.col("fp").cast("binary")), F.lit(bytes(32))).alias("fp")
        own = batch.where(F.col("seq").isNotNull()).select(*self.scope, "seq", fp)
        if batch_id:
            before = batch.sparkSession.read.schema(own.schema).parquet(self.version_path(batch_id - 1))
            own = before.unionByName(own)
        found = written(fifo_verdicts(own, self.window, self.scope), "micro-verdicts")
        flag_duplicates(batch, found).write.mode("overwrite").parquet(f"{self.rows_path()}/batch={batch_id}")
        windows = last_accepted(own, found, self.window, self.scope)
        windows.write.mode("overwrite").parquet(self.version_path(batch_id))


def stream_signatures(stream: DataFrame) -> DataFrame:
    """Signature rules need no state: the batch expression serves."""
    return stream.withColumn("signature", signature_rule(stream))


def batch_stats(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: one row of dedupe counters per micro-batch.

    The folder carries the batch number, so a replayed batch replaces its row.
    """

    def write(flagged: DataFrame, batch_id: int) -> None:
        dedupe_stats(flagged).withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
            f"{path}/batch={batch_id}"
        )

    return write
