"""Streams must give what the batch operators give."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowsieve import session
from flowsieve.operators.dedupe import FilterSize, dedupe_ttl, flag_duplicates, two_stage_verdicts, with_outcome
from flowsieve.operators.report import dedupe_stats, verdict_stats
from flowsieve.operators.routing import dedupe_two_level
from flowsieve.operators.windowed import dedupe_scoped_fifo, dedupe_scoped_rotating, fifo_verdicts, last_accepted
from flowsieve.plans.event_flows import event_view
from flowsieve.streaming import queries as streams
from flowsieve.streaming.dedupe import FifoBatches, stream_first_within, stream_scoped_fifo, stream_ttl, stream_ttl_expiring


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select("seq", *columns).collect())


@pytest.mark.parametrize("name, batch", [("stream_fifo", dedupe_scoped_fifo), ("stream_rotating", dedupe_scoped_rotating)])
def test_stream_carries_windows_over_micro_batches(spark, sf, name, batch, monkeypatch):
    monkeypatch.setattr(streams.replayed, "__defaults__", (250, 1, 4))
    streamed = streams.queries()[name](spark, sf)
    assert rows(streamed, "is_dup") == rows(batch(event_view(spark, sf), 16), "is_dup")


def test_ttl_stream_gives_the_batch_verdicts(spark, sf):
    batch = dedupe_ttl(event_view(spark, sf, keep=["ts"]), 6 * 3600)
    assert rows(streams.stream_ttl_dedupe(spark, sf), "is_dup") == rows(batch, "is_dup")


def test_hot_scope_over_many_small_batches(spark, sf, tmp_path):
    """One scope, a payload column, 20 micro-batches: as in one pass."""
    view = event_view(spark, sf, keep=["k"]).withColumn("tenant", F.lit("all"))
    low, high = view.agg(F.min("seq"), F.max("seq")).first()
    step = (high - low) // 20 + 1
    for start in range(low, high + 1, step):
        view.where((F.col("seq") >= start) & (F.col("seq") < start + step)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(view.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = streams._drained(stream_scoped_fifo(stream, 40))
    assert rows(got, "is_dup", "k") == rows(dedupe_scoped_fifo(view, 40), "is_dup", "k")


def test_late_and_timeless_rows_are_kept_by_the_ttl_stream(spark, tmp_path):
    schema = "seq bigint, tenant string, log_type string, fp binary, ts timestamp, extra int"
    start = datetime(2024, 1, 1)
    batches = [[(1, 0), (2, 30), (3, None)], [(4, 1000), (5, 20)], [(6, 1050), (7, 200), (8, None)]]
    for batch in batches:
        data = [(s, "t", "", bytearray(b"x" * 32), t if t is None else start + timedelta(seconds=t), s * 10) for s, t in batch]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = rows(streams._drained(stream_ttl(stream, 60)), "is_dup", "extra")
    assert got == [(1, False, 10), (2, True, 20), (3, False, 30), (4, False, 40), (5, True, 50), (6, True, 60), (7, False, 70), (8, False, 80)]


def test_batch_counters_add_up(spark, sf):
    total = streams.stream_dedupe_stats(spark, sf).first().asDict()
    assert total == dedupe_stats(dedupe_scoped_fifo(event_view(spark, sf), 16)).first().asDict()


def test_a_replay_needs_as_many_jobs_for_any_table(spark, sf):
    def jobs(view):
        tracker, group = spark.sparkContext.statusTracker(), f"replay-{view.count()}"
        spark.sparkContext.setJobGroup(group, group)
        streams.replayed(view, file_rows=10)
        spark.sparkContext.setJobGroup("", "")
        return len(tracker.getJobIdsForGroup(group))

    view = event_view(spark, sf)
    assert jobs(view.where("seq < 50")) == jobs(view)


def test_a_replay_is_in_order_of_arrival(spark, sf, tmp_path):
    seen = []
    stream = streams.replayed(event_view(spark, sf), file_rows=100)
    query = stream.writeStream.foreachBatch(lambda b, i: seen.append(b.agg(F.min("seq"), F.max("seq"), F.count("*")).first()))
    query.option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) >= 9 and sum(x[2] for x in seen) == 1000
    assert all(a[1] < b[0] for a, b in zip(seen, seen[1:]))


def test_a_hot_scope_in_batches_and_a_batch_replayed(spark, sf, tmp_path):
    """One scope over several micro-batches, and the last one done again: same rows, same windows."""
    view = event_view(spark, sf, keep=["k"]).withColumn("tenant", F.lit("all"))
    sink = FifoBatches(str(tmp_path / "out"), 40)
    kept = len(session._paths)
    parts = [view.where(f"seq >= {a} and seq < {a + 260}") for a in range(0, 1000, 260)]
    for i, part in enumerate(parts):
        sink(part, i)
        if i == 2:
            once = sorted(map(tuple, spark.read.parquet(sink.version_path(2)).collect()))
            sink(part, 2)
            assert sorted(map(tuple, spark.read.parquet(sink.version_path(2)).collect())) == once
    assert len(session._paths) == kept  # a micro-batch releases what it has written
    got = spark.read.parquet(sink.rows_path())
    assert rows(got, "is_dup", "k") == rows(dedupe_scoped_fifo(view, 40), "is_dup", "k")
    last = spark.read.parquet(sink.version_path(3))
    kept = sorted(r["seq"] for r in dedupe_scoped_fifo(view, 40).where("not is_dup").collect())[-40:]
    assert sorted(r["seq"] for r in last.collect()) == kept
    assert sorted(p.name for p in (tmp_path / "out" / "windows").iterdir()) == ["version=2", "version=3"]


def test_rows_without_a_number_or_scope_pass_batches(spark, tmp_path):
    data = [(1, None, "a"), (None, None, "a"), (2, None, "a"), (3, "t", None), (4, "t", None)]
    view = spark.createDataFrame([(s, t, "", f and bytearray(f.encode())) for s, t, f in data], "seq bigint, tenant string, log_type string, fp binary")
    sink = FifoBatches(str(tmp_path), 3)
    sink(view, 0)
    sink(view.where("seq is null or seq < 0"), 1)
    sink(view.withColumn("seq", F.col("seq") + 10), 2)
    got = sorted((r["seq"] or 0, r["is_dup"]) for r in spark.read.parquet(sink.rows_path()).collect())
    assert got == [(0, False)] * 3 + [(1, False), (2, True), (3, False), (4, True), (11, True), (12, True), (13, True), (14, True)]


def test_state_of_expiring_keys_goes_again(spark, tmp_path):
    """Many keys at first, few later: the state shrinks, and verdicts stay those of the batch operator."""
    schema = "seq bigint, tenant string, log_type string, fp binary, ts timestamp"
    start, seq, data = datetime(2024, 1, 1), 0, []
    for batch in range(8):
        rows_of = []
        for k in range(60 if batch < 2 else 3):
            for extra in (0, 20):
                rows_of.append((seq, "t", "", bytearray(f"{batch % 2}-{k}".encode()), start + timedelta(seconds=400 * batch + k + extra)))
                seq += 1
        rows_of.append((seq, "t", "", bytearray(b"timeless"), None))
        seq += 1
        data += rows_of
        spark.createDataFrame(rows_of, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stream_ttl_expiring(stream, 100, delay_seconds=100).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    query = out.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    state = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    assert max(state) >= 60 and state[-1] <= 10
    assert spark.read.format("statestore").load(str(tmp_path / "progress")).count() == state[-1]
    batch = dedupe_ttl(spark.createDataFrame(data, schema), 100)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "is_dup") == rows(batch, "is_dup")


def test_spark_forgets_first_rows_after_the_time_to_live(spark, tmp_path):
    schema = "seq bigint, tenant string, log_type string, fp binary, ts timestamp"
    start = datetime(2024, 1, 1)
    for batch in ([(0, "a", 0), (1, "a", 30)], [(2, "b", 500)], [(3, "b", 540), (4, "c", 900)], [(5, "a", 901)]):
        part = [(s, "t", "", bytearray(f.encode()), start + timedelta(seconds=t)) for s, f, t in batch]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = streams._drained(stream_first_within(stream, 60))
    assert sorted(r["seq"] for r in kept.collect()) == [0, 2, 4, 5]


def test_keyed_state_is_held_by_buckets(spark, tmp_path):
    """Thousands of keys and scopes are some hundred groups of a micro-batch, and their verdicts those of the batch."""
    view = spark.range(3000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 7 != 0, (F.col("id") % 800).cast("string")).alias("tenant"),
        F.lit("").alias("log_type"),
        F.when(F.col("id") % 11 != 0, F.unhex(F.sha2((F.col("id") % 1500).cast("string"), 256))).alias("fp"),
        F.when(F.col("id") % 13 != 0, F.timestamp_seconds(F.col("id") * 2)).alias("ts"),
    )
    forms = {
        "ttl": (lambda s: stream_ttl(s, 3500), lambda v: dedupe_ttl(v, 3500)),
        "expiring": (lambda s: stream_ttl_expiring(s, 3500, 100), lambda v: dedupe_ttl(v, 3500)),
        "fifo": (lambda s: stream_scoped_fifo(s, 2), lambda v: dedupe_scoped_fifo(v, 2)),
    }
    for name, (streamed, batch) in forms.items():
        path = str(tmp_path / name)
        out = streamed(streams.replayed(view, file_rows=1000)).writeStream.format("parquet").option("path", f"{path}/rows")
        query = out.option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
        assert rows(spark.read.parquet(f"{path}/rows"), "is_dup") == rows(batch(view), "is_dup")
        assert max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]) <= 256


def test_a_replay_of_many_files_has_few_micro_batches(spark, sf, tmp_path):
    seen = []
    stream = streams.replayed(event_view(spark, sf), file_rows=50, batch_rows=400)
    query = stream.writeStream.foreachBatch(lambda b, i: seen.append(b.count()))
    query.option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start().awaitTermination()
    assert 4 <= len(seen) <= 5 and sum(seen) == 1000


def test_no_row_of_a_table_out_of_the_order_of_time_is_dropped(spark, sf, tmp_path):
    """Arrival numbers that go on while the times begin anew: the replay is in the order of the time."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    later = events.withColumns({"event_id": F.col("event_id") + 1000, "user_id": F.col("user_id") + 1000})
    events.unionByName(later).write.parquet(str(tmp_path / "events.parquet"))
    batch = dedupe_ttl(event_view(spark, str(tmp_path), keep=["ts"]), 6 * 3600)
    assert rows(streams.stream_ttl_bounded_state(spark, str(tmp_path)), "is_dup") == rows(batch, "is_dup")


def test_verdicts_of_a_micro_batch_do_not_go_through_the_driver(spark, sf):
    """Accepted rows grow with the micro-batch: no join collects them for a broadcast."""
    view = session.written(event_view(spark, sf, keep=["k"]), "view")
    found = session.written(fifo_verdicts(view, 40), "found")
    frames = [
        flag_duplicates(view, found),
        with_outcome(view, found),
        last_accepted(view, found, 40),
        verdict_stats(view, found, by=["tenant"]),
        two_stage_verdicts(view, ["tenant"], FilterSize(1 << 12, 3)),
        dedupe_two_level(view.withColumn("worker_id", F.col("seq") % 3)),
    ]
    for frame in frames:
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
