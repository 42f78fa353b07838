"""Dedupe operators against small sequential models and micro fixtures."""

import hashlib
import math
import random

import pytest
from conftest import verdicts
from pyspark.sql import functions as F

from flowsieve.operators import dedupe as d, windowed as w
from flowsieve.operators.report import dedupe_stats, state_size
from flowsieve.operators.routing import dedupe_partitioned, dedupe_two_level, route


def one(text):
    return [("t", c) for c in text]


def model(pairs, step_for):
    """Feed pairs in order to one `step` per scope."""
    steps = {}
    return [steps.setdefault(t, step_for())(f) for t, f in pairs]


def model_fifo(window):
    accepted = []

    def step(f):
        if f in (accepted[-window:] if window else []):
            return True
        accepted.append(f)
        return False

    return step


def model_rotating(window, generation, on_arrival=False):
    """A plain account of the rules: a queue with copies, a cache without, and
    the fingerprints the current filter knows."""
    s = {"queue": [], "cache": set(), "known": set(), "count": 0}

    def room():
        if len(s["queue"]) >= window:
            s["cache"] -= {s["queue"].pop(0)}

    def turn():
        if s["count"] >= generation:
            s["known"], s["count"] = set(), 0

    def step(f):
        if on_arrival:
            room(), turn()
        known = f in s["known"]
        if known and f in s["cache"]:
            return "duplicate"
        if not on_arrival:
            room(), turn()
        if not (on_arrival and known):
            s["known"].add(f)
            s["count"] += 1
        s["queue"].append(f)
        s["cache"].add(f)
        return "filter_false_positive" if known else "new"

    return step


def bits_of(f, size):
    digest = hashlib.sha256(f.encode()).hexdigest()
    return {int(digest[8 * j : 8 * j + 8], 16) % size.bits for j in range(size.hashes)}


def model_filter(size, window=None):
    s = {"set": set(), "count": 0}

    def step(f):
        bits = bits_of(f, size)
        if bits <= s["set"]:
            return True
        if window and s["count"] >= window:
            s["set"], s["count"] = set(), 0
        s["set"] |= bits
        s["count"] += 1
        return False

    return step


def stream(n, scopes, names, seed, hot=0.0):
    rng = random.Random(seed)
    return [("hot" if rng.random() < hot else f"s{rng.randrange(scopes)}", f"n{rng.randrange(names)}") for _ in range(n)]


# ------------------------------------------------------------ micro fixtures


def test_first_passes_and_repeat_is_flagged(arrivals):
    assert verdicts(d.dedupe_scoped_exact(arrivals(one("aab")))) == [False, True, False]


def test_fifo_and_rotation_differ_on_abcb(arrivals):
    df = arrivals(one("abcb"))
    assert verdicts(w.dedupe_scoped_fifo(df, 2)) == [False, False, False, True]
    assert verdicts(w.dedupe_scoped_rotating(df, 2)) == [False] * 4


def test_rotation_flags_positions_three_and_six(arrivals):
    flags = verdicts(w.dedupe_scoped_rotating(arrivals(one("abacbca")), 2))
    assert [i + 1 for i, f in enumerate(flags) if f] == [3, 6]


def test_worker_window_of_one_never_drops(arrivals):
    df = arrivals(one("aaabb")).withColumn("worker_id", F.lit(0))
    assert not any(verdicts(w.dedupe_worker_window(df, 1)))


def test_empty_input(arrivals, spark):
    empty = arrivals(one("a")).where("seq < 0")
    for op in (
        d.dedupe_none,
        d.dedupe_global_exact,
        d.dedupe_scoped_exact,
        lambda x: w.dedupe_scoped_fifo(x, 2),
        lambda x: d.dedupe_arrival_lookback(x, 2),
        lambda x: d.dedupe_filter_only(x, d.FilterSize(64, 2)),
    ):
        assert op(empty).count() == 0
    stats = dedupe_stats(d.dedupe_none(empty)).first()
    assert (stats["total_records"], stats["duplicates"], stats["dedupe_rate_pct"]) == (0, 0, 0.0)


def test_global_ignores_scope_and_scoped_does_not(arrivals):
    df = arrivals([("x", "a"), ("y", "a"), ("y", "a")])
    assert verdicts(d.dedupe_global_exact(df)) == [False, True, True]
    assert verdicts(d.dedupe_scoped_exact(df)) == [False, False, True]


# ------------------------------------------------------------------- models


@pytest.mark.parametrize("window", [1, 3, 8, 1000])
@pytest.mark.parametrize("pieces", [1, 5])
def test_fifo_equals_the_model(arrivals, window, pieces):
    pairs = stream(600, 7, 14, window, hot=0.35)
    assert verdicts(w.dedupe_scoped_fifo(arrivals(pairs), window, pieces=pieces)) == model(
        pairs, lambda: model_fifo(window)
    )


@pytest.mark.parametrize("window, pieces", [(3, 1), (6, 7), (40, 4)])
def test_rotating_equals_the_model(arrivals, window, pieces):
    pairs = stream(500, 4, 12, 40 + window, hot=0.35)
    got = verdicts(w.dedupe_scoped_rotating(arrivals(pairs), window, pieces=pieces), "outcome")
    assert got == model(pairs, lambda: model_rotating(window, window))


@pytest.mark.parametrize("window, generation", [(6, 3), (4, 9), (5, 5)])
def test_worker_rotating_equals_the_model(arrivals, window, generation):
    pairs = stream(400, 3, 12, window, hot=0.35)
    df = arrivals(pairs).withColumn("worker_id", F.col("tenant"))
    got = verdicts(w.dedupe_worker_rotating(df, window, generation, pieces=5), "outcome")
    assert got == model(pairs, lambda: model_rotating(window, generation, on_arrival=True))


def test_worker_window_is_a_fifo_window_of_one_less(arrivals):
    pairs = stream(300, 3, 10, 5)
    df = arrivals(pairs).withColumn("worker_id", F.col("tenant"))
    assert verdicts(w.dedupe_worker_window(df, 5)) == model(pairs, lambda: model_fifo(4))


@pytest.mark.parametrize("size", [d.FilterSize(32, 2), d.FilterSize(97, 3), d.FilterSize(512, 10)])
def test_filter_equals_record_by_record_insertion(arrivals, size):
    if size.hashes > 8:
        pairs = stream(200, 2, 40, 1)
        flagged = d.dedupe_filter_only(arrivals(pairs), size)
        tumbling = w.dedupe_filter_tumbling(arrivals(pairs), size, 1)  # both engines share the positions
        assert flagged.count() == 200 and tumbling.count() == 200
        return
    pairs = stream(300, 3, 30, size.bits)
    assert verdicts(d.dedupe_filter_only(arrivals(pairs), size)) == model(pairs, lambda: model_filter(size))


@pytest.mark.parametrize("hashes", [3, 10])
def test_bit_positions_agree_between_tasks_and_columns(arrivals, hashes):
    from flowsieve.operators.window_state import BitFilter

    size = d.FilterSize(101, hashes)
    rows = arrivals(one("abcdef")).select("fp", d.filter_positions(F.col("fp"), size).alias("p")).collect()
    for r in rows:
        assert r["p"] == BitFilter(size.bits, size.hashes).positions([bytes(r["fp"])])[0]


@pytest.mark.parametrize("pieces", [1, 6])
def test_tumbling_filter_equals_the_model(arrivals, pieces):
    size, window = d.FilterSize(64, 2), 6
    pairs = stream(400, 3, 25, 3, hot=0.35)
    got = verdicts(w.dedupe_filter_tumbling(arrivals(pairs), size, window, pieces=pieces))
    assert got == model(pairs, lambda: model_filter(size, window))


def test_two_stage_has_no_false_drop(arrivals):
    pairs = stream(500, 2, 60, 9)
    df = arrivals(pairs)
    checked = d.dedupe_two_stage(df, d.FilterSize(64, 2))
    assert verdicts(checked) == verdicts(d.dedupe_scoped_exact(df))
    assert checked.where("outcome = 'filter_false_positive'").count() > 0


def test_windowed_two_stage_with_real_bits_settles_small_scopes_natively(arrivals):
    pairs = stream(300, 3, 30, 8)
    df, size = arrivals(pairs), d.FilterSize(64, 2)
    native = verdicts(w.dedupe_scoped_rotating(df, 10_000, size), "outcome")
    assert native == verdicts(d.dedupe_two_stage(df, size), "outcome")


@pytest.mark.parametrize("window", [1, 4, 50])
def test_arrival_lookback_equals_the_model(arrivals, window):
    pairs = stream(400, 4, 9, window, hot=0.4)

    def step_for():
        seen = []

        def step(f):
            dup = f in seen[-window:]
            seen.append(f)
            return dup

        return step

    assert verdicts(d.dedupe_arrival_lookback(arrivals(pairs), window)) == model(pairs, step_for)


def test_ttl_equals_the_model(arrivals, spark):
    rng = random.Random(4)
    pairs = stream(300, 3, 6, 4)
    times, now = [], 0
    for _ in pairs:
        now += rng.choice([0, 0, 5, 30])
        times.append(now)
    clock = spark.createDataFrame(list(enumerate(times)), "seq bigint, at bigint")
    df = arrivals(pairs).join(clock, "seq").withColumn("ts", F.timestamp_seconds("at"))
    last, want = {}, []
    for key, t in zip(pairs, times):
        want.append(key in last and t - last[key] <= 60)
        last[key] = t
    assert verdicts(d.dedupe_ttl(df, 60)) == want


# --------------------------------------------------------------- properties


def test_nothing_evicted_means_plain_first_seen(arrivals):
    df = arrivals(stream(300, 3, 12, 6))
    exact = verdicts(d.dedupe_scoped_exact(df))
    assert verdicts(w.dedupe_scoped_fifo(df, 12)) == exact
    assert verdicts(w.dedupe_scoped_rotating(df, 12)) == exact


def test_pieces_and_speculation_do_not_change_the_result(arrivals):
    pairs = stream(800, 1, 40, 12)
    df = arrivals(pairs)
    want = model(pairs, lambda: model_fifo(20))
    for pieces in (2, 9, 25):
        assert verdicts(w.dedupe_scoped_fifo(df, 20, pieces=pieces)) == want


def test_small_arrow_batches_carry_the_window(arrivals, spark):
    pairs = stream(300, 4, 12, 2)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 7)
    try:
        got = verdicts(w.dedupe_scoped_fifo(arrivals(pairs), 5))
    finally:
        spark.conf.set(key, before)
    assert got == model(pairs, lambda: model_fifo(5))


def test_saved_windows_load_again():
    from flowsieve.operators.window_state import FifoWindow, ScreenedWindow

    fps = [hashlib.sha256(str(i % 9).encode()).digest() for i in range(60)]
    for make in (
        lambda: FifoWindow(4),
        lambda: ScreenedWindow(4, 3, None),
        lambda: ScreenedWindow(4, 3, (64, 2)),
        lambda: ScreenedWindow(0, 3, (64, 2), exact=False),
        lambda: ScreenedWindow(4, 3, None, on_arrival=True),
    ):
        through, halves = make(), make()
        whole = [v for f in fps for v in through.steps([f])]
        first = halves.steps(fps[:30])
        again = make()
        again.load(halves.save())
        assert whole == first + again.steps(fps[30:])


def test_filter_rate_is_near_its_setting(arrivals):
    n, rate = 500, 0.01
    size = d.FilterSize.for_rate(n, rate)
    assert size.bits == math.ceil(-n * math.log(rate) / math.log(2) ** 2)
    flagged = d.dedupe_filter_only(arrivals([("t", f"u{i}") for i in range(n)]), size)
    assert d.dropped(flagged).count() / n < 0.05


def test_filter_never_misses_a_repeat(arrivals):
    df = arrivals(stream(400, 2, 50, 21))
    pairs = zip(verdicts(d.dedupe_filter_only(df, d.FilterSize(128, 3))), verdicts(d.dedupe_scoped_exact(df)))
    assert all(filtered for filtered, repeated in pairs if repeated)


def test_routing_by_tenant_keeps_verdicts(arrivals):
    df = arrivals(stream(300, 6, 12, 31))
    want = verdicts(w.dedupe_scoped_rotating(df, 5))
    for workers in (1, 2, 4):
        assert verdicts(dedupe_partitioned(df, workers, 5)) == want


def test_routes_are_stable_and_in_range(arrivals):
    df = arrivals(stream(100, 6, 12, 32))
    for strategy in ("tenant", "hash", "random"):
        a, b = (verdicts(route(df, 4, strategy), "worker_id") for _ in range(2))
        assert a == b and set(a) <= {0, 1, 2, 3}
    with pytest.raises(ValueError):
        route(df, 4, "elsewhere")


def test_two_level_decides_globally(arrivals):
    df = route(arrivals(stream(300, 3, 40, 33)), 4, "random")
    flagged = dedupe_two_level(df)
    assert verdicts(flagged) == verdicts(d.dedupe_global_exact(df))
    assert flagged.where("local_repeat and not is_dup").count() == 0


def test_registered_policies(arrivals):
    df = arrivals(one("aab"))
    assert verdicts(d.dedupe(df, "scoped_exact")) == [False, True, False]
    d.register_dedupe("drop all", lambda x: x.withColumn("is_dup", F.lit(True)))
    assert verdicts(d.dedupe(df, "drop all")) == [True] * 3


def test_keeping_firsts_with_and_without_other_columns(arrivals):
    df = arrivals(stream(200, 3, 12, 78))
    want = sorted(r["seq"] for r in d.passed(d.dedupe_scoped_exact(df)).collect())
    key = ["tenant", "log_type", "fp"]
    assert sorted(r["seq"] for r in d.keep_first(df, key).collect()) == want
    narrow = d.keep_first(df.select("seq", *key), key)
    assert narrow.columns == ["seq", *key] and sorted(r["seq"] for r in narrow.collect()) == want


def test_counting_keys_gives_the_counters_of_the_flags(arrivals):
    from flowsieve.operators.report import exact_stats

    df = arrivals(stream(200, 3, 12, 77))
    flagged = dedupe_stats(d.dedupe_scoped_exact(df)).first()
    assert exact_stats(df, ["tenant", "log_type", "fp"]).first().asDict() == flagged.asDict()
    assert exact_stats(df.where("seq < 0"), ["fp"]).first()["total_records"] == 0


def test_every_policy_is_registered():
    import flowsieve.operators.routing  # noqa: F401

    assert set(d._POLICIES) >= {
        "none",
        "global_exact",
        "scoped_exact",
        "scoped_fifo",
        "scoped_rotating",
        "worker_window",
        "worker_rotating",
        "filter_only",
        "filter_tumbling",
        "two_stage",
        "arrival_lookback",
        "ttl",
        "partitioned",
        "two_level",
    }


def test_counters_come_with_a_write(arrivals, tmp_path):
    from flowsieve.operators.report import observed

    df, watch = observed(d.dedupe_scoped_exact(arrivals(one("aab"))))
    df.write.parquet(str(tmp_path / "out"))
    assert watch.get == {"total_records": 3, "duplicates": 1, "false_positives": 0, "evaluations": 2}


def test_state_size_counts_the_filter_beside_each_window(spark, arrivals):
    df = arrivals([("a", "x"), ("a", "y"), ("a", "x"), ("b", "z"), ("b", "z")])
    windows = df.where("seq in (0, 1, 3)").select("tenant", "log_type", "seq", "fp")
    # 40 bytes a fingerprint with its number, and the filter's 12 bits in 2 bytes a scope.
    assert tuple(state_size(windows, 12).first()) == (2, 3, 3 * 40 + 2 * 2)
    assert tuple(state_size(windows).first()) == (2, 3, 3 * 40)
