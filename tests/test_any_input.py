"""Inputs that the test tables lack: null scopes, other digests, odd arrival numbers, disordered times, mixed CSV files."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from flowsieve.functions.records import flow_fingerprint
from flowsieve.operators import dedupe as d, windowed as w
from flowsieve.sources.flows import malformed_lines, read_flows

SCHEMA = "seq bigint, tenant string, log_type string, fp binary"


def view(spark, rows):
    """(tenant, letter) in arrival order."""
    data = [(i, t, "", bytearray(f.encode() * 32)) for i, (t, f) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def flags(df):
    return {r["seq"]: r["is_dup"] for r in df.collect()}


@pytest.mark.parametrize("others", [[], [("small", "a"), ("small", "a")]])
def test_null_scope_is_a_scope(spark, others):
    rows = [(None, f) for f in "abca"] + others
    got = flags(w.dedupe_scoped_fifo(view(spark, rows), 2))
    assert [got[i] for i in range(4)] == [False, False, False, False]  # the last a was evicted
    assert [got[4 + i] for i in range(len(others))] == [False, True][: len(others)]
    got = flags(w.dedupe_scoped_rotating(view(spark, rows), 2))
    assert [got[i] for i in range(4)] == [False] * 4


@pytest.mark.parametrize("kind", ["date", "decimal(10,2)", "binary", "struct<a:int>", "timestamp"])
def test_scope_columns_of_any_type(spark, kind):
    one = {"date": date(2024, 1, 1), "decimal(10,2)": Decimal("1.50"), "binary": bytearray(b"\xff\x00"), "struct<a:int>": (1,), "timestamp": datetime(2024, 1, 1)}[kind]
    data = [(i, k, bytearray(f.encode() * 32)) for i, (k, f) in enumerate([(one, f) for f in "abcbac"] + [(None, f) for f in "abcbac"])]
    df = spark.createDataFrame(data, f"seq bigint, s {kind}, fp binary")
    got = flags(w.dedupe_scoped_fifo(df, 2, scope=["s"]))
    assert [got[i] for i in range(12)] == [False, False, False, True, False, True] * 2


@pytest.mark.parametrize("size", [0, 16, 20, 64])
def test_digests_of_any_length(spark, size):
    names = [str((i * i) % 23) for i in range(400)]
    long = spark.createDataFrame([(i, "t", "", n) for i, n in enumerate(names)], "seq bigint, tenant string, log_type string, n string")
    full = long.withColumn("fp", F.unhex(F.sha2("n", 256)))
    fp = F.col("n").cast("binary") if not size else F.substring(F.unhex(F.sha2("n", 512)), 1, size)
    other = long.withColumn("fp", fp)
    for operator in (w.dedupe_scoped_fifo, w.dedupe_scoped_rotating):
        assert flags(operator(other, 7, pieces=4)) == flags(operator(full, 7, pieces=4))
    small = d.FilterSize(1 << 16, 3)
    assert flags(d.dedupe_filter_only(other, small)) == flags(d.dedupe_scoped_exact(full))


def test_null_and_repeated_arrival_numbers_are_kept(spark):
    data = [(1, "t", "", bytearray(b"a")), (None, "t", "", bytearray(b"b")), (None, "t", "", bytearray(b"a")), (2, "t", "", bytearray(b"a")), (5, "t", "", bytearray(b"c")), (5, "t", "", bytearray(b"d"))]
    df = spark.createDataFrame(data, SCHEMA)
    for flagged in (d.dedupe_scoped_exact(df), d.dedupe_global_exact(df), w.dedupe_scoped_fifo(df, 1), w.dedupe_scoped_rotating(df, 1), d.dedupe_two_stage(df, d.FilterSize(512, 2))):
        got = [(r["seq"], bytes(r["fp"]), r["is_dup"]) for r in flagged.collect()]
        assert len(got) == 6
        assert sorted(got, key=str) == sorted([(1, b"a", False), (None, b"b", False), (None, b"a", False), (2, b"a", True), (5, b"c", False), (5, b"d", False)], key=str)


def test_ttl_is_in_the_order_of_time(spark):
    start = datetime(2024, 1, 1)
    times = [100, 40, None, 170, 161, None]
    data = [(i, "t", "", bytearray(b"k" * 32), None if t is None else start + timedelta(seconds=t)) for i, t in enumerate(times)]
    got = flags(d.dedupe_ttl(spark.createDataFrame(data, SCHEMA + ", ts timestamp"), 60))
    # 40 is first, 100 and 170 - 161 are repeats, 161 is more than a minute after 100; unknown times stay.
    assert got == {0: True, 1: False, 2: False, 3: True, 4: False, 5: False}


def test_carried_digest_is_taken_as_it_is(spark):
    df = spark.createDataFrame([("1.1.1.1", "2.2.2.2", 5)], ["Source IP", "Destination IP", "fwd_bytes"])
    own = flow_fingerprint(df)
    carried = df.select("*", own.alias("_dedupe_fp"))
    digits = df.select("*", F.lower(F.hex(own)).alias("_dedupe_fp"))
    free = df.withColumn("_dedupe_fp", F.lit("any text"))
    expected = df.select(own).first()[0]
    assert carried.select(flow_fingerprint(carried)).first()[0] == expected
    assert digits.select(flow_fingerprint(digits)).first()[0] == expected
    assert len(free.select(flow_fingerprint(free)).first()[0]) == 32 and free.select(flow_fingerprint(free)).first()[0] != expected


def test_csv_folder_with_layouts_of_its_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Source IP, Destination IP\n1.1.1.1,2.2.2.2\n3.3.3.3,4.4.4.4,extra\nonly\n")
    (tmp_path / "b.csv").write_text(" Destination IP,Source IP,Port\n9.9.9.9,8.8.8.8,80\n9.9.9.9,7.7.7.7,x\n")
    (tmp_path / "c.csv").write_text("Source IP, Destination IP\n5.5.5.5,6.6.6.6\n")
    flows = read_flows(spark, str(tmp_path), types={"Port": "int"}, corrupt=True)
    got = {(r["Source IP"], r["Destination IP"], r["Port"]) for r in flows.collect() if r["_corrupt_record"] is None}
    assert got == {("1.1.1.1", "2.2.2.2", None), ("8.8.8.8", "9.9.9.9", 80), ("7.7.7.7", "9.9.9.9", None), ("5.5.5.5", "6.6.6.6", None)}
    assert malformed_lines(flows) == 2
    assert "_corrupt_record" not in read_flows(spark, str(tmp_path)).columns
