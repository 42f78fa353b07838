"""Text form, fingerprints, scopes, times, cleaning, rules, sources."""

import math

import pytest
from pyspark.sql import functions as F

from flowsieve.functions.records import (
    NINE_FIELDS,
    as_text,
    clean_flows,
    column_name,
    fingerprint,
    flow_fingerprint,
    flow_view,
    hex_digits,
    md5_slot,
    parse_event_time,
    scope_columns,
)
from flowsieve.functions.rules import fuse, signature_rule
from flowsieve.operators.dedupe import dedupe_scoped_exact, dropped, passed
from flowsieve.operators.report import dedupe_stats
from flowsieve.sources.flows import head_rows, read_flows, trim_headers, write_result


def record(**change):
    base = dict(zip(NINE_FIELDS, ["1.1.1.1", "2.2.2.2", 1111, 80, 6, 10, 5, 500, 200]))
    names = {"src_ip": NINE_FIELDS[0], "src_port": NINE_FIELDS[2]}
    return {**base, **{names[k]: v for k, v in change.items()}}


def view(spark, records, columns=NINE_FIELDS):
    df = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(records)], ["seq", *NINE_FIELDS])
    nine = fingerprint(df, list(columns))
    return df.select("seq", F.lit("t").alias("tenant"), F.lit("").alias("log_type"), nine.alias("fp"))


def test_fingerprint_is_stable_distinct_and_64_digits(spark):
    df = view(spark, [record(), record(), record(src_ip="1.1.1.2")])
    a, b, c = [r[0] for r in df.select(hex_digits(F.col("fp"))).collect()]
    assert a == b != c and len(a) == 64


def test_batch_splits_into_passed_and_dropped(spark):
    unique = [record(src_port=2000 + i) for i in range(5)]
    flagged = dedupe_scoped_exact(view(spark, [*unique, unique[0], unique[2]]))
    assert passed(flagged).count() == 5 and dropped(flagged).count() == 2


def test_hundred_distinct_records_pass(spark):
    flagged = dedupe_scoped_exact(view(spark, [record(src_port=1000 + i) for i in range(100)]))
    assert dropped(flagged).count() == 0


def test_three_field_fingerprint_ignores_the_port(spark):
    records = [record(src_port=i) for i in range(9)]
    narrow = view(spark, records, ["Source IP", "Destination IP", "Total Length of Fwd Packets"])
    assert narrow.select("fp").distinct().count() == 1
    assert view(spark, records).select("fp").distinct().count() == 9


def test_counts_of_a_record_its_repeat_and_another(spark):
    stats = dedupe_stats(dedupe_scoped_exact(view(spark, [record(), record(), record(src_port=9999)]))).first()
    assert (stats["total_records"], stats["evaluations"], stats["duplicates"]) == (3, 2, 1)
    assert stats["dedupe_rate_pct"] == 33.33


def test_text_of_null_nan_and_whole_doubles(spark):
    df = spark.createDataFrame([(1.0e7,), (2.5,), (None,), (math.nan,)], "x double")
    assert [r[0] for r in df.select(as_text(df, "x")).collect()] == ["10000000", "2.5", "", ""]
    assert df.select(as_text(df, None)).first()[0] == ""


def test_null_fields_do_not_shift_the_fingerprint(spark):
    df = spark.createDataFrame([("a", None, "b"), (None, "a", "b")], "src_ip string, dst_ip string, fwd_bytes string")
    a, b = [r[0] for r in df.select(flow_fingerprint(df)).collect()]
    assert a != b


def test_first_present_alias_wins_even_if_null(spark):
    df = spark.createDataFrame([(None, "10.0.0.1", "tcp")], "tenant_id string, `Src IP` string, protocol string")
    assert column_name(df, ["Source IP", "Src IP"]) == "Src IP"
    row = df.select(*[c.alias(n) for c, n in zip(scope_columns(df), ("t", "l"))]).first()
    assert (row["t"], row["l"]) == ("", "tcp")


def test_tenant_from_source_ip_is_optional(spark):
    df = spark.createDataFrame([("10.0.0.1",)], "source_ip string")
    assert df.select(scope_columns(df)[0]).first()[0] == "10.0.0.1"
    assert df.select(scope_columns(df, tenant_from_source_ip=False)[0]).first()[0] == ""


def test_precomputed_keys_take_precedence(spark):
    df = spark.sql(
        "SELECT 1L AS seq, 'a' AS src_ip, 'k' AS _dedupe_fp, named_struct('tenant','x','log_type','y') AS _dedupe_scope"
        " UNION ALL SELECT 2L, 'a', null, null"
    )
    one, two = flow_view(df).orderBy("seq").collect()
    assert (one["tenant"], one["log_type"], two["tenant"], two["log_type"]) == ("x", "y", "a", "")
    assert one["fp"] != two["fp"] and len(one["fp"]) == len(two["fp"]) == 32


@pytest.mark.parametrize(
    "text, expected",
    [
        ("3/7/2017 8:55", "2017-07-03 08:55:00"),
        (" 03/07/2017 08:55:58", "2017-07-03 08:55:58"),
        ("3/7/2017 1:05:09 PM", "2017-07-03 13:05:09"),
        ("2017-07-03 08:55:58", "2017-07-03 08:55:58"),
        ("nonsense", None),
    ],
)
def test_day_first_times(spark, text, expected):
    parsed = parse_event_time(F.lit(text))
    assert spark.range(1).select(F.date_format(parsed, "yyyy-MM-dd HH:mm:ss")).first()[0] == expected


def test_cleaning_keeps_finite_rows_and_repeats(spark):
    rows = [(1.0, "t"), (1.0, "t"), (math.nan, "t"), (math.inf, "t"), (-math.inf, "t"), (None, "t"), (2.0, None)]
    df = spark.createDataFrame(rows, "x double, time string")
    assert [r["x"] for r in clean_flows(df, ["x"], "time").collect()] == [1.0, 1.0]


def test_signature_ports_packets_null_and_nan(spark):
    rows = [(p, 0.0) for p in (21, 22, 23, 3389, 4444, 80, None)]
    rows += [(80, 10000.0), (80, 10001.0), (80, math.nan), (80, None)]
    df = spark.createDataFrame(rows, "`Destination Port` int, `Total Backward Packets` double")
    assert [r[0] for r in df.select(signature_rule(df)).collect()] == [1, 1, 1, 1, 1, 0, 0, 0, 1, 0, 0]
    nan_port = spark.createDataFrame([(math.nan,), (22.0,)], "`Destination Port` double")
    assert [r[0] for r in nan_port.select(signature_rule(nan_port)).collect()] == [0, 1]
    without = spark.range(1)
    assert without.select(signature_rule(without)).first()[0] == 0


def test_fusion_defers_to_the_anomaly_verdict(spark):
    df = spark.createDataFrame([(s, a) for s in (0, 1) for a in (0, 1)], "s int, a int")
    assert [r[0] for r in df.select(fuse(F.col("s"), F.col("a"))).collect()] == [0, 1, 1, 1]


@pytest.mark.parametrize("slots", [2, 4, 7, 1000])
def test_md5_slot_is_the_full_digest_modulo(spark, slots):
    import hashlib

    keys = [f"10.0.0.{i}" for i in range(50)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r["k"]: r["s"] for r in df.select("k", md5_slot(F.col("k"), slots).alias("s")).collect()}
    assert got == {k: int(hashlib.md5(k.encode()).hexdigest(), 16) % slots for k in keys}


def test_csv_folders_with_other_layouts(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "x.csv").write_text("Source IP, Destination Port, Timestamp\n1.1.1.1, 22,3/7/2017 8:55\n")
    (tmp_path / "b" / "y.csv").write_text(" Timestamp,Source IP\n03/07/2017 08:55:58,2.2.2.2\n")
    df = read_flows(spark, [str(tmp_path / "a"), str(tmp_path / "b")], types={"Destination Port": "int"})
    assert df.columns == ["Source IP", "Destination Port", "Timestamp"]
    assert sorted(r[:2] for r in df.collect()) == [("1.1.1.1", 22), ("2.2.2.2", None)]
    assert df.select(signature_rule(df).alias("s")).agg(F.sum("s")).first()[0] == 1


def test_trimmed_headers_head_and_result_file(spark, tmp_path):
    df = trim_headers(spark.createDataFrame([(i,) for i in (3, 1, 2)], [" seq "]))
    top = head_rows(df, 2)
    assert [r["seq"] for r in top.collect()] == [1, 2]
    write_result(top, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


def test_headers_are_read_without_the_files(spark, tmp_path):
    """The pass over the headers reads a row per file, and none of its lines."""
    import gzip

    from flowsieve.sources import flows

    for i in range(3):
        lines = [f"a{i % 2},b,c"] + [f"{n},{'x' * 40},{n}" for n in range(20_000)]
        (tmp_path / f"f{i}.csv").write_text("\n".join(lines))
    long = ",".join(["a0", "b", "c", *(f"n{k}" for k in range(9_000))])
    (tmp_path / "long name.csv").write_text(f"\ufeff{long}\r\n1,2,3\r\n")
    (tmp_path / "packed.csv.gz").write_bytes(gzip.compress(b"a0,b,c\n7,8,9\n"))
    (tmp_path / "empty.csv").write_text("")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "headers")
    found = sorted(r["header"] for r in flows.header_lines(spark, [str(tmp_path)]).collect())
    jobs = list(tracker.getJobIdsForGroup("headers"))
    spark.sparkContext.setJobGroup("", "")
    assert found == ["a0,b,c", "a0,b,c", "a0,b,c", "a1,b,c", f"\ufeff{long}"]
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in jobs for s in tracker.getJobInfo(j).stageIds}
    assert sum(store.lastStageAttempt(s).inputRecords() for s in stages) == 0
    plain = sorted((r["file"], r["header"].lstrip("\ufeff")) for r in flows._lines_of_blocks(spark, [str(tmp_path)]).collect())
    assert sorted(h.lstrip("\ufeff") for h in found) == sorted(h for _, h in plain)
    got = read_flows(spark, str(tmp_path))
    assert {"a0", "a1", "b", "c", "n8999"} <= set(got.columns) and got.count() == 60_002
