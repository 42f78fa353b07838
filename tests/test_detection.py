"""Order, scaling, sequences, forecasts, thresholds and reports."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import report as r
from flowsieve.operators.ordering import chronological_split, dense_index
from flowsieve.operators.sequences import (
    HISTORY,
    anomaly_threshold,
    custom_forecast,
    linear_forecast,
    mean_forecast,
    residual,
    scale_on_train,
    sequences,
    vector_distance,
    with_history,
)
from flowsieve.plans.detection import DETECTORS, detect


def labelled(spark, truth, prediction):
    return spark.createDataFrame(list(zip(truth, prediction)), "label int, prediction int")


def report(spark, truth, prediction):
    return r.classification_report(labelled(spark, truth, prediction)).first().asDict()


def test_perfect_predictions(spark):
    got = report(spark, [0, 0, 1, 1, 1], [0, 0, 1, 1, 1])
    assert (got["accuracy"], got["f1_score"], got["far"]) == (1.0, 1.0, 0.0)
    assert all(isinstance(v, float) for v in got.values())
    assert set(got) == {"accuracy", "precision", "recall", "f1_score", "far"}


def test_all_wrong_predictions(spark):
    got = report(spark, [1, 1, 0, 0], [0, 0, 1, 1])
    assert got["accuracy"] == 0.0 and got["recall"] == 0.0


def test_false_alarm_rate(spark):
    assert report(spark, [0, 0, 1], [1, 0, 1])["far"] == 0.5


def test_no_positives_gives_zeros(spark):
    got = report(spark, [0, 0], [0, 0])
    assert (got["precision"], got["recall"], got["f1_score"], got["far"]) == (0.0, 0.0, 0.0, 0.0)


def test_four_decimals(spark):
    got = report(spark, [1, 0, 1, 0, 1, 1, 1], [1, 0, 0, 0, 1, 1, 0])
    assert got == {"accuracy": 0.7143, "precision": 1.0, "recall": 0.6, "f1_score": 0.75, "far": 0.0}


def test_missing_prediction_is_an_error(spark):
    with pytest.raises(Exception, match="differ in length"):
        report(spark, [0, 1], [0, None])


def test_comparison_has_a_row_per_detector(spark):
    df = spark.createDataFrame([(0, 0, 1), (1, 1, 1), (1, 0, 1)], "label int, a int, b int")
    got = {row["model"]: row["accuracy"] for row in r.detector_comparison(df, ["a", "b"]).collect()}
    assert got == {"a": 0.6667, "b": 0.6667}


@pytest.mark.parametrize("part, whole, want", [(1, 2, 0), (3, 2, 2), (5, 2, 2), (7, 3, 2), (0, 5, 0), (14477 * 10000, 20000, 7238)])
def test_integer_rounding_takes_ties_to_even(spark, part, whole, want):
    assert spark.range(1).select(r.rounded_division(F.lit(part), F.lit(whole))).first()[0] == want


def test_efficiency_numbers(spark):
    stats = spark.createDataFrame([(1000, 300, 5, 700, 30.0)], "total_records bigint, duplicates bigint, false_positives bigint, evaluations bigint, dedupe_rate_pct double")
    two, one = (r.efficiency_report(stats, s).first() for s in (2.0, 1.0))
    assert two["throughput_rec_s"] == 500.0 and one["avg_latency_us"] == 1000.0
    assert (two["dedup_rate_pct"], two["bloom_fp_rate_pct"]) == (30.0, 0.5)
    assert r.efficiency_report(stats, 0.0).first()["throughput_rec_s"] >= 0


def test_scan_cost_is_triangular(spark):
    stats = spark.createDataFrame([(4,)], "evaluations bigint")
    assert r.scan_cost(stats).first()["scan_comparisons"] == 10.0


def series(spark, n, pieces=3):
    rng = np.random.default_rng(7)
    values = rng.normal(size=n).round(3)
    rows = [(i, int(1000 - i % 7 + i * 10), float(values[i]), i % 5, int(i % 11 == 0)) for i in range(n)]
    df = spark.createDataFrame(rows, "seq bigint, t bigint, x double, y int, label int").repartition(5)
    return dense_index(df, ["t", "seq"], pieces=pieces)


def test_dense_index_is_the_sorted_position(spark):
    df, n = series(spark, 200)
    got = [r["seq"] for r in df.orderBy("idx").collect()]
    want = [r["seq"] for r in df.orderBy("t", "seq").collect()]
    assert n == 200 and got == want
    assert sorted(r["idx"] for r in df.collect()) == list(range(200))


def test_dense_index_of_nothing(spark):
    df, n = dense_index(spark.range(0), ["id"])
    assert n == 0 and df.count() == 0


def test_split_is_seventy_ten_twenty(spark):
    df, n = series(spark, 101)
    counts = {r["split"]: r["count"] for r in chronological_split(df, n).groupBy("split").count().collect()}
    assert counts == {"train": 70, "validation": 10, "test": 21}


def test_scaling_uses_train_only_and_survives_a_constant(spark):
    df, n = series(spark, 100)
    rows = scale_on_train(chronological_split(df.withColumn("c", F.lit(3.0)), n), ["x", "c"])
    train = rows.where("split = 'train'").agg(F.avg("z_x"), F.stddev_pop("z_x"), F.avg("z_c")).first()
    assert abs(train[0]) < 1e-9 and abs(train[1] - 1) < 1e-9 and train[2] == 0.0
    assert rows.where("z_c is null").count() == 0


@pytest.mark.parametrize("bucket", [10, 16, 4096])
def test_bucketed_history_equals_the_global_one(spark, bucket):
    df, n = series(spark, 150)
    rows = chronological_split(df, n)
    got = with_history(rows, lambda w: {"h": F.collect_list("seq").over(w)}, bucket=bucket)
    got = {r["idx"]: list(r["h"]) for r in got.collect()}
    order = {r["idx"]: (r["seq"], r["split"]) for r in rows.collect()}
    want = {
        i: [order[j][0] for j in range(i - HISTORY, i)]
        for i in order
        if i >= HISTORY and all(order[j][1] == order[i][1] for j in range(i - HISTORY, i))
    }
    assert got == want


def test_sequences_have_ten_rows_and_the_next_vector(spark):
    df, n = series(spark, 60)
    rows = sequences(chronological_split(df, n), ["x", "y"])
    one = rows.orderBy("idx").first()
    assert len(one["window"]) == 10 and len(one["window"][0]) == 2 and one["next"] == [one["x"], float(one["y"])]


def test_custom_forecast_of_the_mean_equals_the_native_mean(spark):
    df, n = series(spark, 80)
    rows = chronological_split(df, n)
    own = custom_forecast(rows, ["x", "y"], lambda batch: batch.mean(axis=1))
    native = mean_forecast(rows, ["x", "y"])
    a, b = ({r["seq"]: (r["p_x"], r["p_y"]) for r in f.collect()} for f in (own, native))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_linear_forecast_learns_a_linear_rule(spark):
    rows = [(i, i, 0.5 * i, 0) for i in range(300)]
    df = spark.createDataFrame(rows, "seq bigint, idx bigint, x double, label int")
    fitted = linear_forecast(chronological_split(df, 300), ["x"])
    worst = fitted.where("split = 'test'").select(F.max(F.abs(F.col("x") - F.col("p_x")))).first()[0]
    assert worst < 0.5


def test_residual_and_vector_distance(spark):
    df = spark.createDataFrame([(3.0, 0.0, 4.0, 0.0)], "a double, p_a double, b double, p_b double")
    assert df.select(residual(["a", "b"])).first()[0] == 5.0
    assert df.select(vector_distance(F.array("a", "b"), F.array("p_a", "p_b"))).first()[0] == 5.0


def test_threshold_is_mean_plus_three_deviations_of_benign_validation(spark):
    rows = [("validation", 0, x) for x in (1.0, 2.0, 3.0)] + [("validation", 1, 99.0), ("train", 0, 50.0)]
    got = anomaly_threshold(spark.createDataFrame(rows, "split string, label int, residual double")).first()
    assert math.isclose(got["tau"], 2 + 3 * np.std([1, 2, 3])) and got["benign_rows"] == 3


@pytest.mark.parametrize("forecast", ["mean", "linear"])
def test_detection_end_to_end(spark, sf, forecast):
    from flowsieve.plans.event_flows import FEATURES, event_flows

    found = detect(event_flows(spark, sf), FEATURES, forecast)
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    assert found.count() == n - n * 8 // 10 - HISTORY
    assert found.where("signature = 1 and hybrid = 0").count() == 0
    assert found.where("signature = 0 and hybrid <> anomaly").count() == 0
    assert r.detector_comparison(found, DETECTORS).count() == 3
