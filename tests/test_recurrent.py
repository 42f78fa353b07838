"""The trained forecaster against the same steps in one process."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import recurrent as rec
from flowsieve.operators.sequences import residual, sequences


def wave(spark, n, attacks=()):
    """Two features on a wave, split 70 / 10 / 20, some rows labelled as attacks."""
    rng = np.random.default_rng(n)
    rows = []
    for i in range(n):
        split = "train" if i < n * 7 // 10 else "validation" if i < n * 8 // 10 else "test"
        rows.append((i, split, int(i in attacks), float(np.sin(i / 5) + rng.normal(0, 0.05)), float(np.cos(i / 5) + rng.normal(0, 0.05))))
    return spark.createDataFrame(rows, "idx bigint, split string, label int, x double, y double")


def test_gradient_is_the_slope_of_the_error():
    rng = np.random.default_rng(0)
    net = rec.Network(2, 5, seed=1)
    windows, targets = rng.normal(size=(7, 4, 2)), rng.normal(size=(7, 2))
    gradient, error = net.gradient(windows, targets)
    assert error == pytest.approx(net.squared_error(windows, targets))
    for i in range(net.size):
        up, down = net.weights.copy(), net.weights.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        slope = (rec.Network(2, 5, up).squared_error(windows, targets) - rec.Network(2, 5, down).squared_error(windows, targets)) / 2e-5
        assert gradient[i] == pytest.approx(slope, rel=1e-4, abs=1e-6)


def one_process(df, features, hidden, rate, epochs, patience=3):
    rows = sequences(df, features).where("label = 0").orderBy("idx").collect()
    sides = []
    for split in ("train", "validation"):
        own = [r for r in rows if r["split"] == split]
        sides.append((np.array([r["window"] for r in own]), np.array([r["next"] for r in own])))

    def sums(net):
        gradient, error = net.gradient(*sides[0])
        return np.array([*gradient, error, len(sides[0][0]), net.squared_error(*sides[1]), len(sides[1][0])])

    return rec.descend(sums, rec.Network(len(features), hidden), rate, epochs, patience)


def test_training_on_tasks_is_training_in_one_process(spark):
    df = wave(spark, 400, attacks=range(100, 130)).repartition(5)
    got = rec.train_recurrent(df, ["x", "y"], hidden=6, rate=0.03, epochs=8)
    want = one_process(df, ["x", "y"], 6, 0.03, 8)
    assert len(got.validation_loss) == 9 and np.allclose(got.validation_loss, want.validation_loss)
    assert np.allclose(got.train_loss, want.train_loss) and np.allclose(got.network.weights, want.network.weights)
    assert got.validation_loss[-1] < 0.5 * got.validation_loss[0]


def test_stops_early_and_restores_the_best():
    losses = [5.0, 3.0, 2.0, 2.5, 2.4, 2.3, 1.0]
    seen = []

    def sums(net):
        seen.append(net)
        return np.array([*np.ones(net.size), 10.0, 10, losses[len(seen) - 1] * 4, 4])

    done = rec.descend(sums, rec.Network(1, 2), 0.1, 20, patience=3)
    assert done.validation_loss == losses[:6] and done.network is seen[2]


def test_attacks_do_not_train_and_no_rows_train_nothing(spark):
    df = wave(spark, 200)
    spoiled = df.withColumn("label", F.when(F.col("idx") % 50 == 49, 1).otherwise(0))
    assert rec.train_recurrent(spoiled, ["x"], hidden=3, epochs=2).train_loss != rec.train_recurrent(df, ["x"], hidden=3, epochs=2).train_loss
    none = rec.train_recurrent(df.withColumn("label", F.lit(1)), ["x"], hidden=3)
    assert none.train_loss == [] and np.array_equal(none.network.weights, rec.Network(1, 3).weights)


def test_forecasts_beat_the_mean_on_a_wave(spark):
    from flowsieve.operators.sequences import mean_forecast

    df = wave(spark, 600)
    features = ["x", "y"]

    def error(rows):
        return rows.withColumn("residual", residual(features)).where("split = 'test'").agg(F.avg("residual")).first()[0]

    trained = rec.recurrent_forecast(df, features, hidden=8, rate=0.03, epochs=40)
    assert set(trained.columns) == {*df.columns, "p_x", "p_y"} and trained.count() == 570
    assert error(trained) < 0.5 * error(mean_forecast(df, features))


def test_gradients_are_added_up_by_blocks_of_rows(spark):
    class Watched(rec.Network):
        def gradient(self, windows, targets):
            assert len(windows) <= 1000
            return super().gradient(windows, targets)

    draw = np.random.default_rng(3)
    windows, targets, train = draw.normal(size=(2500, 4, 2)), draw.normal(size=(2500, 2)), draw.random(2500) < 0.7
    data = [(bool(t), w.ravel().tolist(), y.tolist()) for t, w, y in zip(train, windows, targets)]
    rows = spark.createDataFrame(data, "is_train boolean, window array<double>, next array<double>").coalesce(1)
    sums = rec._spark_sums(rows, 2)(Watched(2, 5))
    gradient, error = rec.Network(2, 5).gradient(windows[train], targets[train])
    assert np.allclose(sums[:-4], gradient)
    assert np.allclose(sums[-4:], [error, train.sum(), rec.Network(2, 5).squared_error(windows[~train], targets[~train]), (~train).sum()])
