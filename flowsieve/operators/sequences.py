"""Scaling, sliding sequences, forecasts and residuals over a global order."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window
from pyspark.sql.window import WindowSpec

from ..functions.records import floor_div
from ..session import written

# Fixed value: rows of history per sequence.
HISTORY = 10
_BUCKET = 4096


def scale_on_train(df: DataFrame, features: Sequence[str], split: str = "split") -> DataFrame:
    """Add z_<feature>, standardised with mean and population deviation of train.

    A constant feature has deviation 1, so it scales to 0. The statistics are
    two numbers per feature; as literals they stay inside generated code.
    """
    wanted = []
    for f in features:
        wanted += [F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}")]
    fitted = df.where(F.col(split) == "train").agg(*wanted).first()
    scaled = {}
    for f in features:
        mean, spread = fitted[f"m_{f}"], fitted[f"s_{f}"]
        scaled[f"z_{f}"] = (F.col(f) - F.lit(mean)) / F.lit(spread or 1.0)
    return df.withColumns(scaled)


def with_history(
    df: DataFrame,
    outputs: Callable[[WindowSpec], Mapping[str, Column]],
    length: int = HISTORY,
    by: str = "split",
    idx: str = "idx",
    bucket: int = _BUCKET,
) -> DataFrame:
    """Add columns computed over the `length` rows before each row, per split.

    The first `length` rows of a split have no full history and are left out.
    The order is global, so the rows are cut into buckets of consecutive
    numbers, each given a copy of the last `length` rows of the one before: a
    window per bucket then equals the window over all, at bounded size.
    """
    if bucket < length:
        raise ValueError("a bucket must be at least as long as the history")
    home = floor_div(F.col(idx), bucket)
    late = F.col(idx) % bucket >= bucket - length
    expanded = df.withColumn("_bucket", F.explode(F.when(late, F.array(home, home + 1)).otherwise(F.array(home))))
    before = Window.partitionBy(by, "_bucket").orderBy(idx).rowsBetween(-length, -1)
    return (
        expanded.withColumns({**outputs(before), "_n": F.count(F.lit(1)).over(before)})
        .where((F.col("_bucket") == home) & (F.col("_n") == length))
        .drop("_bucket", "_n")
    )


def sequences(df: DataFrame, features: Sequence[str], length: int = HISTORY) -> DataFrame:
    """Add `window` (length x features) of the preceding rows and `next` (features)."""
    vector = F.array(*[F.col(f).cast("double") for f in features])
    out = with_history(df, lambda w: {"window": F.collect_list(vector).over(w)}, length)
    return out.withColumn("next", vector)


def mean_forecast(df: DataFrame, features: Sequence[str], length: int = HISTORY) -> DataFrame:
    """Add p_<feature>: the mean of the preceding rows."""
    return with_history(df, lambda w: {f"p_{f}": F.avg(f).over(w) for f in features}, length)


def linear_forecast(df: DataFrame, features: Sequence[str], length: int = HISTORY, label: str = "label") -> DataFrame:
    """Add p_<feature>: an autoregression on the feature's own preceding values,
    fitted by least squares on the benign rows of train.

    The lagged rows are written once. One pass adds up the normal equations of
    all features, a row per feature and task; what goes to the driver is
    (length + 1) x (length + 2) numbers per feature.
    """
    lags = {f: [f"_{f}_{k}" for k in range(1, length + 1)] for f in features}

    def lagged(w):
        return {n: F.nth_value(f, length - k).over(w) for f in features for k, n in enumerate(lags[f])}

    rows = written(with_history(df, lagged, length), "lags")
    train = rows.where((F.col("split") == "train") & (F.col(label) == 0))
    width = length + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(features), width, width + 1))
        for batch in batches:
            for i in range(len(features)):
                own = [batch.column(i * width + j).to_numpy(zero_copy_only=False) for j in range(width)]
                known = np.column_stack([np.ones(batch.num_rows), *own[1:]])
                sums[i] += known.T @ np.column_stack([known, own[0]])
        at = np.indices(sums.shape).reshape(3, -1)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(x, pa.int32()) for x in at), pa.array(sums.ravel())], names=["feature", "i", "j", "total"]
        )

    columns = [F.col(c).cast("double") for f in features for c in (f, *lags[f])]
    totals = (
        train.select(*columns)
        .mapInArrow(equations, "feature int, i int, j int, total double")
        .groupBy("feature", "i", "j")
        .agg(F.sum("total").alias("total"))
        .collect()
    )
    system = np.zeros((len(features), width, width + 1))
    for r in totals:
        system[r["feature"], r["i"], r["j"]] = r["total"]
    for f, equation in zip(features, system, strict=True):
        solution = np.linalg.lstsq(equation[:, :-1], equation[:, -1], rcond=None)[0].tolist()
        forecast = F.lit(solution[0])
        for weight, lag in zip(solution[1:], lags[f], strict=True):
            forecast = forecast + F.lit(weight) * F.col(lag)
        rows = rows.withColumn(f"p_{f}", forecast)
    return rows.drop(*[n for names in lags.values() for n in names])


def custom_forecast(
    df: DataFrame, features: Sequence[str], predict: Callable, length: int = HISTORY
) -> DataFrame:
    """Add p_<feature> from a model of the user's own.

    `predict` maps a batch of sequences (rows x length x features) to the next
    vectors (rows x features), both numpy arrays; it runs on Arrow batches.
    """
    @F.pandas_udf("array<double>")
    def score(windows: pd.Series) -> pd.Series:
        batch = np.stack([np.stack(w) for w in windows]) if len(windows) else np.empty((0, length, len(features)))
        return pd.Series(list(np.asarray(predict(batch), dtype="float64")))

    rows = sequences(df, features, length).withColumn("_p", score("window"))
    for i, f in enumerate(features):
        rows = rows.withColumn(f"p_{f}", F.col("_p")[i])
    return rows.drop("_p", "window", "next")


FORECASTS = {"mean": mean_forecast, "linear": linear_forecast}


def residual(features: Sequence[str]) -> Column:
    """Euclidean distance between the forecast and the row itself."""
    total = F.lit(0.0)
    for f in features:
        total = total + (F.col(f) - F.col(f"p_{f}")) * (F.col(f) - F.col(f"p_{f}"))
    return F.sqrt(total)


def vector_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two array columns of equal length."""
    squares = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def anomaly_threshold(df: DataFrame, deviations: float = 3.0, label: str = "label") -> DataFrame:
    """tau: mean plus three population deviations of benign validation residuals."""
    benign = df.where((F.col("split") == "validation") & (F.col(label) == 0))
    return benign.agg(
        (F.avg("residual") + F.lit(deviations) * F.stddev_pop("residual")).alias("tau"),
        F.count("*").alias("benign_rows"),
    )
