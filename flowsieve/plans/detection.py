"""The detection pipeline: order, split, scale, forecast, calibrate, fuse."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.records import clean_flows
from ..functions.rules import fuse, signature_rule
from ..operators.ordering import chronological_split, dense_index
from ..operators.recurrent import recurrent_forecast
from ..operators.sequences import FORECASTS, anomaly_threshold, residual, scale_on_train
from ..session import written

# Names of the three detectors in result tables.
DETECTORS = ("signature", "anomaly", "hybrid")


def prepared(
    flows: DataFrame,
    features: Sequence[str],
    time: str = "ts",
    seq: str = "seq",
    label: str = "label",
    numeric: Sequence[str] | None = None,
) -> DataFrame:
    """Clean rows in time order with split, z_<feature>, and the signature
    verdict, which is taken from the raw columns."""
    clean = clean_flows(flows, numeric or features, time)
    narrow = clean.select(seq, time, label, signature_rule(clean).alias("signature"), *features)
    ordered, total = dense_index(narrow, [time, seq])
    return scale_on_train(chronological_split(ordered, total), features)


def residuals(rows: DataFrame, features: Sequence[str], forecast: str | Callable = "mean") -> DataFrame:
    """Rows with a full history and the distance from their forecast."""
    scaled = [f"z_{f}" for f in features]
    predict = {**FORECASTS, "recurrent": recurrent_forecast}[forecast] if isinstance(forecast, str) else forecast
    return predict(rows, scaled).withColumn("residual", residual(scaled))


def detect(
    flows: DataFrame, features: Sequence[str], forecast: str | Callable = "mean", seq: str = "seq", **columns
) -> DataFrame:
    """Test rows with the signature, anomaly and hybrid verdicts.

    The residuals are written once: the threshold needs a pass over them before
    the flags can be set, and they are far narrower than their windows.
    """
    label = columns.get("label", "label")
    rows = prepared(flows, features, seq=seq, **columns)
    scored = written(
        residuals(rows, features, forecast).select(seq, "idx", "split", label, "signature", "residual"), "residuals"
    )
    tau = anomaly_threshold(scored, label=label).first()["tau"]
    # No benign validation row means no threshold and no anomaly.
    anomaly = F.when(F.col("residual") > F.lit(tau).cast("double"), 1).otherwise(0)
    return (
        scored.where(F.col("split") == "test")
        .withColumn("anomaly", anomaly)
        .withColumn("hybrid", fuse(F.col("signature"), F.col("anomaly")))
    )
