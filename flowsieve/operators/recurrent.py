"""A forecaster that is trained on the table: a small recurrent network over the preceding rows.

Every epoch is one pass over the benign rows of train and validation. A task adds up the gradients of its
rows, Spark adds up the tasks, and the driver moves the weights, some hundred numbers. The same pass gives the
validation loss of the weights it started with; where that has not got better for some epochs, training stops,
and the best weights are the result. Scoring runs on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import written
from .sequences import HISTORY, custom_forecast, sequences

# When training stops.
EPOCHS = 20
PATIENCE = 3
LEAST_GAIN = 1e-4
#: Rows whose states along a window stay in a processor's cache.
BLOCK_ROWS = 1000


class Network:
    """h = tanh(x A + h B + b) along the rows of a window, and the forecast h C + c from the last h."""

    def __init__(self, features: int, hidden: int, weights: np.ndarray | None = None, seed: int = 42):
        self.features, self.hidden = features, hidden
        self.shapes = ((features, hidden), (hidden, hidden), (hidden,), (hidden, features), (features,))
        self.size = sum(int(np.prod(s)) for s in self.shapes)
        if weights is None:
            weights = np.random.default_rng(seed).uniform(-1, 1, self.size) / np.sqrt(hidden)
        self.weights = weights

    def _parts(self, flat: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([int(np.prod(s)) for s in self.shapes])
        return [x.reshape(s) for x, s in zip(np.split(flat, ends[:-1]), self.shapes, strict=True)]

    def _states(self, windows: np.ndarray) -> list[np.ndarray]:
        a, b, bias, _, _ = self._parts(self.weights)
        states = [np.zeros((len(windows), self.hidden))]
        for step in range(windows.shape[1]):
            states.append(np.tanh(windows[:, step] @ a + states[-1] @ b + bias))
        return states

    def predict(self, windows: np.ndarray) -> np.ndarray:
        """Windows (rows x length x features) to next vectors (rows x features)."""
        _, _, _, c, bias = self._parts(self.weights)
        return self._states(np.asarray(windows, float))[-1] @ c + bias

    def squared_error(self, windows: np.ndarray, targets: np.ndarray) -> float:
        return float(((self.predict(windows) - targets) ** 2).sum())

    def gradient(self, windows: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, float]:
        """The gradient of the squared error, added up over the rows, and that error."""
        a, b, _, c, bias = self._parts(self.weights)
        states = self._states(windows)
        error = states[-1] @ c + bias - targets
        out = np.zeros(self.size)
        d_a, d_b, d_bias, d_c, d_out = self._parts(out)
        d_c += states[-1].T @ (2 * error)
        d_out += 2 * error.sum(0)
        back = 2 * error @ c.T
        for step in range(windows.shape[1], 0, -1):
            back = back * (1 - states[step] ** 2)
            d_a += windows[:, step - 1].T @ back
            d_b += states[step - 1].T @ back
            d_bias += back.sum(0)
            back = back @ b.T
        return out, float((error**2).sum())


@dataclass
class Descent:
    """Steps with momentum and a scale of its own for every weight."""

    rate: float
    mean: np.ndarray | float = 0.0
    spread: np.ndarray | float = 0.0
    steps: int = 0

    def step(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.steps += 1
        self.mean = 0.9 * self.mean + 0.1 * gradient
        self.spread = 0.999 * self.spread + 0.001 * gradient**2
        mean, spread = self.mean / (1 - 0.9**self.steps), self.spread / (1 - 0.999**self.steps)
        return weights - self.rate * mean / (np.sqrt(spread) + 1e-8)


@dataclass
class Training:
    """The best network, and per epoch the losses of the weights that the epoch started with."""

    network: Network
    train_loss: list[float] = field(default_factory=list)
    validation_loss: list[float] = field(default_factory=list)


def descend(sums: Callable[[Network], np.ndarray], network: Network, rate: float, epochs: int, patience: int) -> Training:
    """sums: of a network the gradient, then error and rows of train, then of validation. One call an epoch, and one for the last weights."""
    done = Training(network)
    descent, best, waited = Descent(rate), np.inf, 0
    for _ in range(epochs + 1):
        total = sums(network)
        gradient, (train, n, validation, m) = total[:-4], total[-4:]
        if not n:
            break
        done.train_loss.append(train / n)
        # Without benign validation rows the training loss decides.
        done.validation_loss.append(validation / m if m else train / n)
        if done.validation_loss[-1] < best - LEAST_GAIN:
            best, waited, done.network = done.validation_loss[-1], 0, network
        else:
            waited += 1
            if waited >= patience:
                break
        network = Network(network.features, network.hidden, descent.step(network.weights, gradient / n))
    return done


def _spark_sums(rows: DataFrame, features: int) -> Callable[[Network], np.ndarray]:
    """rows: is_train, window (flat) and next."""

    def sums(network: Network) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(network.size + 4)
            for batch in batches:
                if not batch.num_rows:
                    continue
                train = batch.column(0).to_numpy(zero_copy_only=False)
                windows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1, features)
                targets = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, features)
                for start in range(0, batch.num_rows, BLOCK_ROWS):
                    own, w, t = (x[start : start + BLOCK_ROWS] for x in (train, windows, targets))
                    gradient, error = network.gradient(w[own], t[own])
                    total[:-4] += gradient
                    total[-4:] += (error, own.sum(), network.squared_error(w[~own], t[~own]), (~own).sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "total"])

        out = np.zeros(network.size + 4)
        for row in rows.mapInArrow(run, "i bigint, total double").groupBy("i").agg(F.sum("total").alias("total")).collect():
            out[row["i"]] = row["total"]
        return out

    return sums


def train_recurrent(
    df: DataFrame,
    features: Sequence[str],
    length: int = HISTORY,
    label: str = "label",
    hidden: int = 16,
    rate: float = 0.02,
    epochs: int = EPOCHS,
    patience: int = PATIENCE,
    seed: int = 42,
) -> Training:
    """Fit on the benign rows of train, stop by the benign rows of validation. The windows are written once for all epochs."""
    benign = sequences(df, features, length).where(F.col("split").isin("train", "validation") & (F.col(label) == 0))
    is_train = (F.col("split") == "train").alias("is_train")
    rows = written(benign.select(is_train, F.flatten("window").alias("window"), "next"), "training-windows")
    return descend(_spark_sums(rows, len(features)), Network(len(features), hidden, seed=seed), rate, epochs, patience)


def recurrent_forecast(df: DataFrame, features: Sequence[str], length: int = HISTORY, label: str = "label", **options) -> DataFrame:
    """Add p_<feature> from a network trained on the table (see `train_recurrent` for the options)."""
    network = train_recurrent(df, features, length, label, **options).network
    return custom_forecast(df, features, network.predict, length)
