"""Language identification as a mixture: which languages, and how much of each, explain a document's n-grams.

Learning counts hashed character trigrams (of lower-cased bytes, every run of non-letters as one blank) per language over all
training documents: tables of a fixed size, added up natively. A document is then a bag of trigrams drawn from a
mixture of the learned languages; expectation-maximisation finds the proportions. Languages enter one at a time, the
one whose gradient is largest first, and stay only if the log-likelihood gains more than the penalty: half the log of the
number of trigrams for each further language (BIC) plus a gain per trigram that chance does not reach.

EM is run only where it can matter: the log-likelihood is concave in the proportions, so a single language is
known to be the best choice where its gradient bounds the possible gain by the penalty. This skips no case.

The model, which goes to every task, has at most `MODEL_BYTES`: with more languages than that holds tables for, neighbouring buckets
are one, down to `LEAST_BUCKETS`. More languages than those serve are an error.

Whole texts are used, of any length. `und` is the verdict for null texts and for texts without any letter; their score is 0. Rows
are predicted one by one, whatever their id, language or source, repeated ones alike; other columns pass through, and an output replaces one of its
name. Of equally likely languages the first by name counts. Without any training text every prediction is `und`; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import free_name, trimmed

UNDETERMINED = "und"
#: Entries of a language's table of trigram counts; what goes to the driver is this many numbers a language.
BUCKETS = 1 << 16
LEAST_BUCKETS = 1 << 10
MODEL_BYTES = 256 << 20
_SMOOTHING = 0.5
#: Least gain in log-likelihood per trigram by a further language.
_LEAST_GAIN = 0.01
_ROUNDS = 30
_SLICE = 1 << 18  # bytes of text that are worked on together

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[: ord("A")] = 32
_CLASS[ord("A") : ord("Z") + 1] += 32
_CLASS[ord("Z") + 1 : ord("a")] = 32
_CLASS[ord("z") + 1 : 128] = 32


def trigrams(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts, and the number of each text's first one (with the total as the last)."""
    # A blank on either side of each text; a trigram that spans two texts is left out below.
    joined = _CLASS[np.frombuffer(b" " + b"  ".join(bodies) + b" ", np.uint8)]
    lengths = np.fromiter((len(b) + 2 for b in bodies), np.int64, len(bodies))
    owner = np.repeat(np.arange(len(bodies)), lengths)
    # Runs of blanks count as one, within a text.
    same = np.zeros(len(joined), bool)
    same[1:] = (joined[1:] == 32) & (joined[:-1] == 32) & (owner[1:] == owner[:-1])
    joined, owner = joined[~same], owner[~same]
    if len(joined) < 3:
        return np.empty(0, np.int64), np.zeros(len(bodies) + 1, np.int64)
    wide = joined.astype(np.uint32)
    codes = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    inside = owner[2:] == owner[:-2]
    hashed = ((codes * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)[inside]
    counts = np.bincount(owner[:-2][inside], minlength=len(bodies))
    return hashed, np.concatenate(([0], np.cumsum(counts)))


def has_letter(body: bytes | None) -> bool:
    if not body:
        return False
    if any(65 <= b <= 90 or 97 <= b <= 122 for b in body[:256]):
        return True
    return any(map(str.isalpha, body.decode("utf-8", "replace")))  # U+FFFD is no letter


def slices(bodies: list[bytes], size: int = _SLICE) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, body in enumerate(bodies):
        if held and held + len(body) > size:
            yield start, i
            start, held = i, 0
        held += len(body)
    yield start, len(bodies)


@dataclass
class LanguageModel:
    languages: list[str]
    #: Probability of each bucket (row) under each language (column).
    table: np.ndarray
    #: Bits by which buckets are folded.
    shift: int = 0

    def mixtures(self, bodies: list[bytes]) -> np.ndarray:
        """Proportions of the languages, one row a text; a text without trigrams has zeros."""
        out = np.zeros((len(bodies), len(self.languages)))
        for start, end in slices(bodies):
            out[start:end] = self._mixtures(bodies[start:end])
        return out

    def _mixtures(self, bodies: list[bytes]) -> np.ndarray:
        hashed, starts = trigrams(bodies)
        hashed >>= self.shift
        sizes = np.diff(starts)
        out = np.zeros((len(bodies), len(self.languages)))
        some = np.flatnonzero(sizes)
        if not len(some) or not self.languages:
            return out
        at = starts[:-1][some]
        logs = np.stack([np.add.reduceat(np.log(self.table[:, k])[hashed], at) for k in range(len(self.languages))], 1)
        best = logs.argmax(1)
        out[some, best] = 1.0
        if len(self.languages) == 1:
            return out
        # Gradient at the best single language: sum of p(other) / p(best), at most its excess over n can be gained.
        chosen = self.table[hashed, np.repeat(best, sizes[some])]
        slope = np.stack([np.add.reduceat(self.table[hashed, k] / chosen, at) for k in range(len(self.languages))], 1)
        penalty = 0.5 * np.log(sizes[some]) + _LEAST_GAIN * sizes[some]
        for i in np.flatnonzero(slope.max(1) - sizes[some] > penalty):
            grams, counts = np.unique(hashed[at[i] : at[i] + sizes[some[i]]], return_counts=True)
            out[some[i]] = self._select(self.table[grams], counts, int(best[i]), logs[i, best[i]], penalty[i])
        return out

    def _select(self, likely: np.ndarray, counts: np.ndarray, first: int, value: float, penalty: float) -> np.ndarray:
        """Forward selection of the language set by penalised likelihood."""
        chosen, shares = [first], np.ones(1)
        while len(chosen) < likely.shape[1]:
            slope = (counts / (likely[:, chosen] @ shares)) @ likely
            slope[chosen] = -np.inf
            entering = int(slope.argmax())
            if slope[entering] - counts.sum() <= penalty:
                break
            tried = [*chosen, entering]
            new_shares, new_value = expectation_maximisation(likely[:, tried], counts)
            if new_value - value <= penalty:
                break
            chosen, shares, value = tried, new_shares, new_value
        out = np.zeros(likely.shape[1])
        out[chosen] = shares
        return out


def expectation_maximisation(likely: np.ndarray, counts: np.ndarray, rounds: int = _ROUNDS) -> tuple[np.ndarray, float]:
    """Mixture proportions of the columns of `likely`, and the log-likelihood there."""
    shares = np.full(likely.shape[1], 1 / likely.shape[1])
    for _ in range(rounds):
        joint = likely * shares
        new = (counts / joint.sum(1)) @ joint / counts.sum()
        done = np.abs(new - shares).max() < 1e-4
        shares = new
        if done:
            break
    return shares, float(counts @ np.log(likely @ shares))


def folding(languages: int, model_bytes: int) -> int:
    """By how many bits the buckets are folded, so that a model of so many languages fits."""
    shift = 0
    while languages * (BUCKETS >> shift) * 8 > model_bytes:
        shift += 1
    if BUCKETS >> shift < LEAST_BUCKETS:
        raise ValueError(f"{languages} languages have no model within {model_bytes} bytes")
    return shift


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", model_bytes: int = MODEL_BYTES) -> LanguageModel:
    """Learn from all rows with a text and a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, end in slices(bodies):
                hashed, starts = trigrams(bodies[start:end])
                sizes = np.diff(starts)
                for name in set(langs[start:end]):
                    of = np.repeat(np.array([x == name for x in langs[start:end]]), sizes)
                    tables[name] = tables.get(name, 0) + np.bincount(hashed[of], minlength=BUCKETS)
        for name, table in tables.items():
            seen = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen)), pa.array(seen, pa.int32()), pa.array(table[seen], pa.int64())], names=["lang", "gram", "n"])

    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("binary").alias("body"))
    # A task's counts are added up before they leave it: at most a table a language and task is shuffled.
    counted = rows.mapInArrow(trimmed(count), "lang string, gram int, n bigint")
    shift = folding(docs.agg(F.count_distinct(lang)).first()[0], model_bytes)  # of the column alone, texts are not read
    folded = counted.groupBy("lang", F.shiftright("gram", shift).alias("gram")).agg(F.sum("n").alias("n"))
    found = folded.toArrow()  # of a model's size
    names = found.column("lang").to_pylist()
    languages = sorted(set(names))
    place = {name: i for i, name in enumerate(languages)}
    counts = np.zeros((BUCKETS >> shift, len(languages)))
    if languages:
        counts[found.column("gram").to_numpy(), [place[x] for x in names]] = found.column("n").to_numpy()
    counts += _SMOOTHING
    return LanguageModel(languages, counts / counts.sum(0, keepdims=True) if languages else counts, shift)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] | None = None, mixture: bool = False) -> DataFrame:
    """Adds lang_pred and score, the share of that language, and with `mixture` the map of all shares."""
    outputs = ["lang_pred", "score"] + ["mixture"] * mixture
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in outputs]
    body = free_name(docs, "_body")
    source = docs.select(*kept, F.col(text).cast("binary").alias(body))
    types = {"lang_pred": "string", "score": "double", "mixture": "map<string,double>"}
    schema = ", ".join([f"`{c}` {source.schema[c].dataType.simpleString()}" for c in kept] + [f"{o} {types[o]}" for o in outputs])
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # of at most MODEL_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        for batch in batches:
            bodies = batch.column(len(kept)).to_pylist()
            shares = model.mixtures([b or b"" for b in bodies])
            known = [bool(s.any()) and has_letter(b) for s, b in zip(shares, bodies, strict=True)]
            names = [model.languages[s.argmax()] if k else UNDETERMINED for s, k in zip(shares, known, strict=True)]
            scores = [float(min(1.0, s.max())) if k else 0.0 for s, k in zip(shares, known, strict=True)]
            arrays = [batch.column(i) for i in range(len(kept))] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            if mixture:
                maps = [[(n, float(x)) for n, x in zip(model.languages, s, strict=True) if k and x] for s, k in zip(shares, known, strict=True)]
                arrays.append(pa.array(maps, pa.map_(pa.string(), pa.float64())))
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *outputs])

    return source.mapInArrow(trimmed(run), schema)
