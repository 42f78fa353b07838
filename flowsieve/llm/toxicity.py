"""Toxicity by compression distance: which of two zstandard dictionaries shortens a text's windows more.

Fitting, on a bounded sample of labelled rows (`max_per_class` rows of either label, by a hash of the id):

* the ordinary dictionary is trained by the library on words of ordinary texts;
* the toxic dictionary holds, in front of the same base, the words whose document frequency in toxic texts exceeds that
  in ordinary ones by the likelihood-ratio test, the most telling first. The base cancels what both kinds of text
  share, so ordinary windows give a distance of zero instead of noise;
* the part of the sample kept out of the dictionaries sets the significance to ask for, the window threshold and the
  curve from a document's statistic to the share of toxic documents.

A window is a word, or 48 bytes of a longer one with an overlap of half. A lone word is too short for a compressed
block, so every window stands before the same 64-byte frame that both dictionaries hold: its cost is constant, and the
difference in length is that of the word. A document's statistic is the sum over all its windows of what the
distance exceeds the threshold by. Whole texts are scored, each row by itself, without a shuffle.

What the distance can't see: toxicity that lies in the order of ordinary words alone. One match in place of two saves a byte at most,
which is less than what words differ by.

Null and empty texts have no window and get the score of the statistic zero. Rows that share an id share its label;
of several labels the toxic one counts; null labels and ids teach nothing. Copies of a text are learned from once, and scored each for itself.
Without any toxic or any ordinary sample every score is the toxic share. Other columns pass through, an output replaces one of its name; an
empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name

FRAME = bytes(range(128, 192))
WINDOW = 48
MAX_PER_CLASS = 10_000
#: The dictionaries' sizes, and the most words that are weighed for them: bounds of the fit on its bounded sample.
BASE_BYTES, TOXIC_BYTES = 8192, 1 << 14
_BASE_WORDS = 50_000
_CANDIDATES = 1 << 14
#: With its blanks a word of two bytes is as long as the shortest match.
_LEAST_BYTES = 2
#: Shares of the largest likelihood ratio that a word must reach to enter the dictionary; the best one is chosen.
_SIGNIFICANCE = (0.02, 0.04, 0.07, 0.12, 0.25)
_LEAST_RATIO = 12.0
_THRESHOLDS = (1, 2, 3, 4)
_CACHED = 1 << 19
_EDGE = b".,;:!?\"'()[]*#$%&"


def windows(text: bytes) -> Iterator[bytes]:
    for word in text.lower().split():
        if len(word) <= WINDOW:
            yield word
        else:
            for start in range(0, len(word) - WINDOW // 2, WINDOW // 2):
                yield word[start : start + WINDOW]


def _compressor(dictionary: bytes):
    import zstandard

    parameters = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_GREEDY,
        min_match=4,
        window_log=15,
        hash_log=15,
        chain_log=15,
        search_log=5,
        write_content_size=0,
        write_dict_id=0,
        write_checksum=0,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    prepared = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    prepared.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=prepared, compression_params=parameters).compress


class Distance:
    """Compressed length with the ordinary dictionary less that with the toxic one, for a window."""

    def __init__(self, base: bytes, toxic: bytes):
        self._ordinary, self._toxic = _compressor(base + FRAME), _compressor(toxic + base + FRAME)
        self._known: dict[bytes, int] = {}

    def of(self, window: bytes) -> int:
        known = self._known.get(window)
        if known is None:
            if len(self._known) >= _CACHED:
                self._known.clear()
            framed = b" " + window + b" " + FRAME
            known = self._known[window] = len(self._ordinary(framed)) - len(self._toxic(framed))
        return known

    def excess(self, text: bytes) -> list[int]:
        """For each threshold, the sum over the windows of distance - threshold + 1 where that is positive."""
        counts = [0] * 65
        of = self.of
        for window in windows(text):
            d = of(window)
            if d > 0:
                counts[min(d, 64)] += 1
        return [sum(n * (d - t + 1) for d, n in enumerate(counts) if n and d >= t) for t in _THRESHOLDS]


@dataclass
class ToxicityModel:
    base: bytes
    toxic: bytes
    threshold: int
    #: Steps of the curve: from this statistic on, this share of toxic documents.
    steps: list[tuple[float, float]] = field(default_factory=list)

    def score(self, statistic: float) -> float:
        """Between the steps the curve is linear in the logarithm: the first telling window says more than the tenth."""
        return float(np.interp(math.log1p(statistic), [math.log1p(s) for s, _ in self.steps], [p for _, p in self.steps]))


def _toxic_content(ranked: list[tuple[float, bytes]], share: float) -> bytes:
    least = max(_LEAST_RATIO, share * ranked[0][0]) if ranked else 0.0
    size, chosen = 0, []
    for ratio, word in ranked:
        if ratio < least:
            break
        size += len(word) + 1
        if size <= TOXIC_BYTES:
            chosen.append(word)
    return b" " + b" ".join(reversed(chosen)) + b" " if chosen else b""  # the most telling words end up nearest to the base


def likelihood_ratio(x: int, n: int, y: int, m: int) -> float:
    """Of x among n against y among m; negative where the first share is the smaller one."""

    def likely(k: int, of: int, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((of - k) * math.log1p(-p) if of - k else 0.0)

    if not n or not m:
        return 0.0
    both = (x + y) / (n + m)
    value = 2 * (likely(x, n, x / n) + likely(y, m, y / m) - likely(x, n, both) - likely(y, m, both))
    return value if x / n > y / m else -value


def monotone_curve(statistics: list[float], labels: list[int]) -> list[tuple[float, float]]:
    """Share of toxic rows by statistic, pooled until it never falls; each pool counts half a toxic row among one more."""
    pools: list[list[float]] = []  # sum of labels, rows, least statistic
    for s, y in sorted(zip(statistics, labels, strict=True)):
        if pools and pools[-1][2] == s:
            pools[-1][0] += y
            pools[-1][1] += 1
        else:
            pools.append([y, 1, s])
    merged: list[list[float]] = []
    for pool in pools:
        merged.append(pool)
        while len(merged) > 1 and merged[-2][0] / merged[-2][1] >= merged[-1][0] / merged[-1][1]:
            y, n, _ = merged.pop()
            merged[-1][0] += y
            merged[-1][1] += n
    steps = [(s, (y + 0.5) / (n + 1)) for y, n, s in merged]
    shares = np.maximum.accumulate([p for _, p in steps])
    return [(float(s), float(p)) for (s, _), p in zip(steps, shares, strict=True)]


def _f1(statistics: list[float], labels: list[int]) -> float:
    """The best F1 over all cuts."""
    best, hits, positives = 0.0, 0, sum(labels)
    rows = sorted(zip(statistics, labels, strict=True), reverse=True)
    for i, (s, y) in enumerate(rows):
        hits += y
        if i + 1 == len(rows) or rows[i + 1][0] < s:
            best = max(best, 2 * hits / (i + 1 + positives))
    return best


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of the words of a partition: word, in toxic texts, in ordinary texts."""
    counts: dict[bytes, list[int]] = {}
    for batch in batches:
        for body, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for word in {w.strip(_EDGE) for w in windows(body or b"")}:
                counts.setdefault(word, [0, 0])[0 if toxic else 1] += 1
    words = [w for w in counts if len(w) >= _LEAST_BYTES]
    if words:
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary())] + [pa.array([counts[w][i] for w in words], pa.int64()) for i in (0, 1)],
            names=["word", "toxic", "ordinary"],
        )


def _statistics(base: bytes, toxic: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = [Distance(base, t) for t in toxic]
        for batch in batches:
            made = [[d.excess(body or b"") for d in distances] for body in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([[x for e in row for x in e] for row in made], pa.list_(pa.int64()))], names=["label", "excess"]
            )

    return run


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", max_per_class: int = MAX_PER_CLASS) -> ToxicityModel:
    """Fit on the labelled documents among `docs`, at most about `max_per_class` of either label.

    Give only rows that may be learned from. To the driver go the most telling words (at most 16,384), a sample of
    words for the base (at most 50,000) and a few numbers for each calibration row.
    """
    import zstandard

    marked = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max((F.col(label) > 0).cast("int")).alias("_label"))
    sizes = {r["_label"]: r["n"] for r in marked.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    place = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1_000_000))
    share = F.when(F.col("_label") == 1, max_per_class / max(1, sizes.get(1, 0))).otherwise(max_per_class / max(1, sizes.get(0, 0)))
    chosen = F.broadcast(marked.where(place < share * 1_000_000))  # at most about 2 * max_per_class rows
    part = F.pmod(F.xxhash64(text, F.lit("part")), F.lit(3))  # copies of a text are on one side
    sample = docs.join(chosen, doc_id).select(F.col(text).cast("binary").alias("_body"), "_label", part.alias("_part"))
    known, held = sample.where(F.col("_part") != 0), sample.where(F.col("_part") == 0)
    known = known.dropDuplicates(["_body"])

    n, m = (known.agg(F.sum("_label"), F.sum(1 - F.col("_label"))).first())
    n, m = n or 0, m or 0
    if not n or not m:
        p = (sizes.get(1, 0) + 0.5) / (total + 1)
        return ToxicityModel(b"", b"", 1, [(0.0, p)])
    counts = (
        known.select("_body", "_label").mapInArrow(_words, "word binary, toxic bigint, ordinary bigint")
        .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    )
    telling = (
        counts.where((F.col("toxic") >= 2) & (F.col("toxic") / n > 20 * (F.col("ordinary") + 0.5) / m))
        .orderBy(F.desc("toxic"), "ordinary", "word").limit(_CANDIDATES).collect()
    )
    common = counts.where(F.col("ordinary") >= 2).orderBy(F.xxhash64("word")).limit(_BASE_WORDS).collect()
    ranked = sorted(((likelihood_ratio(r["toxic"], n, r["ordinary"], m), bytes(r["word"])) for r in telling), key=lambda x: (-x[0], x[1]))
    words = [b" " + bytes(r["word"]) + b" " for r in common]
    try:
        base = zstandard.train_dictionary(BASE_BYTES, words, k=24, d=6).as_bytes()[-BASE_BYTES:]
    except zstandard.ZstdError:  # too few words to train on: take them as they are
        base = b"".join(words)[-BASE_BYTES:]
    contents = list(dict.fromkeys(_toxic_content(ranked, s) for s in _SIGNIFICANCE))
    rows = held.select("_body", "_label").mapInArrow(_statistics(base, contents), "label int, excess array<bigint>").collect()
    labels_ = [r["label"] for r in rows]
    if not any(labels_) or all(labels_):  # no room for a choice: trust the strictest words
        return ToxicityModel(base, contents[-1], 3, [(0.0, 0.5 / (m + 1)), (3.0, (n + 0.5) / (n + 1))])
    best = max(
        ((_f1([r["excess"][i] for r in rows], labels_), i) for i in range(len(contents) * len(_THRESHOLDS))),
        key=lambda x: (x[0], x[1]),
    )[1]
    # Back from the sample's share of toxic rows to that of all labelled rows is left out: a row's label decides, not the mix.
    return ToxicityModel(base, contents[best // len(_THRESHOLDS)], _THRESHOLDS[best % len(_THRESHOLDS)], monotone_curve([r["excess"][best] for r in rows], labels_))


def score(docs: DataFrame, model: ToxicityModel, cut: float = 0.7, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from `cut` on) to the columns in `keep`, by default all."""
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("score", "predicted")]
    body = free_name(docs, "_body")
    source = docs.select(*kept, F.col(text).cast("binary").alias(body))
    schema = ", ".join([f"`{c}` {source.schema[c].dataType.simpleString()}" for c in kept] + ["score double", "predicted int"])
    at = _THRESHOLDS.index(model.threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model.base, model.toxic)
        for batch in batches:
            scores = [model.score(distance.excess(body or b"")[at]) for body in (v.as_py() for v in batch.column(len(kept)))]
            arrays = [batch.column(i) for i in range(len(kept))]
            arrays += [pa.array(scores, pa.float64()), pa.array([int(s >= cut) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "score", "predicted"])

    return source.mapInArrow(run, schema)


def remainder(doc_id: str | Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % of
