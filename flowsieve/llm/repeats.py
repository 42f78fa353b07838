"""Exact removal of long repeated strings by suffix sorting, sharded by content.

A byte goes if it lies in a string of `depth` bytes that also starts anywhere else, in the same document or another. Strings
are judged on the input and never cross documents.

1. Every window of `depth` bytes has an anchor: its leftmost least-hashed `GRAM`-byte string. Equal windows have their
   anchor at the same place, so windows whose anchor occurs once are unique and go no further. Windows that follow
   each other and share an anchor are a piece of text.
2. Equal pieces are counted before any text moves. A piece that occurs twice is repeated as a whole. A single piece is open where
   its anchor has other pieces too, and those are the only texts that are sorted.
3. Open pieces are dealt into shards by anchor, so a string and its copies are in one shard; an anchor with more text
   than a shard is split by the windows' place relative to it. Windows whose anchor lies at about the same place in them have
   most of their bytes in common (a context); text whose contexts no other piece has holds no repeat and is left out. The rest of a shard is sorted by
   external induced sorting (`induced_sort`), whose common-prefix values show the repeated windows. An anchor with more text than a shard for each
   place of a window has too many pieces for that: its windows are counted by 128-bit hashes in an aggregation, which needs no
   memory for them.
4. Each document gets its repeated stretches and is cut.

Rows are told apart by hashes of id and text, so copies with different ids do not meet in one task, and rows alike in
both are copies of each other: their spans are counted once. A null text is empty; texts shorter than `depth` stay as they are. A null id is
a value like any other. Very long texts are read in overlapping chunks. An empty table gives an empty one; other columns stay, and an output replaces one of its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import written
from .common import by_bytes, give_back, pieces, sha256, trimmed
from .induced_sort import Shard

GRAM = 32
SHARD_BYTES = 2 << 20
_CHUNK = 1 << 20
#: Groups of windows by the place of their anchor, each with its context.
_CONTEXTS = 8
#: Fields of a piece's place: first byte, windows (at most 255), offset of the anchor.
_WINDOWS, _OFFSET = 8, 8


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        n = 1
        while n < GRAM:  # of two neighbours the hash of both together
            h = h[:-n] * np.uint64(pow(0xBF58476D1CE4E5B9, n, 1 << 64)) + h[n:]
            n *= 2
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return h


def window_pieces(body: bytes, depth: int) -> Iterator[tuple[int, int, int, int]]:
    """(first byte, windows, offset of the anchor, hash of the anchor) for the runs of windows that share an anchor."""
    span = depth - GRAM + 1
    place_bits = np.uint64(_CHUNK.bit_length() + 1)
    for start in range(0, len(body) - depth + 1, _CHUNK):
        data = np.frombuffer(body, np.uint8, min(_CHUNK + depth - 1, len(body) - start), start)
        hashes = _gram_hashes(data)
        # The place below the hash makes the leftmost of equal hashes the least.
        least = (hashes >> place_bits << place_bits) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - span + width], least[span - width :])
        anchor = (least & ((np.uint64(1) << place_bits) - np.uint64(1))).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        at = anchor[first]
        counts = np.diff(np.append(first, len(anchor)))
        yield from zip((first + start).tolist(), counts.tolist(), (at - first).tolist(), hashes[at].view(np.int64).tolist(), strict=True)


def _occurrences(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, bodies = (batch.column(i) for i in range(3))
            rows: list[int] = []
            at: list[int] = []
            anchors: list[int] = []
            content: list[int] = []

            def flush() -> pa.RecordBatch:
                index = pa.array(rows, pa.int32())
                columns = [k1.take(index), k2.take(index), pa.array(at, pa.int64()), pa.array(anchors, pa.int64()), pa.array(np.array(content, np.uint64).view(np.int64))]
                for x in (rows, at, anchors, content):
                    x.clear()
                return pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "at", "anchor", "content"])

            for i, value in enumerate(bodies):
                body = value.as_py() or b""
                for first, windows, offset, anchor in window_pieces(body, depth):
                    rows.append(i)
                    at.append((first << (_WINDOWS + _OFFSET)) | (windows << _OFFSET) | offset)
                    anchors.append(anchor)
                    content.append(xxhash.xxh3_64_intdigest(body[first : first + windows + depth - 1]))
                if len(rows) >= 1 << 16:
                    yield flush()
            if rows:
                yield flush()

    return run


def shared_contexts(texts: list[bytes], places: np.ndarray, single: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of a text, first window, last window) for the texts that may hold a window which another text has too, one of them single.

    places: where each text's anchor begins, which all its windows hold. Windows that begin `low` to `high` bytes before it have in common what is
    from `low` bytes before it to the end of the one that begins `high` before it; equal windows begin as far before it, so what they share is equal.
    """
    windows = np.fromiter(map(len, texts), np.int64, len(texts)) - depth + 1
    borders = [(depth - GRAM + 1) * i // _CONTEXTS for i in range(_CONTEXTS + 1)]
    owners, firsts, lasts, keys = [], [], [], []
    for i, (low, end) in enumerate(zip(borders, borders[1:])):
        first, last = np.maximum(0, places - (end - 1)), np.minimum(windows - 1, places - low)
        own = np.flatnonzero(first <= last)
        size = depth - (end - 1 - low)
        keys += [xxhash.xxh3_64_intdigest(texts[t][at : at + size], i) for t, at in zip(own.tolist(), (places[own] - low).tolist(), strict=True)]
        owners.append(own)
        firsts.append(first[own])
        lasts.append(last[own])
    owner, first, last = (np.concatenate(x) for x in (owners, firsts, lasts))
    _, key, count = np.unique(np.array(keys, np.uint64), return_inverse=True, return_counts=True)
    wanted = np.flatnonzero((count[key] > 1) & (np.bincount(key, single[owner], len(count))[key] > 0))
    wanted = wanted[np.argsort(owner[wanted], kind="stable")]
    if not len(wanted):
        return wanted, wanted, wanted
    owner = owner[wanted]
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    return owner[starts], np.minimum.reduceat(first[wanted], starts), np.maximum.reduceat(last[wanted], starts)


def _sorted_shard(depth: int, memory: int):
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        texts = table.column("text").to_pylist()
        k1, k2, base, place, n = (table.column(c).to_numpy() for c in ("k1", "k2", "first", "place", "n"))
        out: list[list[int]] = [[], [], [], []]
        chosen, low, high = shared_contexts(texts, place, n == 1, depth)
        shard = Shard([texts[i][a : b + depth] for i, a, b in zip(chosen.tolist(), low.tolist(), high.tolist(), strict=True)], depth, memory)
        marked = np.flatnonzero(shard.repeated())
        if len(marked):
            # Runs of marked positions; a run never leaves its text, whose last bytes start no whole string.
            breaks = np.flatnonzero(np.diff(marked) > 1)
            firsts, lasts = marked[np.r_[0, breaks + 1]], marked[np.r_[breaks, len(marked) - 1]]
            owner = np.searchsorted(shard.starts, firsts, side="right") - 1
            keep = n[chosen[owner]] == 1
            owner, firsts, lasts = owner[keep], firsts[keep], lasts[keep]
            shift = base[chosen[owner]] + low[owner] - shard.starts[owner]
            out = [k1[chosen[owner]], k2[chosen[owner]], firsts + shift, lasts + shift + depth]
        del shard, marked
        give_back()  # a shard takes some hundred bytes a byte of text while it is sorted
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in out], schema=schema)

    return run


_TYPES = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary(), "kept_sha256": pa.string()}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _cut(n_kept: int, outputs: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, list] = {o: [] for o in outputs}
            for value, marks in zip(batch.column(1), batch.column(2), strict=True):
                body = value.as_py() or b""
                spans = merged([(m["lo"], m["hi"]) for m in marks.as_py() or ()])
                left, at = [], 0
                for lo, hi in spans:
                    left.append(body[at:lo])
                    at = hi
                left.append(body[at:])
                kept = b"".join(left)
                for o in outputs:
                    made[o].append({"n_bytes": len(body), "n_removed": len(body) - len(kept), "n_spans": len(spans), "kept": kept}[o] if o != "kept_sha256" else sha256(kept))
            arrays = batch.column(0).flatten()[1:] + [pa.array(made[o], _TYPES[o]) for o in outputs]
            yield pa.RecordBatch.from_arrays(arrays, names=[f"_c{i}" for i in range(n_kept)] + list(outputs))

    return run


def _field(place: str, low: int, bits: int) -> Column:
    return F.shiftright(F.col(place), low).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _counted_windows(pieces_: DataFrame, depth: int) -> DataFrame:
    """(k1, k2, lo, hi) of the windows that occur in more than one of the pieces (k1, k2, n, low, text), for single pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 4, 1 << 15):  # a window is some 40 bytes here, and a piece has up to `depth`
                texts = part.column(4).to_pylist()
                count = [len(t) - depth + 1 for t in texts]
                raw = b"".join(xxhash.xxh3_128_digest(t[i : i + depth]) for t, n in zip(texts, count, strict=True) for i in range(n))
                halves = np.frombuffer(raw, "<i8").reshape(-1, 2)
                owner = pa.array(np.repeat(np.arange(len(texts)), count))
                at = np.arange(len(halves)) - np.repeat(np.cumsum(count) - count, count) + part.column(3).to_numpy().repeat(count)
                columns = [pa.array(halves[:, 0]), pa.array(halves[:, 1]), *(part.column(i).take(owner) for i in range(3)), pa.array(at)]
                yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "k1", "k2", "n", "lo"])

    hashed = pieces_.mapInArrow(trimmed(run), "h1 bigint, h2 bigint, k1 bigint, k2 bigint, n bigint, lo bigint")
    windows = written(hashed, "repeat-windows")
    common = written(windows.groupBy("h1", "h2").agg(F.count("*").alias("_n")).where("_n > 1").select("h1", "h2"), "repeat-common")
    single = windows.where("n = 1").join(common, ["h1", "h2"], "left_semi")
    return single.select("k1", "k2", "lo", (F.col("lo") + depth).alias("hi"))


def repeated_spans(keyed: DataFrame, depth: int, shard_bytes: int = SHARD_BYTES, memory: int = 1 << 22) -> DataFrame:
    """(k1, k2, lo, hi): stretches of bytes covered by repeated strings, for rows keyed by _k1, _k2 with _id and _body.

    `memory`: entries that a shard's queues hold before they go to disk.
    """
    found = keyed.select("_k1", "_k2", "_body").mapInArrow(trimmed(_occurrences(depth)), "k1 bigint, k2 bigint, at bigint, anchor bigint, content bigint")
    # Written, so that the join deals both sides itself and can split a hot anchor's partition.
    repeated = written(found.groupBy("anchor").agg(F.count("*").alias("_n")).where("_n > 1").select("anchor"), "repeat-anchors")
    candidates = written(found.join(repeated, "anchor", "left_semi"), "repeat-candidates")
    length = _field("at", _OFFSET, _WINDOWS) + (depth - 1)
    distinct = written(
        candidates.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "at")).alias("_one")).select("anchor", "content", "n", "_one.*"),
        "repeat-pieces",
    )
    span = depth - GRAM + 1
    contested = written(
        distinct.groupBy("anchor")
        .agg(F.count("*").alias("_pieces"), F.min("n").alias("_rarest"), F.sum(length.cast("bigint")).alias("_bytes"))
        .where((F.col("_pieces") > 1) & (F.col("_rarest") == 1))
        .select("anchor", F.ceil(F.col("_bytes") / shard_bytes).alias("parts")),
        "repeat-contested",
    )
    open_ = distinct.join(contested, "anchor")
    text, most = open_.agg(F.sum(length.cast("bigint")), F.max("parts")).first()
    shards = pieces(text or 0, shard_bytes)

    # As parts of a hot anchor no shard can hold stand the parts 0.
    parts = F.when(F.col("parts") <= span, F.col("parts")).otherwise(0).cast("int").alias("parts")
    wanted = open_.select("k1", "k2", "anchor", "n", "at", parts).groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "n", "at", "parts")).alias("_wanted"))  # of one document
    low, windows, offset = F.shiftright("at", _WINDOWS + _OFFSET), _field("at", _OFFSET, _WINDOWS), _field("at", 0, _OFFSET)

    def border(part: Column) -> Column:
        return F.ceil(F.lit(span) * part / F.col("parts")).cast("int") - (span - 1) + F.col("offset")

    held = (
        keyed.join(wanted, (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")))
        .select(
            F.col("_k1").alias("k1"),
            F.col("_k2").alias("k2"),
            "_id",
            F.explode(
                F.transform(
                    "_wanted",
                    lambda w: F.struct(
                        w["anchor"].alias("anchor"), w["n"].alias("n"), w["at"].alias("at"), w["parts"].alias("parts"),
                        F.substring(
                            "_body",
                            F.shiftright(w["at"], _WINDOWS + _OFFSET).cast("int") + 1,
                            F.shiftright(w["at"], _OFFSET).bitwiseAND(F.lit((1 << _WINDOWS) - 1)).cast("int") + (depth - 1),
                        ).alias("text"),
                    ),
                )
            ).alias("_piece"),
        )
        .select("k1", "k2", "_id", "_piece.*")
    )
    cut = (
        held.where(F.col("parts") > 0)
        .select("*", low.alias("low"), windows.alias("windows"), offset.alias("offset"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        .withColumn("_from", F.greatest(F.lit(0), border(F.col("part"))))
        .withColumn("_to", F.least(F.col("windows"), border(F.col("part") + 1)))
        .where(F.col("_from") < F.col("_to"))
        .select(
            F.pmod(F.xxhash64("anchor", "part"), F.lit(shards)).alias("shard"),
            "k1", "k2", "_id", "n",
            (F.col("low") + F.col("_from")).alias("first"),
            (F.col("offset") - F.col("_from")).cast("bigint").alias("place"),
            F.substring("text", F.col("_from") + 1, F.col("_to") - F.col("_from") + (depth - 1)).alias("text"),
        )
    )
    spans = "k1 bigint, k2 bigint, lo bigint, hi bigint"
    partly = cut.groupBy("shard").applyInArrow(_sorted_shard(depth, memory), spans)
    if (most or 0) > span:
        hot = held.where(F.col("parts") == 0).select("k1", "k2", "n", low.alias("low"), "text")
        partly = partly.unionByName(_counted_windows(hot, depth))
    common = distinct.where("n > 1").select("anchor", "content")
    wholly = candidates.join(common, ["anchor", "content"], "left_semi").select("k1", "k2", low.alias("lo"), (low + length).alias("hi"))
    return wholly.unionByName(partly)


def remove_repeats(
    docs: DataFrame,
    depth: int = 200,
    text: str = "text",
    doc_id: str = "doc_id",
    keep: tuple[str, ...] | None = None,
    outputs: tuple[str, ...] = ("n_bytes", "n_removed", "n_spans", "kept"),
    shard_bytes: int = SHARD_BYTES,
    memory: int = 1 << 22,
) -> DataFrame:
    """Documents without their repeated strings of `depth` (33 to 286) bytes.

    keep: columns that stay, all but the text by default; an output replaces a column of its name. outputs: some of n_bytes, n_removed, n_spans (maximal removed
    runs), kept (the remaining bytes), kept_sha256.
    """
    if not GRAM < depth <= 254 + GRAM:
        raise ValueError(f"depth must be in {GRAM + 1}..{254 + GRAM}")
    kept = [c for c in (docs.columns if keep is None else keep) if c != text and c.lower() not in outputs]
    keyed = docs.select(
        F.xxhash64(doc_id, text).alias("_k1"),
        F.xxhash64(F.lit("row"), text, doc_id).alias("_k2"),
        F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)]).alias("_id"),
        F.col(text).cast("binary").alias("_body"),
    )
    spans = repeated_spans(keyed, depth, shard_bytes, memory).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("_spans"))  # of one document, once for rows alike
    # All columns are used here as in `repeated_spans`, so both read one exchange of the texts.
    joined = keyed.join(spans, (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")), "left").select("_id", "_body", "_spans")
    types = {pa.int64(): "bigint", pa.binary(): "binary", pa.string(): "string"}
    schema = ", ".join([f"_c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)] + [f"{o} {types[_TYPES[o]]}" for o in outputs])
    return joined.mapInArrow(trimmed(_cut(len(kept), outputs)), schema).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)], *outputs)
