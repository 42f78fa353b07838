"""SimHash near-dedup with pivot distance tables.

1. A text's fingerprint has a bit set where more than half of its shingles' hashes have it set.
2. Equal fingerprints are one member. Members are dealt into groups by parts of their bits:
   * `exact_keys`: the bits are cut into blocks; members within `radius` bits agree on all but `radius` blocks, so
     every choice of that many blocks is a table and no pair is lost;
   * `sampled_keys`: for a radius too wide for that, tables of randomly chosen bits, as many as a pair at the radius needs to
     meet with the wanted probability.
   The number of key bits grows with the members, so that groups stay small.
3. Within a group the distances of each member to many reference fingerprints are its coordinates. By the triangle
   inequality two members within the radius differ by no more than it in any coordinate: pairs are made along the
   first coordinate alone, those that differ by more in another are discarded, the survivors' fingerprints are compared.
4. A task keeps a spanning forest of its links, not the links; components are found by stars.

Groups beyond `GROUP` members are cut into chunks and every two chunks meet in a task of their own: no cap, no single
large task. Documents without words have the fingerprint zero, linked like any other. A null text has no words. Rows
with a null id are linked too; the component's id is the smallest id that is not null, null if there is none. Rows that share an id, or are
alike, are documents of their own; `keep_one` takes rows alike in id and text as one. Texts are read whole, however long. An empty table
gives an empty one. Other columns, whatever their names, are not read but by `keep_one`, which returns them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import written
from .common import free_name, pieces, trimmed
from .components import components

GROUP = 2048
_ROWS_PER_PARTITION = 1 << 19
_ROWS_AT_ONCE = 1 << 15
_PAIRS_AT_ONCE = 1 << 17
PIVOTS = 32


def _shingles(body: bytes | None, words: int) -> list[bytes]:
    tokens = (body or b"").lower().split()  # of bytes: A-Z, and the six white space characters
    if not tokens:
        return []
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    first, last = [0, *(ends[:-1] + 1).tolist()], ends.tolist()
    return [joined[a:b] for a, b in zip(first, last[words - 1 :])] or [joined]  # noqa: B905  fewer ends than starts


def fingerprint(body: bytes | None, words: int = 4, seed: int = 42, bits: int = 64) -> bytes:
    """Big-endian fingerprint of `bits` (a multiple of 64); bits beyond 64 come from the seeds after `seed`."""
    shingles = _shingles(body, words)
    if not shingles:
        return bytes(bits // 8)
    out = []
    for part in range(bits // 64):
        digest, own = xxhash.xxh64_digest, seed + part
        hashes = np.frombuffer(b"".join([digest(s, own) for s in shingles]), np.uint8).reshape(-1, 8)
        ones = np.zeros(64, np.int64)
        for start in range(0, len(hashes), 1 << 16):
            ones += np.unpackbits(hashes[start : start + (1 << 16)], axis=1).sum(0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(hashes)).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, bits: int = 64, text: str = "text", keep: tuple[str, ...] | None = None, out: str = "fp") -> DataFrame:
    """Adds the fingerprint as binary to the columns in `keep`, by default all."""
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != out.lower()]
    source = docs.select(*kept, F.col(text).cast("binary").alias(free_name(docs, "_body")))
    schema = ", ".join([f"`{c}` {source.schema[c].dataType.simpleString()}" for c in kept] + [f"{out} binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([fingerprint(v.as_py(), words, seed, bits) for v in batch.column(len(kept))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), made], names=[*kept, out])

    return source.mapInArrow(trimmed(run), schema)


def _bit_keys(bits: np.ndarray, table: int, chosen: np.ndarray) -> np.ndarray:
    """A 63-bit key of the chosen bits (members in rows of `bits`) and the table; equal bits have equal keys."""
    packed = np.packbits(bits[:, chosen], axis=1)
    wide = np.zeros((len(packed), -(-packed.shape[1] // 8) * 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    key = np.full(len(bits), 0x9E3779B97F4A7C15 * (2 * table + 1) % (1 << 64), np.uint64)
    with np.errstate(over="ignore"):
        for column in wide.view("<u8").T:
            key = (key ^ column) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(29)
    return (key >> np.uint64(1)).astype(np.int64)


def exact_keys(members: int, bits: int, radius: int) -> list[np.ndarray]:
    """The bits of each table, such that any two members within `radius` share a key in one of them.

    The fewest blocks, and so tables, whose keys still set about every member apart.
    """
    for blocks in range(radius + 2, bits + 1):
        cuts = np.array_split(np.arange(bits), blocks)
        free = blocks - radius
        if bits * free / blocks >= min(math.log2(max(members, 2)) + 3, 0.6 * bits):
            break
    return [np.concatenate(c) for c in combinations(cuts, free)]


def sampled_keys(members: int, bits: int, radius: int, sure: float, together: int = 8) -> list[np.ndarray]:
    """Tables of random bits that a pair at `radius` shares one of with probability `sure`; closer pairs, more surely.

    together: members with one key, were all bits random; with more of them there are fewer tables and more pairs in each.
    """
    each = min(bits, max(8, math.ceil(math.log2(max(members, 2)) - math.log2(together))))
    met = (1 - radius / bits) ** each
    tables = math.ceil(math.log(1 - sure) / math.log1p(-met))
    random = np.random.default_rng(1)
    return [np.sort(random.choice(bits, each, replace=False)) for _ in range(tables)]


def _keyed(tables: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = batch.column(0)
                bits = np.unpackbits(np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(batch.num_rows, -1), axis=1)
                for table, chosen in enumerate(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(_bit_keys(bits, table, chosen)), raw], names=["key", "fp"])

    return run


def pivots(bits: int, count: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: fixed pseudo-random ones."""
    return np.random.default_rng(64).integers(0, 1 << 64, (count, bits // 64), np.uint64, endpoint=False)


def _links(group: np.ndarray, side: np.ndarray, fps: np.ndarray, radius: int, references: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group, of different sides where there are two, within `radius`; rows are sorted by group."""
    words = np.ascontiguousarray(fps.T)
    table = np.stack([np.bitwise_count(fps ^ p).sum(1, dtype=np.int32) for p in references], 1)
    two_sided = side >= 0
    order = np.lexsort((table[:, 0], group))
    place = group[order] * (64 * fps.shape[1] + radius + 2) + table[order, 0]
    ends = np.searchsorted(place, place + radius, side="right")
    partners = ends - np.arange(len(order)) - 1
    total = np.cumsum(partners)
    start = 0
    while start < len(order):
        done = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, done + _PAIRS_AT_ONCE, side="right")))
        own = partners[start:end]
        left = np.repeat(np.arange(start, end), own)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(own) - own, own)
        left, right = order[left], order[right]
        apart = ~two_sided[left] | (side[left] != side[right])
        left, right = left[apart], right[apart]
        for column in table.T[1:]:
            near = np.abs(column[left] - column[right]) <= radius
            left, right = left[near], right[near]
        apart = sum(np.bitwise_count(c[left] ^ c[right]).astype(np.int16) for c in words)
        near = apart <= radius
        yield left[near], right[near]
        start = end


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component under the links."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        open_ = a != b
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, root[root]):
            root = root[root]
    return root


def _link(radius: int, bits: int):
    references = pivots(bits)

    def flush(rows: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        cell, side, fps, raw = (np.concatenate(x) for x in zip(*rows, strict=True))
        change = (cell[1:] != cell[:-1]).any(1)
        group = np.concatenate(([0], np.cumsum(change)))
        found = [x for x in _links(group, side, fps, radius, references) if len(x[0])]
        if found:
            root = local_roots(len(fps), *(np.concatenate(x) for x in zip(*found, strict=True)))
            moved = np.flatnonzero(root != np.arange(len(fps)))
            yield pa.RecordBatch.from_arrays([pa.array(raw[moved], pa.binary()), pa.array(raw[root[moved]], pa.binary())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            raw = np.array(batch.column(4).to_pylist(), object)
            fps = np.frombuffer(b"".join(raw), ">u8").astype(np.uint64).reshape(batch.num_rows, -1)
            rows = (cell, batch.column(3).to_numpy(), fps, raw)
            held.append(rows)
            count += batch.num_rows
            if count >= _ROWS_AT_ONCE:
                # Up to the last change of cell; a cell has at most about two chunks of members.
                rows = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                last = np.flatnonzero((rows[0][1:] != rows[0][:-1]).any(1))
                if len(last):
                    cut = int(last[-1]) + 1
                    yield from flush([tuple(x[:cut] for x in rows)])
                    rows = tuple(x[cut:] for x in rows)
                held, count = [rows], len(rows[0])
        if held:
            yield from flush(held)

    return run


def links(members: DataFrame, radius: int = 4, bits: int = 64, keys: Callable[[int, int, int], list[np.ndarray]] = exact_keys, group: int = GROUP) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) with the same components as all links within `radius`."""
    n = members.count()
    tables = keys(n, bits, radius)
    keyed = members.select("fp").mapInArrow(trimmed(_keyed(tables)), "key bigint, fp binary")
    large = keyed.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > group)
    chunks = F.ceil(F.coalesce("_n", F.lit(1)) / group).cast("int")
    chunk = F.pmod(F.xxhash64("fp"), F.col("_chunks")).cast("int")
    cells = (
        keyed.join(large, "key", "left")
        .select("key", "fp", chunks.alias("_chunks"))
        .select("key", "fp", "_chunks", chunk.alias("_own"))
        .select("key", "fp", "_own", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_other"))
        .select(
            "key",
            F.least("_own", "_other").alias("_a"),
            F.greatest("_own", "_other").alias("_b"),
            # Within one chunk all pairs count, between two only those across.
            F.when(F.col("_own") == F.col("_other"), -1).otherwise(F.col("_own")).alias("_side"),
            "fp",
        )
        .repartition(pieces(n * len(tables), _ROWS_PER_PARTITION), "key", "_a", "_b")
        .sortWithinPartitions("key", "_a", "_b")
    )
    return cells.mapInArrow(trimmed(_link(radius, bits)), "a binary, b binary")


def classes(marked: DataFrame, radius: int = 4, bits: int = 64, keys: Callable[[int, int, int], list[np.ndarray]] = exact_keys, doc_id: str = "doc_id") -> DataFrame:
    """(fp, component_id) for every fingerprint of `marked` (columns fp and the id)."""
    members = written(marked.groupBy("fp").agg(F.min(doc_id).alias("_least")), "simhash-members")
    roots = components(links(members, radius, bits, keys), "simhash-components")
    of = members.join(roots, members["fp"] == roots["node"], "left").select("fp", "_least", F.coalesce("root", "fp").alias("_root"))
    smallest = of.groupBy("_root").agg(F.min("_least").alias("component_id"))
    return of.join(smallest, "_root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, bits: int = 64, keys: Callable[[int, int, int], list[np.ndarray]] = exact_keys, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: its id, fingerprint in hexadecimal digits, and the smallest id of its component."""
    marked = written(fingerprints(docs.select(doc_id, text), words, bits=bits, text=text, keep=(doc_id,)), "simhash")
    named = classes(marked, radius, bits, keys, doc_id)
    return marked.join(named, "fp").select(doc_id, F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int, words: int = 5, bits: int = 256, keys: Callable[[int, int, int], list[np.ndarray]] = exact_keys, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Of each component the row with the smallest id (then text, by its hash), with all its columns.

    Rows alike in id and text are one row. A null id is the smallest.
    """
    first, second = free_name(docs, "_h1"), free_name(docs, "_h2")
    named = docs.withColumns({first: F.xxhash64(doc_id, text), second: F.xxhash64(F.lit("row"), text, doc_id)})
    row = F.struct(doc_id, first, second).alias("_row")
    marked = written(fingerprints(named.select(row, text), words, bits=bits, text=text, keep=("_row",)), "simhash")
    kept = classes(marked, radius, bits, keys, "_row").select(F.col(f"component_id.{first}").alias(first), F.col(f"component_id.{second}").alias(second)).distinct()
    return named.join(kept, [first, second], "left_semi").dropDuplicates([first, second]).select(docs.columns)
