"""Line dedup by probing a sharded minimal perfect hash.

A line's key is the line without white space `[\\x20\\x09-\\x0D]` at both ends and with A-Z lower-cased. Keys of at
least `min_chars` code points held by at least `min_docs` documents lose all their lines except in the document with
the largest id that holds them.

1. Documents are dealt into blocks of a bounded size. A block's distinct keys, as 128-bit hashes with the number of
   documents and the largest id, go packed to shards of the hash space. A line that every document has is one entry
   per block, so no shard gets more than its share.
2. A shard adds its entries up, builds a minimal perfect hash over its distinct keys, with arrays of 64-bit fingerprints, 32-bit
   counts and keepers by slot, and probes it with every block's keys. Keys whose count is high enough go back.
3. Each block gets its hits and rewrites its documents. Lines themselves are never joined or shuffled apart from
   their document.

Blocks and shards are numbered by the size of the data, so their size stays the same when the data grow. A row
counts as a document of its own, also one of several with an id, or alike in id and text. A null id sorts below all others; rows that share the
largest id all keep the line. A null or empty text is one empty line; it comes back as an empty text. Very long texts and lines are
split and hashed whole. An empty table gives an empty one; an output replaces a column of its name, other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import NO_ID, pieces, sha256, text_bytes, trimmed

BLOCK_BYTES = 4 << 20
SHARD_BYTES = 32 << 20
PARTITION_BLOCKS = 4
_GAMMA = 2.0
_ENTRY = np.dtype([("hi", "<u8"), ("lo", "<u8"), ("docs", "<u4"), ("keeper", "<i8")])
_HIT = np.dtype([("hi", "<u8"), ("lo", "<u8"), ("keeper", "<i8")])


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line's 16-byte hash, None if its key is too short."""
    key = line.strip()  # of bytes: exactly the six white space characters above
    if len(key) < min_chars:
        return None
    if len(key) < 4 * min_chars and len(key) - sum(0x80 <= b < 0xC0 for b in key) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.lower())  # of bytes: A-Z alone


def _spread(hi: np.ndarray, lo: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = hi ^ (lo + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * (np.uint64(0x94D049BB133111EB) + np.uint64(2) * lo)
        return x ^ (x >> np.uint64(32))


class MinimalPerfectHash:
    """n distinct 128-bit keys to 0..n-1: levels of bit arrays, a key's slot is the rank of its bit."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        base = 0
        while len(hi):
            size = int(_GAMMA * len(hi)) // 64 * 64 + 64
            at = _spread(hi, lo, len(self.levels)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            ranks = base + np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]))
            self.levels.append((words, ranks, size))
            base += int(alone.sum())
            rest = ~alone[at.astype(np.int64)]
            hi, lo = hi[rest], lo[rest]
        self.n = base

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 or any slot for keys that are not among the n."""
        out = np.full(len(hi), -1, np.int64)
        open_ = np.arange(len(hi))
        for level, (words, ranks, size) in enumerate(self.levels):
            if not len(open_):
                break
            at = _spread(hi[open_], lo[open_], level) % np.uint64(size)
            word, bit = words[at >> np.uint64(6)], at & np.uint64(63)
            found = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[found]] = (ranks[at >> np.uint64(6)] + below)[found]
            open_ = open_[~found]
        return out


class LineIndex:
    """Fingerprints, counts and keepers of distinct keys, by slot of a minimal perfect hash."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, docs: np.ndarray, keeper: np.ndarray):
        self.hash = MinimalPerfectHash(hi, lo)
        slot = self.hash.slots(hi, lo)
        self.fingerprints = np.empty(len(hi), np.uint64)
        self.docs, self.keepers = np.empty(len(hi), np.uint32), np.empty(len(hi), np.int64)
        self.fingerprints[slot], self.docs[slot], self.keepers[slot] = hi, docs, keeper

    def probe(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are in the index, and the slot of those."""
        slot = self.hash.slots(hi, lo)
        hit = slot >= 0
        hit[hit] = self.fingerprints[slot[hit]] == hi[hit]
        return hit, slot[hit]


def totals(entries: np.ndarray) -> np.ndarray:
    """One entry a key: documents added up, the largest id."""
    entries = entries[np.lexsort((entries["lo"], entries["hi"]))]
    if not len(entries):
        return entries
    first = np.flatnonzero(np.r_[True, (entries["hi"][1:] != entries["hi"][:-1]) | (entries["lo"][1:] != entries["lo"][:-1])])
    out = entries[first].copy()
    out["docs"] = np.minimum(np.add.reduceat(entries["docs"].astype(np.int64), first), np.iinfo(np.uint32).max)
    out["keeper"] = np.maximum.reduceat(entries["keeper"], first)
    return out


def _block_keys(min_chars: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, dict[bytes, list[int]]] = {}
        for batch in batches:
            for block, doc, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = seen.setdefault(block, {})
                doc = NO_ID if doc is None else doc
                for key in {k for line in (body or b"").split(b"\n") if (k := line_key(line, min_chars))}:
                    had = own.get(key)
                    if had is None:
                        own[key] = [1, doc]
                    else:
                        had[0] += 1
                        had[1] = max(had[1], doc)
        for block, own in seen.items():
            entries = np.zeros(len(own), _ENTRY)
            halves = np.frombuffer(b"".join(own), "<u8").reshape(-1, 2)
            entries["hi"], entries["lo"] = halves[:, 0], halves[:, 1]
            if own:
                counts = np.array(list(own.values()), np.int64)
                entries["docs"], entries["keeper"] = counts[:, 0], counts[:, 1]
            shard = (entries["lo"] % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            entries, shard = entries[order], shard[order]
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.array([], np.int64)
            if len(cuts):
                parts = [p.tobytes() for p in np.split(entries, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[cuts], pa.int64()), pa.array([block] * len(cuts), pa.int64()), pa.array(parts, pa.binary())],
                    names=["shard", "block", "entries"],
                )

    return run


def _probe_shard(min_docs: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        per_block = [np.frombuffer(e, _ENTRY) for e in shard["entries"]]
        total = totals(np.concatenate(per_block))
        index = LineIndex(total["hi"], total["lo"], total["docs"], total["keeper"])
        blocks, hits = [], []
        for block, entries in zip(shard["block"], per_block, strict=True):
            hit, slot = index.probe(entries["hi"], entries["lo"])
            frequent = index.docs[slot] >= min_docs
            hit[hit], slot = frequent, slot[frequent]
            if hit.any():
                found = np.zeros(len(slot), _HIT)
                found["hi"], found["lo"], found["keeper"] = entries["hi"][hit], entries["lo"][hit], index.keepers[slot]
                blocks.append(block)
                hits.append(found.tobytes())
        return pd.DataFrame({"block": np.array(blocks, np.int64), "hits": pd.Series(hits, dtype=object)})

    return run


def _rewrite(min_chars: int, kept: list[str], outputs: tuple[str, ...]):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        keeper: dict[bytes, int] = {}
        for packed in answers.column("hits").to_pylist():
            found = np.frombuffer(packed, _HIT)
            raw = packed_keys(found)
            keeper.update(zip(raw, found["keeper"].tolist(), strict=True))
        n_lines, n_dropped, texts = [], [], []
        for doc, body in zip(docs.column("_id").to_pylist(), docs.column("_body").to_pylist(), strict=True):
            doc = NO_ID if doc is None else doc
            lines = (body or b"").split(b"\n")
            left = lines
            if keeper:
                left = [x for x in lines if (k := line_key(x, min_chars)) is None or keeper.get(k, doc) == doc]
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(left))
            texts.append(b"\n".join(left))
        made = {
            "n_lines": lambda: pa.array(n_lines, pa.int64()),
            "n_dropped": lambda: pa.array(n_dropped, pa.int64()),
            "kept": lambda: pa.array(texts, pa.binary()),
            "kept_sha256": lambda: pa.array([sha256(t) for t in texts], pa.string()),
        }
        return pa.Table.from_arrays(
            [docs.column(f"_k{i}").combine_chunks() for i in range(len(kept))] + [made[o]() for o in outputs],
            names=[f"_k{i}" for i in range(len(kept))] + list(outputs),
        )

    return run


def packed_keys(found: np.ndarray) -> list[bytes]:
    halves = np.empty((len(found), 2), "<u8")
    halves[:, 0], halves[:, 1] = found["hi"], found["lo"]
    raw = halves.tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


_OUTPUT_TYPES = {"n_lines": "bigint", "n_dropped": "bigint", "kept": "binary", "kept_sha256": "string"}


def drop_frequent_lines(
    docs: DataFrame,
    min_chars: int = 20,
    min_docs: int = 3,
    text: str = "text",
    doc_id: str = "doc_id",
    keep: tuple[str, ...] | None = None,
    outputs: tuple[str, ...] = ("n_lines", "n_dropped", "kept"),
    block_bytes: int = BLOCK_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Documents without their frequent lines; see the module for the rule and for nulls and ties.

    keep: columns that stay beside the outputs, all but the text by default; an output replaces a column of its name. outputs: some of n_lines (before
    dropping), n_dropped, kept (the text as bytes, cast it to string), kept_sha256.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != text and c.lower() not in outputs]
    _, size = text_bytes(docs, text)
    blocks, shards = pieces(size, block_bytes), pieces(size, shard_bytes)
    body = F.col(text).cast("binary")
    # The text takes part in the choice of the block: rows without an id do not meet in one.
    dealt = docs.select(
        F.pmod(F.xxhash64(doc_id, text), F.lit(blocks)).alias("_block"),
        F.col(doc_id).cast("bigint").alias("_id"),
        body.alias("_body"),
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(kept)],
    ).repartition(pieces(blocks, PARTITION_BLOCKS), "_block")  # one exchange, used by both passes
    entries = dealt.mapInArrow(  # of all columns: with fewer, Spark would deal the texts out a second time
        trimmed(_block_keys(min_chars, shards)), "shard bigint, block bigint, entries binary"
    )
    hits = entries.groupBy("shard").applyInPandas(_probe_shard(min_docs), "block bigint, hits binary")
    schema = ", ".join(
        [f"_k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)]
        + [f"{o} {_OUTPUT_TYPES[o]}" for o in outputs]
    )
    out = dealt.groupBy("_block").cogroup(hits.withColumnRenamed("block", "_block").groupBy("_block")).applyInArrow(
        _rewrite(min_chars, kept, outputs), schema
    )
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(kept)], *outputs)
