"""Byte-level BPE with the tiktoken library and a local rank file.

A task loads the rank file once. Texts beyond `LONG` characters are cut before white space that follows a
non-space, where no match of the pattern can reach across, so the pieces give the tokens of the whole. A stretch
without such a place (one huge word or run of blanks) is matched by the `regex` module and merged match by match,
which keeps the library's backtracking matcher away from it. Decoding joins raw token bytes; it never passes
through a lossy string.

Nulls are empty texts, bytes that are not UTF-8 become U+FFFD before encoding. Other columns, repeated rows and
repeated ids pass through untouched: every row is encoded by itself, without any shuffle. An output replaces a column of its
name, and an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_bytes, decoded, free_name, sha256, trimmed

LONG = 1 << 15
#: No match of the pattern reaches over this place: what follows a non-space ends a match, what starts with
#: white space begins one.
_SAFE = re.compile(r"\S(?=[ \t\r\n])")
_OUTPUTS = {
    "n_tokens": ("bigint", pa.int64()),
    "ids": ("array<int>", pa.list_(pa.int32())),
    "ids_sha256": ("string", pa.string()),
    "decoded": ("binary", pa.binary()),
    "decoded_sha256": ("string", pa.string()),
}


@lru_cache(maxsize=4)
def _encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return encoding, [str(i) for i in range(encoding.max_token_value + 1)]


@lru_cache(maxsize=4)
def _matcher(pattern: str):
    import regex

    return regex.compile(pattern)


def stretches(text: str, long: int = LONG) -> Iterator[str]:
    """Cut `text` at safe places into stretches of about `long` characters; a stretch may be longer."""
    start, end = 0, len(text)
    while end - start > long:
        place = _SAFE.search(text, start + long)
        if not place:
            break
        yield text[start : place.end()]
        start = place.end()
    yield text[start:]


def encode_text(text: str, rank_file: str, pattern: str, long: int = LONG) -> list[int]:
    encoding, _ = _encoding(rank_file, pattern)
    if len(text) <= long:
        return encoding.encode_ordinary(text)
    ids: list[int] = []
    for stretch in stretches(text, long):
        if len(stretch) <= 2 * long:
            ids += encoding.encode_ordinary(stretch)
        else:
            for match in _matcher(pattern).finditer(stretch):
                ids += encoding._encode_single_piece(match[0])
    return ids


def decode_ids(ids: list[int], rank_file: str, pattern: str) -> bytes:
    return _encoding(rank_file, pattern)[0].decode_bytes(ids)


def tokenize(
    docs: DataFrame,
    rank_file: str,
    pattern: str,
    outputs: tuple[str, ...] = ("n_tokens", "ids"),
    text: str = "text",
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """Encode every text and, where asked for, decode the ids again.

    outputs: some of n_tokens, ids, ids_sha256 (of the decimal ids joined by a blank), decoded, decoded_sha256.
    keep: the columns that stay beside them; all others by default. An output replaces a column of its name.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in outputs]
    body = free_name(docs, "_body")
    source = docs.select(*kept, F.col(text).cast("binary").alias(body))
    schema = ", ".join([f"`{c}` {source.schema[c].dataType.simpleString()}" for c in kept] + [f"{o} {_OUTPUTS[o][0]}" for o in outputs])
    need_decoded = any(o.startswith("decoded") for o in outputs)

    def encoded(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoding, names = _encoding(rank_file, pattern)
        made: dict[str, list] = {o: [] for o in outputs}
        for value in batch.column(len(kept)):
            ids = encode_text(decoded(value.as_py()), rank_file, pattern)
            raw = encoding.decode_bytes(ids) if need_decoded else b""
            for o in outputs:
                if o == "n_tokens":
                    made[o].append(len(ids))
                elif o == "ids":
                    made[o].append(np.array(ids, np.int32))
                elif o == "ids_sha256":
                    made[o].append(sha256(" ".join([names[i] for i in ids]).encode()))
                else:
                    made[o].append(raw if o == "decoded" else sha256(raw))
        arrays = [batch.column(i) for i in range(len(kept))] + [pa.array(made[o], _OUTPUTS[o][1]) for o in outputs]
        return pa.RecordBatch.from_arrays(arrays, names=[*kept, *outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, len(kept)):
                yield encoded(part)

    return source.mapInArrow(trimmed(run), schema)
