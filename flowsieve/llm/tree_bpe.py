"""BPE with the tokenizers library; long texts are halved, their halves encoded in parallel and concatenated as a tree.

A text of more than `LONG` bytes is halved until its parts have at most `PART` characters, wherever the cuts fall: inside a word,
a run of blanks or the string of an added token. The parts are spread over the tasks and encoded alone. Two neighbours are then
concatenated by encoding a window around their join again, which grows until both sides agree with it:

* on the left the window starts at a word (a match of the tokenizer's pattern, or an added token) of the left part that ends far
  enough from the join to be certain, or, inside one long word, at a token; then its first token has to be that token;
* on the right it has to meet the right part either where both have the start of a word, since words from there on depend on what
  follows alone, or inside one word that both see, at the same token.

Tokens are a word's encoding iff every two neighbours among them are the encoding of their own bytes. The spliced row has no two
neighbours that do not stand side by side in one of the three encodings, so the result is that of the whole text, without exception. A window that reaches an end of
its part needs no agreement there, so growth ends in encoding both parts anew at worst.

Texts that are not halved are split into words, each of which the library encodes once while a worker remembers it. A word's encoding does
not depend on its neighbours; where words begin does, and is found by the same pattern. Texts with characters of which engines may disagree
whether they are letters, or with the string of an added token, are left to the library whole.

Nulls are empty texts without a token, bytes that are not UTF-8 become U+FFFD before encoding. Other columns, repeated rows and
repeated ids pass through untouched: every row is encoded by itself, under a number of its own. An empty table gives an empty one.
Short texts are encoded where they are read; only texts that are halved are shuffled. What one row becomes is held by one task.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import written
from .common import by_bytes, decoded, free_name, pieces, trimmed

LONG = 1 << 16
PART = 1 << 14
WINDOW = 64
_BYTES_PER_TASK = 4 << 20
_DECODED_AT_ONCE = 1 << 20
_REMEMBERED = 1 << 19
# The words of a byte-level tokenizer with its own pattern, and characters whose kind (letter, number, blank, other) is settled.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SETTLED = "\x00-\u052f\u2010-\u2027\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_WORD, _WHOLE = 1, 2  # a token that starts a word; one that starts with a whole character
_OUTPUTS = {
    "n_tokens": ("bigint", pa.int64()),
    "ids": ("array<int>", pa.list_(pa.int32())),
    "ids_sha256": ("string", pa.string()),
    "decoded": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
}


@lru_cache(maxsize=4)
def _tokenizer(file: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core's work
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(file)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def _margin(file: str) -> int:
    """How many characters behind a word's end can decide on it: an added token, or the pattern's look ahead."""
    return 8 + max((len(t.content) for t in _tokenizer(file).get_added_tokens_decoder().values()), default=0)


@lru_cache(maxsize=4)
def _token_bytes(file: str) -> list[bytes]:
    """The bytes of every id: a token's characters stand for bytes, printable ones for themselves, the others in order from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    tokenizer = _tokenizer(file)
    texts = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    return [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in texts]


class Words:
    """Encodings of words, as little-endian 32-bit ids; the library's, remembered by the worker."""

    def __init__(self, file: str):
        import regex

        self._file, self._known = file, {}
        with open(file, "rb") as config:
            kind = json.load(config)
        own = kind["pre_tokenizer"] or {}
        self.usable = own.get("type") == "ByteLevel" and not own.get("add_prefix_space") and own.get("use_regex", True) and not kind["normalizer"] and not kind["post_processor"]
        added = "|".join(re.escape(t.content) for t in _tokenizer(file).get_added_tokens_decoder().values()) or r"(?!)"
        self._split, self._settled, self._added = regex.compile(_PATTERN).findall, re.compile(f"[{_SETTLED}]*").fullmatch, re.compile(added).search

    def split(self, text: str) -> list[str] | None:
        """The words of a text, None if the library has to find them."""
        if not self.usable or not self._settled(text) or self._added(text):
            return None
        return self._split(text)

    def encoded(self, texts: list[list[str]]) -> list[np.ndarray]:
        new = list(set().union(*texts).difference(self._known))
        if len(self._known) + len(new) > _REMEMBERED:
            self._known.clear()
            new = list(set().union(*texts))
        for word, made in zip(new, _tokenizer(self._file).encode_batch_fast(new, add_special_tokens=False), strict=True):
            self._known[word] = np.array(made.ids, "<u4").tobytes()
        of = self._known.__getitem__
        return [np.frombuffer(b"".join(map(of, words)), "<i4") for words in texts]


@lru_cache(maxsize=4)
def _words(file: str) -> Words:
    return Words(file)


def encode_texts(texts: list[str], file: str) -> list[np.ndarray]:
    """The ids of some texts that are not halved."""
    words = [_words(file).split(t) for t in texts]
    known = iter(_words(file).encoded([w for w in words if w is not None]))
    others = iter(_tokenizer(file).encode_batch_fast([t for t, w in zip(texts, words, strict=True) if w is None], add_special_tokens=False))
    return [np.array(next(others).ids, np.int32) if w is None else next(known) for w in words]


class Part(NamedTuple):
    """An encoded text: ids, the character at which each token starts, and what it starts."""

    text: str
    ids: np.ndarray
    at: np.ndarray
    starts: np.ndarray


def encode_part(text: str, file: str) -> Part:
    made = _tokenizer(file).encode(text, add_special_tokens=False)
    ids = np.array(made.ids, np.int32)
    offsets = np.array(made.offsets, np.int64).reshape(-1, 2)
    words = np.array(made.word_ids, np.int64)
    starts = np.zeros(len(ids), np.uint8)
    if len(ids):
        starts[0] = _WORD | _WHOLE
        starts[1:] = _WORD * (words[1:] != words[:-1]) + _WHOLE * (offsets[1:, 0] >= offsets[:-1, 1])
    return Part(text, ids, offsets[:, 0], starts)


def _left_cut(a: Part, reach: int, margin: int) -> int:
    """The token of `a` at which a window begins: the last certain start of a word, or a token inside a word longer than `reach`."""
    end = len(a.text) - margin
    last = int(np.searchsorted(a.at, end, side="right"))
    first = int(np.searchsorted(a.at, end - reach))
    words = np.flatnonzero(a.starts[first:last] & _WORD)
    if len(words):
        return first + int(words[-1])
    whole = np.flatnonzero(a.starts[:first] & _WHOLE) if first < 64 else first - 64 + np.flatnonzero(a.starts[first - 64 : first] & _WHOLE)
    return int(whole[-1]) if len(whole) else 0


def _meeting(window: Part, base: int, b: Part, seen: int, margin: int) -> tuple[int, int] | None:
    """Tokens of the window and of `b` from which on `b` holds; `seen` characters of `b` are in the window, whose text starts at `base` of `b`."""
    where = window.at + base
    low, high = np.searchsorted(where, 0), np.searchsorted(where, seen - margin, side="right")
    ours = np.arange(low, high)[(window.starts[low:high] & _WHOLE) > 0]
    theirs = np.flatnonzero(b.starts[: np.searchsorted(b.at, seen - margin, side="right")] & _WHOLE)
    _, x, y = np.intersect1d(where[ours], b.at[theirs], assume_unique=True, return_indices=True)
    ours, theirs = ours[x], theirs[y]
    ours_word, theirs_word = window.starts[ours] & _WORD, b.starts[theirs] & _WORD
    inside = (ours_word == 0) & (theirs_word == 0) & (window.ids[ours] == b.ids[theirs]) & (where[ours] >= margin)
    good = np.flatnonzero((ours_word & theirs_word).astype(bool) | inside)
    return (int(ours[good[0]]), int(theirs[good[0]])) if len(good) else None


def concatenated(a: Part, b: Part, file: str, window: int = WINDOW) -> Part:
    """The encoding of both texts, one after the other."""
    if not a.text or not b.text:
        return a if a.text else b
    joint, margin = len(a.text), _margin(file)
    reach = window
    while True:
        cut = _left_cut(a, reach, margin)
        begin = int(a.at[cut])
        seen = min(len(b.text), reach + margin)
        middle = encode_part(a.text[begin:] + b.text[:seen], file)
        agrees = a.starts[cut] & _WORD or middle.ids[0] == a.ids[cut]
        meet = (len(middle.ids), len(b.ids)) if seen == len(b.text) else _meeting(middle, begin - joint, b, seen, margin)
        if agrees and meet:
            upto, after = meet
            middle.starts[0] = a.starts[cut]
            ids = np.concatenate((a.ids[:cut], middle.ids[:upto], b.ids[after:]))
            at = np.concatenate((a.at[:cut], middle.at[:upto] + begin, b.at[after:] + joint))
            return Part(a.text + b.text, ids, at, np.concatenate((a.starts[:cut], middle.starts[:upto], b.starts[after:])))
        reach *= 4


def concatenated_all(parts: list[Part], file: str, window: int = WINDOW) -> Part:
    """The parts' tree, from the leaves up."""
    while len(parts) > 1:
        pairs = [concatenated(a, b, file, window) for a, b in zip(parts[::2], parts[1::2], strict=False)]
        parts = pairs + parts[len(pairs) * 2 :]
    return parts[0]


def halves(text: str, part: int = PART) -> list[str]:
    """The text halved until no part has more than `part` characters; from left to right."""
    count = 1
    while len(text) > part * count:
        count *= 2
    cuts = [len(text) * i // count for i in range(count + 1)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b] or [""]


def decode_ids(ids: list[int], file: str) -> Iterator[str]:
    """The library's decoding without skipping special tokens: the tokens' bytes as UTF-8, invalid ones replaced; in pieces."""
    of = _token_bytes(file).__getitem__
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for start in range(0, len(ids), _DECODED_AT_ONCE):
        yield decoder.decode(b"".join(map(of, ids[start : start + _DECODED_AT_ONCE])))
    yield decoder.decode(b"", True)


def _output(name: str, ids: np.ndarray, text) -> object:
    """text: the decoded text in pieces, or None where no output asks for it."""
    if name == "n_tokens":
        return len(ids)
    if name == "ids":
        return ids
    if name == "ids_sha256":
        return hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()
    if name == "decoded":
        return "".join(text)
    made = hashlib.sha256()
    for piece in text:
        made.update(piece.encode("utf-8", "replace"))
    return made.hexdigest()


def tokenize(
    docs: DataFrame,
    tokenizer_file: str,
    outputs: tuple[str, ...] = ("n_tokens", "ids"),
    text: str = "text",
    keep: tuple[str, ...] | None = None,
    long: int = LONG,
    part: int = PART,
    window: int = WINDOW,
) -> DataFrame:
    """Encode every text without special tokens around it and, where asked for, decode the ids again.

    outputs: some of n_tokens, ids, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded, decoded_sha256.
    keep: the columns that stay beside them; all others by default. An output replaces a column of its name.
    long: from how many bytes a text is halved; part: characters of a part; window: characters of the first window around a join.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in outputs]
    row, place, half = (free_name(docs, n) for n in ("_row", "_place", "_half"))
    source = docs.select(*kept, F.col(text).cast("binary").alias(half))
    types = {c: source.schema[c].dataType.simpleString() for c in kept}
    need_text = any(o.startswith("decoded") for o in outputs)
    n = len(kept)

    def short(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        ids = encode_texts(texts, tokenizer_file)
        rows = ((i, list(decode_ids(i.tolist(), tokenizer_file)) if need_text else None) for i in ids)
        made = [pa.array(x, _OUTPUTS[o][1]) for o, x in zip(outputs, zip(*([_output(o, *r) for o in outputs] for r in rows), strict=True), strict=True)]
        blank = [pa.nulls(len(ids), k) for k in (pa.int64(), pa.int32(), pa.string())]
        return pa.RecordBatch.from_arrays([*batch.columns[:n], *made, *blank], names=names)

    def cut(batch: pa.RecordBatch, body: str, number: int) -> Iterator[pa.RecordBatch]:
        parts = halves(body, part)
        step = max(1, (1 << 20) // part)
        for first in range(0, len(parts), step):
            some = parts[first : first + step]
            columns = [c if not first else pa.nulls(0, c.type) for c in batch.columns[:n]]
            pad = len(some) - (1 if not first else 0)
            own = [pa.concat_arrays([c, pa.nulls(pad, c.type)]) for c in columns]
            made = [pa.nulls(len(some), _OUTPUTS[o][1]) for o in outputs]
            tail = [pa.array([number] * len(some), pa.int64()), pa.array(range(first, first + len(some)), pa.int32()), pa.array(some, pa.string())]
            yield pa.RecordBatch.from_arrays([*own, *made, *tail], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for some in by_bytes(batch, n):
                sizes = [0 if not v.is_valid else v.as_buffer().size for v in some.column(n)]
                few = [i for i, s in enumerate(sizes) if s <= long]
                if few:
                    chosen = some if len(few) == len(sizes) else some.take(pa.array(few, pa.int64()))
                    yield short(chosen, [decoded(v.as_py()) for v in chosen.column(n)])
                for i, size in enumerate(sizes):
                    if size > long:
                        yield from cut(some.slice(i, 1), decoded(some.column(n)[i].as_py()), number)
                        number += 1

    names = [*kept, *outputs, row, place, half]
    schema = [f"`{c}` {t}" for c, t in types.items()] + [f"{o} {_OUTPUTS[o][0]}" for o in outputs]
    tail = [f"`{row}` bigint", f"`{place}` int", f"`{half}` string"]
    first = written(source.mapInArrow(trimmed(read), ", ".join(schema + tail)), "bpe-read")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in by_bytes(batch, 2):
                made = [encode_part(t.as_py(), tokenizer_file) for t in some.column(2)]
                lists = [pa.array([getattr(m, f) for m in made], pa.list_(k)) for f, k in (("ids", pa.int32()), ("at", pa.int64()), ("starts", pa.uint8()))]
                lists[2] = lists[2].cast(pa.list_(pa.int8()))
                yield pa.RecordBatch.from_arrays([*some.columns, *lists], names=["_row", "_place", "_half", "_ids", "_at", "_starts"])

    def whole(parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("_place")
        columns = [parts.column(c).to_pylist() if c == "_half" else [x.values.to_numpy(zero_copy_only=False) for x in parts.column(c)] for c in ("_half", "_ids", "_at", "_starts")]
        made = concatenated_all([Part(t, i, a, s.astype(np.uint8)) for t, i, a, s in zip(*columns, strict=True)], tokenizer_file, window)
        values = [pa.array([_output(o, made.ids, decode_ids(made.ids.tolist(), tokenizer_file) if need_text else None)], _OUTPUTS[o][1]) for o in outputs]
        return pa.Table.from_arrays([parts.column("_row").slice(0, 1), *values], names=["_row", *outputs])

    parts = first.where(F.col(row).isNotNull()).select(F.col(row).alias("_row"), F.col(place).alias("_place"), F.col(half).alias("_half"))
    size = parts.agg(F.sum(F.octet_length("_half"))).first()[0] or 0
    spread = parts.repartition(pieces(size, _BYTES_PER_TASK), "_row", "_place")
    lists = spread.mapInArrow(trimmed(encoded), "_row bigint, _place int, _half string, _ids array<int>, _at array<bigint>, _starts array<tinyint>")
    joined = lists.groupBy("_row").applyInArrow(whole, ", ".join(["_row bigint"] + [f"{o} {_OUTPUTS[o][0]}" for o in outputs]))
    heads = first.where(F.col(place) == 0).select(F.col(row).alias("_row"), *(F.col(c).alias(f"_kept{i}") for i, c in enumerate(kept)))
    long_rows = heads.join(joined, "_row").select(*(F.col(f"_kept{i}").alias(c) for i, c in enumerate(kept)), *outputs)
    return first.where(F.col(row).isNull()).select(*kept, *outputs).unionByName(long_rows)
