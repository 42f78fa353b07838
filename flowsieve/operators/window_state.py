"""Windows of accepted fingerprints, and the functions that tasks run over them.

This module is shipped to the tasks by value (see `windowed`), so executors need
no installed package; it imports nothing but the standard library and Arrow.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

NEW, DUPLICATE, FALSE_HIT = 0, 1, 2
_DIGEST = 32  # bytes per fingerprint in a saved window


def _pack(*groups: Iterable[bytes]) -> bytes:
    blobs = [b"".join(g) for g in groups]
    return struct.pack(f"<{len(blobs)}Q", *[len(b) for b in blobs]) + b"".join(blobs)


def _unpack(blob: bytes, count: int) -> list[bytes]:
    sizes = struct.unpack_from(f"<{count}Q", blob)
    parts, at = [], 8 * count
    for size in sizes:
        parts.append(blob[at : at + size])
        at += size
    return parts


def _split(blob: bytes) -> list[bytes]:
    return [blob[i : i + _DIGEST] for i in range(0, len(blob), _DIGEST)]


class FifoWindow:
    """The last `window` accepted fingerprints; a hit does not refresh its place."""

    nothing = DUPLICATE  # the verdict of a row that leaves no trace in the result

    def __init__(self, window: int):
        self.window, self.order, self.held = window, deque(), set()
        self.idle_repeats = window > 0

    def steps(self, fps: list[bytes]) -> list[int]:
        order, held, window, out = self.order, self.held, self.window, []
        for fp in fps:
            if fp in held:
                out.append(DUPLICATE)
                continue
            out.append(NEW)
            if window > 0:
                if len(order) >= window:
                    held.discard(order.popleft())
                order.append(fp)
                held.add(fp)
        return out

    def guess(self) -> "FullFifoWindow":
        return FullFifoWindow(self.window)

    def save(self) -> bytes:
        return _pack(self.order)

    def load(self, blob: bytes) -> None:
        self.order = deque(_split(_unpack(blob, 1)[0]))
        self.held = set(self.order)


class FullFifoWindow(FifoWindow):
    """A window whose content before its first row is not known, taken to hold every older fingerprint.

    Until `window` rows were accepted, only a fingerprint's first row of all is. Where repeats come from among the last
    `window` accepted, that is what a window with the right content decides; an empty one accepts them anew
    and may never forget it. `settled` tells whether later rows bear the assumption out.
    """

    def __init__(self, window: int):
        super().__init__(window)
        self.unknown, self.settled = window, True

    def first_steps(self, fps: list[bytes], firsts: list[bool]) -> list[int]:
        order, held, window, out = self.order, self.held, self.window, []
        for fp, first in zip(fps, firsts):
            if fp in held or (self.unknown > 0 and not first):
                out.append(DUPLICATE)
                continue
            out.append(NEW)
            if self.unknown > 0:
                self.unknown -= 1
            elif not first:
                self.settled = False
            if len(order) >= window:
                held.discard(order.popleft())
            order.append(fp)
            held.add(fp)
        return out


class BitFilter:
    """Fixed-size filter over 32-byte digests, a byte per bit; positions as in `filter_positions`."""

    def __init__(self, bits: int, hashes: int, data: bytes | None = None):
        self.size, self.hashes = bits, hashes
        held = np.zeros(bits, np.uint8) if data is None else np.unpackbits(np.frombuffer(data, np.uint8), count=bits)
        self.data = bytearray(held)

    def positions(self, fps: list[bytes]) -> list[list[int]]:
        """The bits of each digest, all at once: its four-byte slices, or those of its next hashes, modulo the size."""
        parts = []
        for start in range(0, self.hashes, 8):
            of = fps if not start else [hashlib.sha256(f.hex().encode() + f"#{start // 8}".encode()).digest() for f in fps]
            slices = np.frombuffer(b"".join(of), ">u4").reshape(len(of), -1)
            parts.append(slices[:, : min(8, self.hashes - start)].astype(np.int64) % self.size)
        return np.concatenate(parts, 1).tolist()

    def __contains__(self, positions: list[int]) -> bool:
        return all(map(self.data.__getitem__, positions))

    def add(self, positions: list[int]) -> None:
        for p in positions:
            self.data[p] = 1

    def save(self) -> bytes:
        return np.packbits(np.frombuffer(self.data, np.uint8)).tobytes()


class ScreenedWindow:
    """An exact FIFO cache behind a filter that is emptied every `generation`.

    The filter is ideal (a set) unless `size` gives real bits. `exact=False`
    trusts the filter alone. Emptying the filter loses repeats: a fingerprint
    still cached but unknown to the new filter enters a second time, and when
    its older copy leaves the queue the cache entry goes with it.

    At insertion (`on_arrival=False`) the filter is emptied after the lookup and
    every accepted row enters it; on arrival it is emptied before the lookup,
    the cache makes room before the lookup too, and rows accepted after a false
    hit are not counted as insertions.
    """

    nothing = DUPLICATE

    def __init__(
        self, window: int, generation: int, size: tuple[int, int] | None, exact: bool = True, on_arrival: bool = False
    ):
        self.window, self.generation, self.size = window, generation, size
        self.exact, self.on_arrival = exact, on_arrival
        # Where room is made on arrival, a repeat of the row before changes the window too.
        self.idle_repeats = not on_arrival and (window > 0 or not exact)
        self.order, self.held, self.inserted = deque(), set(), 0
        self.screen = self._empty()

    def _empty(self):
        return set() if self.size is None else BitFilter(*self.size)

    def _make_room(self) -> None:
        if self.order and len(self.order) >= self.window:
            self.held.discard(self.order.popleft())

    def _turn_over(self) -> None:
        if self.generation and self.inserted >= self.generation:
            self.screen, self.inserted = self._empty(), 0

    def step(self, fp: bytes, mark) -> int:
        """mark: what the filter knows the fingerprint by, itself or its bits."""
        if self.on_arrival:
            self._make_room()
            self._turn_over()
        hit = mark in self.screen
        if hit and (not self.exact or fp in self.held):
            return DUPLICATE
        if not self.on_arrival:
            self._make_room()
            self._turn_over()
        if not hit or not self.on_arrival:
            self.screen.add(mark)
            self.inserted += 1
        if self.exact and self.window > 0:
            self.order.append(fp)
            self.held.add(fp)
        return FALSE_HIT if hit else NEW

    def steps(self, fps: list[bytes]) -> list[int]:
        marks = fps if self.size is None or not fps else self.screen.positions(fps)
        if self.on_arrival:
            return [self.step(*x) for x in zip(fps, marks)]
        # As `step`, in one loop; `known` are fingerprints that the present filter has.
        exact, window, generation, order, held, out, known = self.exact, self.window, self.generation, self.order, self.held, [], set()
        for fp, mark in zip(fps, marks):
            hit = fp in known or mark in self.screen
            if hit and (not exact or fp in held):
                out.append(DUPLICATE)
                known.add(fp)
                continue
            if order and len(order) >= window:
                held.discard(order.popleft())
            if generation and self.inserted >= generation:
                self._turn_over()
                known.clear()
            self.screen.add(mark)
            self.inserted += 1
            known.add(fp)
            if exact and window > 0:
                order.append(fp)
                held.add(fp)
            out.append(FALSE_HIT if hit else NEW)
        return out

    def save(self) -> bytes:
        screen = sorted(self.screen) if self.size is None else [self.screen.save()]
        return _pack(self.order, sorted(self.held), screen, [struct.pack("<Q", self.inserted)])

    def load(self, blob: bytes) -> None:
        order, held, screen, inserted = _unpack(blob, 4)
        self.order, self.held = deque(_split(order)), set(_split(held))
        self.screen = set(_split(screen)) if self.size is None else BitFilter(*self.size, data=screen)
        self.inserted = struct.unpack("<Q", inserted)[0]


class ManyWindows:
    """Several windows over one log of arrivals. A row's verdicts are one number, two bits a window."""

    MOST = 31

    def __init__(self, makes: tuple[Callable, ...]):
        self.windows = [make() for make in makes]
        self.idle_repeats = all(w.idle_repeats for w in self.windows)
        self.nothing = self.all_have(DUPLICATE, len(makes))

    @staticmethod
    def all_have(verdict: int, windows: int) -> int:
        return sum(verdict << 2 * i for i in range(windows))

    def steps(self, fps: list[bytes]) -> np.ndarray:
        out = np.zeros(len(fps), np.int64)
        for i, window in enumerate(self.windows):
            out |= np.array(window.steps(fps), np.int64) << 2 * i
        return out

    def save(self) -> bytes:
        return _pack(*[[w.save()] for w in self.windows])

    def load(self, blob: bytes) -> None:
        for window, own in zip(self.windows, _unpack(blob, len(self.windows))):
            window.load(own)


class NewWindow:
    """Makes the empty window of a scope: one kind for all, or by its first column."""

    def __init__(self, make: Callable | dict[str, Callable], nothing: int = DUPLICATE):
        self.make, self.nothing = make, nothing

    def __call__(self, scope: tuple):
        return self.make[scope[0]]() if isinstance(self.make, dict) else self.make()


# ------------------------------------------------------------ ordered scan

# Row kinds of a scan table: rows settled at once, rows of a piece's first
# scope (a later round may revise them), parts of the final window, summaries,
# and what the window was like after some of the head's rows.
SETTLED, HEAD, WINDOW, SUMMARY, CHECK = 0, 1, 2, 3, 4
# In the order in which a later scan reads them.
AGAIN = {WINDOW: 0, CHECK: 1, HEAD: 2}
# Verdicts of a head's first scan hold those from a full window above the lower bits.
GUESS_SHIFT = 2
SCAN_SCHEMA = "kind int, piece int, seq bigint, fp binary, verdict bigint"
_ARROW_SCHEMA = pa.schema(
    [("kind", pa.int32()), ("piece", pa.int32()), ("seq", pa.int64()), ("fp", pa.binary()), ("verdict", pa.int64())]
)
_PART_BYTES = 1 << 20


def _batch(kind: int, piece: int, seq, fp=None, verdict=None) -> pa.RecordBatch:
    n = len(seq)
    columns = [
        np.full(n, kind, "int32"),
        np.full(n, piece, "int32"),
        seq,
        pa.nulls(n, pa.binary()) if fp is None else fp,
        pa.nulls(n, pa.int64()) if verdict is None else verdict,
    ]
    arrays = [pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, _ARROW_SCHEMA)]
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW_SCHEMA)


def _window_parts(piece: int, blob: bytes) -> pa.RecordBatch:
    parts = [blob[i : i + _PART_BYTES] for i in range(0, len(blob), _PART_BYTES)]
    return _batch(WINDOW, piece, np.arange(len(parts)), pa.array(parts, pa.binary()))


def _summary(piece: int, **facts) -> pa.RecordBatch:
    return _batch(SUMMARY, piece, np.zeros(1, "int64"), pa.array([json.dumps(facts).encode()], pa.binary()))


def _digest(blob: bytes) -> str:
    return hashlib.sha256(blob).hexdigest()


def _runs(columns: list[pa.Array]) -> list[int]:
    """Row numbers where one of the columns changes, with both ends."""
    n = len(columns[0])
    change = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        change |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(change) + 1).tolist(), n]


def _steps(window, fps: pa.Array, repeats: np.ndarray, firsts: np.ndarray | None = None) -> np.ndarray:
    """Verdicts; rows that repeat the row before are settled without the window."""
    verdicts = np.full(len(fps), window.nothing, "int64")
    asked = np.flatnonzero(~repeats) if window.idle_repeats else np.arange(len(fps))
    wanted = fps.take(pa.array(asked)).to_pylist()
    verdicts[asked] = window.steps(wanted) if firsts is None else window.first_steps(wanted, firsts[asked].tolist())
    return verdicts


def _repeats(fps: pa.Array) -> np.ndarray:
    out = np.zeros(len(fps), bool)
    if len(fps) > 1:
        out[1:] = pc.equal(fps[1:], fps[:-1]).to_numpy(zero_copy_only=False)
    return out


class _Checks:
    """Digests of a head's windows after about every `spacing` rows, never between rows of one arrival number."""

    def __init__(self, window, full):
        self.windows, self.spacing, self.since, self.last = (window, full), max(2 * window.window, 4096), 0, None

    def stretches(self, seq: np.ndarray) -> Iterator[tuple[int, int]]:
        """Cut rows where the windows are to be looked at; look with `due` behind each stretch."""
        start = 0
        while start < len(seq):
            end = min(len(seq), start + max(1, self.spacing - self.since))
            while end < len(seq) and seq[end] == seq[end - 1]:
                end += 1
            yield start, end
            self.since += end - start
            self.last, start = int(seq[end - 1]), end

    def due(self, following: int) -> tuple[int, bytes] | None:
        """Where the windows stand before a row with the number `following`, if it is time to note that."""
        if self.since < self.spacing or following == self.last:
            return None
        self.since = 0
        return self.last, b"".join(hashlib.sha256(w.save()).digest() for w in self.windows)


def scan_pieces(batches: Iterator[pa.RecordBatch], new_window: Callable, depth: int) -> Iterator[pa.RecordBatch]:
    """First scan of one sorted piece, from an empty window.

    Input columns: `depth` scope columns, seq, fp, mark; a marked row announces
    that the next one is the first of its scope and fingerprint. Where marks
    are given, rows of the first scope are also scanned from a full window, and
    the piece goes on with the better guess: the full one, where all that its
    window accepted later were first rows, the empty one otherwise. What the
    windows are like is noted from time to time, so that a scan from another
    window can stop where it has become one of these.
    """
    piece = TaskContext.get().partitionId()
    window, full, checks, first, current, marked, marks, guess = None, None, None, None, None, False, False, False
    for batch in batches:
        if not batch.num_rows:
            continue
        mark = batch.column(depth + 2).to_numpy(zero_copy_only=False)
        firsts = np.concatenate(([marked], mark[:-1]))
        marked, marks = bool(mark[-1]), marks or bool(mark.any())
        if mark.any():
            rows = np.flatnonzero(~mark)
            batch, firsts = batch.take(pa.array(rows)), firsts[rows]
            if not batch.num_rows:
                continue
        scopes, seq, fp = batch.columns[:depth], batch.column(depth), batch.column(depth + 1)
        numbers = seq.to_numpy()
        verdicts, heads, noted = [], 0, []
        edges = _runs(scopes)
        for start, end in zip(edges, edges[1:]):
            scope = tuple(c[start].as_py() for c in scopes)
            if scope != current:
                if first is not None and current == first and full is not None:
                    guess = full.settled
                first = scope if current is None else first
                current, window = scope, new_window(scope)
                full = window.guess() if first == scope and marks and hasattr(window, "guess") and window.idle_repeats else None
                checks = full and _Checks(window, full)
            own = fp[start:end]
            repeats = _repeats(own)
            if scope != first:
                verdicts.append(_steps(window, own, repeats))
                continue
            heads = end
            if full is None:
                verdicts.append(_steps(window, own, repeats))
                continue
            for a, b in checks.stretches(numbers[start:end]):
                if note := checks.due(int(numbers[start + a])):
                    noted.append(note)
                part, again = own[a:b], repeats[a:b]
                other = _steps(full, part, again, firsts[start + a : start + b])
                verdicts.append(_steps(window, part, again) | other << GUESS_SHIFT)
        verdicts = np.concatenate(verdicts)
        if noted:
            yield _batch(CHECK, piece, np.array([n for n, _ in noted]), pa.array([d for _, d in noted], pa.binary()))
        if heads:
            yield _batch(HEAD, piece, seq[:heads], fp[:heads], verdicts[:heads])
        kept = np.flatnonzero(verdicts[heads:] != new_window.nothing) + heads
        yield _batch(SETTLED, piece, seq.take(pa.array(kept)), None, verdicts[kept])
    if current is not None:
        whole = first == current
        empty = _digest(new_window(first).save())
        if whole and full is not None:
            guess = full.settled
        blob = (full if whole and guess else window).save()
        yield _window_parts(piece, blob)
        yield _summary(piece, first=list(first), last=list(current), whole=whole, start=empty, end=_digest(blob), guess=bool(guess))


def rescan_heads(
    batches: Iterator[pa.RecordBatch], new_window: Callable, facts: dict[int, tuple]
) -> Iterator[pa.RecordBatch]:
    """Scan first scopes again; each piece's window parts and checks precede its rows, in the order of `AGAIN`.

    `facts` gives each piece's first scope, whether it is the only one, and
    which guess its first scan went on with. Where the window has become that of
    the first scan, what that found stands from there on: no row is looked at or
    written any more, and the summary says up to which arrival number this scan goes.
    """
    piece, window, parts, begin, checks, met = None, None, [], None, deque(), None

    def finish() -> Iterator[pa.RecordBatch]:
        if piece is None:
            return
        if facts[piece][1] and met is None:
            blob = window.save()
            yield _window_parts(piece, blob)
            yield _summary(piece, start=begin, end=_digest(blob), upto=None)
        else:
            yield _summary(piece, start=begin, upto=met)

    for batch in batches:
        if not batch.num_rows:
            continue
        kind, of, seq, fp = (batch.column(c) for c in ("kind", "piece", "seq", "fp"))
        edges = _runs([of, kind])
        for start, end in zip(edges, edges[1:]):
            if of[start].as_py() != piece:
                yield from finish()
                piece, window, parts, checks, met = of[start].as_py(), None, [], deque(), None
            if kind[start].as_py() == AGAIN[WINDOW]:
                parts += fp[start:end].to_pylist()
                continue
            if kind[start].as_py() == AGAIN[CHECK]:
                side = slice(_DIGEST, None) if facts[piece][2] else slice(0, _DIGEST)
                checks.extend((s, d[side]) for s, d in zip(seq[start:end].to_pylist(), fp[start:end].to_pylist()))
                continue
            if window is None:
                blob = b"".join(parts)
                window, begin, parts = new_window(facts[piece][0]), _digest(blob), []
                window.load(blob)
            numbers = seq[start:end].to_numpy()
            at = 0
            while met is None and at < len(numbers):
                # Up to the next check, which is after all rows of its arrival number.
                upto = int(np.searchsorted(numbers, checks[0][0], side="right")) if checks else len(numbers)
                if checks and upto <= at:
                    place, digest = checks.popleft()
                    if hashlib.sha256(window.save()).digest() == digest:
                        met = place
                    continue
                own = fp[start + at : start + upto]
                yield _batch(HEAD, piece, seq[start + at : start + upto], own, _steps(window, own, _repeats(own)))
                at = upto
    yield from finish()


# ---------------------------------------------------------------- streaming


def _pack_scopes(windows: dict[bytes, bytes]) -> bytes:
    return struct.pack("<Q", len(windows)) + _pack(windows, *[[w] for w in windows.values()])


def _unpack_scopes(blob: bytes) -> dict[bytes, bytes]:
    count = struct.unpack_from("<Q", blob)[0]
    names, *windows = _unpack(blob[8:], count + 1)
    return dict(zip(_split(names), windows))


def continue_scopes(key: tuple, frames, state, new_window: Callable, outcomes: tuple[str, ...], own_columns: list[str]):
    """Continue the windows of a bucket's scopes over their rows of a micro-batch, each scope in order.

    Only arrival numbers, scopes and fingerprints are put in order; the frames, with
    whatever else they carry, go out as they came. Windows of scopes without a row stay packed.
    """
    saved = _unpack_scopes(state.get[0]) if state.exists else {}
    held = list(frames)
    scopes = [bytes(s) for f in held for s in f["_scope"]]
    numbers: dict[bytes, int] = {}
    place = np.array([numbers.setdefault(s, len(numbers)) for s in scopes], np.int64)
    order = np.lexsort((np.concatenate([f["seq"].to_numpy() for f in held]), place))
    fps = [bytes(fp) for f in held for fp in f["_fp"]]
    codes, changed = np.empty(len(fps), np.int64), False
    ends = np.cumsum(np.bincount(place, minlength=len(numbers))).tolist()
    for scope, start, end in zip(numbers, [0, *ends], ends):
        rows, window = order[start:end], new_window()
        if scope in saved:
            window.load(saved[scope])
        found = codes[rows] = np.array(window.steps([fps[i] for i in rows]), np.int64)
        # Where room is made on arrival, duplicates change a window too.
        if (found != DUPLICATE).any() or scope not in saved or getattr(window, "on_arrival", False):
            saved[scope], changed = window.save(), True
    if changed:
        state.update((_pack_scopes(saved),))
    names, start = np.array(outcomes, object), 0
    for f in held:
        own = codes[start : start + len(f)]
        start += len(f)
        yield f.drop(columns=own_columns).assign(outcome=names[own], is_dup=own == DUPLICATE)


def _pack_times(last: dict[bytes, int]) -> bytes:
    return _pack(last, [np.fromiter(last.values(), "<i8", len(last)).tobytes()])


def _unpack_times(blob: bytes) -> dict[bytes, int]:
    keys, times = _unpack(blob, 2)
    return dict(zip(_split(keys), np.frombuffer(times, "<i8").tolist()))


def _verdicts_by_time(frames, last: dict[bytes, int], ttl_micros: int, own_columns: list[str]):
    """The frames with verdicts by the time since the last row of the same key; `last` is brought up to date."""
    held = list(frames)
    timed = np.concatenate([f["_timed"].to_numpy() for f in held])
    times = np.concatenate([f["_at"].to_numpy() for f in held])
    keys = [bytes(k) for f in held for k in f["_key"]]
    verdicts = np.zeros(len(keys), bool)
    order = np.lexsort((np.concatenate([f["seq"].to_numpy() for f in held]), times))
    for i, t in zip(order[timed[order]].tolist(), times[order[timed[order]]].tolist()):
        before = last.get(keys[i])
        if before is None:
            last[keys[i]] = t
            continue
        verdicts[i] = abs(t - before) <= ttl_micros
        if t > before:
            last[keys[i]] = t
    out, start = [], 0
    for f in held:
        out.append(f.drop(columns=own_columns).assign(is_dup=verdicts[start : start + len(f)]))
        start += len(f)
    return out


def continue_keys(key: tuple, frames, state, ttl_micros: int, own_columns: list[str]):
    """Verdicts of a bucket's scopes and fingerprints by the time since the last row of each."""
    last = _unpack_times(state.get[0]) if state.exists else {}
    out = _verdicts_by_time(frames, last, ttl_micros, own_columns)
    if last:
        state.update((_pack_times(last),))
    yield from out


def expire_keys(key: tuple, frames, state, ttl_micros: int, own_columns: list[str]):
    """`continue_keys`, and the end of each key's state once the watermark has passed it by the time to live."""
    last = _unpack_times(state.get[0]) if state.exists else {}
    out = [] if state.hasTimedOut else _verdicts_by_time(frames, last, ttl_micros, own_columns)
    now = state.getCurrentWatermarkMs()
    # A row at exactly the time to live is still a repeat.
    last = {k: t for k, t in last.items() if (t + ttl_micros) // 1000 + 1 > now}
    if last:
        state.update((_pack_times(last),))
        state.setTimeoutTimestamp((min(last.values()) + ttl_micros) // 1000 + 1)
    elif state.exists:
        state.remove()
    yield from out
