"""External induced sorting of a shard of texts, with common-prefix values.

Positions whose suffix is smaller than the next are of kind S, the others of kind L; an S position after an L position
is a seed. Sorted seed suffixes induce the order of all L suffixes in one ascending scan, those induce all S
suffixes in a descending one: scanning a suffix puts the one that starts a symbol earlier into the queue of that
symbol. The queues carry (position, common prefix with the one before it in the queue). A predecessor's common prefix
is one more than the least common prefix scanned since the last entry into the same queue. The seeds themselves are
sorted by the same two scans over their substrings, which gives them names, and by the recursion on the string of names.

All that is asked for is where a string of `depth` symbols repeats, so common prefixes are cut at `depth` and the
recursion may stop once its names tell apart what differs within it; it ends there in doubling of names.

Queues are taken in order of their symbol, so a priority queue is one first-in-first-out queue a symbol. What exceeds the memory
limit is appended to a file a queue in a temporary folder of the task and read back block by block when its turn comes.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 16
_SYMBOLS = 258  # 0 ends the shard, 1 ends a text, 2.. are bytes
_ENTRY = np.dtype([("at", "<i8"), ("common", "<i2")])


class DiskQueues:
    """A first-in-first-out queue of entries for each symbol; beyond `limit` entries in memory they go to files."""

    def __init__(self, limit: int, folder: str):
        self._limit, self._folder = limit, tempfile.mkdtemp(dir=folder)
        self._held: list[list[np.ndarray]] = [[] for _ in range(_SYMBOLS)]
        self._spilled = [0] * _SYMBOLS
        self._count = 0
        self.empty = np.ones(_SYMBOLS, bool)
        self.written = 0

    def _path(self, symbol: int) -> str:
        return os.path.join(self._folder, f"{symbol}.queue")

    def put(self, symbol: int, entries: np.ndarray) -> None:
        self._held[symbol].append(entries)
        self.empty[symbol] = False
        self._count += len(entries)
        if self._count > self._limit:
            self._spill()

    def _spill(self) -> None:
        for symbol, blocks in enumerate(self._held):
            if blocks:
                with open(self._path(symbol), "ab") as out:
                    for block in blocks:
                        block.tofile(out)
                        self._spilled[symbol] += len(block)
                        self.written += len(block)
                self._held[symbol] = []
        self._count = 0

    def blocks(self, symbol: int) -> Iterator[np.ndarray]:
        """The queue's entries in order; it may grow while it is read."""
        read = 0
        while True:
            if read < self._spilled[symbol]:
                block = np.fromfile(self._path(symbol), _ENTRY, BLOCK, offset=read * _ENTRY.itemsize)
                read += len(block)
                yield block
            elif self._held[symbol]:
                blocks, self._held[symbol] = self._held[symbol], []
                joined = np.concatenate(blocks)
                self._count -= len(joined)
                for start in range(0, len(joined), BLOCK):
                    yield joined[start : start + BLOCK]
            else:
                break
        if self._spilled[symbol]:
            os.remove(self._path(symbol))
            self._spilled[symbol] = 0


def range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """min(values[first .. last]) for each pair, by a sparse table."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        step = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
    out = np.empty(len(first), values.dtype)
    level = np.frexp(last - first + 1)[1] - 1
    for k in np.unique(level):
        own = level == k
        out[own] = np.minimum(levels[k][first[own]], levels[k][last[own] - (1 << int(k)) + 1])
    return out


class Shard:
    def __init__(self, texts: list[bytes], depth: int, limit: int = 1 << 22, folder: str | None = None):
        self.depth, self._limit, self._folder = depth, limit, folder
        raw = np.frombuffer(b"".join(t + b"\0" for t in texts) + b"\0", np.uint8)
        self.n = n = len(raw)  # with the symbol that ends the shard
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        padded = np.zeros(n // 4 * 4 + 8, np.int16)
        self.symbols = padded[:n]
        self.symbols[:] = raw
        self.symbols += 2
        self.symbols[self.starts + lengths] = 1
        self.symbols[-1] = 0
        self._padded = padded.view("<u8")
        # Kind S: smaller than the next symbol, or as the next one where they are equal.
        rise = np.sign(self.symbols[1:] - self.symbols[:-1]).astype(np.int8)
        differs = np.flatnonzero(rise)
        after = differs[np.searchsorted(differs, np.arange(n - 1))]  # the end differs from what is before it
        self.is_s = np.append(rise[after] > 0, True)
        self.seeds = np.flatnonzero(self.is_s[1:] & ~self.is_s[:-1]) + 1

    # -- scans

    def _scan(self, queues: DiskQueues, kind_s: bool, closing, visit, commons: bool) -> None:
        """Visit all queues by symbol; after a queue's entries come those that `closing` has for the symbol."""
        symbols, depth = self.symbols, self.depth
        since = np.full(_SYMBOLS, depth, np.int16)
        started = ~queues.empty
        order = range(_SYMBOLS - 1, -1, -1) if kind_s else range(_SYMBOLS)
        for symbol in order:
            last = -1
            for own, blocks in ((True, queues.blocks(symbol)), (False, closing(symbol))):
                first_block = True
                for block in blocks:
                    if not len(block):
                        continue
                    if commons and not own and first_block:
                        block = block.copy()
                        block["common"][0] = self._common(last, int(block["at"][0])) if last >= 0 else 0
                    first_block = False
                    last = int(block["at"][-1])
                    visit(symbol, own, block)
                    at, common = block["at"], block["common"]
                    before = at - 1
                    enters = np.flatnonzero((before >= 0) & (self.is_s[before] == kind_s))
                    if len(enters):
                        into = symbols[before[enters]]
                        by = np.argsort(into, kind="stable")
                        enters, into = enters[by], into[by]
                        heads = np.flatnonzero(np.r_[True, into[1:] != into[:-1]])
                        entries = np.zeros(len(enters), _ENTRY)
                        entries["at"] = before[enters]
                        kinds = into[heads]
                        if commons:
                            least = np.empty(len(enters), np.int16)
                            inner = np.ones(len(enters), bool)
                            inner[heads] = False
                            inner = np.flatnonzero(inner)
                            least[inner] = range_minima(common, enters[inner - 1] + 1, enters[inner])
                            least[heads] = np.minimum(since[kinds], np.minimum.accumulate(common)[enters[heads]])
                            made = np.minimum(least + 1, depth)
                            fresh = ~started[kinds]
                            made[heads[fresh]] = 0
                            entries["common"] = made
                            tail = np.append(np.minimum.accumulate(common[::-1])[::-1], depth)
                            since = np.minimum(since, tail[0])
                            since[kinds] = tail[enters[np.append(heads[1:], len(enters)) - 1] + 1]
                        started[kinds] = True
                        for kind, part in zip(kinds.tolist(), np.split(entries, heads[1:]), strict=True):
                            queues.put(kind, part)
                    elif commons:
                        since = np.minimum(since, common.min())

    def _induce(self, seeds: np.ndarray, commons: np.ndarray, visit, use_commons: bool) -> None:
        """Both scans from the seeds in the given order; `visit` sees the descending one."""
        with tempfile.TemporaryDirectory(dir=self._folder) as folder:
            lower = DiskQueues(self._limit, folder)
            first = self.symbols[seeds]
            cuts = np.searchsorted(first, np.arange(_SYMBOLS + 1))

            def seeds_of(symbol: int) -> Iterator[np.ndarray]:
                for start in range(cuts[symbol], cuts[symbol + 1], BLOCK):
                    end = min(cuts[symbol + 1], start + BLOCK)
                    block = np.zeros(end - start, _ENTRY)
                    block["at"], block["common"] = seeds[start:end], commons[start:end]
                    yield block

            found = DiskQueues(self._limit, folder)

            def keep(symbol: int, own: bool, block: np.ndarray) -> None:
                if own:
                    found.put(symbol, block.copy())

            self._scan(lower, False, seeds_of, keep, use_commons)
            self.written = lower.written + found.written
            upper = DiskQueues(self._limit, folder)

            def descending(symbol: int) -> Iterator[np.ndarray]:
                # Largest first; an entry's common prefix is then that with the entry after it.
                blocks = list(found.blocks(symbol))
                after = 0
                for block in reversed(blocks):
                    out = block[::-1].copy()
                    out["common"][1:] = block["common"][1:][::-1]
                    out["common"][0] = after
                    after = block["common"][0]
                    yield out

            self._scan(upper, True, descending, visit, use_commons)
            self.written += upper.written

    # -- seeds

    def _words(self, at: np.ndarray) -> np.ndarray:
        """The four symbols from each position on."""
        return np.lib.stride_tricks.as_strided(self._padded, (self.n,), (2,))[at]

    def _common(self, one: int, other: int) -> int:
        a, b = self.symbols[one : one + self.depth], self.symbols[other : other + self.depth]
        size = min(len(a), len(b))
        differs = np.flatnonzero(a[:size] != b[:size])
        return int(differs[0]) if len(differs) else size

    def common_prefixes(self, one: np.ndarray, other: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Common prefix of each pair of positions, cut at `limit`."""
        out = np.zeros(len(one), np.int64)
        open_ = np.arange(len(one))
        while len(open_):
            reach = out[open_]
            a, b = one[open_] + reach, other[open_] + reach
            inside = (a < self.n) & (b < self.n) & (reach < limit[open_])
            open_, a, b = open_[inside], a[inside], b[inside]
            apart = self._words(a) ^ self._words(b)
            low = apart & (~apart + np.uint64(1))  # the lowest bit that differs
            same = np.where(apart == 0, 4, (np.frexp(low.astype(np.float64))[1] - 1) // 16)
            out[open_] += same
            open_ = open_[same == 4]
        return np.minimum(out, limit)

    def _sorted_seeds(self) -> np.ndarray:
        """The seeds in the order of their suffixes, as far as the depth tells them apart."""
        seeds = self.seeds
        by_symbol = seeds[np.argsort(self.symbols[seeds], kind="stable")]
        is_seed = np.zeros(self.n, bool)
        is_seed[seeds] = True
        kept: list[np.ndarray] = []

        def collect(symbol: int, own: bool, block: np.ndarray) -> None:
            if own:
                kept.append(block["at"][is_seed[block["at"]]])

        self._induce(by_symbol, np.zeros(len(by_symbol), np.int16), collect, False)
        # The end of the shard is a seed that nothing induces; it is the smallest.
        ordered = np.concatenate([np.array([self.n - 1]), *[k[::-1] for k in reversed(kept)]]) if kept else np.array([self.n - 1])
        number = np.zeros(self.n, np.int64)
        number[seeds] = np.arange(len(seeds))
        place = number[ordered]
        lengths = np.append(np.diff(seeds), 0) + 1
        same = lengths[place[1:]] == lengths[place[:-1]]
        pairs = np.flatnonzero(same)
        a, b, size = ordered[pairs], ordered[pairs + 1], lengths[place[pairs]]
        equal = self.common_prefixes(a, b, size) == size
        new = np.ones(len(ordered), bool)
        new[pairs[equal] + 1] = False
        rank = np.empty(len(seeds), np.int64)
        rank[place] = np.cumsum(new) - 1
        # The recursion on the string of names. A name spans two symbols at least.
        width = 1
        while 2 * width < self.depth + 2 and rank.max(initial=0) < len(seeds) - 1:
            following = np.zeros(len(seeds), np.int64)
            following[:-width] = rank[width:] + 1
            _, rank = np.unique(rank * (len(seeds) + 1) + following, return_inverse=True)
            width *= 2
        return seeds[np.argsort(rank, kind="stable")]

    def repeated(self) -> np.ndarray:
        """Whether a string of `depth` bytes that lies within a text starts at each position and at another one too."""
        marked = np.zeros(self.n, bool)
        if self.n <= self.depth:
            return marked
        seeds = self._sorted_seeds()
        commons = np.zeros(len(seeds), np.int16)
        commons[1:] = self.common_prefixes(seeds[:-1], seeds[1:], np.full(len(seeds) - 1, self.depth))
        previous = [-1]

        def mark(symbol: int, own: bool, block: np.ndarray) -> None:
            at, common = block["at"], block["common"]
            full = np.flatnonzero(common >= self.depth)
            if len(full):
                marked[at[full]] = True
                marked[np.where(full > 0, at[full - 1], previous[0])] = True
            previous[0] = int(at[-1])

        self._induce(seeds, commons, mark, True)
        # Only where the whole string is inside a text.
        fits = np.zeros(self.n, bool)
        whole = self.n - self.depth
        ends = np.concatenate(([0], np.cumsum(self.symbols < 2, dtype=np.int32)))
        fits[: whole + 1] = ends[self.depth :][: whole + 1] == ends[: whole + 1]
        return marked & fits
