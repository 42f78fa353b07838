"""Deduplication whose verdicts depend on earlier verdicts of the scope.

A window of the last W accepted fingerprints cannot be written as a window
function: whether a row enters depends on which rows entered before. These
operators run in two ways:

* Scopes with so few distinct fingerprints that nothing is ever evicted are
  settled by aggregation (see `dedupe`).
* The other rows are range partitioned and sorted by (scope, seq), so each task
  reads one contiguous piece of every scope's history. A small scope lies in
  one piece; a scope of any size is cut into as many pieces as it needs. All
  pieces are scanned at once, each starting from an empty window, and each
  writes the window it ends with. A piece whose first scope began in an earlier
  piece is then scanned again from that piece's final window, until every piece
  has started from the window its predecessor ended with. The result equals one
  pass in order; no task holds more than a piece and one window.

The first scans are often right or nearly so: with at most half the rows
repeated, two FIFO windows fed the same rows usually become equal within some 15
window lengths. Where they do not, the repair goes on piece by piece along
the chain: bounded tasks in sequence, since the dependence itself is a sequence.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from functools import partial, reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.records import SCOPE, digest_bytes, quoted
from ..session import new_table_path, task_count, written
from . import window_state
from .dedupe import FilterSize, filter_verdicts, register_dedupe, two_stage_verdicts, with_outcome
from .ordering import in_order
from .window_state import (
    AGAIN,
    CHECK,
    DUPLICATE,
    FALSE_HIT,
    GUESS_SHIFT,
    HEAD,
    NEW,
    SCAN_SCHEMA,
    SETTLED,
    SUMMARY,
    WINDOW,
    FifoWindow,
    ManyWindows,
    NewWindow,
    ScreenedWindow,
    continue_scopes,
    rescan_heads,
    scan_pieces,
)

cloudpickle.register_pickle_by_value(window_state)


class _Chain:
    """Which pieces started from the window their predecessor ended with.

    One small record per piece, kept on the driver.
    """

    def __init__(self, summaries: dict[int, dict]):
        self.pieces = sorted(summaries)
        self.facts = summaries
        self.before = {
            p: q for q, p in zip(self.pieces, self.pieces[1:]) if summaries[q]["last"] == summaries[p]["first"]
        }
        self.rows_round = dict.fromkeys(self.pieces, 0)
        self.window_round = dict.fromkeys(self.pieces, 0)
        self.first_end = {p: summaries[p]["end"] for p in self.pieces}

    def pending(self, frontier_only: bool) -> tuple[list[int], list[int]]:
        """Pieces to run again now, and all whose start is not final yet.

        A piece runs again if it started from another window than its
        predecessor's last; `frontier_only` waits until that one is final.
        """
        final_end, todo, unsettled = {}, [], []
        for p in self.pieces:
            q = self.before.get(p)
            matches = q is None or self.facts[p]["start"] == self.facts[q]["end"]
            final_start = q is None or (matches and final_end[q])
            final_end[p] = final_start or not self.facts[p]["whole"]
            if not final_start:
                unsettled.append(p)
            if not matches and (final_end[q] or not frontier_only):
                todo.append(p)
        return todo, unsettled

    def update(self, round_no: int, piece: int, facts: dict) -> None:
        self.facts[piece] = {**self.facts[piece], **facts}
        self.rows_round[piece] = round_no
        if "end" in facts:
            self.window_round[piece] = round_no
        elif facts["upto"] is not None:  # it has met its first scan, and ends as that does
            self.facts[piece]["end"], self.window_round[piece] = self.first_end[piece], 0


def _read_summaries(table: DataFrame) -> dict[int, dict]:
    """What each piece reports, in one or more records."""
    found: dict[int, dict] = {}
    for r in table.where(F.col("kind") == SUMMARY).select("piece", "fp").collect():
        found.setdefault(r["piece"], {}).update(json.loads(bytes(r["fp"])))
    return found


def scan_in_order(
    rows: DataFrame,
    new_window: Callable,
    scope: Sequence[str],
    pieces: int | None = None,
    speculative_rounds: int = 0,
    firsts: DataFrame | None = None,
) -> DataFrame:
    """(seq, verdict) of the accepted rows of `rows` (scope..., seq, fp).

    In a speculative round every piece that started wrong runs again at once,
    from the best window known; after those, only pieces whose start is final.
    firsts: the first row of each scope and fingerprint, which every window
    accepts. They travel as marks beside the rows and let a piece's first scan
    guess the window that it starts from.
    """
    spark = rows.sparkSession
    base = new_table_path(spark, "scan")

    def table(round_no: int) -> DataFrame:
        return spark.read.schema(SCAN_SCHEMA).parquet(f"{base}/round={round_no}")

    marked = rows.select(*scope, "seq", "fp", F.lit(False).alias("mark"))
    if firsts is None:
        sorted_rows = in_order(marked, [*scope, "seq"], pieces)
    else:
        marked = marked.unionByName(firsts.select(*scope, "seq", "fp", F.lit(True).alias("mark")))
        ranged = marked.repartitionByRange(pieces, *scope, "seq") if pieces else marked.repartitionByRange(*scope, "seq")
        sorted_rows = ranged.sortWithinPartitions(*scope, "seq", "fp", F.desc("mark"))
    scanned = sorted_rows.mapInArrow(partial(scan_pieces, new_window=new_window, depth=len(scope)), SCAN_SCHEMA)
    scanned.write.parquet(f"{base}/round=0")
    chain = _Chain(_read_summaries(table(0)))

    round_no, apart = 0, None
    while True:
        todo, unsettled = chain.pending(frontier_only=round_no >= speculative_rounds)
        if not todo:
            break
        round_no += 1
        # Windows to start from, with the piece that needs each: a row per piece.
        needs = spark.createDataFrame(
            [(chain.before[p], chain.window_round[chain.before[p]], p) for p in todo],
            "of int, round int, piece int",
        )
        rounds = sorted({chain.window_round[chain.before[p]] for p in todo})
        windows = (
            spark.read.schema(SCAN_SCHEMA + ", round int")
            .option("basePath", base)
            .parquet(*[f"{base}/round={r}" for r in rounds])
            .where(F.col("kind") == WINDOW)
            .withColumnRenamed("piece", "of")
            .join(F.broadcast(needs), ["of", "round"])
            .select("kind", "piece", "seq", "fp")
        )
        wanted = F.col("kind").isin(HEAD, CHECK)
        if apart is None and round_no > speculative_rounds and len(unsettled) > len(todo):
            # More rounds of few pieces follow: give each piece its own folder,
            # so that a round opens only the files it needs.
            apart = new_table_path(spark, "heads")
            table(0).where(wanted & F.col("piece").isin(unsettled)).repartition(
                len(unsettled), "piece"
            ).write.partitionBy("piece").parquet(apart)
        if apart is None:
            heads = table(0).where(wanted & F.col("piece").isin(todo))
        else:
            reader = spark.read.schema(SCAN_SCHEMA).option("basePath", apart)
            heads = reader.parquet(*[f"{apart}/piece={p}" for p in todo])
        place = reduce(lambda c, k: c.when(F.col("kind") == k, AGAIN[k]), AGAIN, F)
        facts = {p: (tuple(chain.facts[p]["first"]), chain.facts[p]["whole"], chain.facts[p]["guess"]) for p in todo}
        (
            windows.unionByName(heads.select("kind", "piece", "seq", "fp"))
            .withColumn("kind", place)
            .repartitionByRange(len(todo), "piece")
            .sortWithinPartitions("piece", "kind", "seq")
            .mapInArrow(partial(rescan_heads, new_window=new_window, facts=facts), SCAN_SCHEMA)
            .write.parquet(f"{base}/round={round_no}")
        )
        for piece, facts in _read_summaries(table(round_no)).items():
            chain.update(round_no, piece, facts)

    settled = table(0).where(F.col("kind") == SETTLED).select("seq", "verdict")
    heads, guessed = table(0).where(F.col("kind") == HEAD), F.lit(False)
    if round_no:
        # A row per piece: which round's rows hold, up to where, and which guess of the first scan holds behind.
        rows = [(p, r, chain.facts[p].get("upto"), chain.facts[p]["guess"]) for p, r in sorted(chain.rows_round.items())]
        latest = spark.createDataFrame(rows, "piece int, _round int, _upto bigint, _guess boolean")
        behind = (F.col("round") == 0) & (F.col("seq") > F.col("_upto"))
        heads = (
            spark.read.schema(SCAN_SCHEMA + ", round int")
            .parquet(base)
            .where(F.col("kind") == HEAD)
            .join(F.broadcast(latest), "piece")
            .where((F.col("round") == F.col("_round")) | F.coalesce(behind, F.lit(False)))
        )
        guessed = F.col("_guess") & (F.col("round") == 0) & (F.col("_round") > 0)
    if firsts is not None:
        # A piece that needed no other scan began with its scope, where both guesses agree.
        own = F.when(guessed, F.shiftright("verdict", GUESS_SHIFT)).otherwise(F.col("verdict"))
        heads = heads.withColumn("verdict", own.bitwiseAND((1 << GUESS_SHIFT) - 1))
    return settled.unionByName(heads.where(F.col("verdict") != new_window.nothing).select("seq", "verdict"))


# --------------------------------------------------------------- operators


# Rows per piece: enough windows to forget where the scan began, and enough
# work to be worth a task; the longer ones where there are tasks for all.
_PIECE_WINDOWS = 8
_LONG_PIECE_WINDOWS = 16
_DIGEST = window_state._DIGEST
_PIECE_ROWS = 20_000
# FIFO windows tend to agree after a while wherever they began; the phase of a
# filter generation does not, so its pieces wait for a final start at once.
_FIFO_ROUNDS = 2


def scope_text(df: DataFrame, name: str) -> Column:
    """A scope column of any type as text without nulls: null is a scope of its own."""
    kind = df.schema[name].dataType
    text = F.hex(quoted(name)) if isinstance(kind, T.BinaryType) else quoted(name).cast("string")
    return F.coalesce(F.concat(F.lit("="), text), F.lit("")).alias(name)


def _verdicts(
    df: DataFrame,
    new_window: Callable,
    window: int,
    settled_up_to: int | Column,
    native: Callable[[DataFrame], DataFrame] | None,
    scope: Sequence[str],
    seq: str,
    pieces: int | None,
    speculative_rounds: int = 0,
    guess: bool = False,
) -> DataFrame:
    """(seq, verdict) of accepted rows; `native` serves scopes that never evict,
    which are those of up to `settled_up_to` fingerprints. Without it their first
    arrivals, which alone can be accepted, are scanned with the other scopes' rows."""
    placed = df.where(F.col(seq).isNotNull())
    fp = F.coalesce(digest_bytes(F.col("fp").cast("binary")), F.lit(bytes(_DIGEST)))
    narrow = placed.select(*[scope_text(df, c) for c in scope], fp.alias("fp"), F.col(seq).alias("seq"))
    firsts = written(
        narrow.groupBy(*scope, "fp").agg(F.min("seq").alias("seq"), F.count("*").alias("rows")), "firsts"
    )
    scopes = firsts.groupBy(*scope).agg(F.count("*").alias("n"), F.sum("rows").alias("rows"))
    evicts = F.col("n") > settled_up_to
    evicting, all_rows, first_rows = scopes.agg(
        F.sum(F.when(evicts, F.col("rows"))), F.sum("rows"), F.sum(F.when(~evicts, F.col("n")))
    ).first()
    if evicting is None and (native or all_rows is None):
        return native(firsts) if native else _all_new(firsts)
    rows_to_scan, small = evicting or 0, None
    if evicting is None:
        rows, rows_to_scan = firsts.select(*scope, "fp", "seq"), first_rows
    elif evicting == all_rows:
        rows = narrow
    else:
        large = written(scopes.where(evicts).select(*scope), "large-scopes")
        rows, settled = narrow.join(large, list(scope), "left_semi"), firsts.join(large, list(scope), "left_anti")
        if native:
            small = native(settled)
        else:
            rows, rows_to_scan = rows.unionByName(settled.select(*scope, "fp", "seq")), evicting + first_rows
    if not pieces:
        most = max(1, rows_to_scan // max(_PIECE_WINDOWS * window, _PIECE_ROWS))
        fewest = max(1, rows_to_scan // max(_LONG_PIECE_WINDOWS * window, _PIECE_ROWS))
        pieces = max(fewest, min(most, task_count(df.sparkSession)))
    if not guess:
        marks = None
    else:
        marks = firsts if small is None else firsts.join(large, list(scope), "left_semi")
    scanned = scan_in_order(rows, new_window, scope, pieces, speculative_rounds, marks)
    return scanned if small is None else small.unionByName(scanned)


def _all_new(firsts: DataFrame) -> DataFrame:
    return firsts.select("seq", F.lit(NEW).cast("bigint").alias("verdict"))


def _flag(df: DataFrame, verdicts: DataFrame, seq: str, outcome: bool) -> DataFrame:
    flagged = with_outcome(df, verdicts.withColumnRenamed("seq", seq), seq)
    return flagged if outcome else flagged.drop("outcome")


def fifo_verdicts(df: DataFrame, window: int, scope: Sequence[str] = SCOPE, seq: str = "seq", pieces: int | None = None) -> DataFrame:
    """(seq, verdict) of the rows that `dedupe_scoped_fifo` accepts, for those who only count or keep them."""
    make = NewWindow(partial(FifoWindow, window))
    return _verdicts(df, make, window, window, _all_new, scope, seq, pieces, _FIFO_ROUNDS, guess=True)


def dedupe_scoped_fifo(
    df: DataFrame,
    window: int = 100_000,
    scope: Sequence[str] = SCOPE,
    seq: str = "seq",
    pieces: int | None = None,
) -> DataFrame:
    """A repeat of one of the last `window` accepted fingerprints of its scope."""
    return _flag(df, fifo_verdicts(df, window, scope, seq, pieces), seq, outcome=False)


def rotating_verdicts(
    df: DataFrame,
    window: int,
    size: FilterSize | None = None,
    scope: Sequence[str] = SCOPE,
    seq: str = "seq",
    pieces: int | None = None,
) -> DataFrame:
    """(seq, verdict) of the rows that `dedupe_scoped_rotating` accepts."""
    bits = None if size is None else (size.bits, size.hashes)
    native = _all_new if size is None else partial(two_stage_verdicts, by=scope, size=size)
    make = NewWindow(partial(ScreenedWindow, window, window, bits))
    return _verdicts(df, make, window, window, native, scope, seq, pieces)


def dedupe_scoped_rotating(
    df: DataFrame,
    window: int = 100_000,
    size: FilterSize | None = None,
    scope: Sequence[str] = SCOPE,
    seq: str = "seq",
    pieces: int | None = None,
) -> DataFrame:
    """The window behind a filter that is emptied every `window` insertions.

    Differs from `dedupe_scoped_fifo` both ways (see `ScreenedWindow`). Without
    `size` the filter is ideal, and `outcome` still shows false hits: rows the
    filter knows whose cache entry went with an older copy.
    """
    return _flag(df, rotating_verdicts(df, window, size, scope, seq, pieces), seq, outcome=True)


def dedupe_worker_window(
    df: DataFrame,
    window: int = 100_000,
    worker: str = "worker_id",
    seq: str = "seq",
    pieces: int | None = None,
) -> DataFrame:
    """One window per worker that makes room before the lookup.

    Lookups therefore see the last `window - 1` accepted fingerprints. A filter
    in front that is never emptied changes no verdict.
    """
    return dedupe_scoped_fifo(df, window - 1, (worker,), seq, pieces)


def dedupe_worker_rotating(
    df: DataFrame,
    window: int = 100_000,
    generation: int = 20_000,
    worker: str = "worker_id",
    seq: str = "seq",
    pieces: int | None = None,
) -> DataFrame:
    """`dedupe_worker_window` behind a filter emptied on the first arrival after
    `generation` insertions."""
    make = NewWindow(partial(ScreenedWindow, window, generation, None, on_arrival=True))
    found = _verdicts(df, make, window, min(window, generation) - 1, _all_new, (worker,), seq, pieces)
    return _flag(df, found, seq, outcome=True)


def tumbling_verdicts(
    df: DataFrame, size: FilterSize, window: int, scope: Sequence[str] = SCOPE, seq: str = "seq", pieces: int | None = None
) -> DataFrame:
    """(seq, verdict) of the rows that `dedupe_filter_tumbling` accepts."""
    native = partial(filter_verdicts, by=scope, size=size)
    make = NewWindow(partial(ScreenedWindow, 0, window, (size.bits, size.hashes), exact=False))
    return _verdicts(df, make, window, window, native, scope, seq, pieces)


def dedupe_filter_tumbling(
    df: DataFrame,
    size: FilterSize,
    window: int = 100_000,
    scope: Sequence[str] = SCOPE,
    seq: str = "seq",
    pieces: int | None = None,
) -> DataFrame:
    """Filter membership alone, the filter emptied every `window` insertions."""
    return _flag(df, tumbling_verdicts(df, size, window, scope, seq, pieces), seq, outcome=False)


for _name, _policy in {
    "scoped_fifo": dedupe_scoped_fifo,
    "scoped_rotating": dedupe_scoped_rotating,
    "worker_window": dedupe_worker_window,
    "worker_rotating": dedupe_worker_rotating,
    "filter_tumbling": dedupe_filter_tumbling,
}.items():
    register_dedupe(_name, _policy)


def last_accepted(
    df: DataFrame, verdicts: DataFrame, window: int, scope: Sequence[str] = SCOPE, seq: str = "seq"
) -> DataFrame:
    """The windows after the last row, as rows (scope, seq, fp): each scope's last `window` accepted ones.

    Tasks keep a scope's last rows each before these meet.
    """
    kept = df.select(*scope, seq, "fp").join(verdicts.select(F.col("seq").alias(seq)).hint("merge"), seq)
    newest = Window.partitionBy(*scope).orderBy(F.desc(seq))
    placed = kept.withColumn("_place", F.row_number().over(newest)).where(F.col("_place") <= window)
    return placed.select(*scope, seq, "fp")


# ------------------------------------------------------------------- sweeps


def fifo_setting(window: int) -> tuple[Callable, int]:
    return partial(FifoWindow, window), window


def rotating_setting(window: int, size: FilterSize | None = None) -> tuple[Callable, int]:
    return partial(ScreenedWindow, window, window, size and (size.bits, size.hashes)), window


def worker_setting(window: int, generation: int = 0) -> tuple[Callable, int]:
    """As `dedupe_worker_window`, or `dedupe_worker_rotating` with a generation."""
    if not generation:
        return fifo_setting(window - 1)
    return partial(ScreenedWindow, window, generation, None, on_arrival=True), min(window, generation) - 1


def sweep_counts(
    rows: DataFrame, settings: Mapping[str, tuple[Callable, int]], scope: Sequence[str] = SCOPE, pieces: int | None = None
) -> DataFrame:
    """Records, accepted rows and false hits per setting, in one run for all.

    `rows` holds each record once per setting, under `setting`, which becomes
    part of the scope: the source is read once and one shuffle serves the sweep.
    """
    names = sorted(settings)
    code = reduce(lambda c, i: c.when(F.col("setting") == names[i], i), range(len(names)), F)
    limit = reduce(lambda c, n: c.when(F.col("setting") == f"={n}", settings[n][1]), names, F)
    numbered = rows.select("setting", *scope, "fp", (F.col("seq") * len(names) + code).alias("seq"))
    make = NewWindow({f"={n}": m for n, (m, _) in settings.items()})  # as `scope_text` writes it
    widest = max(n for _, n in settings.values())
    found = _verdicts(numbered, make, widest, limit, _all_new, ["setting", *scope], "seq", pieces)
    accepted = (
        found.withColumn("setting", F.array(*map(F.lit, names))[(F.col("seq") % len(names)).cast("int")])
        .groupBy("setting")
        .agg(
            F.count("*").alias("evaluations"),
            F.sum(F.when(F.col("verdict") == FALSE_HIT, 1).otherwise(0)).cast("bigint").alias("false_positives"),
        )
    )
    return rows.groupBy("setting").agg(F.count("*").alias("total_records")).join(accepted, "setting")


def many_verdicts(
    df: DataFrame,
    settings: Sequence[tuple[Callable, int]],
    scope: Sequence[str] = SCOPE,
    sizes: Mapping[int, FilterSize] | None = None,
    seq: str = "seq",
    pieces: int | None = None,
) -> DataFrame:
    """(seq, verdict) under several windows at once, for rows that any of them accepts.

    Each record is read, shuffled and scanned once, however many windows there
    are, up to 31; window i's verdict is bits 2i and 2i + 1 (`verdict_of`). sizes: the
    filters of those windows that have one.
    """
    if len(settings) > ManyWindows.MOST:
        raise ValueError(f"at most {ManyWindows.MOST} windows in one pass")
    make = partial(ManyWindows, tuple(m for m, _ in settings))
    nothing = ManyWindows.all_have(DUPLICATE, len(settings))
    # A filter may know a first arrival: where there is one, windows decide, and no bit of a filter becomes a row.
    native = None if sizes else _all_new
    limits = [limit for _, limit in settings]
    return _verdicts(df, NewWindow(make, nothing), max(limits), min(limits), native, scope, seq, pieces)


def verdict_of(i: int) -> Column:
    return F.shiftright("verdict", 2 * i).bitwiseAND(3)


def many_counts(verdicts: DataFrame, windows: int, by: Sequence[Column] = ()) -> DataFrame:
    """Per window (column `window`): accepted rows and false hits among the verdicts of `many_verdicts`."""
    counts = [
        F.struct(
            F.lit(i).alias("window"),
            F.count_if(verdict_of(i) != DUPLICATE).alias("evaluations"),
            F.count_if(verdict_of(i) == FALSE_HIT).alias("false_positives"),
        )
        for i in range(windows)
    ]
    counted = verdicts.groupBy(*by).agg(F.array(*counts).alias("_w"))
    kept = [c for c in counted.columns if c != "_w"]
    return counted.select(*kept, F.explode("_w").alias("_w")).select(*kept, "_w.*")
