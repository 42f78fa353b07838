"""Configuration sweeps over the dedupe operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.records import SCOPE
from ..operators.dedupe import FilterSize, dedupe_filter_only, dedupe_none, first_seen, filter_misses
from ..operators.ordering import dense_index
from ..operators.report import best_config, comparison, dedupe_stats, exact_stats, percent, trial_log, verdict_stats
from ..operators.routing import dedupe_two_level, partition_rollup, route, worker_column
from ..operators.windowed import (
    fifo_setting,
    many_counts,
    many_verdicts,
    rotating_setting,
    rotating_verdicts,
    sweep_counts,
    worker_setting,
)
from ..operators.workload import draw_order, draw_rows, duplicate_pressure
from ..session import written

# The ten configurations (workers, routing, filter capacity,
# generation, where the exact check runs) at error rate 0.01.
CONFIGURATIONS = {
    "no dedupe": (1, "tenant", None, 0, None),
    "filter only": (1, "tenant", 500_000, 0, None),
    "exact only": (1, "tenant", None, 0, "local"),
    "exact list": (1, "tenant", None, 0, "local"),
    "central filter+exact": (1, "tenant", 500_000, 0, "local"),
    "hash filter, global exact": (4, "hash", 200_000, 0, "global"),
    "tenant filter+exact": (4, "tenant", 200_000, 0, "local"),
    "hash filter+exact": (4, "hash", 200_000, 0, "local"),
    "hash rotating filter+exact": (4, "hash", 100_000, 20_000, "local"),
    "hash filter+exact, 8 workers": (8, "hash", 100_000, 0, "local"),
}
ERROR_RATE = 0.01

# The bounded search.
DUPLICATE_RATES = (0.1, 0.5, 1.0)
SEARCH_SETTINGS = ((0.01, 1000, 1), (0.01, 5000, 1), (0.05, 1000, 1), (0.05, 5000, 1)) + tuple(
    (0.01, 5000, workers) for workers in (2, 4, 8)
)
CONFIRM_RATE = 0.5


def _copies(view: DataFrame, settings: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """Each record once per setting, with the columns that the setting gives it."""
    rows = [
        F.struct(F.lit(name).alias("setting"), *[col.alias(c) for c, col in columns.items()])
        for name, columns in settings.items()
    ]
    return view.withColumn("_s", F.explode(F.array(*rows))).select("*", "_s.*").drop("_s")


def _local_config(workers: int, routing: str, generation: int, window: int):
    return {"worker_id": worker_column(workers, routing)}, worker_setting(window, generation)


def config_matrix(view: DataFrame, window: int = 100_000) -> DataFrame:
    """Records, drops and drop rate of every configuration.

    A filter that is never emptied has no misses, so in front of a local exact
    check it changes cost, not verdicts. All configurations with a local check
    go through one run, those with equal verdicts as one.
    """
    equal: dict[tuple, list[str]] = {}
    for name, (workers, routing, _, generation, exact) in CONFIGURATIONS.items():
        if exact == "local":
            equal.setdefault((workers, routing if workers > 1 else "", generation), []).append(name)
    local = {
        names[0]: _local_config(workers, routing, generation, window)
        for (workers, routing, generation), names in equal.items()
    }
    copies = _copies(view, {name: columns for name, (columns, _) in local.items()})
    counts = sweep_counts(copies, {name: setting for name, (_, setting) in local.items()}, ["worker_id"])
    same = reduce(
        lambda c, names: c.when(F.col("setting") == names[0], F.array(*map(F.lit, names))), equal.values(), F
    )
    rows = [
        counts.select(
            F.explode(same).alias("setting"),
            "total_records",
            (F.col("total_records") - F.col("evaluations")).alias("duplicates"),
        )
    ]
    for name, (workers, routing, capacity, _, exact) in CONFIGURATIONS.items():
        if exact == "local":
            continue
        routed = route(view, workers, routing)
        if exact == "global":
            flagged = dedupe_two_level(routed)
        elif capacity:
            flagged = dedupe_filter_only(routed, FilterSize.for_rate(capacity, ERROR_RATE), ["worker_id"])
        else:
            flagged = dedupe_none(routed)
        rows.append(dedupe_stats(flagged).select(F.lit(name).alias("setting"), "total_records", "duplicates"))
    workers = reduce(lambda c, n: c.when(F.col("config") == n, CONFIGURATIONS[n][0]), CONFIGURATIONS, F)
    return (
        reduce(DataFrame.unionByName, rows)
        .withColumnsRenamed({"setting": "config", "duplicates": "dropped"})
        .withColumn("workers", workers)
        .withColumn("dup_rate_pct", percent(F.col("dropped"), F.col("total_records")))
    )


def window_sweep(view: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Dedupe rate per window size, for both window semantics, in one pass over the records."""
    kinds = {"fifo": fifo_setting, "rotating": rotating_setting}
    names = [(kind, w) for kind in kinds for w in windows]
    found = many_verdicts(view, [kinds[kind](w) for kind, w in names])
    named = F.array(*[F.struct(F.lit(kind).alias("semantics"), F.lit(w).alias("window_size")) for kind, w in names])
    # Two numbers of the whole table; rows without an arrival number are accepted everywhere.
    total, placeless = view.agg(F.count("*"), F.count_if(F.col("seq").isNull())).first()
    accepted = F.col("evaluations") + placeless
    return (
        many_counts(found, len(names))
        .withColumn("_s", named[F.col("window")])
        .select(
            "_s.*",
            F.lit(total).cast("bigint").alias("total_records"),
            (total - accepted).alias("duplicates"),
            "false_positives",
            accepted.alias("evaluations"),
            percent(total - accepted, F.lit(total).cast("bigint")).alias("dedupe_rate_pct"),
        )
    )


def partition_sweep(view: DataFrame, workers: Sequence[int] = (1, 2, 4), window: int = 50_000) -> DataFrame:
    """Counters per worker count: routing by tenant must not change them."""
    copies = _copies(view, {str(n): {"worker_id": worker_column(n)} for n in workers})
    counts = sweep_counts(copies, {str(n): rotating_setting(window) for n in workers}, ["worker_id", *SCOPE])
    used = copies.groupBy("setting").agg(F.countDistinct("worker_id").alias("workers_used"))
    duplicates = F.col("total_records") - F.col("evaluations")
    return counts.join(used, "setting").select(
        F.col("setting").cast("int").alias("workers"),
        "workers_used",
        "total_records",
        duplicates.alias("duplicates"),
        percent(duplicates, F.col("total_records")).alias("dedupe_rate_pct"),
    )


def filter_error_sweep(
    view: DataFrame, error_rates: Sequence[float], capacities: Sequence[int], by: Sequence[str] = ()
) -> DataFrame:
    """Measured share of first arrivals that a filter wrongly knows."""
    sizes = {f"{e}/{c}": FilterSize.for_rate(c, e) for e in error_rates for c in capacities}
    firsts = first_seen(view, [*by, "fp"])
    known = filter_misses(firsts, by, sizes).groupBy("setting").agg(F.count("*").alias("misses"))
    unique = F.col("unique_records")
    total = firsts.agg(F.count("*").alias("unique_records")).withColumn(
        "setting", F.explode(F.array(*map(F.lit, sizes)))
    )
    return known.join(total, "setting").select(
        "setting",
        unique.alias("unique_records"),
        (unique - F.col("misses")).alias("false_positives"),
        percent(unique - F.col("misses"), unique).alias("fp_rate_pct"),
    )


def pressured_rates(view: DataFrame, rates: Sequence[float], keep: Sequence[str]) -> tuple[DataFrame, int, list[tuple[float, int]]]:
    """`duplicate_pressure` at several rates in one table, the rows without it, and the rows of each rate.

    The table is numbered once; a draw has the same number at every rate, so the
    draws of a lower rate are the first ones of a higher rate. All rates are put
    in order together: `seq` ascends within a rate, and rates follow each other.
    """
    base, n = dense_index(view.select("seq", *keep), ["seq"], out="_i")
    sizes = [(rate, n + int(n * rate)) for rate in sorted(rates)]
    most = max(size for _, size in sizes) - n
    draws = draw_rows(view.sparkSession, n, most)
    rows = base.withColumn("_row", F.col("_i")).unionByName(draws.join(base, "_i")).select("_row", *keep)
    held = [F.when(F.col("_row") < size, F.lit(float(rate))) for rate, size in sizes]
    loaded = rows.withColumn("duplicate_rate", F.explode(F.array_compact(F.array(*held))))
    ordered = loaded.withColumn("_h", draw_order(F.col("_row")))
    return dense_index(ordered, ["duplicate_rate", "_h", "_row"], out="seq")[0].drop("_h", "_row"), n, sizes


def search_trials(view: DataFrame, window: int = 100_000, rates: Sequence[float] = DUPLICATE_RATES) -> DataFrame:
    """Trials of the bounded search, numbered in its order: per duplicate rate two anchors, filter settings, worker counts.

    A trial is the windowed two-stage dedupe per tenant and log type: a filter
    that is emptied every `window` insertions before a cache of `window`
    fingerprints. Routing by tenant keeps a scope on one worker, so the worker
    count moves no verdict, only how much the busiest worker has to do. All filter
    settings of all rates are windows over one log of arrivals, and the rate is
    part of the scope: one pass serves the search. Trials whose dedupe rate is
    more than five points from that of an exact dedupe without scope and window
    are invalid: there the window forgets too much.

    Scores are counts, since a measured throughput is not repeatable: `score` is
    the share of accepted rows that need no exact check, `speedup` how many
    times fewer records the busiest worker has than one worker would.
    """
    loaded, n, sizes = pressured_rates(view, rates, [*SCOPE, "fp"])
    loaded = written(loaded, "pressured")
    filters = list(dict.fromkeys((e, c) for e, c, _ in SEARCH_SETTINGS))
    bits = {i: FilterSize.for_rate(c, e) for i, (e, c) in enumerate(filters)}
    settings = [rotating_setting(window, size) for size in bits.values()]
    found = many_verdicts(loaded, settings, ["duplicate_rate", *SCOPE], bits)
    ends, rate = 0, F
    for d, size in sizes:  # rates lie one behind the other in the arrival numbers
        ends += size
        rate = rate.when(F.col("seq") < ends, F.lit(float(d)))
    counts = many_counts(found, len(filters), [rate.alias("duplicate_rate")])

    workers = sorted({w for _, _, w in SEARCH_SETTINGS})
    places = F.array(*[F.struct(F.lit(w).alias("workers"), worker_column(w).alias("worker_id")) for w in workers])
    load = (
        loaded.select("duplicate_rate", F.explode(places).alias("p"))
        .groupBy("duplicate_rate", "p")
        .agg(F.count("*").alias("n"))
        .groupBy("duplicate_rate", F.col("p.workers").alias("workers"))
        .agg(F.max("n").alias("largest_worker"))
    )
    exact = (
        loaded.groupBy("duplicate_rate", "fp")
        .agg(F.count("*").alias("n"))
        .groupBy("duplicate_rate")
        .agg(F.sum("n").cast("bigint").alias("total_records"), F.count("*").alias("unique_records"))
    )
    listed = [
        F.struct(
            F.lit(place).alias("place"),
            F.lit(mode).alias("mode"),
            F.lit(e).cast("double").alias("error_rate"),
            F.lit(c).cast("int").alias("capacity"),
            F.lit(w).alias("workers"),
            F.lit(i).cast("int").alias("window"),
        )
        for place, (mode, e, c, w, i) in enumerate(
            [("no dedupe", None, None, 1, None), ("global exact", None, None, 1, None)]
            + [
                ("filter+exact" if w == 1 else "partitioned filter+exact", e, c, w, filters.index((e, c)))
                for e, c, w in SEARCH_SETTINGS
            ]
        )
    ]
    order = reduce(lambda c, x: c.when(F.col("duplicate_rate") == float(x[1]), x[0]), enumerate(sorted(rates)), F)
    plain = F.when(F.col("mode") == "no dedupe", F.col("total_records")).otherwise(F.col("unique_records"))
    trials = (
        exact.withColumn("_t", F.explode(F.array(*listed)))
        .select("*", "_t.*")
        .drop("_t")
        .join(F.broadcast(counts), ["duplicate_rate", "window"], "left")  # a row per rate and filter
        .join(F.broadcast(load), ["duplicate_rate", "workers"])  # a row per rate and worker count
        .withColumn("evaluations", F.coalesce("evaluations", plain))
        .withColumn("false_positives", F.coalesce("false_positives", F.lit(0)).cast("bigint"))
    )
    total, accepted = F.col("total_records"), F.col("evaluations")
    rated = trials.select(
        (order * len(listed) + F.col("place") + 1).cast("int").alias("trial_id"),
        "mode",
        "duplicate_rate",
        "error_rate",
        "capacity",
        "workers",
        F.lit(n).cast("bigint").alias("rows_before"),
        total.alias("rows_after"),
        total.alias("total_records"),
        "evaluations",
        "false_positives",
        "largest_worker",
        percent(total - accepted, total).alias("dedupe_rate_pct"),
        percent(accepted - F.col("false_positives"), accepted).alias("score"),
        percent(total, F.col("largest_worker") * 100).alias("speedup"),
        percent(total - F.col("unique_records"), total).alias("_exact"),
    )
    return trial_log(rated, F.col("_exact")).drop("_exact")


def best_settings(trials: DataFrame) -> tuple[tuple[float, int], int]:
    """The winners of the search: a filter's error rate and capacity by `score`, a worker count by `speedup`."""
    plain = best_config(trials.where(F.col("mode") == "filter+exact"), ["error_rate", "capacity"], "score").first()
    spread = best_config(
        trials.where(F.col("mode") == "partitioned filter+exact"), ["error_rate", "capacity", "workers"], "speedup"
    ).first()
    if plain is None or spread is None:
        raise ValueError("no valid trial: the window is too small for these records")
    return (plain["error_rate"], plain["capacity"]), spread["workers"]


def confirm_search(searched: DataFrame, view: DataFrame, window: int = 100_000, rate: float = CONFIRM_RATE) -> DataFrame:
    """Search on one table, then the winners head to head with the anchors on another: two rows of winners pass the driver."""
    trials = written(search_trials(searched, window), "trials")
    (error_rate, capacity), workers = best_settings(trials)
    return confirm(view, error_rate, capacity, workers, window, rate)


def confirm(
    view: DataFrame, error_rate: float, capacity: int, workers: int, window: int = 100_000, rate: float = CONFIRM_RATE
) -> DataFrame:
    """The chosen settings head to head with the anchors on one workload."""
    loaded = written(route(duplicate_pressure(view, rate), workers), "confirm")
    found = written(rotating_verdicts(loaded, window, FilterSize.for_rate(capacity, error_rate)), "confirm-verdicts")
    none = exact_stats(loaded, ["seq"])
    split = partition_rollup(loaded, found).where(F.col("worker_id") == -1)
    runs: Mapping[str, DataFrame] = {
        "no dedupe": none,
        "global exact": exact_stats(loaded, ["fp"]),
        "filter+exact": verdict_stats(loaded, found),
        "partitioned filter+exact": split.drop("worker_id", "largest_worker"),
    }
    busiest = split.select("largest_worker").first()[0]
    searched = F.col("algorithm").contains("filter")
    spread = F.col("algorithm").startswith("partitioned")
    return comparison(runs).select(
        "*",
        F.when(searched, F.lit(error_rate)).alias("error_rate"),
        F.when(searched, F.lit(capacity)).alias("capacity"),
        F.when(spread, F.lit(workers)).otherwise(1).alias("workers"),
        F.when(spread, F.lit(busiest)).otherwise(F.col("total_records")).cast("bigint").alias("largest_worker"),
    )
