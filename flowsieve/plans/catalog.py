"""Named queries over the event flows; each has the columns of its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.records import (
    EVENT_TIME,
    NINE_FIELDS,
    SCOPE,
    as_text,
    clean_flows,
    column_name,
    fingerprint,
    flow_fingerprint,
    flow_view,
    hex_digits,
    parse_event_time,
    scope_columns,
)
from ..functions.rules import fuse, signature_rule
from ..operators import dedupe as d, report as r, windowed as w
from ..operators.ordering import chronological_split, dense_index
from ..operators.routing import dedupe_two_level, partition_rollup, route
from ..operators.sequences import anomaly_threshold, scale_on_train, sequences, vector_distance, with_history
from ..operators.workload import duplicate_pressure
from ..session import new_table_path
from ..sources.flows import head_rows, read_flows, write_result
from . import search
from .detection import DETECTORS, detect, prepared, residuals
from .event_flows import FEATURES, event_flows, event_view

# Sizes that make windows overflow on the test tables (about 70 rows a user).
WINDOW = 16
GENERATION = 7
FILTER = d.FilterSize(256, 3)
WORKERS = 4
HEAD = 500
TTL_SECONDS = 6 * 3600
HOT_WINDOW = 64
SEARCH_WINDOW = 38
HOT_PIECES = 6

SCALED = [f"z_{f}" for f in FEATURES]


def _fp():
    return hex_digits(F.col("fp")).alias("fp")


def _verdict(df: DataFrame, *more: str) -> DataFrame:
    return df.select("seq", "tenant", "is_dup", *more)


# ---------------------------------------------------------------- records


def q_flow_view(spark, sf):
    flows = event_flows(spark, sf)
    view = flow_view(flows, keep=["Source IP", "Destination IP", "Total Length of Fwd Packets"])
    return view.select(
        "seq",
        "tenant",
        "log_type",
        _fp(),
        F.col("Source IP").alias("source"),
        F.col("Destination IP").alias("destination"),
        as_text(view, "Total Length of Fwd Packets").alias("fwd_bytes"),
    )


def q_flow_head_n(spark, sf):
    return head_rows(event_view(spark, sf), HEAD).select("seq", "tenant", "log_type", _fp())


def q_clean_flows(spark, sf):
    """Some values are made unusable here, so that cleaning has work to do."""
    flows = event_flows(spark, sf)
    value = (
        F.when(F.col("k") == 3, F.lit(float("nan")))
        .when(F.col("k") == 4, F.lit(float("inf")))
        .when(F.col("k") == 5, F.lit(None))
        .otherwise(F.col("value"))
    )
    time = F.when(F.col("k") != 6, F.col("ts"))
    dirty = flows.withColumn("value", value).withColumn("ts", time)
    return clean_flows(dirty, ["value", "k"], "ts").select("seq", "value", "k")


def q_parse_event_time(spark, sf):
    flows = event_flows(spark, sf)
    text = (
        F.when(F.col("k") % 4 == 0, F.date_format("ts", "d/M/yyyy H:mm"))
        .when(F.col("k") % 4 == 1, F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
        .when(F.col("k") % 4 == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.lit("unknown"))
    )
    parsed = parse_event_time(F.concat(F.lit(" "), text))
    return flows.select("seq", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("event_time"))


def q_flow_fingerprint(spark, sf):
    flows = event_flows(spark, sf)
    nine = [column_name(flows, [n]) for n in NINE_FIELDS]
    return flows.select(
        "seq",
        hex_digits(flow_fingerprint(flows)).alias("fp"),
        hex_digits(flow_fingerprint(flows, "-")).alias("fp_dash"),
        hex_digits(fingerprint(flows, nine)).alias("fp_nine"),
    )


def q_flow_scope(spark, sf):
    """Null tenants stay: the first tenant column decides even where it is null."""
    flows = event_flows(spark, sf).withColumn("tenant_id", F.when(F.col("k") > 9, F.col("Source IP")))
    flows = flows.withColumnRenamed("Destination IP", "Protocol")
    tenant, log_type = scope_columns(flows)
    return flows.select("seq", tenant.alias("tenant"), log_type.alias("log_type"))


def q_signature_rules(spark, sf):
    flows = event_flows(spark, sf)
    return flows.select("seq", signature_rule(flows).alias("signature"))


# ----------------------------------------------------------------- dedupe


def q_dedupe_none(spark, sf):
    return _verdict(d.dedupe_none(event_view(spark, sf)))


def q_dedupe_global_exact(spark, sf):
    return _verdict(d.dedupe_global_exact(event_view(spark, sf)))


def q_dedupe_scoped_exact(spark, sf):
    return _verdict(d.dedupe_scoped_exact(event_view(spark, sf)))


def q_dedupe_passed(spark, sf):
    return d.split(d.dedupe_scoped_exact(event_view(spark, sf)))[0].select("seq", "tenant", _fp())


def q_dedupe_dropped(spark, sf):
    return d.split(d.dedupe_scoped_exact(event_view(spark, sf)))[1].select("seq", "tenant", _fp())


def q_dedupe_keep_first(spark, sf):
    return d.keep_first(event_view(spark, sf), ["tenant", "log_type", "fp"]).select("seq", "tenant", _fp())


def q_dedupe_scoped_fifo(spark, sf):
    return _verdict(w.dedupe_scoped_fifo(event_view(spark, sf), WINDOW))


def q_dedupe_scoped_fifo_default(spark, sf):
    """At the default window of 100,000 nothing is evicted: settled natively."""
    return _verdict(w.dedupe_scoped_fifo(event_view(spark, sf)))


def q_dedupe_scoped_rotating(spark, sf):
    return _verdict(w.dedupe_scoped_rotating(event_view(spark, sf), WINDOW), "outcome")


def q_dedupe_hot_scope_fifo(spark, sf):
    """Five scopes that span several pieces each: windows are carried over."""
    hot = event_view(spark, sf, keep=["Destination IP"]).withColumn("tenant", F.col("Destination IP"))
    return _verdict(w.dedupe_scoped_fifo(hot, HOT_WINDOW, pieces=HOT_PIECES))


def q_dedupe_scoped_fifo_null_scope(spark, sf):
    """A third of the users without a tenant: the null scope evicts beside small ones."""
    view = event_view(spark, sf, keep=["k"])
    nameless = view.withColumn("tenant", F.when(F.col("tenant").cast("bigint") % 3 != 0, F.col("tenant")))
    return _verdict(w.dedupe_scoped_fifo(nameless, WINDOW))


def q_dedupe_worker_window(spark, sf):
    routed = route(event_view(spark, sf), 8, "hash")
    return _verdict(w.dedupe_worker_window(routed, 512), "worker_id")


def q_dedupe_worker_rotating(spark, sf):
    routed = event_view(spark, sf).withColumn("worker_id", F.col("tenant"))
    return _verdict(w.dedupe_worker_rotating(routed, WINDOW, GENERATION), "outcome")


def q_dedupe_filter_only(spark, sf):
    return _verdict(d.dedupe_filter_only(event_view(spark, sf), FILTER))


def q_dedupe_filter_tumbling(spark, sf):
    return _verdict(w.dedupe_filter_tumbling(event_view(spark, sf), FILTER, WINDOW))


def q_dedupe_two_stage(spark, sf):
    return _verdict(d.dedupe_two_stage(event_view(spark, sf), FILTER), "outcome")


def q_dedupe_two_stage_windowed(spark, sf):
    return _verdict(w.dedupe_scoped_rotating(event_view(spark, sf), WINDOW, FILTER), "outcome")


def q_dedupe_partitioned_stats(spark, sf):
    view = event_view(spark, sf)
    return partition_rollup(route(view, WORKERS), w.rotating_verdicts(view, WINDOW))


def q_route_records(spark, sf):
    view = event_view(spark, sf)
    routed = view
    for strategy in ("tenant", "hash", "random"):
        routed = route(routed, WORKERS, strategy).withColumnRenamed("worker_id", f"by_{strategy}")
    return route(routed, 1).select("seq", "by_tenant", "by_hash", "by_random", F.col("worker_id").alias("single"))


def q_dedupe_two_level(spark, sf):
    return _verdict(dedupe_two_level(route(event_view(spark, sf), WORKERS, "random")), "worker_id", "local_repeat")


def q_dedupe_two_level_null_seq(spark, sf):
    """Some records without an arrival number, some that share one with the record before."""
    view = event_view(spark, sf, keep=["k"])
    number = F.when(F.col("k") == 5, F.col("seq") - 1).when(F.col("k") != 3, F.col("seq"))
    routed = route(view.withColumn("seq", number), WORKERS, "hash")
    return _verdict(dedupe_two_level(routed), "worker_id", "local_repeat")


def q_dedupe_policy(spark, sf):
    """A policy of one's own by name: every destination of a tenant has a window of its own."""

    def per_destination(df, window):
        return w.dedupe_scoped_fifo(df, window, scope=["tenant", "Destination IP"])

    d.register_dedupe("per destination", per_destination)
    return _verdict(d.dedupe(event_view(spark, sf, keep=["Destination IP"]), "per destination", window=4))


def q_dedupe_arrival_lookback(spark, sf):
    return _verdict(d.dedupe_arrival_lookback(event_view(spark, sf), WINDOW))


def q_dedupe_ttl(spark, sf):
    return _verdict(d.dedupe_ttl(event_view(spark, sf, keep=["ts"]), TTL_SECONDS))


def q_dedupe_ttl_disordered(spark, sf):
    """Times that do not follow the arrivals, some unknown: the order is that of the time."""
    view = event_view(spark, sf, keep=["ts", "k"])
    moved = F.expr("ts + make_dt_interval(0, int((k * 5) % 11))")
    view = view.withColumn("ts", F.when(F.col("k") != 6, moved))
    return _verdict(d.dedupe_ttl(view, TTL_SECONDS))


def q_carried_fingerprints(spark, sf):
    """Half of the records carry their digest; they equal those that are computed."""
    flows = event_flows(spark, sf)
    carried = flows.withColumn("_dedupe_fp", F.when(F.col("k") % 2 == 0, flow_fingerprint(flows)))
    return _verdict(d.dedupe_scoped_exact(flow_view(carried)))


# ---------------------------------------------------------- dedupe reports


def q_dedupe_stats(spark, sf):
    return r.exact_stats(event_view(spark, sf), ["tenant", "log_type", "fp"])


def q_dedupe_scan_cost(spark, sf):
    return r.scan_cost(r.exact_stats(event_view(spark, sf), ["fp"]))


def q_dedupe_state_size(spark, sf):
    """Of the windows as they stand after the last record, and of a filter beside each."""
    view = event_view(spark, sf)
    return r.state_size(w.last_accepted(view, w.fifo_verdicts(view, WINDOW), WINDOW), FILTER.bits)


def _comparison(spark, sf):
    view = event_view(spark, sf)
    by = list(SCOPE)
    firsts = d.first_seen(view, [*by, "fp"])
    return r.comparison(
        {
            "no dedupe": r.exact_stats(view, ["seq"]),
            "global exact": r.exact_stats(view, ["fp"]),
            "filter only": r.verdict_stats(view, w.tumbling_verdicts(view, FILTER, 100_000)),
            "filter+exact": r.verdict_stats(view, d.two_stage_verdicts(firsts, by, FILTER)),
            "partitioned filter+exact": r.verdict_stats(view, w.rotating_verdicts(view, 100_000)),
        }
    )


def q_dedupe_comparison(spark, sf):
    return _comparison(spark, sf)


def q_result_file(spark, sf):
    """The comparison written as a result file, and read again as a user would."""
    table, path = _comparison(spark, sf), new_table_path(spark, "result")
    write_result(table, path)
    kinds = {n: t for n, t in table.dtypes if t != "string"}
    return read_flows(spark, path, types=kinds).select(*table.columns)


def q_window_sweep(spark, sf):
    return search.window_sweep(event_view(spark, sf), (4, 16, 64))


def q_partition_sweep(spark, sf):
    return search.partition_sweep(event_view(spark, sf))


def q_config_matrix(spark, sf):
    return search.config_matrix(event_view(spark, sf))


def q_config_ranking(spark, sf):
    """Ranked by rate, since a measured throughput is not repeatable."""
    score = F.col("dup_rate_pct").alias("score")
    return r.ranked(search.config_matrix(event_view(spark, sf)).select("*", score), "score", "config")


def q_trial_log(spark, sf):
    return search.search_trials(event_view(spark, sf), SEARCH_WINDOW)


def q_best_config(spark, sf):
    trials = search.search_trials(event_view(spark, sf), SEARCH_WINDOW)
    searched = trials.where(F.col("mode") == "filter+exact")
    return r.best_config(searched, ["error_rate", "capacity"], "score")


def q_best_partitioned_config(spark, sf):
    trials = search.search_trials(event_view(spark, sf), SEARCH_WINDOW)
    searched = trials.where(F.col("mode") == "partitioned filter+exact")
    return r.best_config(searched, ["error_rate", "capacity", "workers"], "speedup")


def q_confirm_search(spark, sf):
    """Searched on the validation slice of the time order, confirmed on all records."""
    view = event_view(spark, sf, keep=["ts"])
    marked = chronological_split(*dense_index(view, ["ts", "seq"]))
    slice_ = marked.where(F.col("split") == "validation").select("seq", "tenant", "log_type", "fp")
    return search.confirm_search(slice_, view.drop("ts"), SEARCH_WINDOW)


def q_efficiency_report(spark, sf):
    """Elapsed time is an argument; two seconds keep the table repeatable."""
    return r.efficiency_report(r.dedupe_stats(d.dedupe_two_stage(event_view(spark, sf), FILTER)), 2.0)


def q_filter_error_sweep(spark, sf):
    return search.filter_error_sweep(event_view(spark, sf), (0.01, 0.05), (1000, 5000))


# --------------------------------------------------------------- workload


def q_duplicate_pressure(spark, sf):
    loaded = duplicate_pressure(event_view(spark, sf).select("seq", "tenant", "fp"), 0.5)
    return loaded.select("seq", "origin", "tenant", _fp())


# -------------------------------------------------------------- detection


def _ordered(spark, sf) -> tuple[DataFrame, int]:
    flows = clean_flows(event_flows(spark, sf), list(FEATURES), "ts")
    return dense_index(flows.select("seq", "ts", "label", *FEATURES), ["ts", "seq"])


def q_chronological_index(spark, sf):
    return _ordered(spark, sf)[0].select("seq", "idx")


def q_chronological_split(spark, sf):
    return chronological_split(*_ordered(spark, sf)).select("seq", "split")


def q_train_only_scaling(spark, sf):
    scaled = scale_on_train(chronological_split(*_ordered(spark, sf)), FEATURES)
    return scaled.select("seq", *[F.bround(z, 6).alias(z) for z in SCALED])


def q_sequence_windows(spark, sf):
    rows = sequences(chronological_split(*_ordered(spark, sf)), FEATURES)
    history = F.transform("window", lambda x: F.concat_ws(":", *[F.bround(x[i] * 100).cast("bigint") for i in (0, 1)]))
    return rows.select(
        "seq",
        "label",
        F.size("window").alias("length"),
        F.array_join(history, ",").alias("history"),
        F.bround(F.col("next")[0], 4).alias("next_value"),
        F.bround(F.col("next")[1], 4).alias("next_k"),
    )


def _residuals(spark, sf, forecast="mean"):
    return residuals(prepared(event_flows(spark, sf), FEATURES), FEATURES, forecast)


def q_forecast_mean(spark, sf):
    return _residuals(spark, sf).select("seq", *[F.bround(f"p_{z}", 6).alias(f"p_{z}") for z in SCALED])


def q_forecast_linear(spark, sf):
    return _residuals(spark, sf, "linear").select("seq", "split", F.bround("residual", 6).alias("residual"))


def q_forecast_recurrent(spark, sf):
    """From a network trained on the table; sums of tasks may differ in the last digits, hence two decimals."""
    return _residuals(spark, sf, "recurrent").select("seq", "split", F.bround("residual", 2).alias("residual"))


def q_forecast_residual(spark, sf):
    return _residuals(spark, sf).select("seq", "split", F.bround("residual", 6).alias("residual"))


def q_vector_residual(spark, sf):
    """Distance of each embedding from the one before it, as a wide residual."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    indexed, _ = dense_index(vectors.select("vec_id", "embedding"), ["vec_id"])
    rows = with_history(
        indexed.withColumn("split", F.lit("all")),
        lambda before: {"previous": F.last("embedding").over(before)},
        length=1,
    )
    return rows.select("vec_id", F.bround(vector_distance(F.col("previous"), F.col("embedding")), 4).alias("residual"))


def q_anomaly_threshold(spark, sf):
    return anomaly_threshold(_residuals(spark, sf)).withColumn("tau", F.bround("tau", 6))


def q_anomaly_flags(spark, sf):
    return detect(event_flows(spark, sf), FEATURES).select("seq", "anomaly")


def q_hybrid_fusion(spark, sf):
    return detect(event_flows(spark, sf), FEATURES).select("seq", *DETECTORS)


def q_detector_comparison(spark, sf):
    return r.detector_comparison(detect(event_flows(spark, sf), FEATURES), DETECTORS)


def q_detector_comparison_csv(spark, sf):
    """From text files of two layouts, with the time as day-first text, to the detectors."""
    flows = event_flows(spark, sf)
    flows = flows.withColumn(EVENT_TIME[0], F.date_format("ts", "d/M/yyyy H:mm:ss")).drop("ts")
    path, names = new_table_path(spark, "flow-csv"), flows.columns
    for layout, rest in ((names, 0), (names[::-1], 1)):
        flows.where(F.col("k") % 2 == rest).select(*layout).write.option("header", True).csv(f"{path}/layout-{rest}")
    kinds = {n: t for n, t in flows.dtypes if t != "string"}
    read = read_flows(spark, [f"{path}/layout-0", f"{path}/layout-1"], types=kinds)
    timed = read.withColumn("ts", parse_event_time(F.col(column_name(read, EVENT_TIME))))
    return r.detector_comparison(detect(timed, FEATURES), DETECTORS)


def _labelled(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return labels.select(F.col("toxic").alias("label"), (1 - F.col("quality")).alias("prediction"))


def q_confusion_matrix(spark, sf):
    flows = event_flows(spark, sf)
    return r.confusion_matrix(flows.select("label", signature_rule(flows).alias("prediction")))


def q_classification_report(spark, sf):
    return r.classification_report(_labelled(spark, sf))


def q_fused_signature_report(spark, sf):
    """Fusion without a forecast: signatures over a plain size verdict."""
    flows = event_flows(spark, sf)
    large = F.when(F.col("value") > 50, 1).otherwise(0)
    verdicts = flows.select("label", fuse(signature_rule(flows), large).alias("prediction"))
    return r.classification_report(verdicts)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from ..streaming import queries as streams

    batch = {name[2:]: fn for name, fn in globals().items() if name.startswith("q_")}
    return {**batch, **streams.queries()}
