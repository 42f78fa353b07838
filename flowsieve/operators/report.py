"""Result tables: dedupe counters, detection quality, sweeps and rankings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.records import SCOPE

# Fixed values of the cost model.
DOWNSTREAM_MICROS = 50  # per accepted record
SHORTEST_MICROS = 100
RATE_TOLERANCE = 5.0  # points a trial may differ from the exact rate


def count_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("bigint")


def rounded_division(part: Column, whole: Column) -> Column:
    """part / whole to the nearest integer, ties to even, in integers only.

    Rates are rounded this way because a tie is then a tie: 72.385 as a double
    lies on either side of itself, depending on who multiplies it.
    """
    part, whole = part.cast("bigint"), whole.cast("bigint")
    quotient = F.call_function("div", part, whole)
    twice = 2 * (part - quotient * whole)
    up = (twice > whole) | ((twice == whole) & (quotient % 2 == 1))
    return quotient + F.when(up, 1).otherwise(0)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole at two decimals; 0 where there are no rows."""
    return rounded_division(part * 10_000, F.greatest(whole, F.lit(1))) / 100


def ratio(part: Column, whole: Column) -> Column:
    """part / whole at four decimals; 0 where the denominator is zero."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(
        rounded_division(part * 10_000, F.greatest(whole, F.lit(1))) / 10_000
    )


# ------------------------------------------------------------------ dedupe


def _counts(flagged: DataFrame) -> list[Column]:
    false_hit = F.col("outcome") == "filter_false_positive" if "outcome" in flagged.columns else F.lit(False)
    return [
        F.count("*").alias("total_records"),
        count_where(F.col("is_dup")).alias("duplicates"),
        count_where(false_hit).alias("false_positives"),
        count_where(~F.col("is_dup")).alias("evaluations"),
    ]


def dedupe_stats(flagged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Records, duplicates, false filter hits, accepted rows and the rate."""
    counts = flagged.groupBy(*by).agg(*_counts(flagged))
    return counts.withColumn("dedupe_rate_pct", percent(F.col("duplicates"), F.col("total_records")))


def exact_stats(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """`dedupe_stats` of an exact dedupe on `by`, without flagging any row.

    A key of n rows has n - 1 duplicates, so one aggregation of the keys is all.
    """
    total, unique = F.coalesce(F.sum("n"), F.lit(0)).cast("bigint"), F.count("*")
    return (
        df.groupBy(*by)
        .agg(F.count("*").alias("n"))
        .agg(
            total.alias("total_records"),
            (total - unique).alias("duplicates"),
            F.lit(0).cast("bigint").alias("false_positives"),
            unique.alias("evaluations"),
        )
        .withColumn("dedupe_rate_pct", percent(F.col("duplicates"), F.col("total_records")))
    )


def verdict_stats(df: DataFrame, verdicts: DataFrame, by: Sequence[str] = (), seq: str = "seq") -> DataFrame:
    """`dedupe_stats` from the table and the (seq, verdict) of its accepted rows: no row is flagged.

    With `by`, the accepted rows are counted where their arrival number is in
    the table. Rows without a number are accepted; numbers are unique.
    """
    named = [F.col(c) for c in by]
    nothing = F.lit(0).cast("bigint")
    placed = verdicts.withColumnRenamed("seq", seq)
    if by:
        placed = placed.join(df.where(F.col(seq).isNotNull()).select(seq, *named).hint("merge"), seq)
    hits = placed.select(*named, nothing.alias("n"), F.lit(1).alias("a"), (F.col("verdict") == 2).cast("int").alias("f"))
    rows = df.select(*named, F.lit(1).cast("bigint").alias("n"), F.col(seq).isNull().cast("int").alias("a"), F.lit(0).alias("f"))
    sums = [F.coalesce(F.sum(c), nothing).cast("bigint") for c in "naf"]
    counted = rows.unionByName(hits).groupBy(*by).agg(*[s.alias(c) for s, c in zip(sums, "naf")])
    return counted.select(
        *by,
        F.col("n").alias("total_records"),
        (F.col("n") - F.col("a")).alias("duplicates"),
        F.col("f").alias("false_positives"),
        F.col("a").alias("evaluations"),
        percent(F.col("n") - F.col("a"), F.col("n")).alias("dedupe_rate_pct"),
    )


def observed(flagged: DataFrame) -> tuple[DataFrame, Observation]:
    """The frame, and its counters once it has been written: no second pass."""
    watch = Observation("dedupe")
    return flagged.observe(watch, *_counts(flagged)), watch


def scan_cost(stats: DataFrame) -> DataFrame:
    """Comparisons of a linear-scan cache: the k-th accepted row costs k.

    A double, since U(U+1)/2 passes 2^63 at about four billion accepted rows.
    """
    u = F.col("evaluations").cast("double")
    return stats.withColumn("scan_comparisons", u * (u + 1) / 2)


def state_size(windows: DataFrame, filter_bits: int = 0, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Scopes, fingerprints and bytes of stored windows: rows (scope, seq, fp), as a run leaves them behind.

    filter_bits: the bits of the filter that each scope keeps beside its window.
    """
    per_scope = windows.groupBy(*scope).agg(
        F.count("*").alias("cached"), F.sum(F.octet_length("fp") + 8).alias("bytes")  # a number beside each fingerprint
    )
    held = F.col("bytes") + (filter_bits + 7) // 8
    return per_scope.agg(
        F.count("*").alias("scopes"),
        F.coalesce(F.sum("cached"), F.lit(0)).cast("bigint").alias("cached_fingerprints"),
        F.coalesce(F.sum(held), F.lit(0)).cast("bigint").alias("state_bytes"),
    )


def comparison(stats: Mapping[str, DataFrame]) -> DataFrame:
    """One row per algorithm from its counters, with the modelled downstream cost.

    The modelled time depends on counts only, so the table is repeatable; wall
    time belongs to the bench.
    """
    rows = [df.withColumn("algorithm", F.lit(name)) for name, df in stats.items()]
    total, accepted = F.col("total_records"), F.col("evaluations")
    micros = accepted * DOWNSTREAM_MICROS
    tenths = rounded_division(total * (10_000_000 // DOWNSTREAM_MICROS), F.greatest(accepted, F.lit(SHORTEST_MICROS // DOWNSTREAM_MICROS)))
    return (
        reduce(DataFrame.unionByName, rows)
        .withColumn("downstream_s", rounded_division(micros, F.lit(100)) / 10_000)
        .withColumn("downstream_rec_s", tenths / 10)
    )


def efficiency_report(stats: DataFrame, elapsed_seconds: float) -> DataFrame:
    """Records per second and mean latency, next to the dedupe rates."""
    total = F.col("total_records")
    return stats.select(
        "total_records",
        F.bround(total / F.lit(max(elapsed_seconds, SHORTEST_MICROS / 1e6)), 2).alias("throughput_rec_s"),
        F.bround(F.lit(elapsed_seconds * 1e6) / F.greatest(total, F.lit(1)), 2).alias("avg_latency_us"),
        F.col("dedupe_rate_pct").alias("dedup_rate_pct"),
        percent(F.col("false_positives"), total).alias("bloom_fp_rate_pct"),
    )


def trial_log(trials: DataFrame, exact_rate: Column) -> DataFrame:
    """Mark trials whose rate is too far from the exact one as invalid."""
    gap = F.abs(F.col("dedupe_rate_pct") - exact_rate)
    far = gap > RATE_TOLERANCE
    note = F.when(far, F.format_string("%.2f points away from the rate of exact dedupe", gap))
    return trials.withColumn("valid", ~far).withColumn("notes", F.coalesce(note, F.lit("")))


def best_config(trials: DataFrame, config: Sequence[str], metric: str) -> DataFrame:
    """The configuration with the highest mean metric over valid trials.

    Ties go to the first configuration in column order.
    """
    means = trials.where(F.col("valid")).groupBy(*config).agg(F.avg(metric).alias("_mean"))
    return (
        means.withColumn("mean_" + metric, F.bround("_mean", 4))
        .drop("_mean")
        .orderBy(F.desc("mean_" + metric), *config)
        .limit(1)
    )


def ranked(results: DataFrame, score: str, name: str) -> DataFrame:
    """Result rows by descending score, the score column dropped."""
    return results.orderBy(F.desc(score), name).drop(score)


# --------------------------------------------------------------- detection


def _confusion(truth: Column, prediction: Column) -> list[Column]:
    return [
        count_where((truth == t) & (prediction == p)).alias(name)
        for name, t, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))
    ]


def confusion_matrix(
    df: DataFrame, truth: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    return df.groupBy(*by).agg(*_confusion(F.col(truth), F.col(prediction)))


def classification_report(
    df: DataFrame, truth: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, precision, recall, F1 and false-alarm rate.

    A row without truth or prediction is an error: vectors of unequal length.
    """
    missing = F.col(truth).isNull() | F.col(prediction).isNull()
    counts = df.groupBy(*by).agg(*_confusion(F.col(truth), F.col(prediction)), count_where(missing).alias("unpaired"))
    checked = F.when(
        F.col("unpaired") > 0, F.raise_error(F.lit("labels and predictions differ in length")).cast("bigint")
    ).otherwise(F.col("tp"))
    tp, fp, fn, tn = checked, F.col("fp"), F.col("fn"), F.col("tn")
    return counts.select(
        *by,
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        ratio(fp, fp + tn).alias("far"),
    )


def detector_comparison(df: DataFrame, detectors: Sequence[str], truth: str = "label") -> DataFrame:
    """The report of several prediction columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(d).alias("model"), F.col(d).alias("prediction")) for d in detectors])
    long = df.select(F.col(truth).alias("label"), F.explode(pairs).alias("p")).select("label", "p.*")
    return classification_report(long, by=["model"])
