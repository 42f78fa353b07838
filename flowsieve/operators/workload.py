"""Shaping a workload: injected duplicates and synthetic flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from ..functions.records import floor_div, hash_number
from .ordering import dense_index

# A cell holds one burst of each length 1..50.
_BURSTS = 50
_CELL = _BURSTS * (_BURSTS + 1) // 2


def draw_rows(spark: SparkSession, n: int, draws: int, seed: int = 42) -> DataFrame:
    """Row numbers drawn from 0..n-1 with replacement, in `_i`; `_row` numbers the draws from n on."""
    drawn = hash_number(F.lit(f"draw{seed}"), F.col("id")) % max(n, 1)
    return spark.range(draws).select((F.col("id") + n).alias("_row"), drawn.alias("_i"))


def draw_order(row: Column, seed: int = 42) -> Column:
    """What rows are sorted by for a repeatable random order."""
    return hash_number(F.lit(f"order{seed}"), row)


def shuffled(df: DataFrame, key: str, seed: int, out: str = "seq") -> DataFrame:
    """A repeatable random order: rows numbered by the hash of `key`."""
    order = df.withColumn("_h", draw_order(F.col(key), seed))
    return dense_index(order, ["_h", key], out=out)[0].drop("_h")


def duplicate_pressure(df: DataFrame, rate: float | None, seed: int = 42, seq: str = "seq") -> DataFrame:
    """Append int(rate * n) rows drawn with replacement, then shuffle.

    The drawn row numbers are hashes of the draw number, so the count is exact
    (a sampling fraction would give only an expected count). `seq` is numbered
    anew; `origin` keeps the row each copy came from.
    """
    if rate is None:
        return df
    if not 0.0 <= rate <= 1.0:
        raise ValueError("the duplicate rate must lie in [0, 1]")
    if rate == 0.0:
        return df
    base, n = dense_index(df, [seq], out="_i")
    extra = int(n * rate)
    if extra == 0:
        return df
    # One row per draw, spread over the table's own partitions.
    draws = draw_rows(df.sparkSession, n, extra, seed)
    base = base.withColumnRenamed(seq, "origin")
    copies = draws.join(base, "_i")  # a draw matches exactly one row
    all_rows = base.withColumn("_row", F.col("_i")).unionByName(copies).drop("_i")
    return shuffled(all_rows, "_row", seed, out=seq).drop("_row")


def synthetic_flows(
    rows: DataFrame,
    n: int,
    duplicate_rate: float,
    bursty: bool = False,
    tenants: int = 10,
    seed: int = 42,
    shuffle: bool = True,
) -> DataFrame:
    """`n` flows of which about `duplicate_rate` repeat an earlier one.

    `rows` has a column `i` with 0..n-1 (`spark.range`, or the index of a
    table). int(n * (1 - rate)) flows are unique; the rest are picked evenly
    from them, or all rows are picked in bursts of 1..50. Bursts are laid out in
    cells that hold each length once, in hashed order, so every burst knows its
    place without a running total over the table.
    """
    unique = int(n * (1.0 - duplicate_rate))
    if not 0.0 <= duplicate_rate <= 1.0 or unique == 0:
        raise ValueError("the duplicate rate must leave at least one unique flow")

    def pick(index):
        return hash_number(F.lit(f"pick{seed}"), index) % unique

    if bursty:
        cells = -(-n // _CELL)
        if cells * _BURSTS > n:
            numbers = rows.sparkSession.range(cells * _BURSTS).withColumnRenamed("id", "i")
        else:
            numbers = rows.select("i").where(F.col("i") < cells * _BURSTS)
        bursts = numbers.select(
            floor_div(F.col("i"), _BURSTS).alias("cell"),
            (F.col("i") % _BURSTS + 1).alias("length"),
            hash_number(F.lit(f"burst{seed}"), F.col("i")).alias("h"),
            pick(F.col("i")).alias("u"),
        )
        earlier = Window.partitionBy("cell").orderBy("h", "length").rowsBetween(Window.unboundedPreceding, -1)
        start = F.col("cell") * _CELL + F.coalesce(F.sum("length").over(earlier), F.lit(0))
        picked = (
            bursts.select("u", "length", start.alias("start"))
            .where(F.col("start") < n)
            .select("u", F.explode(F.sequence("start", F.least(F.col("start") + F.col("length"), F.lit(n)) - 1)).alias("i"))
        )
    else:
        picked = rows.select("i", F.when(F.col("i") < unique, F.col("i")).otherwise(pick(F.col("i"))).alias("u"))
    flows = picked.select(
        "i",
        F.concat(F.lit("10.0.0."), (hash_number(F.lit(f"tenant{seed}"), F.col("u")) % tenants + 1)).alias("Source IP"),
        F.concat(F.lit("192.168.1."), F.col("u") % 255).alias("Destination IP"),
        (hash_number(F.lit(f"length{seed}"), F.col("u")) % 1461 + 40).cast("string").alias(
            "Total Length of Fwd Packets"
        ),
        F.col("u").cast("string").alias("_id"),
    )
    if shuffle:
        return shuffled(flows, "i", seed).drop("i")
    return flows.withColumnRenamed("i", "seq")
