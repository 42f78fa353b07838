"""Deduplication that built-in operators express.

All functions take a frame with a unique arrival number `seq`, the scope
columns and `fp`, and return it with a verdict column. A row without an arrival
number cannot be placed and is kept as new; rows that share one are kept or
flagged together, kept if any of them is accepted. A null scope or fingerprint
is a value like any other. The verdict never uses a
window over a scope or fingerprint, whose rows may be a third of the table:
accepted rows come from an aggregation (combined before the shuffle), and are
matched to the table on `seq`, which is unique and so spreads evenly. They are as
many as the table's rows, so these joins are merges: left to Spark, accepted rows that
are small on disk would be broadcast, all of them through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.records import SCOPE, digest_bytes, floor_div, hex_digits
from ..session import new_table_path
from .ordering import dense_index

# Verdict names of the two-stage check, by code.
OUTCOMES = ("new", "duplicate", "filter_false_positive")


def first_seen(df: DataFrame, by: Sequence[str], seq: str = "seq") -> DataFrame:
    """The first arrival per key: the rows an unbounded exact dedupe accepts."""
    return df.groupBy(*by).agg(F.min(seq).alias(seq))


def flag_duplicates(df: DataFrame, accepted: DataFrame, seq: str = "seq") -> DataFrame:
    """`df` with is_dup = the row has a `seq`, and not one of `accepted`."""
    # The mark is added to the distinct numbers, which are then dealt as the join needs them.
    marks = accepted.select(seq).where(F.col(seq).isNotNull()).distinct().withColumn("_dup", F.lit(False))
    return df.join(marks.hint("merge"), seq, "left").withColumn("is_dup", F.coalesce("_dup", F.col(seq).isNotNull())).drop("_dup")


def passed(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_dup"))


def dropped(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_dup"))


def split(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passed, dropped) of a batch from one evaluation: written once, a folder per verdict, of which a side reads its own."""
    spark = flagged.sparkSession
    path = new_table_path(spark, "split")
    flagged.write.partitionBy("is_dup").parquet(path)
    schema = T.StructType([f for f in flagged.schema if f.name != "is_dup"] + [flagged.schema["is_dup"]])
    both = spark.read.schema(schema).parquet(path).select(*flagged.columns)
    return passed(both), dropped(both)


def dedupe_none(df: DataFrame) -> DataFrame:
    return df.withColumn("is_dup", F.lit(False))


def dedupe_global_exact(df: DataFrame, seq: str = "seq") -> DataFrame:
    """A repeat of any earlier fingerprint, whatever its scope."""
    return flag_duplicates(df, first_seen(df, ["fp"], seq), seq)


def dedupe_scoped_exact(df: DataFrame, scope: Sequence[str] = SCOPE, seq: str = "seq") -> DataFrame:
    """A repeat of an earlier fingerprint of the same scope, without a window."""
    return flag_duplicates(df, first_seen(df, [*scope, "fp"], seq), seq)


def keep_first(df: DataFrame, by: Sequence[str], seq: str = "seq") -> DataFrame:
    """Only the rows that an exact dedupe on `by` accepts."""
    return passed(flag_duplicates(df, first_seen(df, by, seq), seq)).drop("is_dup")


# ---------------------------------------------------------------- lookbacks


def _spaced(rows: DataFrame, by: Sequence[str], width: int, first: Column) -> DataFrame:
    """Rows more than `width` after the previous row of their key, on `at`.

    `at` is cut into blocks of `width`: a row that is not the first of its key
    in its block is closer than that to an earlier one, and a first row needs
    only the last row of the key in the block before. Each row therefore counts
    in its own block and as history of the next, and one aggregation decides.
    A key with very many rows is reduced to a row per block before the shuffle.
    """
    block = floor_div(F.col("at"), width)
    nothing = F.lit(None).cast("bigint")
    sides = F.array(
        F.struct(block.alias("block"), F.col("at").alias("own"), F.col("seq").alias("seq"), nothing.alias("before")),
        F.struct((block + 1).alias("block"), nothing.alias("own"), nothing.alias("seq"), F.col("at").alias("before")),
    )
    return (
        rows.select(*by, F.explode(sides).alias("s"))
        .select(*by, "s.*")
        .groupBy(*by, "block")
        .agg(F.min("own").alias("own"), first.alias("seq"), F.max("before").alias("before"))
        .where(F.col("own").isNotNull() & (F.col("before").isNull() | (F.col("own") - F.col("before") > width)))
    )


def dedupe_arrival_lookback(
    df: DataFrame, window: int, scope: Sequence[str] = SCOPE, seq: str = "seq"
) -> DataFrame:
    """A repeat within the last `window` arrivals of its scope.

    Positions come from one distributed numbering by (scope, seq): differences
    inside a scope equal those of a numbering per scope.
    """
    narrow = df.select(*scope, "fp", F.col(seq).alias("seq"))
    placed, _ = dense_index(narrow, [*scope, "seq"], out="at")
    accepted = _spaced(placed, [*scope, "fp"], window, F.min("seq"))
    return flag_duplicates(df, accepted.select(F.col("seq").alias(seq)), seq)


def dedupe_ttl(
    df: DataFrame, ttl_seconds: int, time: str = "ts", scope: Sequence[str] = SCOPE, seq: str = "seq"
) -> DataFrame:
    """A repeat at most `ttl_seconds` after the previous row of its key.

    Rows are in the order of their time, and of `seq` where that is equal,
    whatever order they arrived in. A row without a time is kept and is no
    other row's predecessor.
    """
    timed = df.where(F.col(time).isNotNull())
    rows = timed.select(*scope, "fp", F.col(seq).alias("seq"), F.unix_micros(time).alias("at"))
    first = F.min(F.when(F.col("own").isNotNull(), F.struct("own", "seq")))["seq"]
    accepted = _spaced(rows, [*scope, "fp"], ttl_seconds * 1_000_000, first)
    flagged = flag_duplicates(df, accepted.select(F.col("seq").alias(seq)), seq)
    return flagged.withColumn("is_dup", F.col("is_dup") & F.col(time).isNotNull())


# ---------------------------------------------------------------- filters


@dataclass(frozen=True)
class FilterSize:
    """Bits and hash count of a fixed-size membership filter."""

    bits: int
    hashes: int

    @classmethod
    def for_rate(cls, capacity: int, error_rate: float) -> "FilterSize":
        bits = math.ceil(-capacity * math.log(error_rate) / math.log(2) ** 2)
        return cls(bits, math.ceil(math.log2(1 / error_rate)))


def filter_positions(fp: Column, size: FilterSize) -> Column:
    """Bit positions of a digest: its four-byte slices, modulo the size.

    A digest has eight slices; more come from re-hashing it with a number.
    """
    fp = digest_bytes(fp)
    slices = []
    for j in range(size.hashes):
        digest = fp if j < 8 else F.unhex(F.sha2(F.concat(hex_digits(fp), F.lit(f"#{j // 8}")), 256))
        part = F.hex(F.substring(digest, 4 * (j % 8) + 1, 4))
        slices.append(F.conv(part, 16, 10).cast("bigint") % F.lit(size.bits))
    return F.array(*slices)


def filter_misses(
    rows: DataFrame, by: Sequence[str], sizes: Mapping[str, FilterSize], seq: str = "seq"
) -> DataFrame:
    """(setting, by..., seq) of the rows a filter does not know on arrival, for
    each named filter size.

    A row is unknown iff it is the first to set one of its bits. Whether rows
    that hit are inserted or not is the same, as their bits are set already, so
    the first row per bit follows from a minimum, combined before the shuffle,
    and equals record-by-record insertion. Repeats never set a bit: `rows` may
    be the table or its first arrivals.
    """
    settings = F.array(
        *[
            F.struct(F.lit(name).alias("setting"), filter_positions(F.col("fp"), size).alias("bits"))
            for name, size in sizes.items()
        ]
    )
    bits = (
        rows.select(*by, seq, F.explode(settings).alias("_s"))
        .select(F.col("_s.setting").alias("setting"), *by, seq, F.explode("_s.bits").alias("bit"))
    )
    setters = bits.groupBy("setting", *by, "bit").agg(F.min(seq).alias(seq))
    return setters.select("setting", *by, seq).distinct()


def _misses(rows: DataFrame, by: Sequence[str], size: FilterSize, seq: str) -> DataFrame:
    """`filter_misses` for one size: narrower keys, and `seq` alone in the end."""
    bits = rows.select(*by, seq, F.explode(filter_positions(F.col("fp"), size)).alias("bit"))
    return bits.groupBy(*by, "bit").agg(F.min(seq).alias(seq)).select(seq).distinct()


def dedupe_filter_only(
    df: DataFrame, size: FilterSize, by: Sequence[str] = SCOPE, seq: str = "seq"
) -> DataFrame:
    """A filter hit is a duplicate: no misses, some unique rows lost."""
    return flag_duplicates(df, _misses(df, by, size, seq), seq)


def with_outcome(df: DataFrame, verdicts: DataFrame, seq: str = "seq") -> DataFrame:
    """`df` with `outcome` and is_dup, from (seq, verdict) of accepted rows."""
    name = F.when(F.col("_v") == 0, OUTCOMES[0]).when(F.col("_v") == 2, OUTCOMES[2]).otherwise(OUTCOMES[1])
    marks = verdicts.groupBy(seq).agg(F.min("verdict").alias("_v"))
    return (
        df.join(marks.hint("merge"), seq, "left")
        .withColumn("outcome", F.when(F.col(seq).isNull(), OUTCOMES[0]).otherwise(name))
        .withColumn("is_dup", F.col("outcome") == OUTCOMES[1])
        .drop("_v")
    )


def filter_verdicts(firsts: DataFrame, by: Sequence[str], size: FilterSize, seq: str = "seq") -> DataFrame:
    """(seq, verdict) of rows that a filter alone accepts."""
    return _misses(firsts, by, size, seq).withColumn("verdict", F.lit(0))


def two_stage_verdicts(firsts: DataFrame, by: Sequence[str], size: FilterSize, seq: str = "seq") -> DataFrame:
    """(seq, verdict) of rows a filter plus exact check accepts: 0 new, 2 false hit."""
    unknown = filter_verdicts(firsts, by, size, seq)
    return firsts.select(seq).join(unknown.hint("merge"), seq, "left").withColumn("verdict", F.coalesce("verdict", F.lit(2)))


def dedupe_two_stage(
    df: DataFrame, size: FilterSize, by: Sequence[str] = SCOPE, seq: str = "seq"
) -> DataFrame:
    """Filter screen, then exact check of the hits; false hits are accepted."""
    firsts = first_seen(df, [*by, "fp"], seq)
    return with_outcome(df, two_stage_verdicts(firsts, by, size, seq), seq)


# ---------------------------------------------------------------- policies

_POLICIES: dict[str, Callable[..., DataFrame]] = {}


def register_dedupe(name: str, policy: Callable[..., DataFrame]) -> None:
    """Make `policy(df, **options) -> df with is_dup` available by name."""
    _POLICIES[name] = policy


def dedupe(df: DataFrame, policy: str, **options) -> DataFrame:
    return _POLICIES[policy](df, **options)


for _name, _policy in {
    "none": dedupe_none,
    "global_exact": dedupe_global_exact,
    "scoped_exact": dedupe_scoped_exact,
    "arrival_lookback": dedupe_arrival_lookback,
    "ttl": dedupe_ttl,
    "filter_only": dedupe_filter_only,
    "two_stage": dedupe_two_stage,
}.items():
    register_dedupe(_name, _policy)
