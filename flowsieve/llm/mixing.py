"""Temperature mixing of sources, realised as budgeted block permutations.

Weights are the sources' token shares to the power alpha, normalised: alpha 1 keeps the natural mix, 0 makes all sources
equal. The exponent is bisected to the flattest mix that has no more than the target entropy and repeats no
source more often than the limit. Without a budget the mix is as large as it takes to read every source at least once.

A source's budget is read in passes. Each pass is a permutation of the source's blocks (documents dealt by a hash) and of the
documents within a block, all by hashes of the seed and the pass, so it can be repeated anywhere. Whole passes take every
document; the last one stops before the document that would exceed the budget. Where it stops is found by
sums of groups of blocks, then of the blocks of one group, then of the documents of one block: no source is ever sorted
or summed up in one task, and texts are not shuffled.

A token is a word `[^\\x20\\x09-\\x0D]+`. A null text has none; documents without tokens are in every whole pass and cost
nothing. Documents without a source are a source of their own, named by an empty text. Rows alike in id and text share a
place in the order and are taken or left together. An empty table gives an empty mix.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written
from .common import pieces

BLOCK_DOCS = 1000
#: Up to so many sources, tables of a row a source are broadcast; beyond, they are joined by shuffles.
BROADCAST_SOURCES = 100_000
_GROUPS = 1024
_ROUNDS = 60
WORD = r"[^\x20\x09-\x0D]+"


def tempered(tokens: Mapping[str, int], alpha: float) -> dict[str, float]:
    """Weights by source, proportional to its token share to the power alpha; a source without tokens gets none."""
    total = sum(tokens.values())
    powers = {s: (t / total) ** alpha if t else 0.0 for s, t in tokens.items()}
    whole = sum(powers.values())
    return {s: p / whole if whole else 0.0 for s, p in powers.items()}


def entropy(weights: Mapping[str, float]) -> float:
    return -sum(w * math.log2(w) for w in weights.values() if w)


def cover_budget(tokens: Mapping[str, int], weights: Mapping[str, float]) -> float:
    """The least budget that reads every source at least once."""
    return max((tokens[s] / w for s, w in weights.items() if w), default=0.0)


def repeats(tokens: Mapping[str, int], weights: Mapping[str, float], budget: float | None) -> float:
    """How often the most repeated source is read."""
    size = cover_budget(tokens, weights) if budget is None else budget
    return max((size * w / tokens[s] for s, w in weights.items() if w), default=0.0)


def find_exponent(tokens: Mapping[str, int], target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None) -> float:
    """The smallest exponent in 0..1 with at most the target entropy and at most `max_repeats` passes over any source.

    Both fall as the exponent rises. 1 where even the natural mix exceeds them.
    """

    def fits(alpha: float) -> bool:
        weights = tempered(tokens, alpha)
        return (target_entropy is None or entropy(weights) <= target_entropy + 1e-12) and (
            max_repeats is None or repeats(tokens, weights, budget) <= max_repeats * (1 + 1e-12)
        )

    low, high = 0.0, 1.0
    if not any(tokens.values()) or fits(low):
        return low
    for _ in range(_ROUNDS):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


@dataclass(frozen=True)
class SourcePlan:
    source: str
    tokens: int
    docs: int
    weight: float
    budget: int
    passes: int
    rest: int
    blocks: int


def plan(totals: Mapping[str, tuple[int, int]], target_entropy_share: float | None = None, max_repeats: float | None = None, budget: int | None = None) -> list[SourcePlan]:
    """totals: documents and tokens by source. target_entropy_share: of the entropy of equal weights."""
    tokens = {s: totals[s][1] for s in sorted(totals)}  # in a fixed order: sums of doubles depend on it
    filled = sum(1 for t in tokens.values() if t)
    target = None if target_entropy_share is None else target_entropy_share * math.log2(max(1, filled))
    weights = tempered(tokens, find_exponent(tokens, target, max_repeats, budget))
    size = cover_budget(tokens, weights) if budget is None else budget
    out = []
    for source in sorted(totals):
        docs, own = totals[source]
        share = round(size * weights[source])
        if budget is None:  # rounding must not cost a source its first pass
            share = max(share, own)
        # A source without tokens costs nothing and is read once.
        passes, rest = divmod(share, own) if own else (1, 0)
        out.append(SourcePlan(source, own, docs, weights[source], share, passes, rest, pieces(docs, BLOCK_DOCS)))
    return out


def mix(
    docs: DataFrame,
    target_entropy_share: float | None = 0.95,
    max_repeats: float | None = 2.0,
    budget: int | None = None,
    seed: int = 0,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
) -> DataFrame:
    """A row for every time that a document is drawn: its columns, and _epoch, _block and _place.

    These replace columns of the same name. By (_epoch, _block, _place) a source's rows are in the order of its permutations. _weight is the source's.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))
    identity = F.xxhash64(F.col(doc_id), F.xxhash64(text))
    slim = written(docs.select(name.alias("_source"), identity.alias("_doc"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("_tokens")), "mixing")
    totals = {r["_source"]: (r["n"], r["t"]) for r in slim.groupBy("_source").agg(F.count("*").alias("n"), F.sum("_tokens").alias("t")).collect()}
    plans = plan(totals, target_entropy_share, max_repeats, budget)
    settings = spark.createDataFrame(
        [(p.source, p.weight, p.passes, p.rest, p.blocks) for p in plans], "_source string, _weight double, _passes bigint, _rest bigint, _blocks bigint"
    )  # a row a source
    lead, block, place = _order(seed)

    def small(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if len(plans) <= BROADCAST_SOURCES else rows

    last = slim.join(small(settings), "_source").where("_rest > 0").withColumn("_epoch", F.col("_passes"))
    blocks = last.select("_source", "_rest", lead.alias("_lead"), block.alias("_block"), "_tokens").groupBy("_source", "_rest", "_lead", "_block").agg(F.sum("_tokens").alias("_tokens"))
    groups = blocks.groupBy("_source", "_rest", "_lead").agg(F.sum("_tokens").alias("_tokens"))
    at_group = _boundary(groups, ["_source"], "_lead", "_rest")
    at_block = _boundary(blocks.drop("_rest").join(small(at_group), ["_source", "_lead"]), ["_source", "_lead"], "_block", "_rest")
    inside = last.drop("_rest").withColumn("_lead", lead).withColumn("_block", block).withColumn("_place", place).join(small(at_block), ["_source", "_lead", "_block"])
    summed = inside.withColumn("_sum", F.sum("_tokens").over(Window.partitionBy("_source", "_lead", "_block").orderBy("_place")))
    stops = summed.groupBy("_source", "_lead", "_block").agg(F.max(F.when(F.col("_sum") <= F.col("_rest"), F.col("_place"))).alias("_stop"))
    borders = settings.join(stops.select("_source", F.col("_lead").alias("_at_lead"), F.col("_block").alias("_at_block"), "_stop"), "_source", "left")

    columns = [c for c in docs.columns if c.lower() not in ("_epoch", "_block", "_place", "_weight")]
    drawn = docs.select(F.struct(*columns).alias("_row"), name.alias("_source"), identity.alias("_doc")).join(small(borders), "_source").withColumn("_epoch", F.col("_passes"))
    before = (
        (lead < F.col("_at_lead"))
        | ((lead == F.col("_at_lead")) & (block < F.col("_at_block")))
        | ((lead == F.col("_at_lead")) & (block == F.col("_at_block")) & (place <= F.col("_stop")))
    )
    times = F.col("_passes") + F.coalesce(before, F.lit(False)).cast("bigint")
    return (
        drawn.withColumn("_times", times)
        .where("_times > 0")
        .withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_times") - 1)))
        .select("_row.*", "_epoch", block.alias("_block"), place.alias("_place"), "_weight")
    )


def _order(seed: int) -> tuple[Column, Column, Column]:
    """Of a row with _doc, _blocks and _epoch: group of blocks, block and place in the permutation of that pass."""
    number = F.pmod(F.col("_doc"), F.col("_blocks"))
    block = F.xxhash64(F.lit(seed), F.lit("block"), F.col("_epoch"), number)
    # The arithmetic shift keeps the order of the hashes: groups are ranges of blocks.
    return F.shiftright(block, 64 - int(math.log2(_GROUPS))), block, F.xxhash64(F.lit(seed), F.lit("place"), F.col("_epoch"), F.col("_doc"))


def _boundary(sums: DataFrame, keys: list[str], order: str, rest: str) -> DataFrame:
    """The first element of each key, in `order`, up to which the tokens exceed `rest`; `rest` less what comes before it."""
    window = Window.partitionBy(*keys).orderBy(order)
    upto = sums.withColumn("_upto", F.sum("_tokens").over(window))
    crossing = upto.where((F.col("_upto") > F.col(rest)) & (F.col("_upto") - F.col("_tokens") <= F.col(rest)))
    return crossing.select(*keys, order, (F.col(rest) - F.col("_upto") + F.col("_tokens")).alias(rest))
