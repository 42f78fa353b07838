"""Exact top-k search by inner product with MaxScore.

A vector's components, as integers, are the weights of its terms; a query's terms are its non-zero components.
Candidates are dealt into shards of bounded size, a shard holds one posting list per dimension and, for either sign of
the query's weight, the most a posting can add. A query walks a shard in blocks of ascending id:

* terms are ordered by bound; those with the smallest bounds, as long as their sum cannot exceed the score to beat, are
  non-essential. The essential postings are added up for the whole block;
* a candidate stays competitive while its partial score plus the bounds of what is not yet probed exceeds the score to
  beat. Non-essential terms are probed, largest bound first, for competitive candidates alone;
* what is left is exact and enters the query's best k, which raises the score to beat for the next block. Once all
  terms together cannot exceed it, the walk of the shard ends.

Ids ascend, so a later candidate has to exceed the k-th score, not to equal it. Each shard's best k are merged per
query. Queries are dealt into groups, and a task gets one shard and one group: all of the work is split both ways.

Where there are many shards, one in `SAMPLE` is searched first. A query's k-th score there is its floor everywhere: candidates
below it are no results, and a shard hands on only those that reach it, about `SAMPLE` times k a query in all, however many shards there are.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an id. A row
repeated with the same id and vector counts once. Shorter vectors count as padded with zeros. A query is not its own
candidate. Scores are 64-bit integers. An empty table gives an empty one; only the two named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import task_count, written
from .common import pieces

#: A shard of 64 dimensions takes 16 MB; small tables get smaller shards, as long as there are tasks without one.
SHARD_ROWS = 1 << 16
GROUP_ROWS = 1 << 13
LEAST_SHARD_ROWS = 4096
SAMPLE = 64
_NO_FLOOR = -(1 << 62)
_FIRST_BLOCK = 1024
_QUERIES_AT_ONCE = 1024
_PROBED_AT_ONCE = 8


def integer_weights(vector: str | Column, scale: int = 64) -> Column:
    """floor(scale * x) for each component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: str | Column) -> Column:
    def finite(x: Column) -> Column:
        x = x.cast("double")
        return F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False))

    return F.coalesce(F.forall(vector, finite), F.lit(False))


class Shard:
    """Posting lists by dimension, with the largest and smallest weight of each."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.lists = np.ascontiguousarray(weights[order].T)
        shape = len(self.lists)
        self.most = self.lists.max(axis=1) if self.lists.size else np.zeros(shape, weights.dtype)
        self.least = self.lists.min(axis=1) if self.lists.size else np.zeros(shape, weights.dtype)

    def best(self, own: np.ndarray, queries: np.ndarray, k: int, floors: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of the k best candidates of each query, other than `own`, best first; of those that reach its floor."""
        end = min(_FIRST_BLOCK, len(self.ids))
        floors = [_NO_FLOOR] * len(queries) if floors is None else floors
        out = []
        for start in range(0, len(queries), _QUERIES_AT_ONCE):
            part = slice(start, start + _QUERIES_AT_ONCE)
            first = queries[part] @ self.lists[:, :end]  # with no score to beat yet, every term is essential
            out += [self._walk(o, q, k, s, f) for o, q, s, f in zip(own[part], queries[part], first, floors[part], strict=True)]
        return out

    def _walk(self, own: int, query: np.ndarray, k: int, first: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
        bound = np.maximum(np.where(query > 0, query * self.most, query * self.least), 0)
        terms = np.flatnonzero(query)
        terms = terms[np.argsort(bound[terms], kind="stable")]
        reach = np.cumsum(bound[terms])
        ids, scores, to_beat = np.empty(0, np.int64), np.empty(0, query.dtype), None if floor == _NO_FLOOR else floor - 1
        rows = np.arange(len(first)) if to_beat is None else np.flatnonzero(first > to_beat)
        ids, scores, to_beat = self._enter(own, k, ids, scores, rows, first[rows], to_beat)
        start, n = len(first), len(self.ids)
        while start < n:
            end = min(n, 4 * start)
            split = 0 if to_beat is None else int(np.searchsorted(reach, to_beat, side="right"))
            if to_beat is not None and split == len(terms) and (not len(reach) or reach[-1] <= to_beat):
                break
            essential = terms[split:]
            partial = query[essential] @ self.lists[:, start:end].take(essential, axis=0)
            rows = np.arange(start, end)
            if to_beat is not None and split:
                keep = np.flatnonzero(partial + reach[split - 1] > to_beat)
                rows, partial = rows[keep], partial[keep]
            while split and len(rows):
                begin = max(0, split - _PROBED_AT_ONCE)
                probed = terms[begin:split]
                partial = partial + query[probed] @ self.lists[np.ix_(probed, rows)]
                split = begin
                keep = partial + (reach[split - 1] if split else 0) > to_beat
                rows, partial = rows[keep], partial[keep]
            ids, scores, to_beat = self._enter(own, k, ids, scores, rows, partial, to_beat)
            start = end
        return ids, scores

    def _enter(self, own, k, ids, scores, rows, new, to_beat):
        if to_beat is None and len(rows) > 4 * k:  # only the k + 1 best can matter, with all that tie with the last
            keep = np.flatnonzero(new >= np.partition(new, len(new) - k - 1)[len(new) - k - 1])
            rows, new = rows[keep], new[keep]
        other = self.ids[rows] != own
        ids, scores = np.concatenate((ids, self.ids[rows[other]])), np.concatenate((scores, new[other]))
        best = np.lexsort((ids, -scores))[:k]
        ids, scores = ids[best], scores[best]
        return ids, scores, scores[-1] if len(ids) == k else to_beat


def _matrix(lists: pa.ChunkedArray, dims: int) -> np.ndarray:
    array = lists.combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    lengths = np.diff(array.offsets.to_numpy()) if len(array) else np.empty(0, np.int64)
    values = array.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(lengths) and (lengths == dims).all():
        return values.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    column = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, column] = values
    return out


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def longest(t: pa.Table) -> int:
        return max((len(x) for x in t.column("_w")), default=0)

    def run(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        dims = max(longest(candidates), longest(asked))
        weights, queries = _matrix(candidates.column("_w"), dims), _matrix(asked.column("_w"), dims)
        largest = float(np.abs(weights.astype(float)).max(initial=0)) * float(np.abs(queries.astype(float)).max(initial=0)) * max(dims, 1)
        for kind, exact in ((np.float32, 2.0**23), (np.float64, 2.0**52)):  # whole sums up to this, and fast products
            if largest < exact:
                weights, queries = weights.astype(kind), queries.astype(kind)
                break
        shard = Shard(candidates.column("_id").to_numpy(), weights)
        query_ids, ids, scores = [], [], []
        owns, floors = asked.column("_id").to_pylist(), asked.column("_floor").to_pylist()
        for own, (found, score) in zip(owns, shard.best(owns, queries, k, floors), strict=True):
            query_ids.append(np.full(len(found), own, np.int64))
            ids.append(found)
            scores.append(score.astype(np.int64))
        made = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (query_ids, ids, scores)]
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in made], schema=schema)

    return run


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))


def _local(candidates: DataFrame, queries: DataFrame, shards: Column, groups: int, k: int) -> DataFrame:
    """Each shard's best of each query. shards: the numbers of those that are searched, as an array."""
    dealt = candidates.withColumn("_group", _each(groups))
    asked = queries.select(  # under new names, as both sides come from one table
        *[F.col(c).alias(c) for c in ("_id", "_w", "_floor")], F.explode(shards).alias("_shard"), F.pmod(F.xxhash64("_id", F.lit("query")), F.lit(groups)).alias("_group")
    )
    both = dealt.groupBy("_shard", "_group").cogroup(asked.groupBy("_shard", "_group"))
    return both.applyInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint")


def _ranked(local: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame,
    k: int = 20,
    query_every: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = 64,
    shard_rows: int = SHARD_ROWS,
    group_rows: int = GROUP_ROWS,
    sample: int = SAMPLE,
    least_shard_rows: int = LEAST_SHARD_ROWS,
) -> DataFrame:
    """The k best candidates of every row whose id is divisible by `query_every`: query_id, rank, vec_id, score."""
    rows = (
        vectors.select(F.col(vec_id).cast("bigint").alias("_id"), F.col(vector).alias("_v"))
        .where(F.col("_id").isNotNull() & usable("_v"))
        .select("_id", integer_weights("_v", scale).alias("_w"))
        .distinct()
    )
    is_query = F.col("_id") % query_every == 0
    n, asked = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    shards = max(pieces(n, shard_rows), min(pieces(n, least_shard_rows), task_count(vectors.sparkSession)))
    groups = pieces(asked, group_rows)
    candidates = rows.select("_id", "_w", F.pmod(F.xxhash64("_id"), F.lit(shards)).alias("_shard"))
    queries = rows.where(is_query).withColumn("_floor", F.lit(_NO_FLOOR))
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))
    first = shards // sample
    if not first:
        return _ranked(_local(candidates, queries, every, groups, k), k).select("query_id", "rank", "vec_id", "score")
    searched = written(_local(candidates.where(F.col("_shard") < first), queries, F.slice(every, 1, first), groups, k), "maxscore-sample")
    floors = _ranked(searched, k).where(F.col("rank") == k).select(F.col("query_id").alias("_id"), F.col("score").alias("_floor"))
    informed = queries.drop("_floor").join(floors, "_id", "left").withColumn("_floor", F.coalesce("_floor", F.lit(_NO_FLOOR)))
    others = F.slice(every, first + 1, shards - first)
    rest = _local(candidates.where(F.col("_shard") >= first), informed, others, groups, k)
    return _ranked(searched.unionByName(rest), k).select("query_id", "rank", "vec_id", "score")
