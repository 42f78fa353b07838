"""Ranked lexical search by dense blocked multiplication.

The items are the queries, all documents the candidates. A term's weight belongs to the corpus, its impact to a document alone, so an
item's score is a row of weights times a column of impacts:

1. One pass reads the texts: each document keeps its length and how often it holds the items' terms, as numbers of terms. Lengths
   and document frequencies are summed from that table.
2. Documents are taken in tiles, items in blocks. A block's vocabulary is compacted to the terms that the tile holds and cut into
   tiles of at most `TERMS`; weights (items x terms) and impacts (terms x documents) are filled in as dense float64 and multiplied.
3. All numbers are whole and none is negative, so a product is exact while the largest possible sum stays below 2^53. A
   vocabulary tile for which it could be more is halved; what a single term exceeds alone is multiplied in 64-bit integers. The tiles'
   products are added up in 64-bit integers.
4. Of a tile's scores those survive that reach the item's k-th score in the tile and the k-th so far, ties included; then the k
   best by score and id are kept. A task hands on k rows an item, which are merged by rank.

The items are dealt into groups of about `GROUP_BYTES` of text; a group's terms go to every task, and each group is a pass of its own, as many as
the items ask for. Nothing that grows with the documents is broadcast or collected but the groups' document frequencies, a number a term.

Rules: a null text has no terms, for documents and for items. Every row is a document and every row an item: rows alike are
ranked one behind the other, and a repeated item has its rows as often. A null document id sorts first. Scores of 0 are no result; an
empty table gives an empty one. Very long texts are read in slices cut between terms. Only the named columns of either table are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import written
from .common import by_bytes, pieces, trimmed

GROUP_BYTES = 8 << 20
ITEMS, TERMS, DOCUMENTS = 256, 2048, 1024
EXACT = 1 << 53
_SLICE = 1 << 22
#: Letters, digits and all bytes of characters beyond ASCII are parts of terms; A-Z are lower-cased.
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms(body: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, some at a time."""
    body, start = body or b"", 0
    while start < len(body):
        end = start + _SLICE
        part = body[start:end].translate(_TERM_BYTES)
        while end < len(body) and not part.endswith(b" "):  # up to the end of a term
            more = body[end : end + 4096].translate(_TERM_BYTES)
            stop = more.find(b" ")
            more = more if stop < 0 else more[: stop + 1]
            part, end = part + more, end + len(more)
        yield part.split()
        start = end


def impact(times: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * times) // (1000 * times + 8 * norm)


def weight(n: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * frequency + 1)))


def multiplied(weights: np.ndarray, impacts: np.ndarray, exact: int = EXACT) -> np.ndarray:
    """weights @ impacts as 64-bit integers, both whole, float64 and not negative."""
    most = impacts.max(axis=1, initial=0)
    if not len(most) or float((weights @ most).max(initial=0)) < exact:
        return (weights @ impacts).astype(np.int64)
    if len(most) == 1:
        return weights.astype(np.int64) @ impacts.astype(np.int64)
    half = len(most) // 2
    return multiplied(weights[:, :half], impacts[:half], exact) + multiplied(weights[:, half:], impacts[half:], exact)


class Items:
    """Blocks of items: of each block its terms, and (item, term, weight) triples."""

    def __init__(self, numbers: list[int], bags: list[dict[int, int]], weights: np.ndarray, block: int = ITEMS):
        self.blocks = []
        for first in range(0, len(bags), block):
            some = bags[first : first + block]
            item = np.repeat(np.arange(len(some)), [len(b) for b in some])
            term = np.fromiter((t for b in some for t in b), np.int64, len(item))
            times = np.fromiter((n for b in some for n in b.values()), np.int64, len(item))
            order = np.argsort(term, kind="stable")
            item, term, times = item[order], term[order], times[order]
            self.blocks.append((np.array(numbers[first : first + block]), item, term, (times * weights[term]).astype(np.float64)))


class Best:
    """The k best documents so far of each item of a block: highest score, then the smallest id, a null id before all."""

    def __init__(self, items: int, k: int):
        self.k, self.beat = k, np.ones(items, np.int64)
        self.rows = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in range(items)]

    def enter(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        least = self.beat
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        hit = scores >= least[:, None]
        for item in np.flatnonzero(hit.any(axis=1)):
            new = np.flatnonzero(hit[item])
            score, doc, is_known = (np.concatenate(x) for x in zip(self.rows[item], (scores[item, new], ids[new], known[new]), strict=True))
            best = np.lexsort((doc, is_known, -score))[: self.k]
            self.rows[item] = score[best], doc[best], is_known[best]
            if len(best) == self.k:
                self.beat[item] = score[best[-1]]


def block_scores(block: tuple, doc: np.ndarray, term: np.ndarray, impacts: np.ndarray, documents: int, tile: int = TERMS, exact: int = EXACT) -> np.ndarray:
    """Scores (items x documents) of a block in a tile of documents, whose (document, term, impact) triples are given."""
    numbers, item, its_term, its_weight = block
    shared = np.intersect1d(its_term, term)
    total = np.zeros((len(numbers), documents), np.int64)
    column = np.searchsorted(shared, term)
    column[column == len(shared)] = 0
    used = shared[column] == term if len(shared) else np.zeros(len(term), bool)
    doc, column, impacts = doc[used], column[used], impacts[used]
    order = np.argsort(column, kind="stable")
    doc, column, impacts = doc[order], column[order], impacts[order]
    its_column = np.searchsorted(shared, its_term)
    its_column[its_column == len(shared)] = 0
    its_used = shared[its_column] == its_term if len(shared) else np.zeros(len(its_term), bool)
    item, its_column, its_weight = item[its_used], its_column[its_used], its_weight[its_used]
    for first in range(0, len(shared), tile):
        wide = min(tile, len(shared) - first)
        left, right = np.zeros((len(numbers), wide)), np.zeros((wide, documents))
        a, b = np.searchsorted(its_column, (first, first + wide))
        left[item[a:b], its_column[a:b] - first] = its_weight[a:b]
        a, b = np.searchsorted(column, (first, first + wide))
        right[column[a:b] - first, doc[a:b]] = impacts[a:b]
        total += multiplied(left, right, exact)
    return total


def _counted(docs: DataFrame, vocabulary: dict[bytes, int], text: str, doc_id: str) -> DataFrame:
    """_id, how many terms the text has, and the numbers of those in the vocabulary with how often it holds them."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of a group of items, whose size is checked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = known.value.get
        for batch in batches:
            for part in by_bytes(batch, 1):
                lengths, found, times = [], [], []
                for body in part.column(1):
                    n, numbers = 0, []
                    for some in terms(body.as_py()):
                        n += len(some)
                        numbers.append(np.array([i for i in map(find, some) if i is not None], np.int32))
                    own, count = np.unique(np.concatenate(numbers) if numbers else np.empty(0, np.int32), return_counts=True)
                    lengths.append(n)
                    found.append(own)
                    times.append(count)
                made = [pa.array(lengths, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names=["_id", "_n", "_terms", "_times"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).cast("binary").alias("_body"))
    return rows.mapInArrow(trimmed(run), "_id bigint, _n bigint, _terms array<int>, _times array<bigint>")


def _frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term is; a task adds up its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(total[own], pa.int64())], names=["term", "n"])

    out = np.zeros(size, np.int64)
    sums = counted.select("_terms").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    for row in sums.toLocalIterator():  # a number a term of the group
        out[row["term"]] = row["n"]
    return out


def _scored(counted: DataFrame, items: Items, k: int, n: int, length: int, documents: int, tile: int, exact: int) -> DataFrame:
    """(_item, _id, score): the k best of every task."""
    asked = counted.sparkSession.sparkContext.broadcast(items)

    def enter(best: list[Best], rows: pa.Table) -> None:
        lists = rows.column("_terms").combine_chunks(), rows.column("_times").combine_chunks()
        lists = [x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks) for x in lists]
        term, times = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
        doc = np.repeat(np.arange(rows.num_rows), np.diff(lists[0].offsets.to_numpy()))
        norm = 25 + (75 * rows.column("_n").to_numpy() * n) // length
        ids = rows.column("_id")
        known = np.array([x.is_valid for x in ids], bool) if ids.null_count else np.ones(len(ids), bool)
        ids = ids.fill_null(0).to_numpy()
        impacts = impact(times, norm[doc])
        for own, block in zip(best, asked.value.blocks, strict=True):
            own.enter(block_scores(block, doc, term, impacts, rows.num_rows, tile, exact), ids, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(len(b[0]), k) for b in asked.value.blocks]
        held, count = [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, documents):
                held.append(batch.slice(first, documents))
                count += held[-1].num_rows
                if count >= documents:
                    enter(best, pa.Table.from_batches(held))
                    held, count = [], 0
        if count:
            enter(best, pa.Table.from_batches(held))
        for own, (numbers, *_) in zip(best, asked.value.blocks, strict=True):
            item = np.repeat(numbers, [len(r[0]) for r in own.rows])
            score, doc, known = (np.concatenate(x) for x in zip(*own.rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64(), mask=~known), pa.array(score, pa.int64())], names=["_item", "_id", "score"])

    return counted.where(F.size("_terms") > 0).mapInArrow(trimmed(run), "_item bigint, _id bigint, score bigint")


def rank(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    group_bytes: int = GROUP_BYTES,
    documents: int = DOCUMENTS,
    tile: int = TERMS,
    exact: int = EXACT,
) -> DataFrame:
    """The k best documents of every item with a score above 0: item_id, rank, doc_id, score.

    group_bytes: text of the items that one pass serves; documents, tile: sizes of the tiles; exact: sums below it are exact in a product.
    """
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    asked = items.select(F.col(item_id).alias("_name"), F.col(text).cast("binary").alias("_body"))
    size = asked.agg(F.sum(F.octet_length("_body"))).first()[0] or 0
    groups = pieces(size, group_bytes)
    dealt = written(asked.withColumn("_group", F.pmod(F.xxhash64("_name", "_body"), F.lit(groups)).cast("int")), "rank-items")
    out = None
    for group in range(groups):
        rows = dealt.where(F.col("_group") == group).select("_name", "_body").collect()  # about group_bytes
        vocabulary: dict[bytes, int] = {}
        bags = []
        for row in rows:
            bag: dict[int, int] = {}
            for some in terms(row["_body"]):
                for term in some:
                    number = vocabulary.setdefault(term, len(vocabulary))
                    bag[number] = bag.get(number, 0) + 1
            bags.append(bag)
        counted = written(_counted(docs, vocabulary, text, doc_id), "rank-counted")
        n, length = counted.agg(F.count(F.when(F.col("_n") > 0, 1)), F.sum("_n")).first()
        frequencies = _frequencies(counted, len(vocabulary))
        weights = np.array([weight(n, int(f)) for f in frequencies], np.int64)
        made = _scored(counted, Items(list(range(len(rows))), bags, weights), k, n, length or 1, documents, tile, exact)
        order = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_first("_id"))
        best = made.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["_name"]) for i, r in enumerate(rows)], f"_item bigint, `{item_id}` {kind}")
        best = best.join(names, "_item").select(item_id, "rank", F.col("_id").alias(doc_id), "score")
        out = best if out is None else out.unionByName(best)
    return out
