"""Merkle manifest of a table, with a persistent tree: a changed row makes a version, not a new tree.

1. A row's leaf is the SHA-256 of its fields. Rows are numbered within their group in ascending order by range partitioning and
   offsets, so that the tree's shape depends on the rows alone.
2. Every `2 ** bits` consecutive nodes of a group are an aligned block. A task builds a block's tree and hands on its top; the
   tops are the nodes of the next round, until a group has one node. The groups' nodes, in order, make the upper tree
   in the same way. A round divides the nodes by the size of a block, so few rounds serve any table.
3. Downwards each node gets the way from it to the root: the siblings of its ancestors and the sides they are on.
4. A changed leaf is a version: within the block it copies its ancestors and shares all other nodes with the tree. The copy of the
   block's top goes on along the block's way to the root, in the task of the block, so that versions of the upper levels
   spread over all tasks instead of meeting at the root.

A block's first node decides its height: the first block of a group is as high as its nodes ask for, later ones have the full
height, since only a group of several blocks has them.

Rules: a null field is `-`; a null group is the first one; a null order value sorts first. Rows with the same order value are ordered by
their leaf, so rows alike in all fields are leaves of their own with the same digest. Very long texts are hashed where they are read and
move no further. An empty table has no row and no root. Other columns of the table, whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordering import dense_index
from ..session import task_count, written
from .common import pieces

BLOCK_BITS = 10
_ROWS_PER_RANGE = 1 << 18
ALONE, LEFT, RIGHT = 0, 1, 2  # on which side a sibling is, level by level


def digest(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def field_text(value: Column) -> Column:
    """`-` for null, else the number of bytes in UTF-8, `:` and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field_text, values)).cast("binary"), 256))


class Tree:
    """The levels of a block, lowest first. They are never written again: versions share them."""

    def __init__(self, nodes: list[bytes], height: int):
        self.levels = [nodes]
        for _ in range(height):
            below = self.levels[-1]
            self.levels.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])

    @property
    def top(self) -> bytes:
        return self.levels[-1][0]

    def way(self, at: int) -> tuple[list[bytes], bytes]:
        """The siblings of a node's ancestors and, level by level, their sides."""
        siblings, sides = [], bytearray()
        for level in self.levels[:-1]:
            other = at ^ 1
            if other < len(level):
                siblings.append(level[other])
                sides.append(LEFT if other < at else RIGHT)
            else:
                sides.append(ALONE)
            at >>= 1
        return siblings, bytes(sides)

    def version(self, at: int, node: bytes) -> list[bytes]:
        """The nodes that a version with another node at `at` does not share: the node and its copied ancestors."""
        copies = [node]
        for level in self.levels[:-1]:
            pair = level[at & ~1 : (at | 1) + 1]
            pair[at & 1] = copies[-1]
            copies.append(digest(*pair))
            at >>= 1
        return copies


def climb(node: bytes, siblings: Sequence[bytes], sides: bytes) -> bytes:
    """The root that a node and a way to it give."""
    left_over = iter(siblings)
    for side in sides:
        other = next(left_over) if side != ALONE else b""
        node = digest(other, node) if side == LEFT else digest(node, other)
    return node


def _texts(column: pa.ChunkedArray) -> list[bytes | None]:
    return [None if x is None else x.hex().encode() for x in column.to_pylist()]


def _raw(digests: list[bytes]) -> bytes:
    return bytes.fromhex(b"".join(digests).decode())


def _apart(raw: bytes) -> list[bytes]:
    text = raw.hex().encode()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def _block(nodes: pa.Table, bits: int) -> tuple[pa.Table, Tree]:
    nodes = nodes.sort_by("_pos")
    first = nodes.column("_pos")[0].as_py() >> bits == 0
    return nodes, Tree(_texts(nodes.column("_digest")), (nodes.num_rows - 1).bit_length() if first else bits)


def _rise(nodes: DataFrame, bits: int, name: str) -> list[DataFrame]:
    """The nodes (_group, _pos, _digest) of every round; the last has one for each group."""
    schema = pa.schema([("_group", pa.int64()), ("_pos", pa.int64()), ("_digest", pa.binary())])

    def top(block: pa.Table) -> pa.Table:
        block, tree = _block(block, bits)
        made = ([block.column("_group")[0].as_py()], [block.column("_pos")[0].as_py() >> bits], [_raw([tree.top])])
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(made, schema, strict=True)], schema=schema)

    rounds = [nodes]
    while rounds[-1].agg(F.max("_pos")).first()[0]:
        at = F.shiftright("_pos", bits).alias("_at")
        blocks = rounds[-1].select("_group", "_pos", "_digest", at).groupBy("_group", "_at")
        tops = blocks.applyInArrow(lambda t: top(t.select(schema.names)), "_group bigint, _pos bigint, _digest binary")
        rounds.append(written(tops, name))
    return rounds


_WAY = "_siblings binary, _sides binary, _subroot binary, _root binary"


def _descend(nodes: DataFrame, ways: DataFrame, bits: int) -> DataFrame:
    """From the ways of the blocks' tops to those of the nodes: (_group, _pos) and the way."""
    names = ["_group", "_pos", "_siblings", "_sides", "_subroot", "_root"]
    types = [pa.int64(), pa.int64(), *[pa.binary()] * 4]

    def run(block: pa.Table, way: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in types], names=names)
        block, tree = _block(block, bits)
        on = way.to_pylist()[0]
        own = [tree.way(i) for i in range(block.num_rows)]
        return pa.Table.from_arrays(
            [
                block.column("_group"),
                block.column("_pos"),
                pa.array([_raw(s) + on["_siblings"] for s, _ in own], pa.binary()),
                pa.array([s + on["_sides"] for _, s in own], pa.binary()),
                pa.array([on["_subroot"]] * len(own), pa.binary()),
                pa.array([on["_root"]] * len(own), pa.binary()),
            ],
            names=names,
        )

    return _with_ways(nodes.select("_group", "_pos", "_digest"), ways, bits).applyInArrow(run, f"_group bigint, _pos bigint, {_WAY}")


def _with_ways(nodes: DataFrame, ways: DataFrame, bits: int):
    blocks = nodes.withColumn("_at", F.shiftright("_pos", bits)).groupBy("_group", "_at")
    return blocks.cogroup(ways.withColumnRenamed("_pos", "_at").groupBy("_group", "_at"))


def versions(
    docs: DataFrame,
    fields: Sequence[str],
    group: str,
    order: str,
    changed: Column,
    changes: dict[str, Column],
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """One row a leaf: order value, leaf, subroot, root, its way (siblings, sides) to the root, and of the version in which
    the row is changed the root (`version_root`) and how many nodes it does not share (`copied`, 0 if unchanged).

    fields: what a leaf is the digest of. group, order: whose subtree a leaf is in, and where. changed: which rows are changed;
    changes: their new values by field. Digests are 32 raw bytes.
    """
    spark = docs.sparkSession
    values = [F.col(c) for c in fields]
    new = [changes.get(c, F.col(c)) for c in fields]
    leaves = written(
        docs.select(
            F.col(group).alias("_key"),
            F.col(order).alias("_order"),
            leaf_digest(values).alias("_digest"),
            F.when(changed, leaf_digest(new)).alias("_new"),
        ),
        "merkle-leaves",
    )
    ranges = max(task_count(spark), pieces(leaves.count(), _ROWS_PER_RANGE))
    placed, _ = dense_index(leaves, ["_key", "_order", "_digest", "_new"], out="_idx", pieces=ranges)
    starts = written(placed.groupBy("_key").agg(F.min("_idx").alias("_start")), "merkle-groups")
    numbered, groups = dense_index(starts, ["_start"], out="_group")
    numbered = written(numbered.withColumnRenamed("_key", "_own"), "merkle-groups")
    nodes = placed.join(numbered, F.col("_key").eqNullSafe(F.col("_own"))).select(
        "_group", (F.col("_idx") - F.col("_start")).alias("_pos"), "_digest", "_new", "_order"
    )

    below = _rise(nodes, bits, "merkle-nodes")
    subroots = below[-1].select("_group", "_digest")
    above = _rise(subroots.select(F.lit(0).cast("bigint").alias("_group"), F.col("_group").alias("_pos"), "_digest"), bits, "merkle-upper")
    nothing = F.lit(b"").cast("binary")
    ways = above[-1].select(
        "_group", "_pos", nothing.alias("_siblings"), nothing.alias("_sides"), nothing.alias("_subroot"), F.col("_digest").alias("_root")
    )
    for upper in reversed(above[:-1]):
        ways = written(_descend(upper, ways, bits), "merkle-ways")
    ways = ways.select(F.col("_pos").alias("_group"), F.lit(0).cast("bigint").alias("_pos"), "_siblings", "_sides", "_root")
    ways = ways.join(subroots.withColumnRenamed("_digest", "_subroot"), "_group").select("_group", "_pos", "_siblings", "_sides", "_subroot", "_root")
    for lower in reversed(below[1:-1]):
        ways = written(_descend(lower, ways, bits), "merkle-ways")

    order_type = leaves.schema["_order"].dataType.simpleString()
    names = [order, "leaf", "subroot", "root", "siblings", "sides", "version_root", "copied"]
    kinds = [*[pa.binary()] * 6, pa.int32()]

    def finish(block: pa.Table, way: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.Table.from_arrays([block.column("_order"), *(pa.array([], k) for k in kinds)], names=names)
        block, tree = _block(block, bits)
        on = way.to_pylist()[0]
        siblings = _apart(on["_siblings"])
        unchanged = _raw([climb(tree.top, siblings, on["_sides"])])
        made: list[list] = [[] for _ in kinds]
        for i, other in enumerate(_texts(block.column("_new"))):
            own, sides = tree.way(i)
            copies = tree.version(i, other) if other else []
            root = _raw([climb(copies[-1], siblings, on["_sides"])]) if copies else unchanged
            row = (_raw([tree.levels[0][i]]), on["_subroot"], on["_root"], _raw(own) + on["_siblings"], sides + on["_sides"], root, len(copies) + (len(on["_sides"]) if copies else 0))
            for column, value in zip(made, row, strict=True):
                column.append(value)
        return pa.Table.from_arrays([block.column("_order"), *(pa.array(x, k) for x, k in zip(made, kinds, strict=True))], names=names)

    out = ", ".join([f"`{order}` {order_type}"] + [f"{n} binary" for n in names[1:-1]] + ["copied int"])
    return _with_ways(nodes, ways, bits).applyInArrow(finish, out)
