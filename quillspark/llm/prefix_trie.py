"""Prefix trie of conversations: one node for each distinct beginning, with what sharing it would save.

Turns (role, text) are dictionary-encoded: distinct turns are numbered once in a table, so that a conversation is a path
of numbers. Paths are dealt out by range and sorted; a task cuts its range into shards of bounded size and builds a
ternary search tree for each, inserting the median path first so that the trees of siblings are balanced. A traversal
adds up members, leaves and savings.

A node lies in more than one shard only if it begins its shard's first or last path. These boundary nodes are few; they
are summed by key, less what each shard but the first counts anew: the savings of the nodes it shares with the shard
before, a child, and a leaf that is a leaf no more (or twice). Everything else leaves its shard complete.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import scratch_table

#: Turns of the paths of one shard; a longer path is a shard of its own.
SHARD_TURNS = 200_000
#: What a task says of a node: ``key`` and ``shard`` onwards serve the merging.
_NODE = pa.schema(
    [(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends", pa.list_(pa.int64())), ("key", pa.binary()), ("parent_key", pa.binary()), ("shard", pa.int64())]
    + [(c, pa.bool_()) for c in ("in_first", "in_last", "last_end")]
    + [("chars", pa.int64())]
)


def turn_paths(conversations: DataFrame) -> DataFrame:
    """``conv_id, ids, chars`` of ``conversations(conv_id, turn, role, text)``: the dictionary's numbers of the turns in
    order, and the code points of their texts.

    Turns go by number (null first), ties by the MD5 hash of role and text; null roles and texts are empty; repeated
    rows are turns each. Rows without a conversation id belong to none and are left out. A turn in many conversations
    is one row of the dictionary (adaptive execution splits its join); of a conversation only numbers are collected,
    after each task has collected its own, and it has to fit in a row."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn.alias("hash"), F.length(text).cast("long").alias("chars"))
    # numbers hold for good once they are written
    dictionary = scratch_table(rows.select("hash").distinct().select("hash", F.monotonically_increasing_id().alias("id")), "turns")
    turns = rows.join(dictionary, "hash").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "hash", "id", "chars"))).alias("t"))
    return turns.select("conv_id", F.col("t.id").alias("ids"), F.col("t.chars").alias("chars"))


class _Tree:
    """A ternary search tree: a node's siblings hang on it as ``low`` and ``high``, its children on ``below``. Node 0 is
    the root, and 0 as a link is none."""

    def __init__(self) -> None:
        self.turn, self.parent, self.depth, self.chars = [-1], [0], [0], [0]
        self.low, self.high, self.below = [0], [0], [0]

    def _new(self, turn: int, parent: int, chars: int) -> int:
        for column, value in ((self.turn, turn), (self.parent, parent), (self.depth, self.depth[parent] + 1), (self.chars, chars), (self.low, 0), (self.high, 0), (self.below, 0)):
            column.append(value)
        return len(self.turn) - 1

    def insert(self, ids: list[int], chars: list[int]) -> int:
        """The node of a path, made if it is new."""
        at = 0
        for turn, n in zip(ids, chars, strict=True):
            links, last, node = self.below, at, self.below[at]
            while node and self.turn[node] != turn:
                links, last = self.low if turn < self.turn[node] else self.high, node
                node = links[node]
            if not node:
                node = links[last] = self._new(turn, at, n)
            at = node
        return at

    def in_order(self) -> list[int]:
        """All nodes, parents before their children."""
        out, open_ = [], [0]
        while open_:
            node = open_.pop()
            out.append(node)
            open_ += [x for x in (self.high[node], self.low[node], self.below[node]) if x]
        return out

    def path(self, node: int) -> list[int]:
        """The nodes from the root to this one."""
        out = [node]
        while node:
            node = self.parent[node]
            out.append(node)
        return out[::-1]


def _middle_first(n: int) -> Iterator[int]:
    open_ = [(0, n)]
    while open_:
        a, b = open_.pop()
        if a < b:
            middle = (a + b) // 2
            yield middle
            open_ += [(middle + 1, b), (a, middle)]


def _shard(number: int, rows: list[tuple[int, list[int], list[int]]]) -> pa.RecordBatch:
    """Nodes of rows (conversation, ids, chars) sorted by ids and then by conversation."""
    groups = [(ids, chars, [c for c, _, _ in same]) for ids, same in ((k, list(g)) for k, g in itertools.groupby(rows, key=lambda r: r[1])) for chars in (same[0][2],)]
    tree, at = _Tree(), [0] * len(groups)
    for k in _middle_first(len(groups)):
        at[k] = tree.insert(groups[k][0], groups[k][1])
    n = len(tree.turn)
    least, members, children, leaves, saved = [None] * n, [0] * n, [0] * n, [0] * n, [0] * n
    ends: list[list[int]] = [[] for _ in range(n)]
    for node, (_, _, convs) in zip(at, groups, strict=True):
        least[node], members[node], ends[node] = convs[0], len(convs), convs
    order = tree.in_order()
    for node in reversed(order):
        leaves[node] += not children[node]
        saved[node] += (members[node] - 1) * tree.chars[node]
        if node:
            up = tree.parent[node]
            least[up] = least[node] if least[up] is None else min(least[up], least[node])
            members[up] += members[node]
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    key: dict[int, bytes] = {}
    first, last = tree.path(at[0]), tree.path(at[-1])
    for nodes in (first, last):
        digest = hashlib.md5()
        for node in nodes:
            if node:
                digest.update(tree.turn[node].to_bytes(8, "little"))
            key[node] = digest.digest()
    first, last = set(first), set(last)
    up = tree.parent
    return pa.RecordBatch.from_pylist(
        [
            dict(
                conv_id=least[v],
                depth=tree.depth[v],
                parent_conv_id=least[up[v]] if v and up[v] not in key else None,
                n_convs=members[v],
                n_children=children[v],
                n_leaves=leaves[v],
                saved_tokens=saved[v],
                ends=ends[v],
                key=key.get(v),
                parent_key=key.get(up[v]) if v else None,
                shard=number,
                in_first=v in first,
                in_last=v in last,
                last_end=v == at[-1],
                chars=tree.chars[v],
            )
            for v in order
        ],
        schema=_NODE,
    )


def _shards(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    rows, held, number = [], 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        for start in range(0, len(batch), 1024):
            part = batch.slice(start, 1024)
            for row in zip(*(part.column(c).to_pylist() for c in ("conv_id", "ids", "chars")), strict=True):
                rows.append(row)
                held += len(row[1]) + 1
                if held >= most:
                    yield _shard(number, rows)
                    rows, held, number = [], 0, number + 1
    if rows:
        yield _shard(number, rows)


def trie(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row for each distinct beginning of ``paths(conv_id, ids, chars)``, the empty one (depth 0) included; members
    are the paths that start with it, and the node's subtree holds it and all that go on from it.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (smallest member of the parent; null for the root),
    ``n_convs`` (members), ``n_children``, ``n_leaves`` (nodes without children in the subtree), ``saved_tokens``
    (members less one, times the code points of the node's last text, over the subtree), ``ends`` (members that end
    here, ascending). ``conv_id`` and ``depth`` name a node.

    Paths of no turn are members of the root; copies are members each, a repeated id as well; without a path there is
    no node. Ranges end anywhere, in a group of copies as well; ``ends`` of one node has to fit in a row."""
    sorted_ = paths.select("conv_id", "ids", "chars").repartitionByRange("ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    kinds = ", ".join(f"{f.name} {_KIND[f.type]}" for f in _NODE)
    nodes = scratch_table(sorted_.mapInArrow(lambda batches: _shards(batches, shard_turns), kinds), "nodes")
    boundary = nodes.where("key IS NOT NULL")
    merged = _merged(boundary)
    named = merged.select("key", F.col("conv_id").alias("_parent"))
    # names go to each shard's own part of a boundary node: a node with very many children is no hot key then
    known = boundary.select("shard", "key").join(named, "key").withColumnRenamed("key", "parent_key")
    inner = nodes.where("key IS NULL")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    below = inner.where("parent_key IS NOT NULL").drop("parent_conv_id").join(known, ["shard", "parent_key"]).withColumnRenamed("_parent", "parent_conv_id")
    merged = merged.join(named.withColumnRenamed("key", "parent_key"), "parent_key", "left").withColumnRenamed("_parent", "parent_conv_id")
    return reduce(DataFrame.unionByName, [x.select(out) for x in (inner.where("parent_key IS NULL"), below, merged)])


def _merged(parts: DataFrame) -> DataFrame:
    """Boundary nodes of all shards, one row each."""
    spread = parts.groupBy("key").agg(F.min("shard").alias("from"), F.max("shard").alias("to"))
    shared = F.col("in_first") & (F.col("shard") > F.col("from"))
    parts = parts.join(spread, "key").withColumns({"shared": shared, "goes_on": F.col("last_end") & (F.col("shard") < F.col("to"))})
    shard = W.partitionBy("shard")
    deeper = F.sum(F.when(F.col("shared"), F.col("chars")).otherwise(0)).over(shard.orderBy(F.col("depth").desc()).rowsBetween(W.unboundedPreceding, 0))
    parts = parts.withColumns({"again": deeper, "deepest": F.max(F.when(F.col("shared"), F.col("depth"))).over(shard), "end_goes_on": F.max("goes_on").over(shard)})
    twice = (F.col("shared") & (F.col("depth") < F.col("deepest"))).cast("long")
    no_leaf = (F.col("in_last") & F.col("end_goes_on")).cast("long")
    ends = F.sort_array(F.collect_list(F.when(F.size("ends") > 0, F.struct("shard", "ends"))))
    return parts.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"),
        F.max("depth").alias("depth"),
        F.max("parent_key").alias("parent_key"),
        F.sum("n_convs").alias("n_convs"),
        F.sum(F.col("n_children") - twice).alias("n_children"),
        F.sum(F.col("n_leaves") - no_leaf).alias("n_leaves"),
        F.sum(F.col("saved_tokens") + F.when(F.col("shared"), F.col("again")).otherwise(0)).alias("saved_tokens"),
        F.flatten(F.transform(ends, lambda x: x["ends"])).alias("ends"),
    )


_KIND = {pa.int64(): "long", pa.list_(pa.int64()): "array<long>", pa.binary(): "binary", pa.bool_(): "boolean"}


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """``trie`` of the turns of ``conversations`` (see ``turn_paths``)."""
    return trie(scratch_table(turn_paths(conversations), "paths"))
