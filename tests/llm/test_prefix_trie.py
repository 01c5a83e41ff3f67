from __future__ import annotations

import random
from collections import defaultdict

import pytest

from quillspark.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(paths):
    members, kids, ends, chars = defaultdict(list), defaultdict(set), defaultdict(list), {}
    for conv, ids, n in paths:
        for d in range(len(ids) + 1):
            node = tuple(ids[:d])
            members[node].append(conv)
            chars[node] = n[d - 1] if d else 0
            if d:
                kids[node[:-1]].add(node)
        ends[tuple(ids)].append(conv)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in kids[node]) or 1
        saved[node] = (len(members[node]) - 1) * chars[node] + sum(saved[x] for x in kids[node])
    return sorted(((min(m), len(x), min(members[x[:-1]]) if x else -1, len(m), len(kids[x]), leaves[x], saved[x], tuple(sorted(ends[x]))) for x, m in members.items()))


def rows_of(nodes):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, tuple(r.ends)) for r in nodes.collect())


@pytest.mark.parametrize("shard_turns", [1, 4, 25, 1_000_000])
def test_trie_equals_plain_python_however_small_its_shards(spark, shard_turns):
    random.seed(shard_turns)
    paths = []
    for conv in range(200):
        ids = [random.choice([0, 0, 0, 1, 2]) for _ in range(random.choice([0, 1, 1, 2, 3, 5, 8]))]
        paths.append((conv, ids, [(x + 1) * 7 for x in ids]))
    random.shuffle(paths)
    table = spark.createDataFrame(paths, "conv_id long, ids array<long>, chars array<long>").repartition(3)
    assert rows_of(prefix_trie.trie(table, shard_turns)) == plain(paths)


def test_long_path_and_many_copies(spark):
    deep = [(c, list(range(3000)), [1] * 3000) for c in (0, 1)] + [(c, [1, 2], [5, 6]) for c in range(2, 900)] + [(900, [1, 2, 3], [5, 6, 7])]
    table = spark.createDataFrame(deep, "conv_id long, ids array<long>, chars array<long>")
    assert rows_of(prefix_trie.trie(table, 500)) == plain(deep)


def test_nulls_ties_repeats_and_clashes(spark):
    rows = [(1, 1, "user", "b", 0), (1, None, None, None, 0), (2, None, "", "", 0), (2, 1, "user", "b", 0), (2, 1, "user", "b", 0), (None, 1, "user", "x", 0)]
    got = rows_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA + ", depth int")))
    assert got == [(1, 0, -1, 2, 1, 1, 1, ()), (1, 1, 1, 2, 1, 1, 1, ()), (1, 2, 1, 2, 1, 1, 1, (1,)), (2, 3, 1, 1, 0, 1, 0, (2,))]


def test_empty_table(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_conversations_of_one_turn_number_order_by_hash_alike(spark):
    rows = [(c, 5, "user", t) for c, texts in ((1, "abc"), (2, "cab")) for t in texts]
    got = rows_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)))
    assert [r[3] for r in got] == [2, 2, 2, 2]
