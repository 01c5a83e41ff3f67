from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import xxhash

from quillspark.llm import simhash_golay as g


def brute_print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(prints))]


def test_golay_words_and_their_nearby_codewords():
    near = g.nearby_codewords(np.arange(1 << 14))
    assert (near[:, 0] >= 0).all()
    assert set(Counter(zip((near[:, 1:6] >= 0).sum(axis=1).tolist(), (near[:, 6:] >= 0).sum(axis=1).tolist()))) == {(0, 0), (0, 21), (5, 16)}


def test_every_pair_within_four_bits_shares_a_key():
    rng = random.Random(2)
    for _ in range(1500):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        keys = [set(g.keys_of(np.array([x], np.uint64))[1].tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "Ab", "été"]
    texts = [None, "", " \n", "One two", "one TWO"]
    for _ in range(25):
        words = rng.choices(vocabulary, k=rng.randint(30, 200))
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            words = words.copy()
            words[rng.randrange(len(words))] = "edit"
            texts.append("\t".join(words))
    ids = list(range(len(texts), 0, -1))
    df = spark.createDataFrame(list(zip(ids, texts, ids, strict=True)), "doc_id long, text string, component_id long").repartition(3)
    got = {r.doc_id: (r.print & (1 << 64) - 1, r.component_id) for r in g.components(df).collect()}
    prints = [brute_print(t) for t in texts]
    assert [got[d][0] for d in ids] == prints
    assert [got[d][1] for d in ids] == brute_components(prints, ids)
    assert g.components(df.limit(0)).count() == 0


def test_large_block_of_alike_prints_gives_a_forest(spark):
    rng = random.Random(6)
    prints = sorted({sum(1 << b for b in rng.sample(range(14), rng.randint(0, 5))) for _ in range(1500)})
    df = spark.createDataFrame([(p,) for p in prints], "print long")
    for block in (64, 4096):
        links = g.near_links(df, block=block).collect()
        assert all(0 < (r.a ^ r.b).bit_count() <= 4 for r in links)
        roots = g.connected_components(g.near_links(df, block=block)).collect()
        assert len(roots) == len(prints) and {r.root for r in roots} == {min(prints)}


def test_chain_of_links_is_one_component(spark):
    links = spark.range(200).selectExpr("id * 37 % 201 as a", "(id + 1) * 37 % 201 as b")
    roots = g.connected_components(links).collect()
    assert {r.root for r in roots} == {0} and len(roots) == 201
