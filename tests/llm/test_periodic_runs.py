from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from quillspark.llm import periodic_runs
from quillspark.llm.queries import op12_periodic_runs

SPACES = re.compile(r"[^ \t-\r]+")


def plain(words, least=periodic_runs.LEAST):
    """Every run, by comparing all words p apart for every p."""
    x, found = np.asarray(words), {}
    for p in range(1, len(x) // 2 + 1):
        same = np.concatenate([[False], x[:-p] == x[p:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b + p - a >= max(least, 2 * p):
                found.setdefault((a, b + p), p)
    return sorted((a, b - a, p) for (a, b), p in found.items())


def numbers(words):
    seen = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def test_all_short_sequences():
    for n in range(12):
        for x in itertools.product([0, 1], repeat=n):
            assert periodic_runs.runs(np.array(x, np.int64), 2) == plain(x, 2)
    for x in itertools.product([0, 1, 2], repeat=8):
        assert periodic_runs.runs(np.array(x, np.int64), 2) == plain(x, 2)


def test_nested_repetitions():
    random.seed(5)

    def made(depth):
        if not depth:
            return [random.randrange(3) for _ in range(random.randint(1, 7))]
        s = made(depth - 1)
        return s * random.randint(1, 3) + s[: random.randint(0, len(s))] if random.random() < 0.6 else s + made(depth - 1)

    for _ in range(400):
        x = made(random.randint(1, 5))[:400]
        assert periodic_runs.runs(np.array(x), 2) == plain(x, 2)


def test_long_periodic_texts_end():
    x = np.zeros(200_000, np.int64)
    assert periodic_runs.runs(x) == [(0, len(x), 1)]
    assert periodic_runs.runs(np.arange(200_000) % 70_000) == [(0, 200_000, 70_000)]


@pytest.fixture(scope="module")
def edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b\x0b" * 6, "x"), (3, "a b\x0b" * 6, "x"), (4, "a " * 11, "x"), (5, "\t" + "ä " * 12, None), (None, "q " * 30, "x"), (6, "x y z " * 40_000 + "end", "x")]
    found = periodic_runs.find_runs(spark.createDataFrame(rows, "doc_id long, text string, runs string")).collect()
    return sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found), key=str)


def test_edge_cases(edge_cases):
    assert edge_cases == sorted(
        [(1, 0, [], ""), (2, 0, [], ""), (3, 12, [(0, 12, 2)], "a b"), (3, 12, [(0, 12, 2)], "a b"), (4, 11, [], " ".join("a" * 11)), (5, 12, [(0, 12, 1)], "ä"), (None, 30, [(0, 30, 1)], "q"), (6, 120_001, [(0, 120_000, 3)], "x y z end")],
        key=str,
    )


def test_empty_table(spark):
    assert periodic_runs.find_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def expected(doc_id, text):
    words = SPACES.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain(numbers(words))
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *top, top[1] and 1000 * top[1] // top[2], sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_plain_python(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = op12_periodic_runs(spark, sf_dir)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {k for _, k in got.dtypes} == {"bigint", "string"}
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected(r.doc_id, r.text) for r in rows)
