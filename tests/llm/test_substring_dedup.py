from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import substring_dedup as s
from quillspark.llm.fm_index import FmIndex, WaveletMatrix, repeated_windows


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def brute(rows):
    words = [split(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {p for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for p in range(i, i + 35)}
        out.append((d, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


def test_backward_search_finds_repeated_windows():
    rng = np.random.default_rng(0)
    for _ in range(40):
        w, n = int(rng.integers(2, 9)), int(rng.integers(1, 30))
        lengths, base = rng.integers(1, 25, n), rng.integers(0, int(rng.integers(2, 30)), 60)
        texts = []
        for size in lengths:
            at = int(rng.integers(0, 60 - size))
            text = base[at : at + size].copy()
            if rng.random() < 0.6:
                text[rng.integers(0, size)] = rng.integers(0, 40)
            texts.append(text)
        places = rng.choice([1, 1, 1, 2, 3], n)
        masks = repeated_windows(FmIndex(np.concatenate(texts).astype(np.uint64), lengths, 64, places), np.arange(n), lengths, w)
        seen = Counter(tuple(t[i : i + w]) for t, k in zip(texts, places, strict=True) for i in range(len(t) - w + 1) for _ in range(k))
        assert masks.tolist() == [sum(1 << i for i in range(len(t) - w + 1) if seen[tuple(t[i : i + w])] > 1) for t in texts]


@pytest.mark.parametrize("symbols", [1, 2, 3, 40, 3000])
def test_compressed_ranks_equal_counts(symbols):
    rng = np.random.default_rng(symbols)
    sequence = np.minimum(rng.geometric(0.02, 5000) - 1, symbols - 1)
    sequence[:symbols] = np.arange(symbols)
    matrix = WaveletMatrix(sequence)
    asked, at = rng.integers(0, symbols, 800), rng.integers(0, 5001, 800)
    got = matrix.walk(asked, at) - matrix.walk(asked, np.zeros(800, np.int64))
    assert got.tolist() == [int((sequence[:a] == s).sum()) for s, a in zip(asked, at, strict=True)]
    counts = np.bincount(sequence)
    entropy = float(-(counts / 5000 * np.log2(counts / 5000)).sum())
    assert matrix.lengths[sequence].astype(int).sum() <= 5000 * max(1, entropy + 1)


def test_every_hit_is_found_by_the_index(spark, monkeypatch):
    monkeypatch.setattr(s, "_searched", lambda contents, deal, shard: contents.select("minimizer", "content", F.lit(0).cast("long").alias("mask")))
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, text), (2, text), (3, "x " + text)], "id long, text string").withColumn("print", F.lit(0).cast("long"))
    assert s.repeated_hits(df).count() == 0 and s.repeated_hits(df, crowd=0).count() == 0


def test_words_hash_alike_wherever_they_stand():
    texts = ["", "  ab é ab\n", None, "x" * 70000 + " ab", "é"]
    hashes, bounds = s.word_hashes(pa.array(texts))
    assert np.diff(bounds).tolist() == [len(split(t)) for t in texts]
    assert hashes[0] == hashes[2] == hashes[4] and hashes[1] == hashes[5] and len(set(hashes.tolist())) == 3


@pytest.mark.parametrize(("shard", "crowd"), [(16_384, 8_192), (8, 3)])
def test_removal_equals_brute_force(spark, shard, crowd):
    rng = random.Random(11)
    pool = [f"w{i}" for i in range(500)] + ["É", "a,b"]
    passages = [rng.choices(pool, k=k) for k in (35, 36, 50, 120, 34)]
    rows = []
    for i in range(70):
        w = rng.choices(pool, k=rng.randint(0, 200))
        for p in rng.sample(passages, rng.randint(0, 3)):
            p = p.copy()
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "edited"
            at = rng.randint(0, len(w))
            w = w[:at] + p + w[at:]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(80, "la " * 60), (81, None), (82, ""), (83, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (5, " ".join(passages[3]))]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, n_words double").repartition(5)
    got = [(r.doc_id, r.n_words, r.n_removed, r.text) for r in s.remove_repeats(df, shard=shard, crowd=crowd).collect()]
    assert sorted(got, key=str) == brute(rows)
    assert s.remove_repeats(df.limit(0)).count() == 0
