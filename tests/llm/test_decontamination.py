from __future__ import annotations

import math
import random
import re

import pytest

from quillspark.llm import decontamination as d


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def brute(docs, items):
    out = []
    for i, t in docs:
        w = words(t)
        for j, u in items:
            v = words(u)
            k = min(5, len(v))
            if k:
                want = {tuple(v[a : a + k]) for a in range(len(v) - k + 1)}
                n = len(want & {tuple(w[a : a + k]) for a in range(len(w) - k + 1)})
                if n >= max(1, math.ceil(0.8 * len(want) - 1e-9)):
                    out.append((i, j, n, len(want)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_pairs_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(d, "BROADCAST_BYTES", limit)
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(400)] + ["É", "naïve"]
    items = [(i, " ".join(rng.choices(pool, k=rng.choice([3, 6, 20, 60])))) for i in range(30)] + [(90, None), (91, ""), (92, "one"), (93, "a a a a a a a a")]
    docs = [(None, items[2][1].upper())]
    for i in range(60):
        body = rng.choices(pool, k=rng.randint(0, 300))
        leak = rng.choice(items)[1] or "one"
        leak = leak.split()
        if rng.random() < 0.5:
            leak[rng.randrange(len(leak))] = "edited"
        at = rng.randint(0, len(body))
        docs.append((i, ", ".join(body[:at] + leak + body[at:])))
    docs += [(70, None), (71, ""), (72, "a " * 9), (1, docs[2][1])]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n int").repartition(3)
    its = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in d.contained_items(df, its).collect()]
    assert sorted(got, key=str) == brute(docs, items) and len(got) > 20
    bad = {g[0] for g in got}
    assert sorted((r.doc_id for r in d.remove_contaminated(df, its).collect()), key=str) == sorted((i for i, _ in docs if i not in bad), key=str)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    its = df.withColumnRenamed("doc_id", "item_id")
    assert d.contained_items(df, its).count() == 1
    assert d.contained_items(df.limit(0), its).count() == 0
    assert d.contained_items(df, its.limit(0)).count() == 0
    assert d.remove_contaminated(df, its.limit(0)).count() == 1
