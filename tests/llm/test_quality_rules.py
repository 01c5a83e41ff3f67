from __future__ import annotations

import re

from quillspark.llm import quality_rules as q

TEXTS = [None, "", "one two", "a b c d e f g h i j k l", "a b c d e " * 6, "x\ny\nx\n\n \n x", "word*** other$$$ " * 5, "été \x0b naïve #|", "a b c d e f a b c d e g " + " ".join(f"w{i}" for i in range(60)), "z" * 300 + " " + "q " * 9]


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(hit)


def test_ledger_equals_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS * 2)], "doc_id int, text string, n_words string, failure_bits int")
    got = {r.doc_id: r for r in q.apply_policy(q.ledger(df), "base").collect()}
    assert len(got) == 2 * len(TEXTS)
    for i, t in enumerate(TEXTS * 2):
        r, want = got[i], brute(t)
        assert tuple(r[m] for m in q.MEASURES) == want
        assert r.kept == (want[0] >= 10 and 100 * want[5] <= 20 * want[0])
    assert q.ledger(df.limit(0)).count() == 0


def test_ablations_from_bits_alone(spark):
    bits = [0, 0, 1, 2, 3, 4, 8, 12]
    df = spark.createDataFrame([(b,) for b in bits], "failure_bits long")
    got = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in q.ablations(df, "v1").collect()}
    assert got == {"few_words": (2, 1, 3), "repeated_words": (2, 1, 3), "many_symbols": (2, 1, 3), "long_words": (2, 1, 3)}
