"""What rows come from is made once, and a row costs its length, not its square."""

from __future__ import annotations

import random
import time
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillspark.functions import accuracy as acc
from quillspark.functions import text as tx
from quillspark.operators import characters as ch
from quillspark.operators import inference, statistics
from quillspark.operators import translation as mt
from quillspark.plans import catalogue
from quillspark.sources import derived as d
from tests.test_functions import levenshtein


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_cuts_at_line_starts_are_the_cuts_of_the_rule(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choices(["a", "bcd", "é.", "x y", "#"], k=n))
    texts = [words(n) + end for n in (0, 1, 39, 40, 41, 79, 80, 81, 82, 200) for end in ("", " ", "\n", "  \t")]
    texts += ["  " + words(90), words(45).replace(" ", "   "), words(41) + "\t" + words(41) + "\x0b" + words(100), "\n" + words(40) + " \n\n " + words(41)]
    texts += ["".join(rng.choices(["a", " ", " ", "b ", "\n", "\t"], weights=[9, 9, 9, 9, 0.1, 0.1], k=2000)) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = df.select("text", *(F.regexp_replace("text", r[1], "$1\n").alias(c) for c, r in (("rule", d.CUTS), ("fast", d.FAST_CUTS)))).collect()
    assert all(r.rule == r.fast for r in found) and any(r.rule != r.text for r in found)


def test_a_long_word_is_cut_in_linear_time(spark):
    began = time.time()
    df = spark.range(1).select(F.repeat(F.lit("ab"), F.lit(500_000)).alias("text"))
    assert df.select(F.length(F.regexp_replace("text", d.FAST_CUTS[1], "$1\n")).alias("n")).first().n == 1_000_000
    assert time.time() - began < 20


def test_distances_in_blocks(spark):
    rng = random.Random(4)

    def changed(s):
        s = list(s)
        for _ in range(rng.randrange(9)):
            i = rng.randrange(len(s) + 1)
            s[i : i + rng.randrange(2)] = rng.choices("abé", k=rng.randrange(2))
        return "".join(s)

    rows = [("".join(rng.choices("abcé ", k=rng.choice([0, 1, 3, 63, 64, 65, 128, 130]))), None) for _ in range(900)]
    rows = [(a, changed(a) if rng.random() < 0.8 else "".join(rng.choices("ab ", k=rng.randrange(80)))) for a, _ in rows]
    df = spark.createDataFrame([*rows, (None, "a b"), ("a b", None)], "r string, p string").coalesce(1)
    r, p = F.col("r"), F.col("p")
    got = df.select(acc.edit_distance(r, p).alias("c"), acc.char_errors(r, p).alias("e"), acc.word_counts(r, p).alias("w"), acc.wer(r, p).alias("wer"), acc.token_accuracy(r, p).alias("a")).collect()
    for (a, b), g in zip(rows, got, strict=False):
        assert g.c == levenshtein(a, b) and g.e == sum(x != y for x, y in zip(a, b, strict=False)) + abs(len(a) - len(b))
        x, y = a.split(), b.split()
        assert tuple(g.w) == (levenshtein(x, y), len(x), len(y), sum(u != v for u, v in zip(x, y, strict=False)))
    assert [(g.c, g.e, g.w.wrong, g.wer, g.a) for g in got[-2:]] == [(None, None, None, 1.0, None), (None, None, None, 1.0, None)]


def test_words_are_cut_at_any_white_space(spark):
    df = spark.createDataFrame([("a b c\u0085d　e f\x1cg​h i", "")], "r string, p string")
    assert df.select(acc.n_words(F.col("r"), F.col("p")).alias("n")).first().n == 7


def test_documents_are_read_once(spark, sf_dir):
    assert scans(catalogue.QUERIES["displayed"](spark, sf_dir)) == 1
    assert scans(catalogue.QUERIES["cache_hits_misses"](spark, sf_dir)) == 2
    assert scans(catalogue.QUERIES["mode_compare"](spark, sf_dir)) == 3


def test_rows_of_a_trend_and_of_a_histogram_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    rows = spark.range(100, numPartitions=2).selectExpr("'m' AS model", "cast(id AS double) AS x", "cast(3 * id * id + 2 * id + 1 AS double) AS y")
    rows = rows.mapInPandas(run, "model string, x double, y double")
    fit = statistics.quadratic_trend(rows, "x", "y", "model").first()
    assert (round(fit.a, 6), round(fit.b, 6), round(fit.c, 4), fit.n) == (3.0, 2.0, 1.0, 100) and made.value == 100
    assert sum(r.n for r in statistics.histogram(rows, "y").collect()) == 100 and made.value == 200


def test_modes_without_a_baseline_are_no_rows(spark):
    scores = spark.createDataFrame([("simple", 1.0, 2.0, 3.0, 4)], "mode string, bleu double, chrf double, ter double, total_samples long")
    splits = spark.createDataFrame([("simple", 1.25, 2)], "mode string, avg_segments double, samples_split long")
    assert mt.mode_table(scores, splits, "baseline").count() == 0


def test_hits_keep_their_translation_and_misses_get_one(spark):
    rows = spark.createDataFrame(pd.DataFrame({"text": ["abc", "abc", "zed", "old", "none"]}))
    memory = spark.createDataFrame([("old", "kept"), ("none", None)], "text string, translation string")
    got = {tuple(r) for r in inference.with_cache(rows, memory, "reverse").collect()}
    assert got == {("abc", "cba", False), ("zed", "[Translation failed: no translation]", False), ("old", "kept", True), ("none", None, True)}


def test_grams_taken_out_in_pairs_are_counted_once():
    rng = random.Random(6)
    for kinds in (2, 5, 60, 10**7):
        rows = []
        for _ in range(60):
            h = [rng.randrange(kinds) for _ in range(rng.randrange(12))]
            r = list(h)
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(r) + 1)
                r[i : i + rng.randrange(2)] = [rng.randrange(kinds)] * rng.randrange(2)
            rows.append((h, r))
        sides = [(np.array([u for row in rows for u in row[k]], np.int64), np.array([len(row[k]) for row in rows])) for k in (0, 1)]
        for (h, r), got in zip(rows, mt.clipped_counts(*sides, 6), strict=True):
            for n in range(6):
                a, b = (Counter(tuple(x[i : i + n + 1]) for i in range(len(x) - n)) for x in (h, r))
                assert got[3 * n : 3 * n + 3].tolist() == [sum((a & b).values()), sum(a.values()), sum(b.values())]


def test_grams_alike_place_by_place_are_not_sorted(monkeypatch):
    sorted_ = []
    unique = np.unique
    monkeypatch.setattr(mt.np, "unique", lambda x, **k: sorted_.append(len(x)) or unique(x, **k))
    h = np.arange(4000) % 50
    r = np.delete(h, 2000)
    mt.clipped_counts((h, np.array([4000])), (r, np.array([3999])), 6)
    assert sum(sorted_) < 100


def test_counted_pairs_are_not_put_in_order(spark, monkeypatch):
    """Letters are numbered by a table, and pairs that are only counted are not sorted."""
    rng = random.Random(8)
    rows = [("".join(rng.choices("abcdé h", k=120)), "") for _ in range(60)]
    sides = [ch._codes([a for a, _ in rows]), ch._codes([a.replace("h", "").replace("é", "e") for a, _ in rows])]
    whole = ch.align_codes(*sides[0], *sides[1])
    sorted_ = []
    for name in ("unique", "argsort"):
        own = getattr(np, name)
        monkeypatch.setattr(ch.np, name, lambda x, *a, own=own, **k: sorted_.append(len(x)) or own(x, *a, **k))
    counted = ch.align_codes(*sides[0], *sides[1], in_order=False)
    assert Counter(zip(*(whole[i].tolist() for i in (0, 2, 3)), strict=True)) == Counter(zip(*(counted[i].tolist() for i in (0, 2, 3)), strict=True))
    assert max(sorted_, default=0) <= len(rows)


def test_rows_of_modes_and_of_the_best_are_made_once(spark, sf_dir):
    assert scans(catalogue.QUERIES["mode_rows"](spark, sf_dir)) == 1
    assert scans(catalogue.QUERIES["best_worst"](spark, sf_dir)) == 1
    rows = spark.createDataFrame([(1, 2.0), (2, 5.0), (3, 5.0), (5, 1.0), (4, 1.0)], "id long, v double")
    assert [tuple(r) for r in statistics.best_and_worst(rows, "v", "id").collect()] == [("best", 2, 5.0), ("worst", 4, 1.0)]


def _units(texts):
    return np.array([ord(c) for t in texts for c in t], np.uint32), np.array([len(t) for t in texts], np.int64)


def test_letters_left_out_or_replaced_need_no_table(monkeypatch):
    rng = random.Random(9)
    whole = ["".join(rng.choices("abcdéh ", k=rng.randrange(20, 90))) for _ in range(300)]
    noisy = [t.replace("h", "").replace("é", "e") for t in whole]
    pairs = [(a, b) for a, b in zip(whole, noisy, strict=True) if "h" in a]
    monkeypatch.setattr(acc, "_block", None)
    monkeypatch.setattr(acc, "distance", None)
    for sides in (pairs, [(b, a) for a, b in pairs]):
        found = acc.distances(*_units([a for a, _ in sides]), *_units([b for _, b in sides]))
        assert found.tolist() == [max(a.count("h") + a.count("é"), b.count("h") + b.count("é")) for a, b in sides]


def test_distances_of_letters_left_out_are_the_least(monkeypatch):
    rng = random.Random(10)
    pairs = []
    for _ in range(1500):
        a = "".join(rng.choices("abcdeh", k=rng.randrange(14)))
        b = rng.choice([a.replace("h", ""), a.replace("h", "").replace("e", rng.choice("xabc")), a.replace("h", "").replace("c", ""), "".join(rng.choices("abch", k=5))])
        pairs.append(rng.choice([(a, b), (b, a)]))
    for entries in (1 << 21, 40):  # many rows at once, and few
        monkeypatch.setattr(acc, "ENTRIES", entries)
        found = acc.distances(*_units([a for a, _ in pairs]), *_units([b for _, b in pairs]))
        assert found.tolist() == [levenshtein(a, b) for a, b in pairs]


def test_equal_texts_do_not_go_to_python_nor_do_other_letters_get_cleaned(spark):
    rows = [("a b", "a b"), ("", ""), (" ", " "), (None, None), ("A, b!", "a  b"), ("Km", "km"), ("km", "KM."), ("İ", "i̇"), ("abc", "abd"), ("ab", "ba"), ("a1", "a2"), ("é", "É"), ("é", "e"), ("a", None), (None, "a")]
    df = spark.createDataFrame(rows, "r string, p string").coalesce(1)
    r, p = F.col("r"), F.col("p")
    assert [tuple(x) for x in df.select(*acc.unlike(r, p)).collect()[:4]] == [(None, None)] * 4
    got = df.select(acc.normalized(r, p).alias("n"), F.when(r == p, 1).otherwise((tx.clean_text(r) == tx.clean_text(p)).cast("int")).alias("plain"), acc.same_letters(r, p).alias("same"), acc.wer(r, p).alias("w"), acc.token_accuracy(r, p).alias("a"), acc.edit_distance(r, p).alias("c")).collect()
    assert [g.n for g in got] == [g.plain for g in got] and [g.same for g in got[4:13]] == [True, True, True, True, False, True, False, True, False]
    assert [(g.w, g.a, g.c) for g in got[:4]] == [(0.0, 1.0, 0), (0.0, None, 0), (0.0, None, 0), (0.0, None, None)]


def test_what_arrives_in_a_stream_is_made_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def run(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    kinds = "model string, id long, source string, reference string, prediction string"
    rows = spark.range(90, numPartitions=2).selectExpr("'m' AS model", "id", "'hf' AS source", "'a b' AS reference", "if(id < 45, 'a b', 'a c') AS prediction")
    monkeypatch.setattr(d, "predictions", lambda *_: rows.mapInPandas(run, kinds))
    got = {r.source: (r.n, r.cer, r.wer, r.exact) for r in catalogue.QUERIES["stream_scores"](spark, "").collect()}
    assert got == dict.fromkeys(("hf", "all"), (90, 0.166667, 0.25, 0.5)) and made.value == 90
