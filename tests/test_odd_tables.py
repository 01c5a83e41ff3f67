"""Queries against their SQL on small tables of odd rows."""

from __future__ import annotations

import contextlib
import json
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillspark.functions import segmentation as seg
from quillspark.functions import text as tx
from quillspark.operators import characters as ch
from quillspark.operators import translation as mt
from quillspark.plans.catalogue import ORACLE_SQL, QUERIES
from quillspark.sources import readers, writers
from quillspark.streaming import scores
from tests import compare


def test_lines_that_begin_twice_by_themselves(spark, tmp_path, monkeypatch):
    twice = "abcdefghijkl abcdefghijkl who is here"
    texts = [(2, twice), (3, f"x y.\n{twice}"), (4, "One.\x0bTwo of them. Three of them"), (-5, f"a b.\nsome words here\n{twice}"), (None, "some words here"), (6, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(compare, "TABLES", ["documents"])
    assert compare.difference(spark, str(tmp_path), QUERIES["first_sentences"], ORACLE_SQL["first_sentences"]) == ""


def _alignments_with_and_without_tables(monkeypatch, rows):
    """Pairs of the rows, how many rows ``_taken_out`` knew, and the pairs where it knows none."""
    codes, known, found = [ch._codes(list(x)) for x in zip(*rows, strict=True)], [0], ch._taken_out

    def counted(*a):
        out = found(*a)
        known[0] += int(out[0].sum())
        return out

    monkeypatch.setattr(ch, "_taken_out", counted)
    got = ch.align_codes(*codes[0], *codes[1])
    monkeypatch.setattr(ch, "_taken_out", lambda x, row, y, of, diff, many: (np.zeros(len(diff), bool), np.zeros(len(x), bool)))
    return got, known[0], ch.align_codes(*codes[0], *codes[1])


def test_rows_without_some_letters_are_aligned_like_a_table(monkeypatch):
    rng = random.Random(5)
    rows = []
    for k in range(1500):
        text = "".join(rng.choices(("abhé", "ahéö", "hé", "abcdehéü")[k % 4], k=rng.choice([1, 3, 8, 30])))
        other = text.replace("h", "") if k % 7 else text
        other = other.replace("é", rng.choice("ea")).replace("ö", "e") if k % 3 else other
        rows.append((text, other) if k % 2 else (other, text))
    got, known, plain = _alignments_with_and_without_tables(monkeypatch, rows)
    assert all(np.array_equal(x, y) for x, y in zip(got, plain, strict=True)) and known > 500


def test_texts_are_aligned_where_they_lie(spark):
    rows = spark.createDataFrame([("m", 1, "thé aha", "te aa"), ("m", 2, None, "x"), ("n", 3, "", "")], "model string, id long, reference string, prediction string")
    found = ch.certificate(rows, "model", "id")
    assert [tuple(r) for r in found.orderBy("id").collect()] == [("m", 1, "thé aha", "te aa", 3), ("m", 2, "", "x", 1), ("n", 3, "", "", 0)]
    ch.register_count_function(spark)
    rows.createOrReplaceTempView("rows_to_count")
    counts = spark.sql("SELECT * FROM count_aligned(TABLE(SELECT model, reference, prediction FROM rows_to_count))")
    assert sorted(map(tuple, counts.groupBy("model", "ref_char", "pred_char").sum("n").collect())) == sorted(map(tuple, ch.count_confusions(rows, "model").collect()))
    for df in (found, ch.alignments(rows, "model", "id"), counts):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_prediction_files_are_packed_and_not_sorted(spark, tmp_path):
    rows = spark.createDataFrame([("m", "1", "p", "r"), ("n", "2", None, "é"), ("m", "3", "p", None)], "model string, id string, prediction string, reference string")
    writers.write_predictions(rows, f"{tmp_path}/cache")
    assert {x.parent.name for x in tmp_path.glob("cache/*/part-*.json.gz")} == {"model=m", "model=n"} and not [*tmp_path.glob("cache/*/*.json")]
    got = [tuple(r) for m in "mn" for r in readers.predictions(spark, f"{tmp_path}/cache/model={m}").select(F.lit(m), "id", "prediction", "reference").collect()]
    assert sorted(got, key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    with writers.open_folders(spark):
        assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == str(writers.OPEN_FILES)


def test_no_text_meets_its_repeats(spark, tmp_path):
    row = {"model": "m", "id": "1", "source": "hf", "reference": "a b", "prediction": "a c", "at": "2024-01-01T00:00:00Z"}
    (tmp_path / "a.json").write_text(json.dumps(row))
    found = scores.scored_arrivals(spark.read.schema(scores.ARRIVAL).json(str(tmp_path)))
    assert set(found.columns) == {"model", "id", "source", "at", "cer", "wer", "exact", "normalized"} and found.first().wer == 0.5


def test_grams_of_rows_without_some_letters_are_not_sorted(monkeypatch):
    rng, unique, longest = random.Random(7), np.unique, [0]
    monkeypatch.setattr(mt.np, "unique", lambda x, **k: longest.append(len(x)) or unique(x, **k))
    whole = ["".join(rng.choices("abcdefg h", k=200)) for _ in range(40)]
    h, r = (ch._codes([t.replace("h", "") for t in whole]), ch._codes(whole))
    got = mt.clipped_counts(h, r, 6)
    assert max(longest) <= sum(t.count("h") for t in whole)
    for t, found in zip(whole, got.tolist(), strict=True):
        a, b = (Counter(x[i : i + 4] for i in range(len(x) - 3)) for x in (t.replace("h", ""), t))
        assert found[9:12] == [sum((a & b).values()), a.total(), b.total()]


def test_alike_sides_send_no_units(spark):
    pairs = spark.createDataFrame([(1, "a b c d e", "a b c d e"), (2, "a b", "a c"), (3, None, "")], "id long, hypothesis string, reference string")
    sent = mt._unlike_sides(pairs, "id", tokens=(tx.tokens, F.size)).orderBy("id").collect()
    assert [tuple(r)[1:] for r in sent] == [(None, None, 5), (["a", "b"], ["a", "c"], None), (None, None, 0)]
    got = [tuple(r) for r in mt.bleu_stats(pairs).orderBy("id").collect()]
    assert got == [(1, *(x for n in (5, 4, 3, 2) for x in (n, n, n)), 5, 5), (2, 1, 2, 2, 0, 1, 1, *[0] * 6, 2, 2), (3, *[0] * 14)]


def test_weights_are_made_once_a_key_and_intervals_once(spark, sf_dir, monkeypatch):
    made, weights = [], mt._weights
    monkeypatch.setattr(mt, "_weights", lambda seeds, jumps: made.append(len(seeds)) or weights(seeds, jumps))
    stats = spark.createDataFrame([(i, m, 1) for i in range(20) for m in "abc"], "id long, mode string, x long").coalesce(1)
    monkeypatch.setattr(type(stats), "mapInArrow", lambda df, run, kinds: [*run(iter(df.toArrow().to_batches()))])
    with contextlib.suppress(AttributeError):  # a list has no groups
        mt.resamples(stats, "id", 30, "mode")
    assert sum(made) == 20
    monkeypatch.undo()
    plan = QUERIES["mode_significance"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_lines_without_a_conjunction_are_one_segment(spark):
    df = spark.createDataFrame([("a and b or c",), ("and",), ("plain",), (" ",), ("x and ",), (None,)], "text string")
    cuts = seg.all_cuts(seg.spans(F.col("text"), ["and", "or"]))
    got = df.select(seg.n_segments(F.col("text"), cuts).alias("n"), F.size(seg.segments(F.col("text"), cuts)).alias("all")).collect()
    assert [r.n for r in got] == [3, 1, 1, 1, 2, None] == [r.all if r.all != -1 else None for r in got]
