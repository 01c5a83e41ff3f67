"""Operators held against plain Python, with plans and times that have to scale."""

from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import segmentation as seg
from quillspark.operators import characters as ch
from quillspark.operators import inference
from quillspark.operators import translation as mt
from quillspark.sources import lines, readers, writers


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# -- frames ---------------------------------------------------------------------------------------


def _collapsed(labels, blank=0):
    out, before = [], None
    for x in labels:
        x = blank if x is None else x
        if x != before and x != blank:
            out.append(x)
        before = x
    return out


def test_frames_collapse_alike_in_segments_of_any_length(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for sample in (None, 1, 2, 3):
        best = [rng.choice([0, 0, 1, 1, 2]) for _ in range(200)]
        steps = sorted(rng.sample(range(-50, 1000), 200))
        rows += [(sample, t, c, 1.0 if c == b else rng.random() * 0.9) for t, b in zip(steps, best, strict=True) for c in range(3)]
        want[sample] = _collapsed(best)
    rng.shuffle(rows)
    frames = spark.createDataFrame(rows, "sample int, t long, class int, score double")
    for steps in (1, 3, 64, 4096):
        assert {r.sample: list(r.labels) for r in ch.frame_collapse(frames, "sample", "t", "class", "score", steps=steps).collect()} == want
    assert ch.collapse_segments(ch.best_classes(frames, "sample", "t", "class", "score"), "sample", "t", "class", 0, 64).count() > 40


def test_frame_ties_nulls_and_no_frames(spark):
    rows = [(1, 0, 2, 0.5), (1, 0, 1, 0.5), (1, 1, 0, None), (1, 1, 3, 0.1), (1, 2, 3, 0.9), (1, 3, None, None), (1, 4, 3, 1.0)]
    frames = spark.createDataFrame(rows, "sample int, t int, class int, score double")
    (r,) = ch.frame_collapse(frames, "sample", "t", "class", "score").collect()
    assert r.labels == [1, 3, 3]
    assert ch.frame_collapse(frames.limit(0), "sample", "t", "class", "score").count() == 0


# -- resamples ------------------------------------------------------------------------------------


def _weights(key, n):
    x = int(hashlib.md5(str(key).encode()).hexdigest()[:15], 16) % (mt.MODULUS - 1) + 1
    out = []
    for _ in range(n):
        x = x * mt.MULTIPLIER % mt.MODULUS
        out.append(sum(x * 1000 // mt.MODULUS >= p for p in mt.POISSON))
    return out


def test_resamples_equal_a_loop(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(50), rng.randrange(9)) for i in range(3000)]
    got = {(r.mode, r.resample): (r.x, r.y) for r in mt.resamples(spark.createDataFrame(rows, "id long, mode string, x long, y int"), "id", 40, "mode").collect()}
    want = {}
    for i, mode, x, y in rows:
        for b, w in enumerate(_weights(i, 40)):
            s = want.setdefault((mode, b), [0, 0])
            s[0] += w * x
            s[1] += w * y
    assert got == {k: tuple(v) for k, v in want.items()}
    assert 0.95 < sum(sum(_weights(i, 1000)) for i in range(200)) / 200_000 < 1.0


def test_what_resamples_shuffle_does_not_grow_with_the_rows(spark):
    def sent(n):
        stats = spark.range(n).select("id", F.lit(1).cast("long").alias("x")).repartition(4)
        plan = mt.resamples(stats, "id", 30)
        plan.collect()
        return stats.rdd.getNumPartitions(), plan.agg(F.sum("x")).first()[0]

    (parts, few), (_, many) = sent(400), sent(40_000)
    assert parts == 4 and many > 90 * few
    # a task sends one row for each resample
    stats = spark.range(40_000).select("id", F.lit(1).cast("long").alias("x")).repartition(4)
    assert "Generate" not in plan_of(mt.resamples(stats, "id", 30)) and plan_of(mt.resamples(stats, "id", 30)).count("MapInArrow") == 1


# -- splits ---------------------------------------------------------------------------------------


def _split(text, places, shortest, longest=None):
    start, cuts = 0, []
    for p in places:
        if longest is not None:
            cut = len(text) > longest and p - start >= longest and len(text[start:p].strip(seg.WHITE)) >= shortest
        else:
            cut = len(text[start:p].strip(seg.WHITE)) >= shortest and len(text[p:].strip(seg.WHITE)) >= shortest
        if cut:
            cuts.append(p)
            start = p
    return cuts


@pytest.fixture(scope="module")
def split_rows(spark):
    rng = random.Random(6)
    texts = [None, "", "and", " and or ", *("".join(rng.choices(["and ", "or ", "öl ", "  ", " ", "word ", "İ", "\U0001f600"], k=rng.choice([3, 30, 90]))) for _ in range(150))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").repartition(3)
    t = F.col("t")
    found = seg.spans(t, ["and", "or"])
    out = df.select("id", "t", found.alias("s")).select("*", seg.greedy_cuts(t, F.col("s"), 5, 20).alias("g"), seg.aggressive_cuts(t, F.col("s"), 5).alias("a"))
    return out.select("*", seg.segments(t, F.col("a")).alias("parts"), seg.profile(t, F.col("s")).alias("p")).collect()


def test_splits_equal_plain_python(split_rows):
    assert len(split_rows) == 154
    for r in split_rows:
        if r.t is None:
            assert r.s is None and r.g is None and r.a is None and r.parts is None
            continue
        places = [s.pos for s in r.s]
        assert r.g == _split(r.t, places, 5, 20) and r.a == _split(r.t, places, 5)
        bounds = [0, *r.a, len(r.t)]
        parts = [p for p in (r.t[x:y].strip(seg.WHITE) for x, y in zip(bounds, bounds[1:], strict=False)) if p]
        assert r.parts == (parts if len(parts) > 1 else [r.t.strip(seg.WHITE)])
        assert r.p.total == len(places) == sum(r.p.counts.values()) and r.p.positions == places
        if "İ" not in r.t:
            assert all(r.t[s.pos : s.end].lower() == s.conj for s in r.s)


def test_splitting_a_line_costs_its_length(spark):
    def took(n):
        line = "some words here and more of them or less " * n
        df = spark.createDataFrame([(line,)], "t string")
        cuts = seg.aggressive_cuts(F.col("t"), F.col("s"))
        began = time.time()
        (r,) = df.select("t", seg.spans(F.col("t"), ["and", "or"]).alias("s")).select(F.size(cuts).alias("n"), F.size(seg.segments(F.col("t"), cuts)).alias("p")).collect()
        return time.time() - began, r.n

    took(10)
    (quarter, _), (whole, n) = took(6_000), took(24_000)  # 1 MB
    assert n > 20_000 and whole < 8 * max(quarter, 0.5)


# -- lines of files -------------------------------------------------------------------------------


def test_lines_of_a_file_in_small_splits(spark, tmp_path):
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcé \r", k=rng.choice([0, 3, 60, 5000]))) for _ in range(700)]
    (tmp_path / "a.txt").write_bytes(("\n".join(texts) + "\n").encode())
    (tmp_path / "b.txt").write_bytes("x\n\ny".encode())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        counts = lines.split_counts(spark, f"{tmp_path}/a.txt").cache()
        assert counts.count() > 50
        found = sorted((r.path[-5:], r.line_no, r.line) for r in lines.numbered_lines(spark, str(tmp_path)).collect())
        assert found == [("a.txt", i, t) for i, t in enumerate(texts)] + [("b.txt", 0, "x"), ("b.txt", 1, ""), ("b.txt", 2, "y")]
        for start, count in ((0, 1), (137, 60), (695, 50), (900, 5)):
            some = lines.get_lines(spark, f"{tmp_path}/a.txt", start, count, counts)
            assert sorted((r.line_no, r.line) for r in some.collect()) == list(enumerate(texts))[start : start + count]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


# -- similarity to labels -------------------------------------------------------------------------


def test_softmax_over_label_blocks_of_any_size(spark):
    rng = np.random.default_rng(5)
    vectors, names = rng.normal(size=(70, 8)), rng.normal(size=(9, 8))
    vectors[3] = 0
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(3)
    labels = spark.createDataFrame([(f"l{i}", v.tolist()) for i, v in enumerate(names)], "label string, label_vec array<float>")
    one = lambda x: x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1)
    s = 20 * one(vectors.astype(np.float32).astype(float)) @ one(names.astype(np.float32).astype(float)).T
    want = np.exp(s) / np.exp(s).sum(axis=1, keepdims=True)
    for label_block, item_block in ((1, 7), (3, 1024), (64, 1)):
        got = ch.zero_shot(items, labels, 20.0, label_block, item_block).collect()
        assert len(got) == want.size
        assert max(abs(want[r.vec_id, int(r.label[1:])] - r.probability) for r in got) < 1e-9
    assert ch.zero_shot(items.limit(0), labels).count() == 0


# -- plug-ins -------------------------------------------------------------------------------------


def test_a_failing_list_is_halved_until_the_bad_texts_stand_alone():
    calls = []

    def model(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise ValueError("no")
        return [t.upper() for t in texts]

    texts = [f"t{i}" for i in range(200)] + ["bad"] + [f"u{i}" for i in range(300)]
    found = inference.call_in_lists(model, texts)
    assert [x for x, _ in found] == [t.upper() if t != "bad" else "" for t in texts] and [e for _, e in found if e] == ["no"]
    assert max(calls) == inference.CALL_TEXTS and len(calls) <= 2 + 2 * 9
    assert inference.call_in_lists(model, []) == [] and inference.call(lambda texts: [], ["a"])[0][1] == "0 results for 1 texts"
    assert [len(x) for x, _ in inference.call_in_lists(lambda t: t, ["x" * 100_000, "y", "z" * 70_000])] == [100_000, 1, 70_000]


def test_lists_give_what_single_texts_give_with_few_calls(spark):
    rows = spark.createDataFrame([(f"{'z' if i % 50 == 0 else 'a'}{i}",) for i in range(1000)], "text string").coalesce(1)
    counter = spark.sparkContext.accumulator(0)

    def counting():
        inner = inference.REGISTRY["reverse"]()

        def model(texts):
            counter.add(1)
            return inner(texts)

        return model

    inference.REGISTRY["counting"] = counting
    inference.REGISTRY["single"] = inference.one_by_one(lambda: lambda t: inference.REGISTRY["reverse"]()([t])[0])
    assert sorted(inference.batch_infer(rows, "counting").collect(), key=str) == sorted(inference.batch_infer(rows, "single").collect(), key=str)
    assert counter.value < 400  # 1000 texts, 20 of them bad


def test_splits_are_predicted_where_they_lie(spark):
    rows = spark.createDataFrame([(1, "ab cd", ["ab", " cd "]), (2, "whole", ["whole"]), (3, "x", None), (4, "p " * 50 + "q", ["p " * 50, " ", "q"])], "id int, reference string, segments array<string>")
    found = inference.predict_split(rows, "first60")
    assert {r.id: (r.prediction, r.split_prediction) for r in found.collect()} == {1: ("ab cd", "ab cd"), 2: ("whole", "whole"), 3: ("x", "x"), 4: (("p " * 50)[:60], ("p " * 50)[:60].strip() + " q")}
    assert "Exchange" not in plan_of(found) and "Join" not in plan_of(found)


# -- translation memory ---------------------------------------------------------------------------


def test_memory_of_runs(spark, tmp_path, monkeypatch):
    from quillspark.operators import memory as mem

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    memory = mem.Memory(spark, "held", str(tmp_path / "held"), 4)
    rows = lambda *x: spark.createDataFrame([(t, r, s) for t, r, s in x], "text string, translation string, s long").withColumn("at", F.timestamp_seconds("s"))
    try:
        memory.append(rows(("a", "A1", 1), ("a", "A0", 0), ("b", "B1", 1), ("z", "[Translation failed: x]", 1), (None, "N", 1)))
        memory.append(rows(("a", "A2", 2), ("c", "C2", 2)))
        memory.append(rows(("b", "B0", 0), ("d", None, 3)))
        texts = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",), ("q",), (None,)], "text string")
        want = {"a": "A2", "b": "B1", "c": "C2", "d": None, "q": None}
        found = memory.lookup(texts)
        assert {r.text: r.translation for r in found.collect()} == want and found.count() == 5
        # only the texts are dealt out: no exchange stands over a scan of the memory
        plan = plan_of(memory.lookup(texts))
        assert plan.count("Exchange") == 1 and plan.count("SortMergeJoin") == 3 and "BroadcastHashJoin" not in plan
        assert plan_of(memory.rows()).count("Exchange") == 1
        assert {(r.text, r.translation, r.hit) for r in memory.translate(texts, "reverse").collect()} == {("a", "A2", True), ("b", "B1", True), ("c", "C2", True), ("d", None, True), ("q", "q", False)}
        memory.compact()
        assert len(memory.runs()) == 1 and {r.text: r.translation for r in memory.lookup(texts).collect()} == want
        monkeypatch.setattr(mem, "MOST_RUNS", 2)
        for k in range(4):
            memory.append(rows(("a", f"N{k}", 10 + k)))
        assert len(memory.runs()) <= 3 and memory.lookup(texts).where("text = 'a'").first().translation == "N3"
        assert memory.rows().count() == 4
    finally:
        memory.forget()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert memory.runs() == []


# -- outcomes of runs, files as rows --------------------------------------------------------------


def test_outcomes_of_runs(spark):
    rows = [
        ("ok", 0, "start"), ("ok", 3000, "CER: 0.5 | WER: 0.6"), ("ok", 6000, "Training complete. Best CER: 0.25"), ("ok", 6001, "Error: later"),
        ("error", 0, "x"), ("error", 10, "ValueError: bad value"), ("error", 20, "Exit code: 1"),
        ("failed", 5, "Exit code: 0"), ("failed", 9, "Exit code: 3"),
        ("stalled", 0, "x"), ("stalled", 3601, "Training complete. Best CER: 0.1"),
        ("edge", 0, "x"), ("edge", 3600, "Training complete. Best CER: 0.2"),
        ("silent", 0, "x"), ("running", 6500, "x"), ("running", 6500, None),
    ]
    lines_ = spark.createDataFrame([(a, s, i, t) for i, (a, s, t) in enumerate(rows)] + [("none", None, 99, "x")], "log string, s long, line_no int, text string").withColumn("at", F.timestamp_seconds(F.col("s") + 1_700_000_000))
    got = {r.log: (r.status, r.best_cer, r.message, r.seconds) for r in readers.run_outcomes(lines_).collect()}
    assert got == {
        "ok": ("success", 0.25, None, 6000), "error": ("error", None, "bad value", 10), "failed": ("failed", None, "3", 4), "stalled": ("timeout", None, None, 3600),
        "edge": ("success", 0.2, None, 3600), "silent": ("timeout", None, None, 3600), "running": ("running", None, None, 0),
    }
    later = readers.run_outcomes(lines_, as_of=F.timestamp_seconds(F.lit(1_700_100_000))).where("log = 'running'").first()
    assert later.status == "timeout" and readers.run_outcomes(lines_.limit(0)).count() == 0


def test_files_are_joined_without_being_opened(spark, tmp_path):
    for name, content in (("entry_1.png", b"one"), ("entry_22.png", b"\x00\xff"), ("entry_3.txt", b"three"), ("sub/entry_4.png", b"four"), ("entry_5.png", b"")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = readers.files(spark, str(tmp_path), "*.png")
    assert {r.path.rpartition("/")[2]: r.sha256 for r in writers.content_hashes(found).collect()} == {f"entry_{i}.png": hashlib.sha256(c).hexdigest() for i, c in ((1, b"one"), (22, b"\x00\xff"), (4, b"four"))}
    kept = readers.file_assets(found, spark.createDataFrame([(1,), (4,), (5,), (9,)], "id int"))
    assert {(r.id, r.length) for r in kept.collect()} == {("1", 3), ("4", 4)}
    assert "content" not in plan_of(kept).replace("content#", "content") and "ReadSchema: struct<path:string,length:bigint>" in plan_of(kept)


# -- table function -------------------------------------------------------------------------------


def test_alignments_from_a_table_function_over_batches(spark):
    rng = random.Random(12)
    rows = [(rng.choice(["m", "n"]), i, "".join(rng.choices("abé ", k=rng.randint(0, 20))), "".join(rng.choices("abé ", k=rng.randint(0, 20)))) for i in range(300)] + [(None, 300, None, "x")]
    df = spark.createDataFrame(rows, "model string, id long, reference string, prediction string").repartition(3)
    df.createOrReplaceTempView("rows_to_align")
    ch.register_batch_function(spark)
    found = spark.sql("SELECT * FROM align_rows(TABLE(SELECT model, id, reference, prediction FROM rows_to_align) PARTITION BY model)")
    assert sorted(map(str, found.collect())) == sorted(map(str, ch.alignments(df, "model", "id").collect()))
    counts = spark.sql("SELECT model, ref_char, count(*) AS n FROM align_rows(TABLE(SELECT model, id, reference, prediction FROM rows_to_align) PARTITION BY model) WHERE ref_char <> '' GROUP BY ALL")
    assert {tuple(r) for r in counts.collect()} == {tuple(r) for r in ch.count_confusions(df, "model").groupBy("model", "ref_char").agg(F.sum("n")).collect()}
