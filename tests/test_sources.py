from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import corpus, inference, scoring, statistics
from quillspark.operators import translation as mt
from quillspark.sources import derived, readers, writers
from quillspark.streaming import scores


def test_keyed_corpus(spark, tmp_path):
    entries = {"length": 3214, "10": {"original": " b ", "translation": "B", "original_formatted": "b ."}, "2": {"original": "a", "translation": "A"}, "0": {}, "68": {"orginal": "x", "translation": "X"}, "7": {"original": "  ", "translation": "y"}}
    (tmp_path / "c.json").write_text(json.dumps(entries))
    rows = readers.keyed_corpus(spark, str(tmp_path / "c.json"))
    assert {r.id for r in rows.collect()} == {"10", "2", "0", "68", "7"}
    assert [(r.id, r.original) for r in readers.nonempty_pairs(rows).orderBy(F.col("id").cast("int")).collect()] == [("2", "a"), ("10", "b")]


def test_prediction_memory_and_result_files(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"id": "1", "prediction": "", "reference": "a"}\n\n{"id": "2", "prediction": "b", "reference": ""}\n')
    assert readers.predictions(spark, str(tmp_path / "p.jsonl")).count() == 2
    rows = spark.createDataFrame([("a", "A"), ("b", "[Translation failed: x]")], "text string, translation string")
    writers.append_memory(rows, str(tmp_path / "m"))
    writers.append_memory(rows.withColumn("translation", F.lit("A2")).where("text = 'a'"), str(tmp_path / "m"))
    assert [(r.text, r.translation) for r in readers.translation_memory(spark, str(tmp_path / "m")).collect()] == [("a", "A2")]
    results = [{"model": "x", "status": "success", "metrics": {"cer": 0.2}}, {"model": "y", "status": "failed", "error": "e"}, {"model": "z", "status": "success", "metrics": {"cer": 0.1}}]
    (tmp_path / "r.json").write_text(json.dumps(results))
    assert [(r.model, round(r.cer, 6)) for r in readers.model_results(spark, str(tmp_path / "r.json")).collect()] == [("z", 10.0), ("x", 20.0)]


def test_writers(spark, tmp_path):
    means = spark.createDataFrame([("b", None, 0.5), ("a", 0.25, None)], "model string, cer double, wer double")
    writers.write_leaderboard(means, str(tmp_path / "l"), ["model"], ["cer", "wer"])
    assert [r.value for r in spark.read.text(str(tmp_path / "l")).collect()] == ["model,cer,wer", "a,0.250000,-1.000000", "b,-1.000000,0.500000"]
    pairs = spark.createDataFrame([("x\ty", 'say "hi"')], "sme string, eng string")
    writers.write_pairs(pairs, str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "p/tsv")).first().value == 'x y\tsay "hi"'
    writers.write_sentences(spark.createDataFrame([(2, "b"), (1, "a")], "idx int, text string"), str(tmp_path / "s"))
    assert [r.value for r in spark.read.text(str(tmp_path / "s")).collect()] == ["a", "b"]
    writers.write_results(pairs, means.limit(1), spark.range(1), str(tmp_path / "r"))
    assert "aggregate_metrics" in spark.read.json(str(tmp_path / "r/summary")).columns
    writers.write_predictions(pairs.withColumn("model", F.lit("m")), str(tmp_path / "c"))
    assert "model" in spark.read.json(str(tmp_path / "c")).columns
    writers.write_split_experiment(pairs.withColumn("parts", F.array("sme")), means, str(tmp_path / "e"))
    assert spark.read.option("header", True).csv(str(tmp_path / "e/comparison")).columns == ["sme", "eng"]


def test_run_folder_metadata_and_mode_comparison(spark, tmp_path):
    from datetime import datetime

    (tmp_path / "in.json").write_text("{}")
    at = datetime(2024, 5, 6, 7, 8, 9)
    files = spark.read.format("binaryFile").load(str(tmp_path / "in.json"))
    meta = writers.run_metadata(files, "m", at, {"baseline": [], "simple": ["ja", "go"]}, spark.createDataFrame([(3,)], "total_samples long")).first()
    assert meta.inputs[0].sha256 == "44136fa355b3678a1146ad16f7e8649e94fb4fc21fe77e8310c060f61caaff8a"
    assert meta.conjunctions == {"baseline": [], "simple": ["ja", "go"]} and meta.total_samples == 3 and meta.modes == ["baseline", "simple"]
    assert writers.run_folder("/x", "m", at) == "/x/m_20240506_070809"
    scores = spark.createDataFrame([("baseline", 10.0, 20.0, 30.0, 7), ("simple", 12.345, 21.0, 29.0, 7)], "mode string, bleu double, chrf double, ter double, total_samples long")
    table = mt.mode_table(scores, spark.createDataFrame([("simple", 1.25, 2)], "mode string, avg_segments double, samples_split long"), "baseline")
    assert [(r.mode, round(r.delta_bleu, 3), r.avg_segments, r.samples_split) for r in table.orderBy("mode").collect()] == [("baseline", 0.0, 1.0, 0), ("simple", 2.345, 1.25, 2)]
    writers.write_mode_comparison(table, str(tmp_path / "modes"))
    assert [r.value for r in spark.read.text(str(tmp_path / "modes")).collect()] == ["mode,bleu,chrf,ter,avg_segments,samples_split,total_samples", "baseline,10.00,20.00,30.000,1.0,0,7", "simple,12.35,21.00,29.000,1.3,2,7"]


def test_intervals_that_overlap_or_not(spark):
    rows = spark.createDataFrame([("base", 10.0, 9.0, 11.0), ("a", 10.5, 9.5, 11.5), ("b", 13.0, 12.0, 14.0)], "mode string, mean double, ci_lower double, ci_upper double")
    assert {(r.mode, r.delta_lower, r.significant) for r in mt.significance(rows, "base").collect()} == {("base", -1.0, False), ("a", -0.5, False), ("b", 2.0, True)}


def test_registry_and_error_policy(spark):
    with pytest.raises(ValueError, match="unknown model"):
        inference.factory_of("nope")
    inference.REGISTRY["picky"] = inference.one_by_one(lambda: lambda t: {"ok": "fine"}[t])
    rows = inference.batch_infer(spark.createDataFrame([("ok",), ("bad",)], "text string"), "picky").collect()
    assert [(r.prediction, r.error) for r in rows] == [("fine", None), ("", "'bad'")]


def test_published_paired_test(spark):
    assert abs(statistics.student_p(6.017284, 19) - 8.656e-06) < 2e-8
    rows = spark.createDataFrame([(5.0, 4.0), (6.0, 4.5), (7.0, 6.5)], "a double, b double")
    r = statistics.paired_ttest(rows, "a", "b").first()
    assert r.n == 3 and abs(r.t - 2 * 3**0.5) < 1e-9 and abs(r.cohens_d - 2) < 1e-9 and not r.significant_05
    assert statistics.paired_ttest(rows.limit(1), "a", "b").first().t is None


def test_translation_scores_of_equal_and_edge_texts(spark):
    rows = [(1, "the cat is on the mat", "the cat is on the mat"), (2, "", "a b"), (3, "a b", ""), (4, "the the the the", "the cat the mat")]
    df = spark.createDataFrame(rows, "id long, hypothesis string, reference string")
    bleu = {r.id: r.s for r in mt.bleu_stats(df).select("id", mt.bleu_of().alias("s")).collect()}
    assert abs(bleu[1] - 100) < 1e-9 and bleu[2] == bleu[3] == bleu[4] == 0
    chrf = {r.id: r.s for r in mt.chrf_stats(df).select("id", mt.chrf_of().alias("s")).collect()}
    assert abs(chrf[1] - 100) < 1e-9 and chrf[2] == chrf[3] == 0
    assert {r.id: r.s for r in mt.ter_stats(df).select("id", mt.ter_of().alias("s")).collect()} == {1: 0, 2: 100, 3: 100, 4: 50}
    assert abs(mt.add_up(mt.bleu_stats(df.where("id = 1"))).select(mt.bleu_of().alias("s")).first().s - 100) < 1e-9


def test_merges_and_swaps_in_runs_of_wanted_lines(spark):
    df = spark.createDataFrame([("g", i, c, w) for i, (c, w) in enumerate([("a", True), ("b", True), ("c", False), ("d", True), ("e", False)])], "g string, idx int, text string, w boolean")
    merged = corpus.merge_next(df, F.col("w"), "g").orderBy("idx")
    assert [r.text for r in merged.collect()] == ["a b", "c", "d e"]
    assert [r.text for r in corpus.swap_next(df, F.col("w"), "g").orderBy("idx").collect()] == ["b", "a", "c", "e", "d"]


def test_stream_state_equals_batch(spark, sf_dir, tmp_path):
    rows = derived.predictions(spark, sf_dir).where("id % 40 = 0").withColumn("id", F.col("id").cast("string"))
    rows.where("crc32(id) % 2 = 0").write.json(str(tmp_path / "in"))
    state, checkpoint = str(tmp_path / "state"), str(tmp_path / "checkpoint")
    scores.score_stream(spark, str(tmp_path / "in"), state, checkpoint).awaitTermination()
    rows.write.mode("append").json(str(tmp_path / "in"))  # the first half arrives again
    scores.score_stream(spark, str(tmp_path / "in"), state, checkpoint).awaitTermination()
    got = {(r.model, r.source): r for r in scores.means(scores.read_state(spark, state)).collect()}
    batch = scoring.rollup_by_source(scoring.score_rows(rows), ["cer", "exact", "normalized"]).where("source <> 'all'").collect()
    assert len(got) == len(batch) == 6
    for r in batch:
        g = got[r.model, r.source]
        assert g.n == r.n and abs(g.cer - r.cer) < 1e-9 and abs(g.exact - r.exact) < 1e-9


def test_files_of_their_own_are_written_and_read_once(spark, sf_dir, tmp_path, monkeypatch):
    from quillspark.plans import catalogue

    plan = catalogue.QUERIES["page_files"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan binaryFile") == 1
    texts = {k: "é\n" * (k % 5) for k in range(600)}
    rows = spark.createDataFrame([*texts.items(), (600, None)], "k long, text string").repartition(3)
    for path in (str(tmp_path / "bare"), f"file:{tmp_path}/uri"):
        for _ in range(2):  # what runs again replaces what it wrote
            folders = writers.write_files(rows, path)
        found = {r.path.rsplit("/", 1)[1]: bytes(r.content).decode() for r in readers.files(spark, folders, "*.txt").collect()}
        assert found == {f"k={k}.txt": t + "\n" for k, t in [*texts.items(), (600, "")]}
    assert sum(p.is_file() for p in tmp_path.rglob("*")) == 2 * 601  # nothing half written is left
    none = writers.write_files(rows.where("k < 0"), str(tmp_path / "none"))
    assert readers.files(spark, none, "*.txt").count() == 0

    def unknown(uri):
        raise writers.pa.ArrowInvalid(uri)

    monkeypatch.setattr(writers.fs, "FileSystem", type("Unknown", (), {"from_uri": staticmethod(unknown)}))
    by_spark = readers.files(spark, writers.write_files(rows.where("k < 3"), str(tmp_path / "spark")), "*.txt")
    kept = readers.file_assets(by_spark, spark.range(2), r"/k=(\d+)(?:/[^/]+)?\.txt$")
    assert sorted((r.id, r.length) for r in kept.collect()) == [("0", 1), ("1", 4)]
