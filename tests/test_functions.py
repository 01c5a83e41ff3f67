from __future__ import annotations

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillspark.functions import accuracy as acc
from quillspark.functions import segmentation as seg
from quillspark.functions import text as tx
from quillspark.operators import characters as ch
from quillspark.operators import translation as mt


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def test_error_rates_and_their_edges(spark):
    rows = [("abc", "abd"), ("", ""), ("", "x"), ("abc", ""), ("a", "abcd"), ("the cat sat on the mat", "the cat sit on mat"), ("čáppa šŋ", "cáppa ŋŋ")]
    df = spark.createDataFrame(rows, "r string, p string")
    r, p = F.col("r"), F.col("p")
    got = df.select(acc.cer(r, p).alias("cer"), acc.wer(r, p).alias("wer"), acc.token_accuracy(r, p).alias("acc"), acc.normalized(r, p).alias("norm")).collect()
    for (a, b), g in zip(rows, got, strict=True):
        rate = lambda x, y: levenshtein(x, y) / len(x) if x else float(bool(y))
        assert abs(g["cer"] - rate(a, b)) < 1e-12 and abs(g["wer"] - rate(a.split(), b.split())) < 1e-12
    assert got[1]["acc"] is None and got[1]["norm"] == 1


def test_distances_of_long_rows(spark):
    """50,000 characters, and more distinct words than a character set holds planes."""
    rng = random.Random(5)
    long = "".join(rng.choices("abcdefgh ", k=50_000))
    words = [f"w{i}" for i in range(70_000)]
    other = words[:100] + ["x"] + words[101:40_000] + words[40_003:] + ["y"]
    rows = [(long, long[:110]), (long[:9000], long[:2000] + "##" + long[2000:9000]), ("", long), ("a b c", "c b a")]
    df = spark.createDataFrame(rows, "r string, p string")
    assert [r.c for r in df.select(acc.edit_distance(F.col("p"), F.col("r")).alias("c")).collect()] == [50_000 - 110, 2, 50_000, 2]
    df = spark.createDataFrame([(" ".join(words), " ".join(other)), *rows], "r string, p string")
    got = [r.w for r in df.select(acc.token_distance(tx.words(F.col("r")), tx.words(F.col("p"))).alias("w")).collect()]
    assert got[0] == 5 and got[3:] == [len(long.split()), 2]
    for _ in range(400):
        a, b = (np.array(rng.choices(range(3), k=rng.randint(0, 70))) for _ in range(2))
        assert acc.distance(a, b) == levenshtein(a.tolist(), b.tolist())


def test_text_rules(spark):
    assert one(spark, tx.clean_text(F.col("t")), t="  Hello,   WORLD! it's ") == "hello world its"
    assert one(spark, tx.format_sentence(F.col("t")), t="Hi,you (there)  .") == "Hi , you ( there ) ."
    assert one(spark, tx.nfkc_clean(F.col("t")), t="ﬁ\xa0x\ny​ z ") == "fi xy z"
    assert one(spark, tx.header_split(F.col("t")), t="Of The Old Reindeer Man And then he went") == ["Of The Old Reindeer Man .", "And then he went"]
    assert one(spark, tx.header_split(F.col("t")), t="About The Old Reindeer about the old man who") == ["About The Old Reindeer .", "about the old man who"]
    assert one(spark, tx.header_split(F.col("t")), t="Nothing to split here at all today friends") == ["Nothing to split here at all today friends"]
    assert one(spark, tx.first_sentence_repair(F.col("t"), "I am a Sámi"), t="I am a Sámi I am a Sámi who has") == ["I am a Sámi .", "I am a Sámi who has"]
    assert one(spark, tx.is_page_number(F.col("t")), t="134 .") and one(spark, tx.is_footnote(F.col("t")), t="13 Turi refers here to")
    assert one(spark, tx.is_header_fragment(F.col("t")), t="SÁMI TEXT") and not one(spark, tx.is_header_fragment(F.col("t")), t="123 45")


def test_splitter_on_north_sami(spark):
    text = "Ja dasa lea dát sivva: go sápmelaš boahtá moskkus gámmirii, de son ii ipmir ii báljo maidege, go ii biegga beasa bossut njuni vuostá."
    found = seg.spans(F.col("t"))
    assert [(s.pos, s.conj) for s in one(spark, found, t=text)] == [(0, "ja"), (23, "go"), (94, "go")]
    cuts = seg.greedy_cuts(F.col("t"), found)
    assert one(spark, cuts, t=text) == [94]
    assert one(spark, seg.rejoin(seg.segments(F.col("t"), cuts)), t=text) == text
    assert one(spark, cuts, t="Mon lean okta sápmelaš.") == []
    assert [s.conj for s in one(spark, found, t="ovdal go son ja dalle go")] == ["ovdal go", "ja", "dalle go"]


def test_alignment_rebuilds_both_sides():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abč", k=rng.randint(0, 12))) for _ in range(2))
        pairs = ch.align(a, b)
        assert "".join(x for x, _ in pairs) == a and "".join(y for _, y in pairs) == b
        assert sum(x != y for x, y in pairs) == levenshtein(a, b)
    assert ch.align("ab", "b") == [("a", ""), ("b", "b")]


def test_alignment_of_batches_and_in_sql(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choices("abč ", k=rng.randint(0, 15))), "".join(rng.choices("abč ", k=rng.randint(1, 15)))) for _ in range(200)]
    row, pos, ref, pred = ch.align_batch(*map(list, zip(*rows, strict=True)))
    for i, (a, b) in enumerate(rows):
        at = row == i
        assert list(zip(ref[at].tolist(), pred[at].tolist(), strict=True)) == ch.align(a, b) and pos[at].tolist() == list(range(at.sum()))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate([*rows, ("", ""), (None, "a")])], "id long, reference string, prediction string")
    df.createOrReplaceTempView("to_align")
    ch.register_table_function(spark)
    lateral = spark.sql("SELECT t.id, a.pos, a.ref_char, a.pred_char FROM to_align t, LATERAL align_chars(t.reference, t.prediction) a")
    assert sorted(ch.alignments(df, "id").collect()) == sorted(lateral.collect())


def test_long_rows_are_aligned_in_a_band_like_all_others(spark, monkeypatch):
    rng = random.Random(7)
    for k in range(120):
        a = "".join(rng.choices("abč ", k=rng.randint(1, 90)))
        b = "".join(c for c in a if rng.random() > 0.1) + "".join(rng.choices("ab", k=rng.randint(0, 5))) if k % 2 else "".join(rng.choices("abč ", k=rng.randint(1, 60)))
        if not b:
            continue
        monkeypatch.setattr(ch, "STEP", rng.choice([1, 2, 7, 512]))
        for one, two in zip(ch.align_batch([a], [b]), ch.align_long(a, b), strict=True):
            assert one.tolist() == two.tolist()
    text = "".join(rng.choices("abcdefghč ", k=50_000))
    df = spark.createDataFrame([(1, text, text.replace("č", "")[:-7]), (2, text, text[:50])], "id long, reference string, prediction string")
    sums = ch.alignments(df, "id").groupBy("id").agg(F.count_if(F.col("ref_char") != "").alias("r"), F.count_if(F.col("pred_char") != "").alias("p"), F.count_if(F.col("ref_char") != F.col("pred_char")).alias("d")).collect()
    lost = text.count("č")
    assert {(r.id, r.r, r.p) for r in sums} == {(1, 50_000, 50_000 - lost - 7), (2, 50_000, 50)}
    assert all(r.d == (lost + 7 if r.id == 1 else 50_000 - 50) for r in sums)


def test_clipped_counts_equal_counters():
    rng = random.Random(8)
    rows = [(rng.choices("abc", k=rng.randint(0, 30)), rng.choices("abc", k=rng.randint(0, 30))) for _ in range(80)]
    sides = [(np.array([ord(c) for row in rows for c in row[k]], np.uint32), np.array([len(row[k]) for row in rows])) for k in (0, 1)]
    got = mt.clipped_counts(*sides, 4)
    for (h, r), found in zip(rows, got.tolist(), strict=True):
        for n in range(1, 5):
            a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (h, r))
            assert found[3 * n - 3 : 3 * n] == [sum((a & b).values()), a.total(), b.total()]


def test_char_accuracy_and_pivot(spark):
    confused = spark.createDataFrame([("m", "á", "á", 9), ("m", "á", "a", 1), ("m", "Á", "Á", 1), ("m", "č", "", 2)], "model string, ref_char string, pred_char string, n long")
    tracked = ch.tracked_chars(spark.createDataFrame([("á",), ("č",), ("ŋ",)], "char string"))
    got = {r.char: (r.correct, r.total, r.accuracy) for r in ch.char_accuracy(confused, tracked).collect()}
    assert got["á"] == (9, 10, 0.9) and got["ŋ"] == (0, 0, None) and got["č"] == (0, 2, 0.0) and len(got) == 6
    pivot = {r["char"]: r["m"] for r in ch.case_folded(confused, ["m"]).collect()}
    assert pivot == {"á": 90.9, "č": 0.0, "overall": 76.9}


def test_every_prediction_of_every_model_is_aligned(spark, sf_dir):
    from quillspark.plans import characters
    from quillspark.sources import derived

    rows = derived.predictions(spark, sf_dir)
    got = {r.model: r.n for r in characters.confusion_pairs(spark, sf_dir).groupBy("model").agg(F.sum("n").alias("n")).collect()}
    assert got == {r.model: r.n for r in rows.groupBy("model").agg(F.sum(F.length("reference")).alias("n")).collect()}
    assert set(characters.char_alignment(spark, sf_dir).columns) == {"model", "id", "pos", "ref_char", "pred_char"}


def _plain_alignment(a: str, b: str) -> list[tuple[str, str]]:
    cost = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif j and cost[i][j] == cost[i][j - 1] + 1:
            j -= 1
            out.append(("", b[j]))
        else:
            i -= 1
            out.append((a[i], ""))
    return out[::-1]


def test_alignments_equal_a_plain_table(monkeypatch):
    rng = random.Random(11)
    for cells in (1 << 23, 2000, 150):
        monkeypatch.setattr(ch, "CELLS", cells)
        rows = []
        for _ in range(150):
            a = "".join(rng.choices("abč \U0001f600", k=rng.randint(0, 25)))
            rows.append((a, rng.choice([a, "".join(c for c in a if rng.random() > 0.2), "".join(rng.sample(a, len(a))), "".join(rng.choices("abč", k=rng.randint(0, 25)))])))
            rows.append(rows[-1][::-1])
        row, pos, ref, pred = ch.align_batch(*map(list, zip(*rows, strict=True)))
        for i, (a, b) in enumerate(rows):
            at = row == i
            assert list(zip(ref[at].tolist(), pred[at].tolist(), strict=True)) == _plain_alignment(a, b) and pos[at].tolist() == list(range(at.sum()))


def test_every_alignment_and_count_of_a_whole_table_equals_a_plain_table(spark, sf_dir):
    """Rows of up to 120 characters of the three mock models, each against the full table of costs."""
    from quillspark.sources import derived

    rows = derived.predictions(spark, sf_dir).where("length(reference) <= 120").select("model", "id", "reference", "prediction").cache()
    want, pairs = Counter(), 0
    got = {(r.model, r.id): list(zip(r.ref_chars, r.pred_chars, strict=True)) for r in ch.aligned_rows(rows, "model", "id").collect()}
    for r in rows.collect():
        plain = _plain_alignment(r.reference, r.prediction) if r.reference != r.prediction else [(c, c) for c in r.reference]
        assert got[r.model, r.id] == plain
        want.update((r.model, a, b) for a, b in plain if a)
        pairs += len(plain)
    counted = {(r.model, r.ref_char, r.pred_char): r.n for r in ch.count_confusions(rows, "model").collect()}
    assert counted == dict(want) and ch.alignments(rows, "model", "id").count() == pairs


def test_counts_of_null_groups_empty_sides_and_tables(spark):
    rows = spark.createDataFrame([("m", "ab", None), (None, None, "x"), (None, "é", "é"), (None, "", "")], "model string, reference string, prediction string")
    assert {tuple(r) for r in ch.count_confusions(rows, "model").collect()} == {("m", "a", "", 1), ("m", "b", "", 1), (None, "é", "é", 1)}
    assert {tuple(r) for r in ch.count_confusions(rows).collect()} == {("a", "", 1), ("b", "", 1), ("é", "é", 1)}
    assert ch.count_confusions(rows.limit(0), "model").count() == 0
