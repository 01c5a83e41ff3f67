from __future__ import annotations

import math
import zlib

import numpy as np
import public_tokenizers

from quillspark.llm import language_id as li

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(word, table, column):
    """Sum over all segmentations, one by one."""
    pieces, _ = li.vocabulary(PATH)
    word = li.START + word

    def total(at):
        if at == len(word):
            return 1.0
        out = 0.0
        for end in range(at + 1, len(word) + 1):
            piece = pieces.get(word[at:end], len(pieces) if end == at + 1 else None)
            if piece is not None:
                out += table[piece, column] * total(end)
        return out

    return math.log(total(0))


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(0)
    table = rng.random((len(li.vocabulary(PATH)[0]) + 2, 3))
    table[-1] = 0
    words = ["the", "thinwhtion", "éèle", "日本", "a"]
    got = li.word_scores(words, table, PATH)
    assert np.allclose(got, [[brute(w, table, c) for c in range(3)] for w in words])
    counts = li.expected_counts(["the"], np.array([2.0]), table[:, 0], PATH)
    lengths = {i: len(p) for p, i in li.vocabulary(PATH)[0].items()}
    assert math.isclose(sum(counts[i] * n for i, n in lengths.items()), 2 * len("▁the"))


def test_long_words_are_neither_cut_nor_lost():
    """5,000 letters without a space: the forward sum in logarithms, and pieces that cover each letter once."""
    rng = np.random.default_rng(1)
    pieces, longest = li.vocabulary(PATH)
    table = np.maximum(rng.random((len(pieces) + 2, 2)) / len(pieces), li.FLOOR)
    table[-1] = 0
    for word in ("".join(rng.choice(list("abdeinrst"), 5000)), "ก" * 300, "x" * 17):
        marked = li.START + word
        log_sum = np.full((len(marked) + 1, 2), -np.inf)
        log_sum[0] = 0
        for end in range(1, len(marked) + 1):
            for start in range(max(0, end - longest), end):
                piece = pieces.get(marked[start:end], len(pieces) if end == start + 1 else None)
                if piece is not None:
                    log_sum[end] = np.logaddexp(log_sum[end], log_sum[start] + np.log(table[piece]))
        assert np.allclose(li.word_scores(["short", word], table, PATH)[1], log_sum[-1], rtol=1e-9)
        counts = li.expected_counts([word], np.array([3.0]), table[:, 0], PATH)
        lengths = np.zeros(len(table))
        lengths[list(pieces.values())] = [len(p) for p in pieces]
        lengths[len(pieces)] = 1
        assert math.isclose(counts @ lengths, 3 * len(marked), rel_tol=1e-9)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = li.identify(docs, PATH).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_rows_without_letters(spark):
    rows = [(1, "the cat", "en"), (2, "le chat", "fr"), (3, None, "en"), (4, "", None), (5, "12 !_²", "en"), (6, "x" * 500 + "ä" * 5000, "fr"), (None, "der hund", None), (7, "the the", "en")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in li.identify(df, PATH).collect()}
    assert len(got) == 8 and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 5))
    assert got[7].lang_pred == "en" and 0.5 < got[7].score <= 1 and got[None].lang_pred in ("en", "fr")
    assert li.identify(df.limit(0), PATH).count() == 0
    assert {r.lang_pred for r in li.identify(df.withColumn("lang", df.lang.substr(9, 1)).na.replace("", None), PATH).collect()} == {"und"}


def test_columns_that_clash_in_another_case(spark):
    df = spark.createDataFrame([(1, "the cat", "en", 0.5, "x", 7), (2, "le chat", "fr", 0.5, "y", 8)], "doc_id long, text string, lang string, Score double, LANG_PRED string, extra int")
    found = li.identify(df, PATH, keep=True)
    assert found.columns == ["doc_id", "text", "lang", "extra", "held_out", "lang_pred", "score"] and found.count() == 2
