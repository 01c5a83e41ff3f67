"""Each stage on nulls, empty texts, ties, repeated rows, an empty table and columns whose names clash."""

from __future__ import annotations

import corpus_pipeline as p
import pytest

WORDS = "the quick brown fox jumps over the lazy dog while seven wizards quietly boxed twelve liquor jugs".split()
LONG = " ".join(WORDS * 3)
LINE = "a line that three documents hold alike"
ROWS = [
    (1, LONG, "en"), (1, LONG, "en"), (2, LONG.upper(), "en"), (3, f"{LINE}\n{' '.join(WORDS[5:])}", "en"), (4, f"{LINE}\nder hund und die katze gehen heute nach hause", "de"),
    (5, f"{LINE}\n", "en"), (6, None, "de"), (7, "", None), (8, " \n ", "en"), (None, "der hund und die katze schlafen in dem haus", "de"), (9, "12 34 !", "en"), (10, f"{LINE}", "en"),
]
CLASHES = ["_id", "_doc", "_drop", "_leak", "_hits", "_print", "score", "lang_pred", "held_out", "n_lines", "n_dropped", "node", "root", "key"]


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHES)
    return spark.createDataFrame([(i, t, lang, "web", 0, *range(len(CLASHES))) for i, t, lang in ROWS], schema).repartition(2)


def kept(out, docs):
    assert out.dtypes == docs.dtypes
    rows = out.collect()
    assert all(tuple(r[c] for c in CLASHES) == tuple(range(len(CLASHES))) for r in rows)
    return sorted((r.doc_id or 0) for r in rows), rows


def test_language_stage(spark, docs, sf_dir):
    ids, rows = kept(p.identify_language(spark, docs, sf_dir), docs)
    assert not {6, 7, 8, 9} & set(ids) and {1, 2, 0} <= set(ids) and ids.count(1) == 2
    assert {r.lang for r in rows} <= {"en", "de"}
    assert p.identify_language(spark, docs.limit(0), sf_dir).count() == 0


def test_line_stage(spark, docs, sf_dir):
    ids, rows = kept(p.dedup_lines(spark, docs, sf_dir), docs)
    # only 10 keeps the line; 5 held nothing else
    assert ids == [0, 1, 1, 2, 3, 4, 6, 7, 8, 9, 10]
    assert [r.doc_id for r in rows if LINE in r.text] == [10] and all(r.n_chars == len(r.text) for r in rows)
    assert p.dedup_lines(spark, docs.limit(0), sf_dir).count() == 0


def test_near_duplicate_stage(spark, docs, sf_dir):
    ids, _ = kept(p.drop_near_duplicates(spark, docs, sf_dir), docs)
    # 2 is 1 in capitals, whose repeated rows both stay; of the wordless texts the least id stays
    assert ids == [0, 1, 1, 3, 4, 5, 6, 9]
    assert p.drop_near_duplicates(spark, docs.limit(0), sf_dir).count() == 0


def test_decontamination_stage(spark, docs, tmp_path):
    items = spark.createDataFrame([(1, " ".join(WORDS[5:12])), (2, None), (3, "")], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    ids, _ = kept(p.decontaminate(spark, docs, str(tmp_path)), docs)
    assert ids == [0, 4, 5, 6, 7, 8, 9, 10]
    assert p.decontaminate(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_encoding_stage(spark, docs, sf_dir):
    out = p.encode(spark, docs, sf_dir).collect()
    assert len(out) == len(ROWS) and {r.n_tokens for r in out if r.doc_id in (6, 7, 8)} == {0}
