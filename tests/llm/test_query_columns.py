"""The registered queries' own columns against plain Python over the whole small table."""

from __future__ import annotations

import hashlib
import re
import zlib

import public_tokenizers
from tokenizers import Tokenizer

from quillspark.llm import language_id, license_scan, queries
from tests.llm.test_license_scan import brute as brute_licence
from tests.llm.test_simhash import brute_components, brute_print


def texts_of(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def result(query, spark, sf_dir):
    rows = query(spark, sf_dir).collect()
    found = {r.doc_id: r for r in rows}
    assert len(found) == len(rows)
    return found


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op2_columns(spark, sf_dir):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts, got = texts_of(spark, sf_dir), result(queries.op2_token_counts, spark, sf_dir)
    assert got.keys() == texts.keys()
    for d, text in texts.items():
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (got[d].n_bytes, got[d].n_tokens, got[d].over_limit) == (len(text.encode()), n, n > 1024)


def test_op3_columns(spark, sf_dir):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts, got = texts_of(spark, sf_dir), result(queries.op3_bpe_tree, spark, sf_dir)
    assert got.keys() == texts.keys()
    for d, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(ids), sha256(" ".join(map(str, ids))))
        assert got[d].decoded_sha256 == sha256(library.decode(ids, skip_special_tokens=False))


def test_op5_columns(spark, sf_dir):
    texts, got = texts_of(spark, sf_dir), result(queries.op5_license_scan, spark, sf_dir)
    assert got.keys() == texts.keys()
    for d, text in texts.items():
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licence(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) <= {x for x, *_ in license_scan.TEMPLATES}
        assert (r.score > 0) == (r.labels != "") and 0 <= r.score <= 1


def test_op7_columns(spark, sf_dir):
    texts, got = texts_of(spark, sf_dir), result(queries.op7_language_id, spark, sf_dir)
    assert got.keys() == texts.keys()
    languages = {r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang").distinct().collect()}
    for d, text in texts.items():
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= got[d].score <= 1
        lettered = re.search(r"[^\W\d_]", text) is not None
        assert got[d].lang_pred in languages if lettered else got[d].lang_pred == language_id.UNDETERMINED


def test_op8_columns(spark, sf_dir):
    texts, got = texts_of(spark, sf_dir), result(queries.op8_simhash_golay, spark, sf_dir)
    ids = sorted(texts)
    prints = [brute_print(texts[d]) for d in ids]
    assert [got[d].fingerprint for d in ids] == [f"{p:016x}" for p in prints]
    assert [got[d].component_id for d in ids] == brute_components(prints, ids)
