"""The pipeline's rows and the language predictions against plain Python over the whole small table."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import regex
import zlib
from tokenizers import Tokenizer

from quillspark.llm import language_id, queries
from quillspark.llm.common import scratch_dir
from tests.llm.test_decontamination import brute as contained
from tests.llm.test_line_dedup import brute as line_dedup

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def forward(word, logs):
    """Log-sums over the cuts of each prefix of a marked word into pieces; a single character may be unknown (None)."""
    pieces, longest = language_id.vocabulary(PIECES)
    out = [0.0] + [-math.inf] * len(word)
    edges = []
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - longest), end):
            piece = pieces.get(word[start:end], -1 if end == start + 1 else None)
            if piece is not None:
                out[end] = np.logaddexp(out[end], out[start] + logs[piece])
                edges.append((start, end, piece))
    return out, edges


def learnt(rows):
    """``lang: {piece: log-probability}`` (piece -1: unknown), by two rounds of expected counts."""
    pieces, _ = language_id.vocabulary(PIECES)
    words = {}
    for text, lang in rows:
        words.setdefault(lang, Counter()).update(w for w in regex.findall(r"\p{L}+", text.lower()))
    models = {}
    for lang, counts in sorted(words.items()):
        logs = {i: -math.log(len(pieces)) for i in range(-1, len(pieces))}
        for _ in range(language_id.ROUNDS):
            uses = Counter()
            for w, n in counts.items():
                w = language_id.START + w
                alpha, edges = forward(w, logs)
                beta = [-math.inf] * len(w) + [0.0]
                for start, end, piece in sorted(edges, key=lambda e: -e[1]):
                    beta[start] = np.logaddexp(beta[start], beta[end] + logs[piece])
                for start, end, piece in edges:
                    uses[piece] += n * math.exp(alpha[start] + logs[piece] + beta[end] - alpha[-1])
            sums = np.array([uses[i] for i in range(len(pieces))]) + language_id.SMOOTHING
            logs = dict(enumerate(np.log(np.maximum(sums / sums.sum(), language_id.FLOOR)).tolist())) | {-1: math.log(language_id.FLOOR)}
        models[lang] = logs
    return models


def predicted(text, models, known):
    words = Counter(regex.findall(r"\p{L}+", (text or "").lower()))
    if not words:
        return "und", 0.0
    for w in words:
        if w not in known:
            known[w] = {lang: forward(language_id.START + w, logs)[0][-1] for lang, logs in models.items()}
    total = {lang: sum(n * known[w][lang] for w, n in words.items()) for lang in models}
    best = max(total, key=total.get)
    return best, 1 / sum(math.exp(t - total[best]) for t in total.values())


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    return sorted((r.doc_id, r.text, r.lang) for r in rows)


@pytest.fixture(scope="module")
def languages(docs):
    taught = [(t, lang) for i, t, lang in docs if zlib.crc32(str(i).encode()) % 4 != 2 and t is not None and lang is not None]
    models, known = learnt(taught), {}
    return {i: predicted(t, models, known) for i, t, _ in docs}


def test_predictions_equal_plain_sums(spark, sf_dir, languages):
    got = {r.doc_id: r for r in queries.op7_language_id(spark, sf_dir).collect()}
    assert got.keys() == languages.keys()
    for i, (lang, score) in languages.items():
        assert got[i].lang_pred == lang and math.isclose(got[i].score, score, abs_tol=1e-6)


def alike(a, b):
    return a == b or 10 * len(a & b) >= 8 * len(a | b) > 0


def near_dedup(rows):
    """Of each class of texts linked at 0.8 by their runs of five words, the least id."""
    runs, root = {}, {}
    for i, t in rows:
        words = regex.sub("[A-Z]", lambda m: m[0].lower(), t).split()
        runs[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    for i in sorted(runs):
        root[i] = i
        for j in [j for j in root if j != i and alike(runs[i], runs[j])]:
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = {k: new if r == old else r for k, r in root.items()}
    return [(i, t) for i, t in rows if root[i] == i]


def test_pipeline_rows_equal_plain_stages(spark, sf_dir, docs, languages):
    rows = [(i, t) for i, t, _ in docs if languages[i][0] != "und" and languages[i][1] >= corpus_pipeline.LEAST_SCORE]
    rows = [(i, t) for i, _, dropped, t in line_dedup(rows) if not dropped or t.strip(" \t\n\x0b\x0c\r")]
    rows = near_dedup(rows)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = {i for i, *_ in contained(rows, items)}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in rows:
        if i not in leaks:
            ids = library.encode(t, add_special_tokens=False).ids
            want.append((i, len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)))
    left = {p.name for p in Path(scratch_dir(spark).removeprefix("file:")).glob("*")}
    out = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in out.collect()) == sorted(want)
    assert 50 < len(want) < len(docs)
    # of all that the stages wrote, the last one's rows are left
    now = {p.name for p in Path(scratch_dir(spark).removeprefix("file:")).glob("*")} - left
    assert [n.split("-")[:2] for n in now] == [["stage", "bpe_encoding"]]
