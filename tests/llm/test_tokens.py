from __future__ import annotations

import random

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillspark.llm import bpe_tree, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, n_tokens int"
TEXTS = [
    None, "", " ", "\n\n  a", "Hello  world's end.\n\tNew line — café İstanbul 12½", "it's we'll I'M 'sx",
    "<|endoftext|> a <|startoftext|>b<|endoftext|>", "日本語 text नमस्ते \U0001f600‍\U0001f525", "é Å Σας", "a\x1cb\x85c d", "x" * 9001,
    "ab" * 4000 + " tail " + "éć" * 2500, "the " * 500, "the " * 500, "--==" * 1500, " \n" * 9000,
    " ".join(f"Don't stop-{i} <|startoftext|> naïve人 unforgettable" for i in range(900)),
]


def rows(spark, texts):
    return spark.createDataFrame([(i if i != 3 else None, t, 7) for i, t in enumerate(texts)], SCHEMA).repartition(3)


def test_counts_equal_the_library(spark):
    tok = Tokenizer.from_file(BYTE)
    got = sorted((r.n_bytes, r.n_tokens) for r in token_counts.token_counts(rows(spark, TEXTS), BYTE).collect())
    assert got == sorted((len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for t in TEXTS)
    parted = sorted((r.n_bytes, r.n_tokens) for r in token_counts.token_counts(rows(spark, TEXTS), BYTE, together=1).collect())
    assert parted == got
    assert token_counts.token_counts(rows(spark, []), BYTE).count() == 0


@pytest.mark.parametrize(("long_text", "chunk"), [(1, 7), (64, 32), (4096, 2048), (16_384, 4096)])
def test_encode_decode_equals_the_library(spark, long_text, chunk):
    tok = Tokenizer.from_file(WORD)
    out = bpe_tree.encode_decode(rows(spark, TEXTS), WORD, long_text=long_text, chunk=chunk)
    want = []
    for t in TEXTS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((len(ids), " ".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False)))
    assert sorted((r.n_tokens, r.ids, r.decoded) for r in out.collect()) == sorted(want)
    assert bpe_tree.encode_decode(rows(spark, []), WORD).count() == 0


def test_joins_of_random_chunks_are_exact():
    bpe, rng = bpe_tree.load(WORD), random.Random(5)
    for alphabet in ("ab", "theinandr", "éèai"):
        for size in (3, 17, 90):
            text = "".join(rng.choices(alphabet, k=700))
            cut = [text[i : i + size] for i in range(0, len(text), size)]
            parts = [(bpe.encode_chunk(bpe.mapped(c), i == len(cut) - 1), i < len(cut) - 1) for i, c in enumerate(cut)]
            assert bpe.join_all(parts) == bpe.encode_words([text])[0]


def test_texts_cut_anywhere_are_joined_exactly():
    bpe, rng = bpe_tree.load(WORD), random.Random(9)
    library = Tokenizer.from_file(WORD)
    for _ in range(60):
        text = "".join(rng.choices("theinadr's .,12é人 " + "<|endoftext|>"[rng.randrange(13)], k=rng.randint(0, 400)))
        for chunk in (1, 5, 64):
            parts = []
            for t, kind in bpe_tree.cut(bpe.pieces(text), chunk):
                words = t.split(" ") if t else []
                if kind == bpe_tree.SPECIAL:
                    parts.append(([int(t)], False))
                    continue
                tail = bpe.encode_chunk(bpe.mapped(words.pop()), False) if kind == bpe_tree.OPEN else []
                parts.append(([i for found in bpe.encode_words(words) for i in found] + tail, kind == bpe_tree.OPEN))
            assert bpe.join_all(parts) == library.encode(text, add_special_tokens=False).ids


def test_words_agree_with_the_library_on_latin_text():
    bpe, split = bpe_tree.load(WORD), token_counts.pre_tokenizer(BYTE)
    library = Tokenizer.from_file(BYTE).pre_tokenizer
    rng = random.Random(3)
    pool = [*map(chr, range(1, 0x250)), *" \n\t'sStTrRelLmMdD" * 12, "’", "—", "…"]
    for _ in range(400):
        text = "".join(rng.choices(pool, k=40))
        assert split(text) == [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)]
        plain = bpe.library.normalizer.normalize_str(text)
        assert bpe.words(text) == [plain[a:b] for _, (a, b) in bpe.library.pre_tokenizer.pre_tokenize_str(plain)]


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_levels_of_few_parts_a_task_equal_the_library(spark, fan):
    library, rng = Tokenizer.from_file(WORD), random.Random(4)
    texts = [*TEXTS, "x" * 60_000, "".join(rng.choices("theinadr's é人 ", k=30_000)), "<|endoftext|>" * 40 + "tail", "z" * 64]
    got = bpe_tree.encode_decode(rows(spark, texts), WORD, long_text=64, chunk=500, fan=fan).select("n_tokens", "ids").collect()
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert sorted((r.n_tokens, r.ids) for r in got) == sorted((len(ids), " ".join(map(str, ids))) for ids in want)


def test_a_level_joins_no_more_parts_than_its_fan(spark):
    """A text of 300 parts by fours: 75, 19, 5, 2 and 1 parts; a row of one part moves no more."""
    made = bpe_tree._join_parts(WORD, 4)
    bpe = bpe_tree.load(WORD)
    parts = list(bpe_tree.cut(bpe.pieces("ab" * 15_000), 100))
    frame = next(bpe_tree._encode_parts(WORD)(iter([pd.DataFrame({"row": 1, "doc_id": 1, "part": range(len(parts)), "n_parts": len(parts), "text": [t for t, _ in parts], "kind": [k for _, k in parts]})])))
    frame["tokens"] = frame["tokens"].map(np.array)
    sizes = []
    while len(frame) > 1:
        frame = pd.concat([made(part) for _, part in frame.groupby(frame["part"] // 4)], ignore_index=True)
        assert set(frame["n_parts"]) == {len(frame)} and list(frame["part"]) == list(range(len(frame)))
        sizes.append(len(frame))
        frame["tokens"] = frame["tokens"].map(np.array)
    assert sizes == [75, 19, 5, 2, 1]
    assert frame["tokens"][0].tolist() == bpe.encode_words(["ab" * 15_000])[0]
