"""Language identification by segmentation-marginalised unigrams (operator 7).

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum
over all ways to cut it into pieces, found by the forward algorithm; a text's log-probability is the sum over
its words. Pieces are learnt by expected counts (forward and backward) over the word counts of a bounded,
hash-chosen sample of labelled documents: at most about ``sample_per_language`` of each language. Everything
else reads whole texts of all rows.

Defined results: ``und`` with score 0 for a null text, one without a letter, or where no language was learnt;
otherwise the language of highest probability (the first in order on ties) and its posterior under equal
priors as the score. Words are runs of letters, lower-cased, of any length: probabilities are rescaled along the
way. Rows with a null id, repeated rows and empty tables need no care. ``held_out`` rows never teach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import scratch_table, slices

NOT_LETTERS = r"[^\p{L}]+"
#: Least probability of a piece or an unknown character, and characters between two rescalings.
FLOOR, STRIDE = 1e-7, 16
SAMPLE_PER_LANGUAGE, ROUNDS, SMOOTHING = 3000, 2, 0.01
#: Distinct words remembered per Python worker.
MEMO = 100_000
UNDETERMINED = "und"
START = "▁"


@lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[dict[str, int], int]:
    """Lower-case pieces of the vocabulary that hold letters only (a start mark may lead), and the longest."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    kept = [p for p in pieces if p == START or (body := p.removeprefix(START)).isalpha() and body == body.lower()]
    return {p: i for i, p in enumerate(kept)}, max(map(len, kept))


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of all texts; each word's number in order ('' may be one); where each text's words begin."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), NOT_LETTERS)
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), offsets[:-1] - offsets[0]


@lru_cache(maxsize=4)
def prefix_tree(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces as a tree of prefixes: its edges (node, character) in order, the node each leads to, and the
    piece that each node spells, or -1."""
    pieces, _ = vocabulary(path)
    nodes, edges = {"": 0}, {}
    for piece in pieces:
        for end in range(1, len(piece) + 1):
            node = nodes.setdefault(piece[:end], len(nodes))
            edges[nodes[piece[: end - 1]] << 21 | ord(piece[end - 1])] = node
    keys = np.array(sorted(edges))
    return keys, np.array([edges[k] for k in keys.tolist()]), np.array([pieces.get(prefix, -1) for prefix in nodes])


def _lattice(words: list[str], path: str) -> Iterator[tuple[int, list[tuple[int, np.ndarray, np.ndarray]]]]:
    """For words of one length, per start: ends, the words that hold a piece between, and the pieces. A character
    that is no piece counts as unknown and gets the number after the last piece."""
    keys, targets, piece_at = prefix_tree(path)
    unknown = len(vocabulary(path)[0])
    n = len(words[0]) + 1
    chars = np.array([START + w for w in words], dtype=f"<U{n}").view(np.uint32).reshape(len(words), n).astype(np.int64)
    for start in range(n):
        rows, node, out = np.arange(len(words)), np.zeros(len(words), np.int64), []
        for end in range(start + 1, n + 1):
            edge = node << 21 | chars[rows, end - 1]
            at = np.minimum(np.searchsorted(keys, edge), len(keys) - 1)
            goes = keys[at] == edge
            if end == start + 1:
                single = np.full(len(words), unknown)
                single[goes] = np.where(piece_at[targets[at[goes]]] < 0, unknown, piece_at[targets[at[goes]]])
                out.append((end, rows, single))
            rows, node = rows[goes], targets[at[goes]]
            if not len(rows):
                break
            if end > start + 1 and (ends := piece_at[node] >= 0).any():
                out.append((end, rows[ends], piece_at[node[ends]]))
        yield start, out


def _by_length(words: list[str]) -> Iterator[np.ndarray]:
    sizes = np.array([len(w) for w in words])
    for n in np.unique(sizes):
        yield np.flatnonzero(sizes == n)


def word_scores(words: list[str], table: np.ndarray, path: str) -> np.ndarray:
    """Log-probability of each word in each language; 0 for ''. ``table``: a row per piece, one for unknown
    characters and a last row of zeros (number -1)."""
    out = np.zeros((len(words), table.shape[1]))
    longest = vocabulary(path)[1]
    for at in _by_length(words):
        some = [words[i] for i in at]
        if not some[0]:
            continue
        alpha, scale = np.zeros((len(some[0]) + 2, len(some), table.shape[1])), 0.0
        alpha[0] = 1
        for start, edges in _lattice(some, path):
            if start % STRIDE == STRIDE - 1:
                scale = scale + np.log(alpha[start])
                alpha[start : start + longest] /= alpha[start].copy()
            for end, rows, found in edges:
                alpha[end, rows] += alpha[start, rows] * table[found]
        out[at] = np.log(alpha[-1]) + scale
    return out


def _summed(edges: list[tuple[int, int, np.ndarray, np.ndarray]], size: int, places: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all paths from place 0 to each place (edges in order of their starts, with words and
    probabilities), and the logarithm by which each is to be scaled."""
    total, scale, done = np.zeros((places, size)), np.zeros((places, size)), 0
    total[0] = 1
    for start, end, rows, p in edges:
        if start != done:
            done = start
            if start % STRIDE == STRIDE - 1:
                scale[start:] += np.log(total[start])
                total[start : start + longest] /= total[start].copy()
        total[end, rows] += total[start, rows] * p
    return total, scale


def expected_counts(words: list[str], counts: np.ndarray, probabilities: np.ndarray, path: str) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words of one language."""
    total = np.zeros(len(probabilities))
    longest = vocabulary(path)[1]
    for at in _by_length(words):
        some, n = [words[i] for i in at], len(words[at[0]]) + 1
        edges = [(start, end, rows, found) for start, ends in _lattice(some, path) for end, rows, found in ends]
        uses = [probabilities[found] for *_, found in edges]
        alpha, left = _summed([(a, b, rows, p) for (a, b, rows, _), p in zip(edges, uses, strict=True)], len(some), n + 1, longest)
        mirrored = sorted(((n - b, n - a, rows, p) for (a, b, rows, _), p in zip(edges, uses, strict=True)), key=lambda e: e[0])
        beta, right = (x[::-1] for x in _summed(mirrored, len(some), n + 1, longest))
        whole = np.log(alpha[n]) + left[n]
        for (start, end, rows, found), p in zip(edges, uses, strict=True):
            scaled = np.exp(left[start, rows] + right[end, rows] - whole[rows])
            np.add.at(total, found, alpha[start, rows] * p * beta[end, rows] * scaled * counts[at[rows]])
    return total


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words, codes, starts = words_of(batch.column("text"))
        langs = batch.column("lang").dictionary_encode()
        sizes = np.diff(np.append(starts, len(codes)))
        both, n = np.unique(np.repeat(langs.indices.to_numpy(), sizes) * len(words) + codes, return_counts=True)
        kept = np.array([bool(w) for w in words])[both % len(words)]
        both, n = both[kept], n[kept]
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(both // len(words))), pa.array(words, pa.string()).take(pa.array(both % len(words))), pa.array(n)], names=["lang", "word", "n"])


def learn(labelled: DataFrame, path: str, sample_per_language: int = SAMPLE_PER_LANGUAGE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their piece probabilities, from rows of ``doc_id, text, lang``.

    What reaches the driver is one number per language and one per language and piece."""
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages, n_pieces = sorted(sizes), len(vocabulary(path)[0])
    if not languages:
        return [], np.zeros((n_pieces + 2, 0))
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, sample_per_language / sizes[lang]))))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20)
    sample = labelled.where(drawn).select("lang", "text").mapInArrow(_word_counts, "lang string, word string, n long")
    words = scratch_table(sample.groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    table = np.full((n_pieces + 2, len(languages)), 1 / n_pieces)
    table[-1] = 0
    for _ in range(rounds):
        now = table

        def expect(frames: Iterator[pd.DataFrame], now: np.ndarray = now) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for lang, part in frame.groupby("lang"):
                    found = expected_counts(part["word"].tolist(), part["n"].to_numpy(float), now[:, languages.index(lang)], path)
                    at = np.flatnonzero(found[:n_pieces])
                    yield pd.DataFrame({"lang": lang, "piece": at, "n": found[at]})

        sums = words.mapInPandas(expect, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        table = np.full((n_pieces + 2, len(languages)), SMOOTHING)
        for i, lang in enumerate(languages):
            part = sums[sums["lang"] == lang]
            table[part["piece"].to_numpy(), i] += part["n"].to_numpy()
        table = np.maximum(table / table[:n_pieces].sum(axis=0), FLOOR)
        table[n_pieces], table[-1] = FLOOR, 0
    return languages, table


def _predict(languages: list[str], table: np.ndarray, path: str, kept: list[str], text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        scores = np.empty((0, len(languages)))
        for batch in slices(batches, text, 1 << 20):
            words, codes, starts = words_of(batch.column(text))
            if len(memo) > MEMO:
                memo, scores = {}, scores[:0]
            new = [w for w in words if w not in memo]
            memo.update(zip(new, range(len(memo), len(memo) + len(new)), strict=True))
            if new and languages:
                scores = np.concatenate([scores, word_scores(new, table, path)])
            written = np.add.reduceat(np.array([bool(w) for w in words])[codes], starts, dtype=np.int64) > 0
            pred, best = np.full(batch.num_rows, UNDETERMINED, object), np.zeros(batch.num_rows)
            if languages:
                total = np.add.reduceat(scores[[memo[w] for w in words]][codes], starts, axis=0)
                total -= total.max(axis=1, keepdims=True)
                pred[written] = np.array(languages, object)[total.argmax(axis=1)][written]
                best[written] = 1 / np.exp(total).sum(axis=1)[written]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(pred, pa.string()), pa.array(best)], names=[*kept, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, path: str, sample_per_language: int = SAMPLE_PER_LANGUAGE, rounds: int = ROUNDS, keep: bool = False) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``doc_id, text, lang``; with ``keep`` the other
    input columns too (but for ones of these names, in any case)."""
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages, table = learn(labelled.select("doc_id", "text", "lang"), path, sample_per_language, rounds)
    names = [c for c in docs.columns if c.lower() not in ("held_out", "lang_pred", "score")] if keep else ["doc_id"]
    source = docs.select(*names) if keep else docs.select("doc_id", "text")
    fields = [T.StructField(f.name, f.dataType, True) for f in docs.schema if f.name in names]
    out = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    found = source.mapInArrow(_predict(languages, table, path, names, "text"), out)
    return found.select(*names, held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
