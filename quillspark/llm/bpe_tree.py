"""BPE encoding and decoding by tree concatenation (operator 3).

A text of ``long_text`` characters or more is cut every ``chunk`` characters, wherever that falls; the chunks are
encoded in parallel, each on its own, and neighbours are then joined level by level: a task of a level joins at most
``fan`` neighbouring parts, pairwise, and what it makes is one part of the next level. Where a cut fell
inside a word, a window of tokens on both sides of the join is re-encoded and grown until its outer tokens equal
those it replaces; since BPE by merge ranks is decided by pairs of neighbouring tokens, the joined sequence is
then the library's own. Words end where the library's pre-tokenizer ends them, so no window leaves its word.
Shorter texts are encoded where they lie, each distinct word of a task once.

Output per row: ``n_tokens``, ``ids`` (decimal, joined by one space) and ``decoded`` (what the library's
``decode(ids, skip_special_tokens=False)`` gives). Null text counts as empty: 0 tokens, empty strings.
Repeated rows and ids keep their rows; an empty table gives an empty result; other columns do not pass.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import cached_property, reduce
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from quillspark.llm.common import scratch_table, slices
from quillspark.llm.token_counts import BLANKS, LETTERS, NUMBERS, settled, special_strings

LONG_TEXT, CHUNK = 16_384, 4096
#: Neighbouring parts that one task of a level joins.
FAN = 64
#: Distinct words remembered per Python worker.
MEMO = 100_000
WORD_PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{BLANKS}{LETTERS}{NUMBERS}]+")


class WordBpe:
    """The library's tokenizer, opened up: words of a text, tokens of a word or of a chunk of one."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        self.path = path
        self.special = special_strings(path)
        self.ids_of_special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.names = {i: t for t, i in spec["model"]["vocab"].items()} | {i: t for t, i in self.ids_of_special.items()}

    def _model(self, **changes) -> Tokenizer:
        """The library's model alone: no normalizer, no pre-tokenizer, no added tokens."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        spec = json.load(open(self.path, encoding="utf-8"))
        return Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": None, "added_tokens": [], "model": spec["model"] | changes}))

    # each is loaded by the tasks that use it
    @cached_property
    def numerals(self) -> dict[int, str]:
        return {i: str(i) for i in self.names}

    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    @cached_property
    def whole(self) -> Tokenizer:
        return self._model()

    @cached_property
    def inner(self) -> Tokenizer:
        return self._model(end_of_word_suffix=None)

    @cached_property
    def bytes_of(self) -> pre_tokenizers.PreTokenizer:
        return pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    @cached_property
    def words_model(self) -> Tokenizer:
        model = self._model()
        model.pre_tokenizer = self.bytes_of
        return model

    def pieces(self, text: str) -> list[str | int]:
        """Words in order as strings, special tokens as their ids."""
        out: list[str | int] = []
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            out += self.words(text[at : m.start()])
            out.append(self.ids_of_special[m[0]])
            at = m.end()
        return out + self.words(text[at:]) if at or out else self.words(text)

    def words(self, text: str) -> list[str]:
        if settled(text) and settled(low := text.lower()):
            return WORD_PATTERN.findall(low)
        plain = self.library.normalizer.normalize_str(text)
        return [plain[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.words_model.encode_batch_fast(words, add_special_tokens=False)]

    def mapped(self, text: str) -> str:
        """One character per UTF-8 byte, as the vocabulary spells them."""
        return "".join(t for t, _ in self.bytes_of.pre_tokenize_str(text))

    def encode_chunk(self, mapped: str, last: bool) -> list[int]:
        return (self.whole if last else self.inner).encode(mapped, add_special_tokens=False).ids if mapped else []

    def spelled(self, ids: list[int], last: bool) -> str:
        text = "".join(self.names[i] for i in ids)
        return text.removesuffix(self.suffix) if last and self.suffix else text

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """Tokens of the joined text; ``last``: ``right`` ends its word."""
        if not left or not right:
            return left or right
        k = 4
        while True:
            a, b = left[-k:], right[:k]
            ends = k >= len(right)
            window = self.encode_chunk(self.spelled(a, False) + self.spelled(b, last and ends), last and ends)
            if (k >= len(left) or window[0] == a[0]) and (ends or window[-1] == b[-1]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            k *= 2

    def join_parts(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of two neighbouring parts of which the left one ends inside a word."""
        a = next((i for i in range(len(left), 0, -1) if self.ends_word(left[i - 1])), 0)
        b = next((i for i, t in enumerate(right, 1) if self.ends_word(t)), len(right))
        last = b > 0 and self.ends_word(right[b - 1])
        return left[:a] + self.join(left[a:], right[:b], last) + right[b:]

    def ends_word(self, token: int) -> bool:
        name = self.names[token]
        return name.endswith(self.suffix) or name in self.ids_of_special

    def join_all(self, parts: list[tuple[list[int], bool]]) -> list[int]:
        """Parts (tokens, and whether the part ends inside a word) joined pairwise, level by level."""
        while len(parts) > 1:
            pairs = [parts[i : i + 2] for i in range(0, len(parts), 2)]
            parts = [((self.join_parts(p[0][0], p[1][0]) if p[0][1] else p[0][0] + p[1][0]), p[1][1]) if len(p) == 2 else p[0] for p in pairs]
        return parts[0][0] if parts else []


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One per Python worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


SCHEMA = "doc_id long, n_tokens long, ids string, decoded string"


def _encode(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        ids: dict[str | int, str] = {}
        names: dict[str | int, str] = {}
        for batch in slices(batches, "text", 1 << 20):
            rows = [bpe.pieces(t or "") for t in batch.column("text").to_pylist()]
            if len(ids) > MEMO:
                ids, names = {}, {}
            new = list({w for row in rows for w in row if w not in ids})
            words = [w for w in new if isinstance(w, str)]
            for w, found in [*zip(words, bpe.encode_words(words), strict=True), *((w, [w]) for w in new if not isinstance(w, str))]:
                ids[w] = " ".join(map(str, found))
                names[w] = " ".join(map(bpe.names.__getitem__, found))
            joined = [" ".join(map(ids.__getitem__, row)) for row in rows]
            decoded = [" ".join(map(names.__getitem__, row)) for row in rows]
            counts = [x.count(" ") + 1 if x else 0 for x in joined]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(joined, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return run


PARTS = "row long, doc_id long, part int, n_parts int, text string, kind int"
ENCODED = "row long, doc_id long, part int, n_parts int, kind int, tokens array<int>"
#: Kinds of parts: one that ends with a word's end, one that ends inside a word, a special token's number.
CLOSED, OPEN, SPECIAL = range(3)


def cut(pieces: list[str | int], chunk: int) -> Iterator[tuple[str, int]]:
    """Parts of ``chunk`` characters, words joined by spaces; a cut falls where it falls. Never none at all."""
    if not pieces:
        yield "", CLOSED
    for special, run in groupby(pieces, lambda piece: isinstance(piece, int)):
        words = list(run)
        if special:
            yield from ((str(piece), SPECIAL) for piece in words)
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        first, kept = 0, 0  # the word that a part begins in, and how much of it went before
        for at in range(chunk, int(ends[-1]) + chunk, chunk):
            last = min(int(np.searchsorted(ends, at)), len(words) - 1)
            inside = at < ends[last]
            part = words[first : last + 1]
            size = len(words[last]) - int(ends[last] - at) if inside else len(words[last])
            part[-1] = part[-1][:size]
            part[0] = part[0][kept:]
            yield " ".join(part), OPEN if inside else CLOSED
            first, kept = (last, size) if inside else (last + 1, 0)


def _parts(path: str, chunk: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for frame in frames:
            for row, doc_id, text in zip(frame["row"], frame["doc_id"], frame["text"], strict=True):
                parts = list(cut(bpe.pieces(text), chunk))
                yield pd.DataFrame({"row": row, "doc_id": doc_id, "part": range(len(parts)), "n_parts": len(parts), "text": [t for t, _ in parts], "kind": [k for _, k in parts]}).astype({"doc_id": "Int64"})

    return run


def _encode_parts(path: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        known: dict[str, list[int]] = {}
        for frame in frames:
            parts = [t.split(" ") if t and k != SPECIAL else [] for t, k in zip(frame["text"], frame["kind"], strict=True)]
            tails = [words.pop() if k == OPEN else "" for words, k in zip(parts, frame["kind"], strict=True)]
            if len(known) > MEMO:
                known = {}
            new = list({w for words in parts for w in words if w not in known})
            known.update(zip(new, bpe.encode_words(new), strict=True))
            tokens = [[int(t)] if k == SPECIAL else list(chain.from_iterable(map(known.__getitem__, words))) + bpe.encode_chunk(bpe.mapped(tail), False) for t, k, words, tail in zip(frame["text"], frame["kind"], parts, tails, strict=True)]
            yield frame[["row", "doc_id", "part", "n_parts", "kind"]].assign(tokens=tokens)

    return run


def _join_parts(path: str, fan: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Neighbouring parts of a row as one part of the next level; it ends as its last part does."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        tokens = load(path).join_all([(t.tolist(), k == OPEN) for t, k in zip(frame["tokens"], frame["kind"], strict=True)])
        last = frame.iloc[[-1]][["row", "doc_id", "part", "n_parts", "kind"]]
        return last.assign(part=last["part"] // fan, n_parts=-(-last["n_parts"] // fan), tokens=[tokens]).astype({"doc_id": "Int64"})

    return run


def _spell(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for i in range(batch.num_rows):  # long texts: a batch each
                found = batch.column("tokens")[i].as_py()
                made = [pa.array([len(found)], pa.int64()), *(pa.array([" ".join(map(of.__getitem__, found))], pa.string()) for of in (bpe.numerals, bpe.names))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), *made], names=["doc_id", "n_tokens", "ids", "decoded"])

    return run


def joined_rows(parts: DataFrame, tokenizer_path: str, fan: int = FAN) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` from encoded parts, a written table of ``ENCODED``.

    Each level is a shuffle of the rows that still have parts, and is written: a row of few parts is done after one
    level and moves no more, and a lost executor costs tasks of one level."""
    most = parts.agg(F.max("n_parts")).first()[0] or 0
    done = [parts.where("n_parts = 1")]
    while most > 1:
        groups = parts.where("n_parts > 1").groupBy("row", F.floor(F.col("part") / fan).alias("group"))
        parts = scratch_table(groups.applyInPandas(_join_parts(tokenizer_path, fan), ENCODED), "bpe-level")
        done.append(parts.where("n_parts = 1"))
        most = -(-most // fan)
    whole = reduce(DataFrame.unionByName, done)
    return whole.select("doc_id", "tokens").mapInArrow(_spell(tokenizer_path), SCHEMA)


def encode_decode(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", long_text: int = LONG_TEXT, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` for every row; see the module for the two ways."""
    if fan < 2:
        raise ValueError("a level joins two parts or more")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    long = F.coalesce(F.length("text") >= long_text, F.lit(False))
    usual = source.where(~long).mapInArrow(_encode(tokenizer_path), SCHEMA)
    parts = (
        source.where(long)
        .withColumn("row", F.monotonically_increasing_id())
        .mapInPandas(_parts(tokenizer_path, chunk), PARTS)
        .repartition("row", "part")
        .mapInPandas(_encode_parts(tokenizer_path), ENCODED)
    )
    return usual.unionByName(joined_rows(scratch_table(parts, "bpe-parts"), tokenizer_path, fan))
