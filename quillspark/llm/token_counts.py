"""Token counts without token ids (operator 2).

Texts are cut into blocks; a block holds its distinct pre-tokens once and, per document, how often each
occurs (sorted codes as gaps); only pre-tokens that the vocabulary holds as one piece are summed at once. The blocks' pre-tokens are dealt and sorted by pre-token, so each distinct one
of the whole table is encoded once (by ``BLOCKS_TOGETHER`` blocks, if there are more than that); piece counts go
back packed per block and are joined to the block's frequencies, where frequency times count is summed. A frequent
pre-token is one small row per block, so no key grows with its occurrences, and the blocks dealt together bound the
rows of one pre-token in a task.

Results equal the tokenizer library's ``encode(text, add_special_tokens=False)``: special strings inside a
text count as one token, as is the library's default. A null text counts as empty (0 bytes, 0 tokens);
repeated rows and repeated ids each keep their row; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import scratch_table, slices

# Code points whose classes are settled for long: Latin letters, digits, signs and general punctuation.
# Texts made of these take the compiled pattern; all others take the library's own pre-tokenizer.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
BLANKS = r"\t-\r \x85\xa0"
OTHER_RANGE = re.compile("[^\x00-ɏ‐-‧‰-⁞]")
BYTE_PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{BLANKS}{LETTERS}{NUMBERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")
BLOCK_BYTES = 12 << 20
#: Piece counts packed together on their way back to the blocks.
ROWS_PACKED = 1 << 17
#: Blocks (of up to BLOCK_BYTES) whose rows of one pre-token may meet in one task.
BLOCKS_TOGETHER = 1 << 16
#: A block's tokens and frequencies: see ``pack``.
BLOCK = "block long, tokens array<string>, docs array<long>, n_bytes array<long>, known array<long>, gaps binary, freqs binary"


def settled(text: str) -> bool:
    return text.isascii() or OTHER_RANGE.search(text) is None


def special_strings(path: str) -> re.Pattern | None:
    """The added tokens that the library finds inside texts, longest first."""
    added = [t["content"] for t in json.load(open(path, encoding="utf-8")).get("added_tokens", [])]
    return re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None


def pre_tokenizer(path: str) -> Callable[[str], list[str]]:
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path).pre_tokenizer

    def split(text: str) -> list[str]:
        if settled(text):
            return BYTE_PATTERN.findall(text)
        return [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)]

    return split


def counting_model(path: str):
    """The library's tokenizer for strings that are pre-tokens already."""
    from tokenizers import Tokenizer, pre_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    model = Tokenizer.from_file(path)
    model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    model.encode_special_tokens = True
    return model


@lru_cache(maxsize=2)
def single_pieces(path: str) -> frozenset[str]:
    """Pre-tokens that are one piece, as far as the vocabulary spells them (its size bounds the set)."""
    model = counting_model(path)
    texts = [t for t in (model.decode([i], skip_special_tokens=False) for i in range(model.get_vocab_size(with_added_tokens=False))) if "\ufffd" not in t]
    return frozenset(t for t, e in zip(texts, model.encode_batch_fast(texts, add_special_tokens=False), strict=True) if len(e.ids) == 1)


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, as many as the largest needs; the first byte says how many."""
    planes = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([planes]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<i8").reshape(-1)


def _blocks(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("block", pa.int64()), ("tokens", pa.list_(pa.string())), ("docs", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("known", pa.list_(pa.int64())), ("gaps", pa.binary()), ("freqs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, special, single = pre_tokenizer(path), special_strings(path), single_pieces(path)
        block = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", BLOCK_BYTES):
            codes: dict[str, int] = {}
            rows, sizes, known = [], [], []
            for scalar in batch.column("text"):
                text = scalar.as_py() or ""
                sizes.append(len(text.encode()))
                parts = special.split(text) if special else [text]
                seen = Counter(split(parts[0]))
                for part in parts[1:]:
                    seen.update(split(part))
                rest = {k: n for k, n in seen.items() if k not in single}
                known.append(len(parts) - 1 + seen.total() - sum(rest.values()))
                row = np.fromiter((codes.setdefault(k, len(codes)) for k in rest), np.int32, len(rest))
                order = np.argsort(row)
                rows.append((row[order], np.fromiter(rest.values(), np.int32, len(rest))[order]))
            # one ascending sequence of document * width + code, kept as gaps
            width = max(1, len(codes))
            keys = np.concatenate([np.empty(0, np.int64), *(i * width + c.astype(np.int64) for i, (c, _) in enumerate(rows))])
            gaps = pack(np.diff(keys, prepend=-1) - 1)
            freqs = pack(np.concatenate([np.empty(0, np.int32), *(f for _, f in rows)]))
            del keys, rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([list(codes)], pa.list_(pa.string())), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([known], pa.list_(pa.int64())), pa.array([gaps], pa.binary()), pa.array([freqs], pa.binary())],
                schema=schema,
            )
            block += 1

    return run


def _piece_counts(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by token: each distinct one is encoded once, and its count goes back to the blocks that
    hold it, packed per block."""

    def packed(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        block, code, n = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((code, block))
        block, code, n = block[order], code[order], n[order]
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        parts = [(pack(np.diff(c, prepend=0)), pack(k)) for c, k in zip(np.split(code, starts[1:]), np.split(n, starts[1:]), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(block[starts]), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())], names=["block", "codes", "pieces"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counting_model(path)
        known: dict[str, int] = {}
        rows, held = [], 0
        for batch in slices(batches, "token", 1 << 20):
            coded = batch.column("token").dictionary_encode()
            tokens = coded.dictionary.to_pylist()
            new = [t for t in tokens if t not in known]
            found = dict(zip(new, (len(e) for e in model.encode_batch_fast(new, add_special_tokens=False)), strict=True))
            counts = np.array([found[t] if t in found else known[t] for t in tokens])
            known = {tokens[-1]: int(counts[-1])}  # a token's rows may go on in the next batch
            rows.append((batch.column("block").to_numpy(), batch.column("code").to_numpy().astype(np.int64), counts[coded.indices.to_numpy()]))
            held += batch.num_rows
            if held >= ROWS_PACKED:
                yield packed(rows)
                rows, held = [], 0
        if rows:
            yield packed(rows)

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in ("docs", "n_bytes", "known", "gaps", "freqs", "counts", "width")}
            docs = row["docs"].values
            width = row["width"].as_py()
            pieces = np.zeros(max(1, width), np.int64)
            for part in row["counts"].as_py() or ():
                pieces[np.cumsum(unpack(part["codes"]))] = unpack(part["pieces"])
            keys = np.cumsum(unpack(row["gaps"].as_py()) + 1) - 1
            n = np.zeros(len(docs), np.int64)
            np.add.at(n, keys // max(1, width), unpack(row["freqs"].as_py()) * pieces[keys % max(1, width)])
            total = pa.array(n + row["known"].values.to_numpy(), pa.int64())
            yield pa.RecordBatch.from_arrays([docs, row["n_bytes"].values, total], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", together: int = BLOCKS_TOGETHER) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for every row, counted by a byte-level BPE of the tokenizers library.

    ``tokenizer_path`` must exist on every executor, as the library itself must."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    blocks = scratch_table(source.mapInArrow(_blocks(tokenizer_path), BLOCK), "token-blocks")
    part = F.pmod(F.xxhash64("block"), F.lit(-(-blocks.count() // together) or 1))
    tokens = blocks.select("block", F.posexplode("tokens").alias("code", "token")).repartition("token", part).sortWithinPartitions("token")
    pieces = tokens.mapInArrow(_piece_counts(tokenizer_path), "block long, codes binary, pieces binary")
    counts = pieces.groupBy("block").agg(F.collect_list(F.struct("codes", "pieces")).alias("counts"))
    rows = blocks.select("block", "docs", "n_bytes", "known", "gaps", "freqs", F.size("tokens").alias("width"))
    return rows.join(counts, "block", "left").mapInArrow(_sums, "doc_id long, n_bytes long, n_tokens long")
