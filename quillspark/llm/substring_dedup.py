"""Substring dedup with compressed FM-index shards (operator 6).

Every window of ``WINDOW`` words has one minimizer (its least hash of ``GRAM`` words, the leftmost on ties),
so equal windows share it. Consecutive windows of a document with the same minimizer are a region; regions
are dealt to shards by minimizer, which sends all places of a window to one shard and lets each document be
searched in the shards of its own regions only. A region whose minimizer occurs once holds no repeat. Of all others
each distinct content is indexed once, with the number of its places: a shard builds an FM-index over its contents, sums
their places up in the order of suffixes, and streams the contents through backward search, reporting the windows of
which an interval holds two places or more. Whatever is removed was found there.

A minimizer with more than ``CROWD`` distinct contents (a passage in very many surroundings) does not fit a shard:
its contents are cut into their windows, and each distinct window, with the number of its places, is indexed and searched
in a shard dealt by a hash of the window, so that no shard grows with a passage's frequency.

Words are runs without space and 0x09 to 0x0D, compared unchanged. Defined results: a null text has no words;
windows repeat across rows and within one row; repeated rows repeat each other; texts shorter than a window
lose nothing; empty tables give empty results. Input columns pass, but for ``n_words`` and ``n_removed``,
which are replaced; ``text`` becomes the kept words joined by one space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import fresh, scratch_table, slices
from quillspark.llm.fm_index import FmIndex, repeated_windows

WINDOW, GRAM = 35, 8
#: Distinct contents in a shard, and of one minimizer before its windows are dealt one by one.
SHARD, CROWD = 16_384, 8_192
LEAST_ID = -(1 << 63)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


# -- words and hashes -----------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


BASE_BYTE, BASE_HIGH, BASE_WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
INVERSE_WORD = pow(BASE_WORD, -1, 1 << 64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of all texts, in order, and where each text's words begin (one more at the
    end)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    word = ~_SPACE[data]
    before = np.concatenate([[False], word[:-1]])
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(word & ~before)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.empty(0, np.uint64), bounds
    at = np.arange(len(data)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(data)]))
    value = (data.astype(np.uint64) + np.uint64(1)) * _powers(BASE_BYTE, 1 << 16)[at & 0xFFFF]
    if at.max() > 0xFFFF:
        value *= _powers(BASE_HIGH, int(at.max() >> 16) + 1)[at >> 16]
    value[~word] = 0
    return _mix(np.add.reduceat(value, starts)), bounds


def regions(hashes: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Regions of all texts: ``text`` number, ``first`` window (word number in its text), ``windows`` in a row,
    ``minimizer`` and ``content`` hash."""
    n = len(hashes)
    none = {k: np.empty(0, np.int64) for k in ("text", "first", "windows", "minimizer", "content")}
    if n < WINDOW:
        return none
    powers, inverse = _powers(BASE_WORD, n + 1), _powers(INVERSE_WORD, n + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:n], dtype=np.uint64)])
    between = lambda a, b: _mix((prefix[b] - prefix[a]) * inverse[a])
    grams = n - GRAM + 1
    gram = between(np.arange(grams), np.arange(grams) + GRAM)
    # least gram of each window, by doubling: 1, 2, 4, 8, 16 and twice 16 for 28
    width, span = WINDOW - GRAM + 1, 1
    place = np.arange(grams)

    def lesser(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(gram[b] < gram[a], b, a)

    while 2 * span <= width:
        place = lesser(place[:-span], place[span:])
        span *= 2
    place = lesser(place[: len(place) - (width - span)], place[width - span :])
    starts = np.arange(len(place))
    text = np.searchsorted(bounds, starts, "right") - 1
    inside = starts + WINDOW <= bounds[text + 1]
    starts, text, place = starts[inside], text[inside], place[inside]
    if not len(starts):
        return none
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    windows = np.diff(np.append(new, len(starts)))
    first = starts[new]
    content = between(first, first + windows + WINDOW - 1)
    content = _mix(content + (place[new] - first).astype(np.uint64))
    return {"text": text[new], "first": first - bounds[text[new]], "windows": windows, "minimizer": gram[place[new]].view(np.int64), "content": content.view(np.int64)}


# -- tasks ----------------------------------------------------------------------------------------

REGION = "minimizer long, content long, id long, print long, first int, windows int"


def _region_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 2 << 20):
        found = regions(*word_hashes(batch.column("text")))
        at = pa.array(found["text"])
        columns = [pa.array(found["minimizer"]), pa.array(found["content"]), batch.column("id").take(at), batch.column("print").take(at), pa.array(found["first"].astype(np.int32)), pa.array(found["windows"].astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=["minimizer", "content", "id", "print", "first", "windows"])


def _content_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of the wanted regions of each text."""
    for batch in slices(batches, "text", 2 << 20):
        hashes, bounds = word_hashes(batch.column("text"))
        wanted = batch.column("wanted")
        rows = pc.list_parent_indices(wanted).to_numpy()
        each = wanted.flatten()
        first, windows = each.field("first").to_numpy() + bounds[rows], each.field("windows").to_numpy()
        words = [hashes[a : a + n + WINDOW - 1].tobytes() for a, n in zip(first.tolist(), windows.tolist(), strict=True)]
        columns = [each.field("minimizer"), each.field("content"), each.field("n"), pa.array(words, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["minimizer", "content", "n", "words"])


def _search_shard(frame: pd.DataFrame) -> pd.DataFrame:
    """Masks of repeated windows of the shard's contents, each of which stands for ``n`` places."""
    parts = [np.frombuffer(w, np.uint64) for w in frame["words"]]
    lengths = np.array([len(p) for p in parts])
    index = FmIndex(np.concatenate(parts), lengths, 2 * WINDOW - GRAM + 1, frame["n"].to_numpy())
    masks = repeated_windows(index, np.arange(len(parts)), lengths, WINDOW)
    return frame[["minimizer", "content"]].assign(mask=masks)


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of each content: where it lies, its two hashes and its words."""
    for batch in slices(batches, "words", 1 << 18):
        parts = [np.frombuffer(w, np.uint64) for w in batch.column("words").to_pylist()]
        runs = np.concatenate([np.lib.stride_tricks.sliding_window_view(p, WINDOW) for p in parts])
        sizes = [len(p) - WINDOW + 1 for p in parts]
        first = _mix((runs * _powers(BASE_WORD, WINDOW)).sum(axis=1, dtype=np.uint64)).view(np.int64)
        second = _mix((_mix(runs) * _powers(BASE_BYTE, WINDOW)).sum(axis=1, dtype=np.uint64)).view(np.int64)
        place = np.arange(len(runs)) - np.repeat(np.cumsum([0, *sizes])[:-1], sizes)
        named = [pa.array(np.repeat(batch.column(c).to_numpy(), sizes)) for c in ("minimizer", "content", "n")]
        words = pa.array([run.tobytes() for run in runs], pa.binary())
        yield pa.RecordBatch.from_arrays([*named, pa.array(place), pa.array(first), pa.array(second), words], names=["minimizer", "content", "n", "place", "h1", "h2", "words"])


def _rewrite(kept: list[str], text: str, found: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            out, n_words, n_removed = [], [], []
            for value, hits in zip(batch.column(text).to_pylist(), batch.column(found), strict=True):
                words = (value or "").encode().split()
                n_words.append(len(words))
                if hits.is_valid:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for hit in hits.as_py():
                        windows = np.flatnonzero([hit["mask"] >> i & 1 for i in range(hit["windows"])]) + hit["first"]
                        np.add.at(gone, windows, 1)
                        np.add.at(gone, windows + WINDOW, -1)
                    words = [w for w, g in zip(words, np.cumsum(gone), strict=False) if not g]
                n_removed.append(n_words[-1] - len(words))
                out.append(b" ".join(words).decode())
            columns = [pa.array(out, pa.string()) if c == text else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[*kept, "n_words", "n_removed"])

    return run


# -- the operator ---------------------------------------------------------------------------------


def _contents_with_words(source: DataFrame, contents: DataFrame) -> DataFrame:
    """Add the word hashes of each distinct content, cut out of the one document that stands for it."""
    wanted = contents.select("place.id", "place.print", F.struct("minimizer", "content", "n", "place.first", "place.windows").alias("w")).groupBy("id", "print").agg(F.collect_list("w").alias("wanted"))
    # rows that share id and text would each answer: one is enough
    named = source.select("id", "print", "text").join(wanted, ["id", "print"]).select("text", "wanted")
    return named.mapInArrow(_content_rows, "minimizer long, content long, n long, words binary")


def _searched(contents: DataFrame, deal: str, shard: int) -> DataFrame:
    """``minimizer, content, mask`` of contents (``minimizer, content, n, words``), from shards dealt by the column
    ``deal``."""
    n_shards = -(-contents.count() // shard) or 1
    shards = contents.select("minimizer", "content", "n", "words", F.pmod(F.xxhash64(deal), F.lit(n_shards)).alias("shard"))
    return shards.groupBy("shard").applyInPandas(lambda frame: _search_shard(frame), "minimizer long, content long, mask long")


def _crowd_masks(words: DataFrame, shard: int) -> DataFrame:
    """``minimizer, content, mask`` of the contents of crowded minimizers, window by window."""
    places = scratch_table(words.mapInArrow(_window_rows, "minimizer long, content long, n long, place long, h1 long, h2 long, words binary"), "windows")
    windows = places.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.first("words").alias("words"))
    windows = scratch_table(windows.select(F.col("h1").alias("minimizer"), F.col("h2").alias("content"), "n", "words"), "distinct-windows")
    again = _searched(windows, "minimizer", shard).where("mask <> 0").select(F.col("minimizer").alias("h1"), F.col("content").alias("h2"))
    hit = places.select("minimizer", "content", "place", "h1", "h2").join(scratch_table(again, "repeated-windows"), ["h1", "h2"])
    return hit.groupBy("minimizer", "content").agg(F.expr("bit_or(shiftleft(1L, cast(place as int)))").alias("mask"))


def repeated_hits(source: DataFrame, shard: int = SHARD, crowd: int = CROWD) -> DataFrame:
    """``id, print, first, windows, mask``: regions with repeated windows, of ``id, print, text`` rows."""
    found = scratch_table(source.mapInArrow(_region_rows, REGION), "regions")
    counts = found.groupBy("minimizer").agg(F.count("*").alias("places")).where("places > 1")
    # as a written table the counts are dealt anew for the join, so that a frequent minimizer's rows can be split
    counts = scratch_table(counts.select("minimizer"), "minimizers")
    found = scratch_table(found.join(counts, "minimizer"), "shared-regions")
    contents = found.groupBy("minimizer", "content").agg(F.count("*").alias("n"), F.min(F.struct("id", "print", "first", "windows")).alias("place"))
    contents = scratch_table(contents, "contents")
    # the same content may be cut out of equal rows more than once
    words = scratch_table(_contents_with_words(source, contents).dropDuplicates(["minimizer", "content"]), "content-words")
    crowded = scratch_table(contents.groupBy("minimizer").agg(F.count("*").alias("size")).where(F.col("size") > crowd).select("minimizer"), "crowded")
    masks = _searched(words.join(crowded, "minimizer", "left_anti"), "minimizer", shard)
    if crowded.count():
        masks = masks.unionByName(_crowd_masks(words.join(crowded, "minimizer", "left_semi"), shard))
    masks = scratch_table(masks.where("mask <> 0"), "masks")
    return found.join(masks, ["minimizer", "content"]).select("id", "print", "first", "windows", "mask")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard: int = SHARD, crowd: int = CROWD) -> DataFrame:
    """The documents with every word of a repeated window removed, ``n_words`` before and ``n_removed``."""
    kept = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed")]
    id_name, print_name, hits_name = fresh(docs.columns, "_id", "_print", "_hits")
    key = (F.coalesce(F.col(doc_id).cast("long"), F.lit(LEAST_ID)), F.xxhash64(F.col(text)))
    source = docs.select(key[0].alias("id"), key[1].alias("print"), F.col(text).cast("string").alias("text"))
    hits = repeated_hits(source, shard, crowd).distinct().groupBy("id", "print").agg(F.collect_list(F.struct("first", "windows", "mask")).alias(hits_name))
    hits = hits.withColumnsRenamed({"id": id_name, "print": print_name})
    joined = docs.select(*kept, key[0].alias(id_name), key[1].alias(print_name)).join(hits, [id_name, print_name], "left").select(*kept, hits_name)
    fields = [T.StructField(f.name, f.dataType, True) for f in docs.schema if f.name in kept]
    out = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.mapInArrow(_rewrite(kept, text, hits_name), out)
