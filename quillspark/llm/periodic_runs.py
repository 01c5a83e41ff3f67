"""Periodic runs of words, proposed by a dictionary of basic factors.

A run is a stretch of words with smallest period q, at least two periods long, that no neighbouring word extends. The
dictionary names the factors of each power-of-two length L of a document so that equal ones have one name, longer names
from pairs of shorter ones. A run of period p, L <= p < 2L, holds a factor of length L at some place i and at i + p.
Occurrences of a factor within 2L of one another form few arithmetic progressions, so each place needs only be compared
with the next occurrence and with the ends of the progressions that follow; each such distance from L to 2L proposes a
period, which is extended word by word and kept where it reaches twice its length. A multiple of a run's period gives
the same stretch; the least period of a stretch is the run's.

A factor can only recur where its halves do, so names are kept for recurring factors alone: in ordinary text few are
left at length four. Documents are handled where they lie, many to an array, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import slices

#: Words of the shortest run.
LEAST = 12
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _ranks(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose key occurs again, and a name for each, sorted by name and then by place."""
    order = np.argsort(keys, kind="stable")
    keys, places = keys[order], places[order]
    new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    name = np.cumsum(new) - 1
    again = np.bincount(name)[name] > 1
    return places[again], name[again]


def _proposals(places: np.ndarray, names: np.ndarray, name_at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods from ``size`` to twice that, of occurrences sorted by name and place. Two of one progression
    propose nothing but its own step: a longer distance is a multiple of it. A place inside a progression only starts a
    run of a longer period if all of the period recurs, which two factors of ``size`` words show."""
    n = len(places)
    gap = np.where(names[1:] == names[:-1], np.diff(places), 2 * size)
    turns = (gap[1:] != gap[:-1]) | (gap[1:] > size)
    progression = np.cumsum(np.append(True, turns))  # of each gap
    inside = np.zeros(n, bool)
    inside[1:-1] = ~turns
    end_at = np.append(np.where(inside, n, np.arange(n)), n)
    end_at = np.minimum.accumulate(end_at[::-1])[::-1]
    at, to = np.arange(n - 1), np.arange(1, n)
    start, period = [], []
    while len(at):
        apart = places[to] - places[at]
        near = (names[to] == names[at]) & (apart < 2 * size)
        at, to, apart = at[near], to[near], apart[near]
        fits = (apart >= size) & ((to == at + 1) | (progression[at] != progression[to - 1]))
        i, p = places[at[fits]], apart[fits]
        square = name_at[i + p - size] == name_at[np.minimum(i + 2 * p - size, len(name_at) - 1)]
        fine = ~inside[at[fits]] | square & (name_at[i + p - size] >= 0)
        start.append(i[fine])
        period.append(p[fine])
        to = end_at[to + 1]
        at, to = at[to < n], to[to < n]
    return (np.concatenate(start), np.concatenate(period)) if start else (np.empty(0, np.int64), np.empty(0, np.int64))


def _equal_ahead(x: np.ndarray, a: int, b: int) -> int:
    """How many words from ``a`` on equal those from ``b`` on (a < b)."""
    done, step = 0, 32
    while b + done < len(x):
        step = min(step, len(x) - b - done)
        differ = np.flatnonzero(x[a + done : a + done + step] != x[b + done : b + done + step])
        if len(differ):
            return done + int(differ[0])
        done, step = done + step, 2 * step
    return done


def _equal_before(x: np.ndarray, a: int, b: int) -> int:
    """How many words before ``a`` equal those before ``b`` (a < b)."""
    done, step = 0, 32
    while done < a:
        step = min(step, a - done)
        differ = np.flatnonzero(x[a - done - step : a - done] != x[b - done - step : b - done])
        if len(differ):
            return done + step - 1 - int(differ[-1])
        done, step = done + step, 2 * step
    return done


def runs(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of ``least`` words or more, sorted by start and then by period. Words
    are numbers; documents put one after the other are parted by numbers that occur once."""
    found: dict[tuple[int, int], int] = {}
    places, names = _ranks(words, np.arange(len(words)))
    size = 1
    while len(places):
        name_at = np.full(len(words) + size, -1, np.int64)
        name_at[places] = names
        start, period = _proposals(places, names, name_at, size)
        order = np.lexsort((start, period))
        start, period = start[order], period[order]
        first = np.append(True, (np.diff(start) != 1) | (np.diff(period) != 0))[: len(start)]  # neighbours extend to one stretch
        reached: dict[int, int] = {}
        for i, p in zip(start[first].tolist(), period[first].tolist(), strict=True):
            if i < reached.get(p, -1):
                continue
            a, b = i - _equal_before(words, i, i + p), i + p + _equal_ahead(words, i, i + p)
            reached[p] = b - p
            if b - a >= max(least, 2 * p):
                found[a, b] = min(p, found.get((a, b), p))
        places = np.sort(places)
        places = places[name_at[places + size] >= 0]
        places, names = _ranks(name_at[places] * len(words) + name_at[places + size], places)
        size *= 2
    return sorted((a, b - a, p) for (a, b), p in found.items())


def _of_batch(batch: pa.RecordBatch, least: int) -> pa.RecordBatch:
    texts = pc.fill_null(batch.column("text"), "")
    split = pc.split_pattern_regex(texts, "[ \t-\r]+")
    filled = pc.not_equal(split.values, "")
    row = pc.list_parent_indices(split).to_numpy()[filled.to_numpy(zero_copy_only=False)]
    values = split.values.filter(filled)
    n_words = np.bincount(row, minlength=len(batch)).astype(np.int64)
    ends = np.cumsum(n_words)
    # a word's number holds its document, and a number of its own stands after each document
    code = values.dictionary_encode().indices.to_numpy().astype(np.int64) * len(batch) + row
    marks = np.arange(len(batch)) - len(batch)
    words = np.insert(code, ends, marks)
    first = ends - n_words
    begins = first + np.arange(len(batch))
    lost = np.zeros(len(words) + 1, np.int64)
    each = runs(words, least)
    for start, length, period in each:
        lost[start + period] += 1
        lost[start + length] -= 1
    kept = np.delete(np.cumsum(lost)[:-1] == 0, ends + np.arange(len(batch)))
    left = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=len(batch)))]).astype(np.int32)
    collapsed = pc.binary_join(pa.ListArray.from_arrays(left, values.filter(pa.array(kept))), " ")
    start = np.array([x[0] for x in each], np.int64)
    of = np.searchsorted(begins, start, "right") - 1
    fields = [start - begins[of] if len(each) else start, *(np.array([x[k] for x in each], np.int64) for k in (1, 2))]
    counts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(batch)))]).astype(np.int32)
    found = pa.ListArray.from_arrays(counts, pa.StructArray.from_arrays([pa.array(f) for f in fields], fields=list(RUN)))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), found, collapsed], ["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of ``docs(doc_id, text)``, one row per row: the runs (``start, length,
    period``, in words, sorted) and the text, its words parted by one space, without what runs repeat: a word goes if a
    run holds it after that run's first period.

    Null and empty texts have no word and no run; rows that share an id are judged each alone; an empty table gives
    none; other columns are not looked at. A text is held whole by one task, whose memory grows with its words."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield _of_batch(part, least)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def longest(found: Column) -> Column:
    """The run of greatest length; of equals the one of the smallest start, then period. Null if there is none."""
    key = F.transform(found, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"), r.alias("run")))
    return F.array_min(key)["run"]
