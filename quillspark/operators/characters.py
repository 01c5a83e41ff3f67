"""Characters: alignments, confusions, vocabularies, frame collapse."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf, udtf

from quillspark.functions.accuracy import distance, numbered
from quillspark.functions.text import chars
from quillspark.operators.arrow import group_rows

#: Lower-case North Sámi letters with diacritics; upper-case ones follow from them (fixed values).
TRACKED_LOWER = "áčđŋšŧž"


#: Cells and rows of the tables filled at once, characters read at once, and rows of a long table between two that are kept.
CELLS, ROWS, CHARS, STEP = 1 << 23, 1024, 1 << 20, 512
BEYOND = 1 << 30
#: Entries of the table of the characters that rows hold, and places by which parts of a row are moved to see if they fit.
ENTRIES, MOVED = 1 << 21, 8


def align(reference: str, prediction: str) -> list[tuple[str, str]]:
    """Pairs of characters, '' for a gap: of equally cheap steps back the diagonal comes first, then an
    insertion, then a deletion."""
    _, _, ref, pred = _aligned([reference], [prediction])
    return list(zip(ref.tolist(), pred.tolist(), strict=True))


class _Align:
    def eval(self, reference: str, prediction: str) -> Iterator[tuple[int, str, str]]:
        for pos, (a, b) in enumerate(align(reference or "", prediction or "")):
            yield pos, a, b


def register_table_function(spark: SparkSession, name: str = "align_chars") -> None:
    """``name(reference, prediction)`` for SQL: a row (pos, ref_char, pred_char) per pair, joined laterally."""
    spark.udtf.register(name, udtf(_Align, returnType="pos int, ref_char string, pred_char string"))


class _AlignBatches:
    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, references, predictions in _slices([rows]):
            row, pos, ref, pred = align_codes(*_codes(references), *_codes(predictions))
            own = [part.column(c).take(pa.array(row)) for c in ("model", "id")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(pos.astype(np.int32)), _as_letters(ref), _as_letters(pred)], ["model", "id", "pos", "ref_char", "pred_char"])


def register_batch_function(spark: SparkSession, name: str = "align_rows") -> None:
    """``name(TABLE(...) PARTITION BY ...)`` for SQL: rows (model, id, pos, ref_char, pred_char) for a table of rows (model,
    id, reference, prediction), aligned an Arrow batch at a time. How the table is partitioned says only which rows meet in
    a task; a partition is read in batches and never held."""
    spark.udtf.register(name, arrow_udtf(_AlignBatches, returnType="model string, id long, pos int, ref_char string, pred_char string"))


class _CountBatches:
    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield from _counted([rows], ["model"])


def register_count_function(spark: SparkSession, name: str = "count_aligned") -> None:
    """``name(TABLE(...))`` for SQL: rows (model, ref_char, pred_char, n), the counts of the aligned pairs of each Arrow batch
    of a table of rows (model, reference, prediction); who sums them up has those of the table. Without PARTITION BY no
    row leaves its task, and no pair leaves it either."""
    spark.udtf.register(name, arrow_udtf(_CountBatches, returnType="model string, ref_char string, pred_char string, n long"))


def _aligned(references: list[str], predictions: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    row, pos, ref, pred = align_codes(*_codes(references), *_codes(predictions))
    return row, pos, _letters(ref), _letters(pred)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts as numbers, and how many each has."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(t) for t in texts], np.int64)


def _letters(codes: np.ndarray) -> np.ndarray:
    """Characters of aligned codes, '' for a gap."""
    kinds, at = np.unique(codes, return_inverse=True)
    return np.array([chr(c - 1) if c else "" for c in kinds.tolist()], "U1")[at]


def align_batch(references: list[str], predictions: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``align`` for many rows at once: row number, place, characters of both sides."""
    return _aligned(references, predictions)


def _unmatched(r: np.ndarray, m: np.ndarray, p: np.ndarray, n: np.ndarray, kinds: int) -> np.ndarray:
    """Per row, characters of one side that the other has none left for (of either side, the more): no alignment has
    fewer wrong pairs."""
    key = np.concatenate([np.repeat(np.arange(len(m)), m), np.repeat(np.arange(len(n)), n)]) * (kinds + 1) + np.concatenate([r, p])
    size = len(m) * (kinds + 1)
    if size > 4 * len(key) + (1 << 16):
        names, key = np.unique(key, return_inverse=True)
        rows, size = names // (kinds + 1), len(names)
    else:
        rows = np.repeat(np.arange(len(m)), kinds + 1)
    over = np.bincount(key[: len(r)], minlength=size) - np.bincount(key[len(r) :], minlength=size)
    one, other = (np.bincount(rows, np.maximum(x, 0), len(m)) for x in (over, -over))
    return np.maximum(one, other).astype(np.int64)


def _found_in(longer: np.ndarray, size: np.ndarray, shorter: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of which all of one side stands, in order, in the other, and the places where: the last ones possible."""
    every, left = np.arange(len(n)), n.copy()
    at = np.zeros(longer.shape, bool)
    if shorter.shape[1]:
        starts = np.searchsorted(size, np.arange(longer.shape[1]), "right").tolist()
        for i in range(longer.shape[1] - 1, -1, -1):
            k = starts[i]  # rows are sorted by their length: the first ones have ended before
            ahead = left[k:]
            at[k:, i] = same = (longer[k:, i] == shorter[every[k:], np.maximum(ahead - 1, 0)]) & (ahead > 0)
            ahead -= same
    return left == 0, at


def _flat(side: tuple[np.ndarray, np.ndarray, np.ndarray], part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of some rows one after the other, and each one's row among them."""
    codes, first, size = side
    row = np.repeat(np.arange(len(part)), size[part])
    return codes[np.arange(len(row)) + (first[part] - np.cumsum(size[part]) + size[part])[row]], row


def _taken_out(x: np.ndarray, row: np.ndarray, y: np.ndarray, of: np.ndarray, diff: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose longer side (``x``, of rows ``row``) becomes the other (``y``, of rows ``of``) when characters that the other
    lacks are taken out, all or those of one kind, and the rest of them replaced; and which characters have a partner.

    Each such character costs one and cannot cost less, so a best alignment has no other wrong pair: it leaves out ``diff``
    of them and pairs all else in order. Two such alignments differ only from one lacking character to the next if what
    stands between fits the other side moved by a few places too. Where nothing stands between, the way back replaces the
    last ones of a stretch; where something does, the row is left to the table, as are rows that could be moved by more
    than ``MOVED``."""
    there = np.zeros(len(diff) * many, bool)
    there[of * many + y] = True
    lacks = ~there[row * many + x]
    count = np.bincount((row * many + x)[lacks], minlength=len(there)).reshape(-1, many)
    total, fits = count.sum(axis=1), count == diff[:, None]
    every, kind = total == diff, fits.argmax(axis=1)
    known = every | fits.any(axis=1)
    gone = lacks & known[row] & (every[row] | (x == kind[row]))
    bound = np.where(every, 0, np.minimum(diff, total - diff))
    known &= bound <= MOVED
    stay = np.flatnonzero(~gone & known[row])
    ours = np.flatnonzero(known[of])
    wrong = (x[stay] != y[ours]) & ~lacks[stay]
    known[row[stay[wrong]]] = False
    mixed = known & (bound > 0)
    some = np.flatnonzero(mixed[row])
    if len(some):
        place = np.zeros(len(x), np.int64)  # of the partner in y
        place[stay] = ours
        x, row, place, lacks, out = (v[some] for v in (x, row, place, lacks, gone))
        at = np.flatnonzero(lacks)
        out = out[at]
        near = row[at[1:]] == row[at[:-1]]
        between = at[1:] - at[:-1] > 1

        def chains(most: np.ndarray) -> np.ndarray:
            """Number of each lacking character's chain: ``most`` says how far what follows one may be moved."""
            linked = near & ~between
            for by in range(1, int(most.max(initial=0)) + 1):
                for sign in (-by, by):
                    other = place + sign
                    fit = (other >= 0) & (other < len(y))
                    other = np.where(fit, other, 0)
                    fit &= (of[other] == row) & (y[other] == x)
                    unfit = np.cumsum(~fit & ~lacks)
                    linked |= near & between & (most[:-1] >= by) & (unfit[at[1:]] == unfit[at[:-1]])
            return np.cumsum(np.r_[True, ~linked]) - 1

        chain = chains(bound[row[at]])
        for _ in range(2):  # no more moves than a chain has characters to trade
            taken, size = np.bincount(chain, out), np.bincount(chain)
            trade = np.minimum(taken, size - taken).astype(np.int64)
            chain = chains(trade[chain])
        taken, size = np.bincount(chain, out).astype(np.int64), np.bincount(chain)
        apart = np.r_[False, between & (chain[1:] == chain[:-1])]
        trade = (taken > 0) & (taken < size)
        known[row[at[apart & trade[chain]]]] = False
        rank = np.arange(len(at)) - np.searchsorted(chain, chain)
        gone[some[at]] = np.where(trade[chain], rank < taken[chain], out)
    return known, ~gone


def align_codes(r: np.ndarray, m: np.ndarray, p: np.ndarray, n: np.ndarray, in_order: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and both characters' codes (plus one; 0 for a gap) of the pairs of rows whose characters stand one
    after the other in ``r`` and ``p``, ``m`` and ``n`` of each row.

    Of sides of one length that differ in as many places as either has unmatched characters, the best way is straight
    on; where one side is part of the other, it is to skip characters of the other, as early ones as possible; rows that
    ``_taken_out`` knows need no table either. Any other row is filled in a table: an alignment with d wrong pairs has at most d deletions and insertions, and as many more
    deletions as the reference is longer, so it stays in a band of d + 1 diagonals. That of the least possible distance
    is filled first, and then one twice as wide until it holds the distance. Who only counts pairs takes them in any
    order, without places."""
    first_r, first_p = np.cumsum(m) - m, np.cumsum(n) - n
    kinds, small = numbered(np.concatenate([r, p]))
    small = (small + 1).astype(np.uint8 if len(kinds) < 255 else np.uint16 if len(kinds) < 65535 else np.uint32)  # 0 is no character
    sides = (small[: len(r)], first_r, m), (small[len(r) :], first_p, n)
    many, least = len(kinds), np.zeros(len(m), np.int64)

    def at_least(part: np.ndarray) -> None:
        least[part] = _unmatched(_flat(sides[0], part)[0], m[part], _flat(sides[1], part)[0], n[part], many)

    kinds = np.concatenate([[0], kinds + np.uint32(1)]).astype(np.uint32)
    even, every = m == n, np.repeat(np.arange(len(m)), m)
    ours, theirs = np.repeat(even, m), np.repeat(even, n)
    wrong = np.bincount(every[ours], sides[0][0][ours] != sides[1][0][theirs], len(m))
    at_least(np.flatnonzero(wrong > 0))
    even &= wrong == least
    ours, theirs = np.repeat(even, m), np.repeat(even, n)
    rows, ref, pred = [every[ours]], [r[ours] + np.uint32(1)], [p[theirs] + np.uint32(1)]
    left = [np.flatnonzero(~even & (m == n))]
    for longer, shorter, out in ((0, 1, (ref, pred)), (1, 0, (pred, ref))):
        size, other = sides[longer][2], sides[shorter][2]
        maybe, some = np.flatnonzero(size > other), max(1, ENTRIES // len(kinds))
        others = []
        for start in range(0, len(maybe), some):
            part = maybe[start : start + some]
            (x, row), (y, of) = _flat(sides[longer], part), _flat(sides[shorter], part)
            known, paired = _taken_out(x, row, y, of, (size - other)[part], len(kinds))
            others.append(part[~known])
            codes, partner, there = kinds[x[known[row]]], np.zeros(int(known[row].sum()), np.uint32), paired[known[row]]
            partner[there] = kinds[y[known[of]]]
            rows.append(part[row[known[row]]])
            out[0].append(codes)
            out[1].append(partner)
        maybe = np.concatenate(others) if others else maybe
        at_least(maybe)
        left.append(maybe[least[maybe] != (size - other)[maybe]])
        maybe = maybe[least[maybe] == (size - other)[maybe]]
        maybe = maybe[np.argsort(size[maybe])]
        while len(maybe):
            part = maybe[: max(1, int(np.count_nonzero(np.arange(1, min(4 * ROWS, len(maybe)) + 1) * size[maybe[: 4 * ROWS]] <= CELLS)))]
            maybe = maybe[len(part) :]
            grid = _grid(sides[longer], part)
            held, at = _found_in(grid, size[part], _grid(sides[shorter], part), other[part])
            left.append(part[~held])
            there = (grid > 0) & held[:, None]
            codes = kinds[grid[there]]
            rows.append(part[np.nonzero(there)[0]])
            out[0].append(codes)
            out[1].append(np.where(at[there], codes, 0).astype(np.uint32))
    left = np.concatenate(left)
    while len(left):
        wide = np.maximum(least[left], 4)
        half = 1 << np.maximum(np.log2(wide).astype(np.int64) - 1, 2)
        if len(left) * (int(wide.max()) + 1) * (int(m[left].max()) + 1) <= CELLS:
            half = int(wide.max())
        least[left] = -(-wide // half) * half  # few widths, many rows of each; one width if that fits
        left = left[np.lexsort((m[left], least[left]))]
        again, start = [], 0
        while start < len(left):
            d, ahead = int(least[left[start]]), left[start : start + ROWS]
            cells = np.arange(1, len(ahead) + 1) * (d + 1) * (m[ahead] + 1)
            part = ahead[: max(1, int(np.count_nonzero((cells <= CELLS) & (least[ahead] == d))))]
            start += len(part)
            if cells[0] > CELLS:
                i = int(part[0])
                found = _align_long(r[first_r[i] : first_r[i] + m[i]], p[first_p[i] : first_p[i] + n[i]])
                rows.append(np.full(len(found[0]), i))
                ref.append(found[0])
                pred.append(found[1])
            else:
                held, at, *codes = _in_band(_grid(sides[0], part), m[part], _grid(sides[1], part), n[part], d)
                again.append(part[~held])
                rows.append(part[at])
                ref.append(kinds[codes[0]])
                pred.append(kinds[codes[1]])
        left = np.concatenate(again) if again else left[:0]
        least[left] *= 2
    row, ref, pred = (np.concatenate(x) for x in (rows, ref, pred))
    if not in_order:
        return row, row[:0], ref, pred
    order = np.argsort(row, kind="stable")
    row = row[order]
    return row, np.arange(len(row)) - np.searchsorted(row, row), ref[order], pred[order]


def _grid(side: tuple[np.ndarray, np.ndarray, np.ndarray], part: np.ndarray) -> np.ndarray:
    """Rows of numbers, filled up with 0."""
    codes, first, size = side
    out = np.zeros((len(part), int(size[part].max(initial=0))), codes.dtype)
    row = np.repeat(np.arange(len(part)), size[part])
    column = np.arange(len(row)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
    out[row, column] = codes[first[part][row] + column]
    return out


def _in_band(r: np.ndarray, m: np.ndarray, p: np.ndarray, n: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Alignments with ``d`` wrong pairs at most, of rows sorted by ``m``: which rows have one, then row and both numbers
    of their pairs in order. Each step of the table and of the way back is one operation over all rows; of the table only
    the steps back are kept, a byte a cell."""
    count, w = len(m), d + 1
    low = np.maximum((d + m - n) // 2, 0)  # diagonals below the first; the others are above
    far = 1 << 14 if r.shape[1] + w < 1 << 13 else BEYOND
    kind = np.int16 if far < BEYOND else np.int32
    padded = np.zeros((count, max(r.shape[1] + w, int(low.max()) + p.shape[1])), r.dtype)
    if p.shape[1]:
        padded[np.arange(count)[:, None], low[:, None] + np.arange(p.shape[1])] = p
    column = np.arange(w, dtype=kind)
    cost = np.where(column < low[:, None], far, column - low[:, None]).astype(kind)
    step = np.empty((r.shape[1] + 1, count, w), np.uint8)  # 0 diagonal, 1 insertion, 2 deletion
    last, total, done, one = n - m + low, np.zeros(count, np.int64), 0, kind(1)
    ends = np.searchsorted(m, np.arange(r.shape[1] + 1), "right").tolist()  # rows that end up to each step; they come first
    for i, end in enumerate(ends):
        if i:
            diagonal = cost + (padded[done:, i - 1 : i - 1 + w] != r[done:, i - 1 : i])
            best = diagonal - column
            np.minimum(best[:, :-1], cost[:, 1:] - column[:-1] + one, out=best[:, :-1])
            cost = np.minimum.accumulate(best, axis=1) + column
            here = step[i, done:]
            here[:, 0] = 2
            np.subtract(2, cost[:, 1:] == cost[:, :-1] + one, out=here[:, 1:], casting="unsafe")
            here *= cost != diagonal
        if end > done:
            total[done:end] = cost[np.arange(end - done), np.clip(last[done:end], 0, w - 1)]
            cost, done = cost[end - done :], end
    held = (last >= 0) & (last < w) & (total <= d)
    i, j, every, back = m.copy(), n.copy(), np.flatnonzero(held), []
    every = every[(m[every] > 0) | (n[every] > 0)]
    while len(every):
        a, b = i[every], j[every]
        turn = step[a, every, b - a + low[every]]
        turn[a == 0] = 1
        turn[b == 0] = 2
        none = np.zeros(len(every), r.dtype)
        back.append((every, np.where(turn == 1, none, r[every, a - 1]) if r.shape[1] else none, np.where(turn == 2, none, p[every, b - 1]) if p.shape[1] else none))
        i[every] = a = a - (turn != 1)
        j[every] = b = b - (turn != 2)
        every = every[(a > 0) | (b > 0)]
    row, ref, pred = (np.concatenate([x[c] for x in back])[::-1] if back else np.empty(0, np.int64) for c in range(3))
    return held, row, ref, pred


def align_long(reference: str, prediction: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for one row whose band is large."""
    ref, pred = _align_long(_codes([reference])[0], _codes([prediction])[0])
    return np.zeros(len(ref), np.int64), np.arange(len(ref)), _letters(ref), _letters(pred)


def _align_long(r: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every ``STEP``-th row of the band as wide as the distance is kept, and the rows between are filled again on the
    way back. Codes plus one, 0 for a gap."""
    far, m, n = distance(r, p), len(r), len(p)

    def below(first: int, values: np.ndarray, i: int) -> tuple[int, np.ndarray]:
        """Row ``i`` (the column it starts at, and its costs) from the one above."""
        low, high = max(0, i - far), min(n, i + far)
        above = np.full(high - low + 2, BEYOND, np.int64)  # columns low - 1 to high
        a, b = max(first, low - 1), min(first + len(values), high + 1)
        above[a - low + 1 : b - low + 1] = values[a - first : b - first]
        best = above[1:] + 1
        if low == 0:
            best[1:] = np.minimum(best[1:], above[1:-1] + (p[:high] != r[i - 1]))
            best[0] = i
        else:
            best = np.minimum(best, above[:-1] + (p[low - 1 : high] != r[i - 1]))
        column = np.arange(len(best))
        return low, np.minimum.accumulate(best - column) + column

    now = (0, np.arange(min(n, far) + 1, dtype=np.int64))
    kept = {0: now}
    for i in range(1, m + 1):
        now = below(*now, i)
        if i % STEP == 0:
            kept[i] = now
    rows: dict[int, tuple[int, np.ndarray]] = {}

    def load(i: int) -> None:
        """Fill row ``i`` and those above it down from the last one kept."""
        if i not in rows or i - 1 not in rows:
            start = (i - 1) // STEP * STEP
            rows.clear()
            rows[start] = kept[start]
            for k in range(start + 1, min(start + STEP, m) + 1):
                rows[k] = below(*rows[k - 1], k)

    def cost(i: int, j: int) -> int:
        first, values = rows[i] if i in rows else kept[i]
        return int(values[j - first]) if 0 <= j - first < len(values) else BEYOND

    i, j, back = m, n, []
    while i or j:
        if i:
            load(i)
        here = cost(i, j)
        if i and j and here == cost(i - 1, j - 1) + (r[i - 1] != p[j - 1]):
            i, j = i - 1, j - 1
            back.append((r[i] + 1, p[j] + 1))
        elif j and here == cost(i, j - 1) + 1:
            j -= 1
            back.append((0, p[j] + 1))
        else:
            i -= 1
            back.append((r[i] + 1, 0))
    pairs = np.array(back[::-1], np.uint32).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str], list[str]]]:
    """Batches cut to about ``CHARS`` characters (one long row stays whole), with both sides; nulls are empty."""
    for batch in batches:
        sides = [pc.fill_null(batch.column(c), "") for c in ("reference", "prediction")]
        size = np.cumsum(pc.add(*(pc.utf8_length(x) for x in sides)).to_numpy())
        start = 0
        while start < len(batch):
            end = max(start + 1, int(np.searchsorted(size, CHARS + (size[start - 1] if start else 0), "right")))
            yield batch.slice(start, end - start), *(x.slice(start, end - start).to_pylist() for x in sides)
            start = end


def _kinds(rows: DataFrame, names: Iterable[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)


def _as_letters(codes: np.ndarray) -> pa.Array:
    kinds, at = numbered(codes)
    return pa.DictionaryArray.from_arrays(pa.array(at.astype(np.int32)), pa.array([chr(c - 1) if c else "" for c in kinds.tolist()], pa.string())).dictionary_decode()


def aligned_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys, ref_chars, pred_chars``: both sides of each row as arrays of one length, '' for gaps. No row leaves its
    partition: texts are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, references, predictions in _slices(batches):
            row, _, ref, pred = align_codes(*_codes(references), *_codes(predictions))
            ends = pa.array(np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32))
            sides = [pa.ListArray.from_arrays(ends, _as_letters(x)) for x in (ref, pred)]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *sides], [*keys, "ref_chars", "pred_chars"])

    return rows.select(*keys, "reference", "prediction").mapInArrow(run, f"{_kinds(rows.select(*keys), keys)}, ref_chars array<string>, pred_chars array<string>")


def alignments(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys, pos, ref_char, pred_char`` of every row with a character on either side."""
    pairs = F.arrays_zip(F.col("ref_chars").alias("ref_char"), F.col("pred_chars").alias("pred_char"))
    return aligned_rows(rows, *keys).select(*keys, F.posexplode(pairs).alias("pos", "p")).select(*keys, "pos", "p.ref_char", "p.pred_char")


def _joined(codes: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Texts of aligned codes, of each row from one end to the next, without the gaps."""
    letters = _as_letters(codes).cast(pa.large_string())
    starts = np.frombuffer(letters.buffers()[1], np.int64, len(letters) + 1)
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(starts[ends].tobytes()), letters.buffers()[2]).cast(pa.string())


def certificate(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys, reference, prediction, n_wrong``: the sides an alignment gives back and its wrong pairs, which for a best
    one are as many as the edit distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, references, predictions in _slices(batches):
            row, _, ref, pred = align_codes(*_codes(references), *_codes(predictions))
            ends = np.searchsorted(row, np.arange(len(part) + 1))
            wrong = np.bincount(row[ref != pred], minlength=len(part)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), _joined(ref, ends), _joined(pred, ends), pa.array(wrong)], [*keys, "reference", "prediction", "n_wrong"])

    return rows.select(*keys, "reference", "prediction").mapInArrow(run, f"{_kinds(rows.select(*keys), keys)}, reference string, prediction string, n_wrong long")


def _counted(batches: Iterable[pa.RecordBatch], by: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """``by, ref_char, pred_char, n`` of the aligned reference characters of each slice of rows."""
    for part, references, predictions in _slices(batches):
        firsts, group = group_rows(part, by)
        row, _, ref, pred = align_codes(*_codes(references), *_codes(predictions), in_order=False)
        there = ref > 0
        kinds, at = numbered(np.concatenate([ref[there], pred[there]]))
        n, size = int(there.sum()), max(len(kinds), 1)
        pair = (group[row[there]] * size + at[:n]) * size + at[n:]
        if size * size * max(len(firsts), 1) <= len(pair) + (1 << 16):
            counts = np.bincount(pair)
            found = np.flatnonzero(counts)
            counts = counts[found]
        else:
            found, counts = np.unique(pair, return_counts=True)
        of = pa.array(firsts[found // size // size] if len(found) else np.empty(0, np.int64))
        letters = [_as_letters(kinds[x]) if len(found) else pa.array([], pa.string()) for x in (found // size % size, found % size)]
        yield pa.RecordBatch.from_arrays([*(part.column(c).take(of) for c in by), *letters, pa.array(counts.astype(np.int64))], [*by, "ref_char", "pred_char", "n"])


def count_confusions(rows: DataFrame, *by: str) -> DataFrame:
    """``confusions`` of the alignments of all rows. Each task counts the pairs of its rows, so that what is shuffled is
    a row for each pair of characters that it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted(batches, by)

    kinds = ", ".join(x for x in (_kinds(rows.select(*by), by), "ref_char string, pred_char string, n long") if x)
    counted = rows.select(*by, "reference", "prediction").mapInArrow(run, kinds)
    return counted.groupBy(*by, "ref_char", "pred_char").agg(F.sum("n").alias("n"))


def holding(rows: DataFrame, tracked: str) -> DataFrame:
    """Rows whose reference holds a tracked character: only these need an alignment."""
    return rows.where(F.col("reference").rlike(f"[{tracked}]"))


def tracked_chars(lower: DataFrame) -> DataFrame:
    """``char`` of both cases, once each."""
    return lower.select("char").union(lower.select(F.upper("char").alias("char"))).distinct()


def confusions(aligned: DataFrame, *by: str) -> DataFrame:
    """``by, ref_char, pred_char, n`` for aligned reference characters ('' where it was deleted)."""
    return aligned.where("ref_char <> ''").groupBy(*by, "ref_char", "pred_char").agg(F.count("*").alias("n"))


def char_accuracy(confused: DataFrame, tracked: DataFrame, *by: str) -> DataFrame:
    """``by, char, correct, total, accuracy`` of every tracked character; NULL accuracy where it never occurs.

    The counts of a group are one map by character, and the tracked characters one array (both no longer than an
    alphabet), so that what the counts come from is computed once."""
    right = F.sum(F.when(F.col("ref_char") == F.col("pred_char"), F.col("n")).otherwise(0))
    found = confused.groupBy(*by, "ref_char").agg(F.struct(right.alias("correct"), F.sum("n").alias("total")).alias("c"))
    found = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("ref_char", "c"))).alias("found"))
    wanted = tracked.agg(F.collect_set("char").alias("chars"))  # one row
    each = found.crossJoin(F.broadcast(wanted)).select(*by, "found", F.explode("chars").alias("char"))
    each = each.select(*by, "char", *(F.coalesce(F.try_element_at("found", F.col("char"))[c], F.lit(0)).alias(c) for c in ("correct", "total")))
    return each.withColumn("accuracy", F.try_divide("correct", F.nullif("total", F.lit(0))))


def case_folded(confused: DataFrame, models: list[str]) -> DataFrame:
    """Accuracy per letter of either case, a column per model, and over all letters (``char`` is ``overall``)."""
    folded = confused.withColumns({"char": F.lower("ref_char"), "hit": F.when(F.col("ref_char") == F.col("pred_char"), F.col("n")).otherwise(0)})
    rows = folded.unionByName(folded.withColumn("char", F.lit("overall")))
    return rows.groupBy("char").pivot("model", models).agg(F.round(100 * F.sum("hit") / F.sum("n"), 1))


def top_confusions(confused: DataFrame, *by: str, n: int = 3) -> DataFrame:
    """The most frequent wrong predictions of each character."""
    wrong = confused.where("ref_char <> pred_char")
    ranked = wrong.withColumn("rank", F.row_number().over(W.partitionBy(*by, "ref_char").orderBy(F.col("n").desc(), "pred_char")))
    return ranked.where(F.col("rank") <= n)


# -- vocabularies ---------------------------------------------------------------------------------


def char_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.select(F.explode(chars(F.col(text))).alias("char")).groupBy("char").agg(F.count("*").alias("n"))


def charset(texts: DataFrame, min_freq: int = 1, text: str = "text", spaces: bool = True) -> DataFrame:
    """One row: the characters seen ``min_freq`` times or more, sorted, as one string."""
    counts = char_counts(texts, text).where(F.col("n") >= min_freq)
    if not spaces:
        counts = counts.where(~F.col("char").rlike(r"(?U)^\s$"))
    return counts.agg(F.array_join(F.array_sort(F.collect_list("char")), "").alias("charset"))


def encode_ids(text: Column, vocabulary: Column) -> Column:
    """Numbers of the characters in the vocabulary string, from 1; unknown characters are left out."""
    ids = F.transform(chars(text), lambda c: F.position(c, vocabulary))
    return F.filter(ids, lambda i: i > 0)


def decode_ids(ids: Column, vocabulary: Column) -> Column:
    """The characters again; 0 is the blank."""
    return F.array_join(F.transform(F.filter(ids, lambda i: i > 0), lambda i: F.substr(vocabulary, i, F.lit(1))), "")


def best_classes(frames: DataFrame, sample: str, step: str, label: str, score: str) -> DataFrame:
    """``sample, step, label`` with the class of greatest score of each step; of equals the least, and a null score is
    below all. Each task reduces its own classes first."""
    return frames.groupBy(sample, step).agg(F.max_by(label, F.struct(F.col(score), -F.col(label))).alias(label))


def collapse_segments(labels: DataFrame, sample: str, step: str, label: str, blank: int, steps: int = 4096) -> DataFrame:
    """``sample, segment, labels``: the greedy collapse of ordered labels (repeats go, then blanks, which part repeats),
    in segments of ``steps`` step numbers; put together in order they are the sample's.

    A segment is its first and last label and its collapsed body; where a segment starts with the label that the one
    before it ends with, its body loses its first. Only the end labels of a sample's segments meet in one task, so a
    long sample is as many tasks as it has segments. Steps may be missing (the ones beside them are then neighbours);
    null samples are one sample; null labels count as blanks."""
    rows = labels.select(F.col(sample).alias("sample"), F.floor(F.col(step) / steps).alias("segment"), F.struct(F.col(step).alias("step"), F.coalesce(F.col(label), F.lit(blank)).alias("label")).alias("x"))
    held = rows.groupBy("sample", "segment").agg(F.sort_array(F.collect_list("x")).alias("x"))
    every = F.col("x.label")
    new = F.filter(F.transform(every, lambda c, i: F.when(((i == 0) | (c != F.get(every, F.greatest(i - 1, F.lit(0))))) & (c != blank), c)), lambda c: c.isNotNull())
    held = held.select("sample", "segment", F.get(every, F.lit(0)).alias("first"), F.element_at(every, -1).alias("last"), new.alias("body"))
    before = F.lag("last").over(W.partitionBy("sample").orderBy("segment"))
    goes_on = before.eqNullSafe(F.col("first")) & (F.col("first") != blank)
    return held.select(F.col("sample").alias(sample), "segment", F.when(goes_on, F.slice("body", F.lit(2), F.size("body"))).otherwise(F.col("body")).alias("labels"))


def frame_collapse(frames: DataFrame, sample: str, step: str, label: str, score: str, blank: int = 0, steps: int = 4096) -> DataFrame:
    """``sample, labels`` of long frames (sample, step, class, score): the best class of each step, collapsed. The
    labels of a sample have to fit in a row; ``collapse_segments`` gives them in pieces."""
    parts = collapse_segments(best_classes(frames, sample, step, label, score), sample, step, label, blank, steps)
    whole = parts.groupBy(sample).agg(F.sort_array(F.collect_list(F.struct("segment", "labels"))).alias("parts"))
    return whole.select(sample, F.flatten("parts.labels").alias("labels"))


def run_collapse(frames: DataFrame, group: str, order: str, label: str, blank: str) -> DataFrame:
    """Greedy collapse of ordered labels per group: repeats go, then blanks (a blank parts repeats)."""
    before = F.lag(label).over(W.partitionBy(group).orderBy(order))
    kept = frames.withColumn("_before", before).where((F.col("_before").isNull() | (F.col("_before") != F.col(label))) & (F.col(label) != blank))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, label))), lambda x: x[label])
    return kept.groupBy(group).agg(ordered.alias("labels"))


# -- vectors --------------------------------------------------------------------------------------


def unit(vector: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.coalesce(F.try_divide(x.cast("double"), size), F.lit(0.0)))


def _blocks(rows: DataFrame, vector: str, size: int) -> DataFrame:
    """Up to ``size`` rows of a task as one: its columns as arrays, with the unit vectors one after the other."""
    others = [c for c in rows.columns if c != vector]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), size):
                part = batch.slice(start, size)
                columns = [*(part.column(c) for c in others), part.column(vector).flatten()]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in columns], [*others, vector])

    kinds = dict(rows.dtypes)
    return rows.select(*others, unit(F.col(vector)).alias(vector)).mapInArrow(run, "".join(f"`{c}` array<{kinds[c]}>, " for c in others) + f"`{vector}` array<double>")


#: Items and labels of one block: their product is one matrix of scores.
ITEM_BLOCK, LABEL_BLOCK = 1024, 1024


def zero_shot(items: DataFrame, labels: DataFrame, scale: float = 100.0, label_block: int = LABEL_BLOCK, item_block: int = ITEM_BLOCK) -> DataFrame:
    """``vec_id, label, probability``: softmax of each item's scaled cosines over all label vectors (``label, label_vec``).

    Items and labels are packed into blocks, and a pair of blocks is one matrix product. The first pass keeps, for each
    item and block of labels, the greatest score and the sum of exponentials beneath it, which merge to the item's; the
    second makes the scores again and divides, so that scores are never shuffled. No row holds all labels; whether the
    blocks of labels go to every task or are dealt out is left to their size. All vectors have one length, ``vec_id`` names one item, and each
    has a row for each label, as the result asks for."""
    kinds = dict(items.dtypes)["vec_id"], dict(labels.dtypes)["label"]
    items = items.select("vec_id", "embedding")
    named = _blocks(labels.select("label", "label_vec"), "label_vec", label_block)

    def scores(batch: pa.RecordBatch, i: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
        ids, names = batch.column("vec_id")[i].values, batch.column("label")[i].values
        left, right = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).reshape(len(x), -1) for c, x in (("embedding", ids), ("label_vec", names)))
        return ids, names, scale * (left @ right.T)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, _, s = scores(batch, i)
                top = s.max(axis=1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(top), pa.array(np.exp(s - top[:, None]).sum(axis=1))], ["vec_id", "top", "total"])

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, names, s = scores(batch, i)
                top, total = (batch.column(c)[i].values.to_numpy(zero_copy_only=False)[:, None] for c in ("top", "total"))
                p = np.exp(s - top) / total
                at = np.repeat(np.arange(len(ids)), len(names)), np.tile(np.arange(len(names)), len(ids))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[0])), names.take(pa.array(at[1])), pa.array(p.ravel())], ["vec_id", "label", "probability"])

    parts = _blocks(items, "embedding", item_block).crossJoin(named).mapInArrow(tops, f"vec_id {kinds[0]}, top double, total double")
    most = parts.groupBy("vec_id").agg(F.max("top").alias("top"), F.collect_list(F.struct("top", "total")).alias("parts"))
    whole = most.select("vec_id", "top", F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["total"] * F.exp(x["top"] - F.col("top"))).alias("total"))
    # an item's block again, with what its scores are divided by
    return _blocks(items.join(whole, "vec_id"), "embedding", item_block).crossJoin(named).mapInArrow(shares, f"vec_id {kinds[0]}, label {kinds[1]}, probability double")
