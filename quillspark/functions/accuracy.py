"""Column functions that score a prediction against a reference."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from quillspark.functions.text import clean_text

#: Bytes of both sides that are worked on at once, rows and table entries of a block of rows, and the rows that a block is
#: worth while for.
CHARS, ROWS, ENTRIES, WORTH = 1 << 21, 4096, 1 << 21, 96
#: What ``(?U)\s`` is, for an engine that knows ASCII's only.
WHITE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: A number for each byte that ``clean_text`` keeps as a letter or digit of ASCII, one for both cases; 0 for others.
LETTERS = np.zeros(256, np.uint64)
LETTERS[[*range(48, 58), *range(97, 123)]] = np.random.default_rng(1).integers(1, 1 << 62, 36)
LETTERS[65:91] = LETTERS[97:123]
#: The letters beyond ASCII whose lower case holds one of ASCII.
LOWER_TO_ASCII = "[\u0130\u212a]"


def error_rate(edits: Column, size: Column, predicted_any: Column) -> Column:
    """``edits / size``; an empty reference gives 1 for any prediction and 0 for none."""
    return F.when(size > 0, edits / size).otherwise(F.when(predicted_any, F.lit(1.0)).otherwise(F.lit(0.0)))


def unlike(a: Column, b: Column) -> tuple[Column, Column]:
    """Both texts where they are not the same, else nulls: equal texts are known, and need not go to Python."""
    apart = ~a.eqNullSafe(b)
    return F.when(apart, a), F.when(apart, b)


def cer(reference: Column, prediction: Column) -> Column:
    """Character error rate; may exceed 1."""
    return error_rate(edit_distance(prediction, reference), F.length(reference), prediction != "")


def distance(a: np.ndarray, b: np.ndarray) -> int:
    """Edit distance of two arrays of numbers: a column of the table is a few operations on one long integer, a bit
    per row, so memory is linear and a pair of tokens costs a fraction of a bit operation."""
    n = min(len(a), len(b))
    front = next(iter(np.flatnonzero(a[:n] != b[:n])[:1].tolist()), n)
    a, b = a[front:], b[front:]
    n = min(len(a), len(b))
    back = next(iter(np.flatnonzero(a[::-1][:n] != b[::-1][:n])[:1].tolist()), n)
    a, b = a[: len(a) - back].tolist(), b[: len(b) - back].tolist()
    if not a or not b:
        return len(a) + len(b)
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole, top, found = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    more, less = whole, 0  # rows where the table rises by one, or falls by one, going down
    for x in b:
        same = places.get(x, 0)
        diagonal = (((same & more) + more) ^ more) | same | less
        right, left = less | ~(diagonal | more), diagonal & more
        found += 1 if right & top else -1 if left & top else 0
        right, left = (right << 1) | 1, left << 1
        more, less = (left | ~(diagonal | right)) & whole, right & diagonal & whole
    return found


def numbered(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different units in order, and each unit's number among them: small units by a table, others sorted."""
    if not len(units) or int(units.max()) > 4 * len(units) + (1 << 16):
        return np.unique(units, return_inverse=True)
    there = np.zeros(int(units.max()) + 1, bool)
    there[units] = True
    return np.flatnonzero(there).astype(units.dtype), (np.cumsum(there) - 1)[units]


def _apart(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and both units of the places that both sides have and that differ. A side is its units as numbers, row after
    row, and the number of units of each row."""
    both = np.minimum(m, n)
    row = np.repeat(np.arange(len(m)), both)
    at = np.arange(len(row)) - np.repeat(np.cumsum(both) - both, both)
    x, y = a[np.repeat(np.cumsum(m) - m, both) + at], b[np.repeat(np.cumsum(n) - n, both) + at]
    there = np.flatnonzero(x != y)
    return row[there], x[there], y[there]


def places(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per row, places that both sides have and that differ (sides as in ``_apart``)."""
    return np.bincount(_apart(a, m, b, n)[0], minlength=len(m))


def distances(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Edit distance of each row (sides as in ``_apart``).

    Where the shorter side is the other's front, or one place differs, that is the distance; and so are the places that
    differ in sides of one length, if none of their units stands in such a place of the other. Rows that ``_lacking``
    knows need no table. Other rows are worked on in blocks of like numbers of words of 64 places, a column of all their
    tables at a time; a few rows alone."""
    row, x, y = _apart(a, m, b, n)
    found = np.bincount(row, minlength=len(m)) + abs(m - n)
    even = np.flatnonzero((m == n)[row])
    row, x, y = row[even], x[even], y[even]
    many = int(max(x.max(initial=0), y.max(initial=0))) + 1
    names, at = np.unique(np.concatenate([row, row]) * many + np.concatenate([x, y]), return_inverse=True)
    sides = [np.bincount(k, minlength=len(names)) for k in (at[: len(row)], at[len(row) :])]
    mixed = np.zeros(len(m), bool)
    mixed[names[(sides[0] > 0) & (sides[1] > 0)] // many] = True
    left = np.flatnonzero((found > abs(m - n)) & (found > 1) & (mixed | (m != n)))
    first_a, first_b = np.cumsum(m) - m, np.cumsum(n) - n
    for longer, shorter in (((a, first_a, m), (b, first_b, n)), ((b, first_b, n), (a, first_a, m))):
        rows = left[longer[2][left] > shorter[2][left]]
        known = _lacking(_grid(*longer, rows)[0], longer[2][rows], _grid(*shorter, rows)[0], shorter[2][rows])
        found[rows[known >= 0]] = known[known >= 0]
        left = np.setdiff1d(left, rows[known >= 0], assume_unique=True)
    words = -(-m // 64)
    wide = 1 << np.ceil(np.log2(np.maximum(words[left], 1))).astype(np.int64)  # rows of up to twice the words go together
    for w in np.unique(wide).tolist():
        rows = left[wide == w]
        if len(rows) <= WORTH:
            alone = rows
        else:
            alone, rows = rows[m[rows] == 0], rows[m[rows] > 0]
            rows = rows[np.argsort(-(n + words)[rows], kind="stable")]
            start = 0
            while start < len(rows):
                some = rows[start : start + ROWS]
                size = np.cumsum((m + n)[some]) * w
                some = some[: max(1, int(np.searchsorted(size, 4 * ENTRIES, "right")))]
                start += len(some)
                found[some] = _block(*(_grid(u, f, k, some) for u, f, k in ((a, first_a, m), (b, first_b, n))), m[some], n[some], w)
        for i in alone.tolist():
            found[i] = distance(a[first_a[i] : first_a[i] + m[i]], b[first_b[i] : first_b[i] + n[i]])
    return found


def _lacking(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Distances of rows whose first side is the longer one (sides as in ``_apart``) and becomes the second when all units
    that the second lacks are taken out, or those of one kind, and its other units that the second lacks are replaced;
    -1 for other rows. Each such unit costs one and cannot cost less, so the distance is their number."""
    kinds = numbered(np.concatenate([a, b]))[1]
    many = int(kinds.max(initial=0)) + 1
    found, some = np.full(len(m), -1), max(1, ENTRIES // many)
    ends_a, ends_b = np.r_[0, np.cumsum(m)], len(a) + np.r_[0, np.cumsum(n)]
    for start in range(0, len(m), some):
        end = min(start + some, len(m))
        ours, theirs, x, y = m[start:end], n[start:end], kinds[ends_a[start] : ends_a[end]], kinds[ends_b[start] : ends_b[end]]
        row = np.repeat(np.arange(end - start), ours)
        there = np.zeros((end - start) * many, bool)
        there[np.repeat(np.arange(end - start), theirs) * many + y] = True
        lacks = ~there[row * many + x]
        count = np.bincount((row * many + x)[lacks], minlength=len(there)).reshape(-1, many)
        total, fits = count.sum(axis=1), count == (ours - theirs)[:, None]
        kind, every = fits.argmax(axis=1), total == ours - theirs
        stay = ~(lacks & (every[row] | (x == kind[row])))
        known = every | fits.any(axis=1)
        at, u, _ = _apart(x[stay], np.bincount(row[stay], minlength=end - start), y, theirs)
        known[at[there[at * many + u]]] = False
        found[start:end] = np.where(known, total, -1)
    return found


def _grid(units: np.ndarray, first: np.ndarray, size: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of some rows, with their row and place."""
    row = np.repeat(np.arange(len(rows)), size[rows])
    at = np.arange(len(row)) - np.repeat(np.cumsum(size[rows]) - size[rows], size[rows])
    return units[first[rows][row] + at], row, at


def _block(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray], m: np.ndarray, n: np.ndarray, w: int) -> np.ndarray:
    """``distance`` for rows whose first side has at most ``w`` words of 64 places, sorted by second side and words, most
    first. Each word is one column behind the one before it, whose carry it takes, so a step is one operation over all
    words of all rows; the first word is the last one of the arrays."""
    rows = len(m)
    kinds = numbered(np.concatenate([a[0], b[0]]))[1]
    many = int(kinds.max()) + 1
    if rows * many * w > ENTRIES:  # numbers within the row, so that the table grows with the text only
        own, kinds = np.unique(np.concatenate([a[1], b[1]]) * many + kinds, return_inverse=True)
        of = own // many
        kinds = (np.arange(len(own)) - np.searchsorted(of, of))[kinds]
        many = int(kinds.max()) + 1
    side = np.full((rows, int(m.max())), many)
    side[a[1], a[2]] = kinds[: len(a[0])]
    text = np.full((rows, int(n.max()) + 2 * w), many)  # no unit before and after: nothing changes there
    text[b[1], b[2] + w - 1] = kinds[len(a[0]) :]
    first = np.arange(rows) * (many + 1)
    table = np.zeros((rows * (many + 1), w), np.uint64)  # per row and unit, the places that hold it
    one, top = np.uint64(1), np.uint64(63)
    for i in range(side.shape[1]):
        table[first + side[:, i], w - 1 - i // 64] |= one << np.uint64(i % 64)
    table, text, slots = table.ravel(), (text + first[:, None]) * w, np.arange(w)
    more, less = np.full((rows, w), ~np.uint64(0)), np.zeros((rows, w), np.uint64)
    up, down = np.zeros((rows, w), np.uint64), np.zeros((rows, w), np.uint64)
    up[:, -1] = 1
    behind = (m - 1) // 64
    last, at_last, found = ((m - 1) % 64).astype(np.uint64), np.arange(rows) * w + w - 1 - behind, m.copy()
    steps = n + behind
    for t, k in enumerate(np.searchsorted(-steps, -np.arange(int(steps[0])), "left").tolist()):  # rows that are not done
        same, rises, falls = table.take(text[:k, t : t + w] + slots), more[:k], less[:k]
        still = same | falls
        same |= down[:k]
        diagonal = (((same & rises) + rises) ^ rises) | same
        right, left = falls | ~(diagonal | rises), rises & diagonal
        found[:k] += ((right.take(at_last[:k]) >> last[:k]) & one).view(np.int64) - ((left.take(at_last[:k]) >> last[:k]) & one).view(np.int64)
        carry = right >> top, left >> top
        right, left = (right << one) | up[:k], (left << one) | down[:k]
        more[:k], less[:k] = left | ~(still | right), right & still
        if w > 1:
            up[:k, :-1], down[:k, :-1] = carry[0][:, 1:], carry[1][:, 1:]
    return found


def _slices(a: pa.Array, b: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Both sides cut to about ``CHARS`` bytes (one long row stays whole); nulls are empty."""
    a, b = pc.fill_null(a, ""), pc.fill_null(b, "")
    size, start = np.cumsum(pc.add(pc.binary_length(a), pc.binary_length(b)).to_numpy().astype(np.int64)), 0
    while start < len(a):
        end = max(start + 1, int(np.searchsorted(size, CHARS + (size[start - 1] if start else 0), "right")))
        yield a.slice(start, end - start), b.slice(start, end - start)
        start = end


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32), pc.utf8_length(texts).to_numpy().astype(np.int64)


def _words(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs between white space as numbers, equal ones alike."""
    parts = pc.split_pattern_regex(pa.concat_arrays([a, b]).cast(pa.large_string()), WHITE)
    flat, ends = parts.flatten(), np.cumsum(parts.value_lengths().to_numpy().astype(np.int64))
    there = pc.greater(pc.binary_length(flat), 0)
    ends = np.r_[0, np.cumsum(there.to_numpy(zero_copy_only=False))][np.r_[0, ends]]
    codes = flat.filter(there).dictionary_encode().indices.to_numpy()
    split = ends[len(a)]
    return codes[:split], np.diff(ends[: len(a) + 1]), codes[split:], np.diff(ends[len(a) :])


def _known(a: pa.Array, b: pa.Array) -> np.ndarray:
    return ~(pc.is_null(a).to_numpy(zero_copy_only=False) | pc.is_null(b).to_numpy(zero_copy_only=False))


def _per_row(a: pa.Array, b: pa.Array, f: Callable[..., np.ndarray]) -> pa.Array:
    found = [f(*_characters(x), *_characters(y)) for x, y in _slices(a, b)]
    return pa.array(np.concatenate([*found, np.empty(0, np.int64)]), pa.int32(), mask=~_known(a, b))


@F.arrow_udf(IntegerType())
def character_edits(a: pa.Array, b: pa.Array) -> pa.Array:
    """Character edit distance of any two texts."""
    return _per_row(a, b, distances)


def edit_distance(a: Column, b: Column) -> Column:
    """Character edit distance."""
    return F.when(a == b, 0).otherwise(character_edits(*unlike(a, b)))


def _letters(texts: pa.Array) -> np.ndarray:
    """Sum of ``LETTERS`` over the bytes of each text."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    there = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held else np.empty(0, np.uint8)
    return np.diff(np.r_[np.uint64(0), np.cumsum(LETTERS[there])][ends - ends[0]])


@F.arrow_udf(BooleanType())
def same_letters(a: pa.Array, b: pa.Array) -> pa.Array:
    """False only if two texts differ after ``clean_text``, as they hold other numbers of a letter or digit of ASCII."""
    found = [np.empty(0, bool)]
    for x, y in _slices(a, b):
        odd = [pc.match_substring_regex(t, LOWER_TO_ASCII).to_numpy(zero_copy_only=False) for t in (x, y)]
        found.append((_letters(x) == _letters(y)) | odd[0] | odd[1])
    return pa.array(np.concatenate(found), pa.bool_(), mask=~_known(a, b))


@F.arrow_udf(IntegerType())
def char_errors(a: pa.Array, b: pa.Array) -> pa.Array:
    """Places of two texts that hold other characters, plus the difference in length."""
    return _per_row(a, b, lambda x, m, y, n: places(x, m, y, n) + abs(m - n))


@F.arrow_udf(IntegerType())
def token_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Edit distance between two token arrays."""
    codes = pa.concat_arrays([a.flatten().cast(pa.large_string()), b.flatten().cast(pa.large_string())]).dictionary_encode().indices.to_numpy()
    m, n = (x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
    split = len(a.flatten())
    return pa.array(distances(codes[:split], m, codes[split:], n), pa.int32())


@F.arrow_udf(StructType([StructField(name, IntegerType()) for name in ("edits", "size_a", "size_b", "wrong")]))
def word_counts(a: pa.Array, b: pa.Array) -> pa.Array:
    """Of the words (runs between white space) of two texts: edit distance, how many each has, and places of both that
    hold other words. Sizes of a null text are null, and places if either is."""
    found = [np.empty((4, 0), np.int64)]
    for x, y in _slices(a, b):
        sides = _words(x, y)
        found.append(np.stack([distances(*sides), sides[1], sides[3], places(*sides)]))
    edits, size_a, size_b, wrong = np.concatenate(found, axis=1)
    no = [pc.is_null(x).to_numpy(zero_copy_only=False) for x in (a, b)]
    return pa.StructArray.from_arrays([pa.array(edits, pa.int32()), pa.array(size_a, pa.int32(), mask=no[0]), pa.array(size_b, pa.int32(), mask=no[1]), pa.array(wrong, pa.int32(), mask=no[0] | no[1])], ["edits", "size_a", "size_b", "wrong"])


def wer(reference: Column, prediction: Column) -> Column:
    """Word error rate on runs between white space."""
    w = word_counts(*unlike(reference, prediction))
    return F.when(reference == prediction, F.lit(0.0)).otherwise(error_rate(w["edits"], w["size_a"], w["size_b"] > 0))


def token_accuracy(reference: Column, prediction: Column) -> Column:
    """Share of places that hold the same token; NULL if neither text has one."""
    w = word_counts(*unlike(reference, prediction))
    share = F.try_divide(F.least(w["size_a"], w["size_b"]) - w["wrong"], F.greatest(w["size_a"], w["size_b"]))
    return F.when(reference == prediction, F.when(reference.rlike("[^" + WHITE[1:-1]), F.lit(1.0))).otherwise(share)


def word_errors(reference: Column, prediction: Column) -> Column:
    """Places of two texts that hold other words, plus the difference in words."""
    w = word_counts(reference, prediction)
    return w["wrong"] + F.abs(w["size_a"] - w["size_b"])


def n_words(reference: Column, prediction: Column) -> Column:
    """Words of the reference."""
    return word_counts(reference, prediction)["size_a"]


def exact(reference: Column, prediction: Column) -> Column:
    return (reference == prediction).cast("int")


def normalized(reference: Column, prediction: Column) -> Column:
    """Equality after ``clean_text``; equal texts need none, nor do texts that hold other letters."""
    other = ~same_letters(*unlike(reference, prediction))
    return F.when(reference == prediction, 1).when(other, 0).otherwise((clean_text(reference) == clean_text(prediction)).cast("int"))
