"""Conjunction spans and the splits made at them, as column functions.

Offsets are found in the lower-cased text and applied to the text itself, as the rule is defined; where
lower-casing changes a text's length the cut shifts with it. Matches are found in the JVM; places, cuts and segments are
made over Arrow batches with running sums, so that a line costs its length however many conjunctions it holds."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from quillspark.functions.text import strip

#: North Sámi conjunctions (fixed values).
MULTI_WORD = ["ovdal go", "maŋŋil go", "dassážii go", "dan botta go", "dalle go", "nu ahte"]
COORDINATE = ["ja", "muhto", "dahje", "dehe", "vai", "sihke"]
SUBORDINATE = ["go", "dasgo", "dannego", "dainnago", "daningo", "jos", "jus", "beare", "amas", "ahte", "nugo", "dego", "vaikko", "goas"]
NORTH_SAMI = MULTI_WORD + COORDINATE + SUBORDINATE
#: Seven and all conjunctions: the two modes of a translation run.
MODES = {"simple": COORDINATE + ["go"], "full": NORTH_SAMI}
MIN_SEGMENT, MAX_SEGMENT = 20, 80


def pattern(conjunctions: Sequence[str]) -> str:
    """One word-bounded alternation, the longest first, so that a word inside a longer conjunction is not
    found again."""
    return r"(?U)\b(" + "|".join(map(re.escape, sorted(conjunctions, key=len, reverse=True))) + r")\b"


SPAN = StructType().add("pos", IntegerType()).add("end", IntegerType()).add("conj", StringType())
#: White space of Unicode (fixed values).
WHITE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_IS_WHITE = np.isin(np.arange(0x3002), [ord(c) for c in WHITE])
#: Characters whose places are held at once; a longer line is held alone.
CHARS = 1 << 20


@F.arrow_udf(ArrayType(SPAN))
def _placed(between: pa.Array, found: pa.Array) -> pa.Array:
    """Where each match lies: after the gaps and matches before it."""
    gaps, matches = (np.concatenate([[0], np.cumsum(pc.utf8_length(x.flatten()).to_numpy())]) for x in (between, found))
    n_gaps, n = (pc.fill_null(pc.list_value_length(x), 0).to_numpy() for x in (between, found))
    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    row = np.repeat(np.arange(len(n)), n)
    gap_at, at = (np.cumsum(n_gaps) - n_gaps)[row], ends[row]
    k = np.arange(len(row)) - at
    pos = gaps[gap_at + k + 1] - gaps[gap_at] + matches[:-1] - matches[at]
    fields = [pa.array(pos.astype(np.int32)), pa.array((pos + np.diff(matches)).astype(np.int32)), found.flatten()]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, ["pos", "end", "conj"]), mask=found.is_null() if found.null_count else None)


def matches(text: Column, rule: str) -> Column:
    """Array of (pos, end, conj) of the matches of a rule of one group, in order. What lies between is sought, and goes to
    Python, only where there is a match."""
    found = F.regexp_extract_all(text, F.lit(rule), F.lit(1))
    return _placed(F.when(F.size(found) > 0, F.split(text, rule)), found)


def spans(text: Column, conjunctions: Sequence[str] = NORTH_SAMI) -> Column:
    """Array of (pos, end, conj) in order."""
    return matches(F.lower(text), pattern(conjunctions))


def _rows(text: pa.Array, found: pa.Array) -> Iterator[tuple[int, int, list[int], np.ndarray, np.ndarray]]:
    """Of each row with a match: its number, length, the places of its matches, and for each place in it that of the
    next character that is no white space, and the one after the last such character before."""
    starts = found.offsets.to_numpy() - found.offsets[0].as_py()
    pos = pc.struct_field(found.flatten(), "pos").to_numpy()
    some = np.flatnonzero(np.diff(starts) > 0)
    texts = text.take(pa.array(some))
    size = np.cumsum(pc.utf8_length(texts).to_numpy())
    done = 0
    while done < len(some):
        to = max(done + 1, int(np.searchsorted(size, CHARS + (size[done - 1] if done else 0), "right")))
        codes = np.frombuffer("".join(texts.slice(done, to - done).to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        place, white = np.arange(len(codes)), _IS_WHITE[np.minimum(codes, len(_IS_WHITE) - 1)]
        ahead = np.append(np.minimum.accumulate(np.where(white, len(codes), place)[::-1])[::-1], len(codes))
        behind = np.append(0, np.maximum.accumulate(np.where(white, 0, place + 1)))
        first = size[done - 1] if done else 0
        for i in range(done, to):
            a, b = (size[i - 1] if i else 0) - first, size[i] - first
            row = int(some[i])
            yield row, int(b - a), pos[starts[row] : starts[row + 1]].tolist(), ahead[a : b + 1] - a, behind[a : b + 1] - a
        done = to


def _cut_lists(n: int, cuts: dict[int, list[int]], nulls: pa.Array | None) -> pa.Array:
    sizes = np.zeros(n, np.int64)
    for row, own in cuts.items():
        sizes[row] = len(own)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array([c for row in sorted(cuts) for c in cuts[row]], pa.int32()), mask=nulls)


def _nulls(*arrays: pa.Array) -> pa.Array | None:
    out = arrays[0].is_null()
    for x in arrays[1:]:
        out = pc.or_(out, x.is_null())
    return out if pc.any(out).as_py() else None


@F.arrow_udf(ArrayType(IntegerType()))
def _greedy(text: pa.Array, found: pa.Array, shortest: pa.Array, longest: pa.Array) -> pa.Array:
    cuts: dict[int, list[int]] = {}
    least, most = (x[0].as_py() if len(x) else 0 for x in (shortest, longest))
    for row, size, places, ahead, behind in _rows(text, found):
        start, own = 0, []
        for p in places if size > most else ():
            at = min(p, size)
            if p - start >= most and behind[at] - ahead[min(start, size)] >= least:
                own.append(p)
                start = p
        cuts[row] = own
    return _cut_lists(len(text), cuts, _nulls(text, found))


@F.arrow_udf(ArrayType(IntegerType()))
def _aggressive(text: pa.Array, found: pa.Array, shortest: pa.Array) -> pa.Array:
    cuts: dict[int, list[int]] = {}
    least = shortest[0].as_py() if len(shortest) else 0
    for row, size, places, ahead, behind in _rows(text, found):
        start, own = 0, []
        for p in places:
            at = min(p, size)
            if behind[at] - ahead[min(start, size)] >= least and behind[size] - ahead[at] >= least:
                own.append(p)
                start = p
        cuts[row] = own
    return _cut_lists(len(text), cuts, _nulls(text, found))


@F.arrow_udf(ArrayType(StringType()))
def _segments(text: pa.Array, cuts: pa.Array) -> pa.Array:
    out: list[list[str] | None] = []
    for t, own in zip(text.to_pylist(), cuts.to_pylist(), strict=True):
        if t is None or own is None:
            out.append(None)
            continue
        bounds = [0, *own, len(t)]
        parts = [x for x in (t[a:b].strip(WHITE) for a, b in zip(bounds, bounds[1:], strict=False)) if x]
        out.append(parts if len(parts) > 1 else [t.strip(WHITE)])
    return pa.array(out, pa.list_(pa.string()))


def greedy_cuts(text: Column, found: Column, shortest: int = MIN_SEGMENT, longest: int = MAX_SEGMENT) -> Column:
    """Offsets of cuts: the first conjunction at least ``longest`` after the last cut, if the segment before it
    holds ``shortest`` characters; none in texts of up to ``longest``."""
    return _greedy(text, found, F.lit(shortest), F.lit(longest))


def aggressive_cuts(text: Column, found: Column, shortest: int = MIN_SEGMENT) -> Column:
    """Offsets of cuts: every conjunction that leaves ``shortest`` characters on both sides."""
    return _aggressive(text, found, F.lit(shortest))


def profile(text: Column, found: Column, longest: int = MAX_SEGMENT) -> Column:
    """Of a text: ``text_length, total, counts`` (of each conjunction it holds), ``positions, could_split``."""
    names = F.array_sort(F.array_distinct(F.transform(found, lambda s: s["conj"])))
    counts = F.map_from_entries(F.transform(names, lambda c: F.struct(c, F.size(F.filter(found, lambda s: s["conj"] == c)))))
    total = F.size(found)
    return F.struct(F.length(text).alias("text_length"), total.alias("total"), counts.alias("counts"), F.transform(found, lambda s: s["pos"]).alias("positions"), ((F.length(text) > longest) & (total > 0)).alias("could_split"))


def all_cuts(found: Column) -> Column:
    """Every conjunction that does not begin the text."""
    return F.filter(F.transform(found, lambda s: s["pos"]), lambda p: p > 0)


def segments(text: Column, cuts: Column) -> Column:
    """Array of stripped segments; a text whose rest would be blank stays whole."""
    return _segments(text, cuts)


def n_segments(text: Column, cuts: Column) -> Column:
    """How many ``segments`` there are; a text without a cut is one and does not go to Python."""
    cut = F.size(cuts) > 0
    return F.when(cut, F.size(_segments(F.when(cut, text), F.when(cut, cuts)))).when(F.size(cuts) == 0, 1)


def rejoin(parts: Column, separator: str = " ") -> Column:
    """Segments joined, blank ones left out."""
    return F.array_join(F.filter(F.transform(parts, strip), lambda s: s != ""), separator)
