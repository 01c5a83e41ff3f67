"""BLEU, chrF and TER from statistics that add up: per row, per corpus, per resample."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.accuracy import distances, numbered, token_distance
from quillspark.functions.text import tokens, words
from quillspark.operators.arrow import group_rows

WORD_ORDER, CHAR_ORDER, BETA = 4, 6, 2.0
#: The sequence of a row's weights: modulus and multiplier; and the thousandths from which a row counts once, twice and
#: three times.
MODULUS, MULTIPLIER, POISSON = 2**31 - 1, 48271, (368, 736, 920)
#: Keys whose weights are held at once, and groups whose statistics are.
WEIGHED, GROUPS = 256, 16
#: Units (characters or tokens) whose grams are counted at once.
UNITS = 1 << 21
#: Entries of a table of the units that each row holds.
TABLE = 1 << 22


def clipped_counts(hyp: tuple[np.ndarray, np.ndarray], ref: tuple[np.ndarray, np.ndarray], order: int) -> np.ndarray:
    """Per row and n-gram order: clipped matches, grams of the hypothesis, grams of the reference.

    A side is its units as numbers, row after row, and the number of units of each row. Equal grams of both sides of a
    row may be taken out in pairs, each a match, and what is left counts as before. Sides that are alike match in all
    grams. Grams of other rows are first compared place by place, counted from the front, or past the units that
    ``_passed`` finds, and then from the back. A gram that holds a unit that the other side lacks has no match; only the
    rest is sorted, by a number made of the row and the units."""
    sizes = [np.asarray(x[1], np.int64) for x in (hyp, ref)]
    out = np.zeros((len(sizes[0]), 3 * order), np.int64)
    for n in range(order):
        out[:, 3 * n + 1], out[:, 3 * n + 2] = (np.maximum(x - n, 0) for x in sizes)
    even = sizes[0] == sizes[1]
    own, other = (np.repeat(even, x) for x in sizes)
    wrong = np.bincount(np.repeat(np.arange(len(even)), sizes[0])[own], hyp[0][own] != ref[0][other], len(even))
    unlike = ~even | (wrong > 0)
    out[~unlike, ::3] = out[~unlike, 1::3]
    if unlike.any():
        left = [(x[0][np.repeat(unlike, n)], n[unlike]) for x, n in zip((hyp, ref), sizes, strict=True)]
        out[unlike, ::3] = _matches(*left, order)
    return out


def _lacking(x: np.ndarray, row: np.ndarray, y: np.ndarray, of: np.ndarray, rows: int, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Units of either side (``x`` and ``y``, of rows ``row`` and ``of``) that the other side of the row lacks."""
    some, found = max(1, TABLE // many), []
    ends = [np.searchsorted(r, np.arange(0, rows + some, some)) for r in (row, of)]
    for k, start in enumerate(range(0, rows, some)):
        keys = [(r[e[k] : e[k + 1]] - start) * many + u[e[k] : e[k + 1]] for u, r, e in ((x, row, ends[0]), (y, of, ends[1]))]
        there = np.zeros((2, min(some, rows - start) * many), bool)
        there[0, keys[0]] = there[1, keys[1]] = True
        found.append((~there[1, keys[0]], ~there[0, keys[1]]))
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def _passed(x: np.ndarray, row: np.ndarray, lacks: np.ndarray, diff: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose first side has ``diff`` units more than the other, and as many that the other lacks, in all or of one
    kind; and these units."""
    total = np.bincount(row[lacks], minlength=len(diff))
    keys, count = np.unique((row * many + x)[lacks], return_counts=True)
    fits = count == diff[keys // many]
    kind = np.full(len(diff), -1)
    kind[(keys // many)[fits]] = (keys % many)[fits]
    every = total == diff
    known = (diff > 0) & (every | (kind >= 0))
    return known, lacks & known[row] & (every[row] | (x == kind[row]))


def _matches(hyp: tuple[np.ndarray, np.ndarray], ref: tuple[np.ndarray, np.ndarray], order: int) -> np.ndarray:
    """Clipped matches per row and n-gram order of rows whose sides are not alike."""
    rows, split = len(hyp[1]), len(hyp[0])
    units = numbered(np.concatenate([hyp[0], ref[0]]))[1].astype(np.int64)
    many = int(units.max(initial=0)) + 1
    sizes = [x[1] for x in (hyp, ref)]
    row = np.concatenate([np.repeat(np.arange(rows), x) for x in sizes])
    left = np.concatenate([np.repeat(np.cumsum(x), x) for x in sizes]) - np.concatenate([np.arange(split), np.arange(len(ref[0]))])  # units from here to the row's end
    lacks = np.concatenate(_lacking(units[:split], row[:split], units[split:], row[split:], rows, many))
    sides = slice(None, split), slice(split, None)
    passed, gone = np.zeros(rows, bool), np.zeros(len(units), bool)
    for a, b in ((0, 1), (1, 0)):
        known, gone[sides[a]] = _passed(units[sides[a]], row[sides[a]], lacks[sides[a]], sizes[a] - sizes[b], many)
        passed |= known
    own, of = np.arange(split), row[:split]
    first = split + np.cumsum(sizes[1]) - sizes[1]
    front, over = first - (np.cumsum(sizes[0]) - sizes[0]), sizes[1] - sizes[0]
    shifts, alike = [], []
    for shift, rows_of_it in ((front, ~passed), (front + over, (over != 0) & ~passed)):
        shift, at = shift[of], own + shift[of]
        there = np.flatnonzero(rows_of_it[of] & (at >= first[of]) & (at < (first + sizes[1])[of]))
        same = np.zeros(split, bool)
        same[there] = units[there] == units[at[there]]
        shifts.append(shift)
        alike.append(same)
    stay = ~gone & passed[row]
    one, other = np.flatnonzero(stay[:split]), split + np.flatnonzero(stay[split:])
    shifts[0][one] = other - one
    alike[0][one] = units[one] == units[other]
    runs = [x.copy() for x in alike]
    goes_on = shifts[0][1:] == shifts[0][:-1]
    out = np.zeros((rows, order), np.int64)
    dead = lacks.copy()
    for n in range(order):
        if n:
            dead[: max(len(dead) - n, 0)] |= lacks[n:]
        free = (left > n) & ~dead
        found = np.zeros(rows, np.int64)
        for k, (run, same, shift) in enumerate(zip(runs, alike, shifts, strict=True)):
            if n:
                run[: max(split - n, 0)] &= same[n:] & goes_on[n - 1 :] if k == 0 else same[n:]
                run[max(split - n, 0) :] = False
            one = np.flatnonzero(run & free[:split])
            other = one + shift[one]
            kept = free[other]
            one, other = one[kept], other[kept]
            free[one] = free[other] = False
            found += np.bincount(of[one], minlength=rows)
        rest = np.flatnonzero(free)
        ours = rest < split
        both = np.logical_and(*(np.bincount(row[rest[x]], minlength=rows) > 0 for x in (ours, ~ours)))[row[rest]]
        rest, ours = rest[both], ours[both]
        key, most = row[rest], max(rows, 1)
        for i in range(n + 1):
            if most * many >= 1 << 62:
                key = np.unique(key, return_inverse=True)[1].astype(np.int64)
                most = int(key.max(initial=0)) + 1
            key = key * many + units[rest + i]
            most *= many
        gram = np.unique(key, return_inverse=True)[1]
        size = int(gram.max(initial=-1)) + 1
        row_of = np.zeros(size, np.int64)
        row_of[gram] = row[rest]
        twice = np.minimum(*(np.bincount(gram[x], minlength=size) for x in (ours, ~ours)))
        out[:, n] = found + np.bincount(row_of, weights=twice, minlength=rows).astype(np.int64)
    return out


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = [t or "" for t in texts.to_pylist()]
    return np.frombuffer("".join(values).encode("utf-32-le"), np.uint32), np.array([len(v) for v in values], np.int64)


def _units(hyp: pa.Array, ref: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Both sides as numbers: the characters of strings, or the tokens of arrays."""
    if not pa.types.is_list(hyp.type):
        return [_characters(hyp), _characters(ref)]
    codes = pa.concat_arrays([hyp.flatten().cast(pa.large_string()), ref.flatten().cast(pa.large_string())]).dictionary_encode().indices.to_numpy()
    split = len(hyp.flatten())
    sizes = [x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (hyp, ref)]
    return [(codes[:split], sizes[0]), (codes[split:], sizes[1])]


def _lengths(units: pa.Array) -> np.ndarray:
    """Units of each row, without making objects of them."""
    counts = pc.list_value_length(units) if pa.types.is_list(units.type) else pc.utf8_length(units)
    return pc.fill_null(counts, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _unspaced(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def _gram_stats(rows: DataFrame, key: str, sides: dict[str, int], lengths: bool, others: tuple[str, ...] = (), edits: bool = False, summed: bool = False) -> DataFrame:
    """``key`` and ``m1, h1, r1, m2, ...`` of rows of ``_unlike_sides``, for each name of ``sides``; orders are numbered on
    from one name to the next, lengths and edits are the last name's. ``others`` are counts of the row that pass. No row
    leaves its partition; if they are ``summed``, a slice of rows is one row a key."""
    orders = sum(sides.values())
    names = [f"{c}{n}" for n in range(1, orders + 1) for c in "mhr"] + (["hyp_len", "ref_len"] if lengths else []) + (["edits"] if edits else []) + list(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(sum(_lengths(batch.column(f"{name}_{side}")) for name in sides for side in "hr"))
            start = 0
            while start < len(batch):
                end = max(start + 1, int(np.searchsorted(sizes, UNITS + (sizes[start - 1] if start else 0), "right")))
                yield counted(batch.slice(start, end - start))
                start = end

    def counted(part: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for name, order in sides.items():
            size = part.column(f"{name}_n")
            unlike = pc.is_null(size)
            both = _units(*(part.column(f"{name}_{side}").filter(unlike) for side in "hr"))
            unlike = unlike.to_numpy(zero_copy_only=False)
            size = np.repeat(pc.fill_null(size, 0).to_numpy()[:, None].astype(np.int64), 2, axis=1)
            counts = np.repeat(np.maximum(size[:, :1] - np.arange(order), 0), 3, axis=1)
            counts[unlike] = clipped_counts(*both, order)
            size[unlike] = np.stack([both[0][1], both[1][1]], axis=1)
            found += list(counts.T)
        if lengths:
            found += list(size.T)
        if edits:
            found.append(np.zeros(len(part), np.int64))
            found[-1][unlike] = distances(*both[0], *both[1])
        found += [part.column(c).cast(pa.int64()).to_numpy() for c in others]
        keys = part.column(key)
        if summed:
            firsts, group = group_rows(part, [key])
            order = np.argsort(group, kind="stable")
            starts = np.searchsorted(group[order], np.arange(len(firsts)))
            keys, found = keys.take(pa.array(firsts)), [np.add.reduceat(x[order], starts) for x in found]
        return pa.RecordBatch.from_arrays([keys, *map(pa.array, found)], names=[key, *names])

    kind = dict(rows.dtypes)[key]
    return rows.mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{n} long" for n in names))


def _texts() -> tuple[Column, Column]:
    return tuple(F.coalesce(F.col(c), F.lit("")) for c in ("hypothesis", "reference"))


def _unlike_sides(pairs: DataFrame, key: str, **units: tuple[Callable[[Column], Column], Callable[[Column], Column]]) -> DataFrame:
    """For each name (a text's units, and how many they are) those of both sides as ``name_h, name_r``; where the sides are alike only their number
    ``name_n``, which says all and is null elsewhere."""
    h, r = _texts()
    return pairs.select(key, *(c for name, (unit, size) in units.items() for c in (F.when(h != r, unit(h)).alias(f"{name}_h"), F.when(h != r, unit(r)).alias(f"{name}_r"), F.when(h == r, size(unit(r))).alias(f"{name}_n"))))


def bleu_stats(pairs: DataFrame, key: str = "id") -> DataFrame:
    """Per pair of ``hypothesis, reference``: matches, totals and token lengths."""
    return _gram_stats(_unlike_sides(pairs, key, tokens=(tokens, F.size)), key, {"tokens": WORD_ORDER}, lengths=True)


def _chrf_words(text: Column) -> Column:
    """Words, of which a sign at the end, or else in front, is one of its own."""
    sign = lambda c: F.instr(F.lit(string.punctuation), c) > 0
    apart = lambda w: F.when((F.length(w) > 1) & sign(F.right(w, F.lit(1))), F.array(F.left(w, F.length(w) - 1), F.right(w, F.lit(1)))).when((F.length(w) > 1) & sign(F.left(w, F.lit(1))), F.array(F.left(w, F.lit(1)), F.substr(w, F.lit(2)))).otherwise(F.array(w))
    return F.flatten(F.transform(words(text), apart))


def chrf_stats(pairs: DataFrame, key: str = "id", word_order: int = 0) -> DataFrame:
    """Per pair: matches and totals of character grams, and of word grams up to ``word_order`` after them."""
    units = {"chars": (_unspaced, F.length)} | ({"words": (_chrf_words, F.size)} if word_order else {})
    return _gram_stats(_unlike_sides(pairs, key, **units), key, {"chars": CHAR_ORDER, "words": word_order} if word_order else {"chars": CHAR_ORDER}, lengths=False)


def ter_stats(pairs: DataFrame, key: str = "id") -> DataFrame:
    rows = pairs.select(key, *(tokens(text).alias(f"tokens_{side}") for text, side in zip(_texts(), "hr", strict=True)))
    return rows.select(key, token_distance("tokens_h", "tokens_r").alias("edits"), F.size("tokens_r").alias("ref_len"), F.size("tokens_h").alias("hyp_len"))


def add_up(stats: DataFrame, *by: str) -> DataFrame:
    """Sums of the statistics, per group or of all rows."""
    names = [c for c, kind in stats.dtypes if kind in ("int", "bigint", "double") and c not in ("id", *by)]
    return stats.groupBy(*by).agg(*(F.sum(c).alias(c) for c in names))


def bleu_of() -> Column:
    """BLEU (0 to 100) of summed statistics: no smoothing, so an order without a match gives 0."""
    orders = range(1, WORD_ORDER + 1)
    missing = reduce(lambda a, b: a | b, ((F.col(f"m{n}") == 0) | (F.col(f"h{n}") == 0) for n in orders))
    logs = reduce(lambda a, b: a + b, (F.ln(F.try_divide(f"m{n}", F.nullif(f"h{n}", F.lit(0)))) for n in orders))
    penalty = F.least(F.lit(1.0), F.exp(1 - F.try_divide("ref_len", F.nullif("hyp_len", F.lit(0)))))
    return F.when(missing | (F.col("hyp_len") == 0), F.lit(0.0)).otherwise(penalty * F.exp(logs / WORD_ORDER) * 100)


def chrf_of(beta: float = BETA, word_order: int = 0) -> Column:
    """chrF (0 to 100) of summed statistics: mean precision and recall over orders that both sides have."""
    orders = range(1, CHAR_ORDER + word_order + 1)
    valid = lambda n: (F.col(f"h{n}") > 0) & (F.col(f"r{n}") > 0)
    total = lambda c: reduce(lambda a, b: a + b, (F.when(valid(n), F.try_divide(f"m{n}", F.nullif(f"{c}{n}", F.lit(0)))).otherwise(F.lit(0.0)) for n in orders))
    count = reduce(lambda a, b: a + b, (valid(n).cast("int") for n in orders))
    p, r = F.try_divide(total("h"), F.nullif(count, F.lit(0))), F.try_divide(total("r"), F.nullif(count, F.lit(0)))
    f = F.try_divide((1 + beta**2) * p * r, F.nullif(beta**2 * p + r, F.lit(0.0)))
    return F.coalesce(f * 100, F.lit(0.0))


def ter_of() -> Column:
    """TER of summed statistics without block shifts; an empty reference gives 0 or 100."""
    return F.when(F.col("ref_len") > 0, 100 * F.try_divide("edits", F.nullif("ref_len", F.lit(0)))).otherwise(F.when(F.col("hyp_len") > 0, F.lit(100.0)).otherwise(F.lit(0.0)))


def corpus_scores(pairs: DataFrame, by: str) -> DataFrame:
    """``by, bleu, chrf, ter, total_samples`` per group of ``hypothesis, reference``, from summed statistics. The rows are read once:
    character grams, token grams and token edits of a row are counted together."""
    sides = _unlike_sides(pairs, by, chars=(_unspaced, F.length), tokens=(tokens, F.size)).withColumn("total_samples", F.lit(1))
    sums = add_up(_gram_stats(sides, by, {"chars": CHAR_ORDER, "tokens": WORD_ORDER}, lengths=True, others=("total_samples",), edits=True, summed=True), by)
    done = sums.select(by, chrf_of().alias("chrf"), ter_of().alias("ter"), "total_samples", "hyp_len", "ref_len", *(F.col(f"{c}{CHAR_ORDER + n}").alias(f"{c}{n}") for n in range(1, WORD_ORDER + 1) for c in "mhr"))
    return done.select(by, bleu_of().alias("bleu"), "chrf", "ter", "total_samples")


def _weights(seeds: np.ndarray, jumps: np.ndarray) -> np.ndarray:
    """How often each row counts in each resample: the thousandth that the row's number there falls in, of the modulus,
    which is a power of two less one, so that a remainder is a sum of two parts."""
    x = seeds.astype(np.uint64)[:, None] * jumps
    high = x >> np.uint64(31)
    x &= np.uint64(MODULUS)
    x += high
    np.minimum(x, np.subtract(x, np.uint64(MODULUS), out=high), out=x)  # a lesser number wraps around and is the greater
    out = np.zeros(x.shape, np.uint8)
    for least in POISSON:
        out += x >= np.uint64(-(-least * MODULUS // 1000))
    return out.astype(np.float64)


def resamples(stats: DataFrame, key: str, n: int, *by: str) -> DataFrame:
    """Sums of ``stats`` in ``n`` resamples (``by, resample`` and the statistics): each row counts 0 to 3 times in each,
    with the odds of a Poisson count of mean 1.

    A row's counts are a multiplicative sequence that starts from a hash of its key; rows of one key that are read
    together share it. A task multiplies the weights of some keys at a time with the statistics of all groups and sends
    one table of ``n`` sums for each group, however many rows it reads."""
    names = [c for c, kind in stats.dtypes if kind in ("int", "bigint") and c not in (key, "id", *by)]
    seed = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 15), 16, 10).cast("long") % (MODULUS - 1) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        jumps = np.array(list(accumulate(range(n), lambda x, _: x * MULTIPLIER % MODULUS, initial=MULTIPLIER))[:n], np.uint64)
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            firsts, group = group_rows(batch, by)
            ids = [tuple(batch.column(c)[int(i)].as_py() for c in by) for i in firsts]
            values = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in names]
            seeds = batch.column("_seed").to_numpy()
            for start in range(0, len(ids), GROUPS):
                own = np.flatnonzero((group >= start) & (group < start + GROUPS))
                some = min(GROUPS, len(ids) - start)
                own_seeds, at = np.unique(seeds[own], return_inverse=True)
                at = at * some + group[own] - start
                table = np.stack([np.bincount(at, v[own], len(own_seeds) * some) for v in values], axis=1).reshape(len(own_seeds), -1)
                found = sum(_weights(own_seeds[k : k + WEIGHED], jumps).T @ table[k : k + WEIGHED] for k in range(0, len(own_seeds), WEIGHED))
                for g, own_sums in enumerate(np.reshape(found, (n, some, -1)).transpose(1, 0, 2), start):
                    sums[ids[g]] = sums.get(ids[g], 0) + own_sums
        for group_values, found in sums.items():
            columns = [pa.array([v] * n, batch.schema.field(c).type) for v, c in zip(group_values, by, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(n)), *(pa.array(x.astype(np.int64)) for x in found.T)], [*by, "resample", *names])

    kinds = dict(stats.dtypes)
    weighed = stats.select(*by, seed.alias("_seed"), *(F.coalesce(c, F.lit(0)).alias(c) for c in names))
    parts = weighed.mapInArrow(run, "".join(f"`{c}` {kinds[c]}, " for c in by) + "resample long, " + ", ".join(f"{c} long" for c in names))
    return parts.groupBy(*by, "resample").agg(*(F.sum(c).alias(c) for c in names))


def interval(scores: DataFrame, value: str, *by: str, level: float = 0.95) -> DataFrame:
    """Mean and percentile interval of resampled scores (one row, or one per group)."""
    tail = (1 - level) / 2
    return scores.groupBy(*by).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(tail)).alias("ci_lower"), F.percentile(value, F.lit(1 - tail)).alias("ci_upper"))


def significance(intervals: DataFrame, baseline: str) -> DataFrame:
    """Each mode's interval (``mode, mean, ci_lower, ci_upper``) against the baseline's: bounds of the difference
    from its mean, and whether the two intervals lie apart. One row per mode."""
    whole, is_base = W.partitionBy(), F.col("mode") == baseline  # one row per mode, made once
    base = {f"_{c}": F.max(F.when(is_base, F.col(c))).over(whole) for c in ("mean", "ci_lower", "ci_upper")}
    both = intervals.withColumns({"_n": F.count_if(is_base).over(whole), **base}).where("_n > 0")
    apart = (F.col("_ci_upper") < F.col("ci_lower")) | (F.col("ci_upper") < F.col("_ci_lower"))
    return both.select("mode", "mean", "ci_lower", "ci_upper", (F.col("ci_lower") - F.col("_mean")).alias("delta_lower"), (F.col("ci_upper") - F.col("_mean")).alias("delta_upper"), apart.alias("significant"))


def mode_table(scores: DataFrame, splits: DataFrame, baseline: str) -> DataFrame:
    """One row per mode: scores, their differences from the baseline's, and split statistics (``mode,
    avg_segments, samples_split``), which count as 1 and 0 where a mode does not split."""
    metrics = [c for c in scores.columns if c not in ("mode", "total_samples")]
    whole, is_base = W.partitionBy(), F.col("mode") == baseline  # one row per mode, made once
    base = {f"_{c}": F.max(F.when(is_base, F.col(c))).over(whole) for c in metrics}
    out = scores.withColumns({"_n": F.count_if(is_base).over(whole), **base}).where("_n > 0").join(splits, "mode", "left")
    deltas = [(F.col(c) - F.col(f"_{c}")).alias(f"delta_{c}") for c in metrics]
    return out.select("mode", *metrics, *deltas, F.coalesce("avg_segments", F.lit(1.0)).alias("avg_segments"), F.coalesce("samples_split", F.lit(0)).alias("samples_split"), "total_samples")
