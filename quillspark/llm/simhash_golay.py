"""SimHash near-duplicates through Golay-code keys (operator 8).

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each padded to a 23-bit word of the
perfect Golay code, in which every word lies within 3 bits of exactly one codeword. Half-way between two
fingerprints that differ in at most 4 bits there is one within 2 bits of either; the nearest codewords of its
segments are then within 3 bits of the segments of either fingerprint, but for an excess of 2 bits over all
three. So a fingerprint's keys are the triples of nearby codeword indices (36 bits) with at most that excess,
about 110 of them, and every such pair meets in one: no link is lost, and fingerprints that are not alike
hardly ever meet. Candidates that share a key are verified by their differing bits.

Equal fingerprints are one row from the start. Rows of a key are compared in blocks of bounded size, and a
block of many alike fingerprints reports only links that join its parts, so a large group of copies costs
a spanning forest, not all its pairs. Components come from alternating star contractions, each round
written to the shared folder.

Defined results: null or wordless text has fingerprint zero and links like any other; rows with a null
``doc_id`` are linked too, and a component's id is the least non-null id in it; repeated rows keep their
rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import fresh, scratch_table, slices

#: Generator polynomial of the binary Golay code of length 23, and its check bits.
GENERATOR, CHECK = 0b101011100011, 11
SEGMENTS = ((42, 22), (21, 21), (0, 21))
MAX_BITS = 4
#: Fingerprints compared in one block, and up to how many a block reports every link.
BLOCK, PLAIN = 4096, 32
BITS_AT_ONCE = 1 << 19


# -- fingerprints ---------------------------------------------------------------------------------


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes (rows of 64-bit words) set each bit."""
    rows = hashes.view(np.uint8).reshape(len(hashes), -1)
    total = np.zeros(8 * rows.shape[1], np.int64)
    for i in range(0, len(rows), BITS_AT_ONCE // rows.shape[1]):
        bits = np.unpackbits(rows[i : i + BITS_AT_ONCE // rows.shape[1]], axis=1)
        total += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return total


def shingle_hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words (of all words, if fewer), repeats included."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    runs = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else (words,)
    return np.fromiter((digest(s, seed) for s in map(b" ".join, runs)), np.uint64)


def _fingerprint_rows(shingle: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            prints = np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column("text")):
                hashes = shingle_hashes(text.as_py(), shingle, seed)
                if len(hashes):
                    prints[i] = np.packbits(2 * _bit_sums(hashes) > len(hashes)).view(np.int64)[0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], names=["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, print``: a bit is set if it is set in over half the shingle hashes."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(_fingerprint_rows(shingle, seed), "doc_id long, print long")


# -- Golay keys -----------------------------------------------------------------------------------


def _remainder(word: int) -> int:
    for shift in range(word.bit_length() - 12, -1, -1):
        if word >> (shift + CHECK) & 1:
            word ^= GENERATOR << shift
    return word


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of words below 2**12 (low, then shifted by 12), and per remainder the error patterns that lead
    to a codeword: the nearest first, then up to 5 of 4 bits, then up to 21 of 5 bits; -1 where there is none."""
    low = np.array([_remainder(x) for x in range(1 << 12)])
    high = np.array([_remainder(x << 12) for x in range(1 << 11)])
    table = np.full((1 << CHECK, 1 + 5 + 21), -1)
    free = np.tile(np.array([0, 1, 6]), (1 << CHECK, 1))  # next free column for up to 3, 4 and 5 bits
    for weight in range(6):
        for bits in combinations(range(23), weight):
            pattern = sum(1 << b for b in bits)
            of, kind = low[pattern & 4095] ^ high[pattern >> 12], max(0, weight - 3)
            table[of, free[of, kind]] = pattern
            free[of, kind] += 1
    return low, high, table


def nearby_codewords(words: np.ndarray) -> np.ndarray:
    """Per 23-bit word the indices of its codewords within 5 bits, in the order of ``golay_tables``."""
    low, high, patterns = golay_tables()
    errors = patterns[low[words & 4095] ^ high[words >> 12]]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> CHECK)


def keys_of(prints: np.ndarray, most_excess: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of fingerprints (as unsigned). With an excess of 2 all pairs within 4 bits meet."""
    near = [nearby_codewords((prints >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64)) for at, n in SEGMENTS]
    excess = (range(1), range(1, 6), range(6, 27))
    rows, keys = [], []
    for levels in product(range(3), repeat=3):
        if sum(levels) <= most_excess:
            for i, j, k in product(*(excess[x] for x in levels)):
                ok = np.flatnonzero((near[0][:, i] >= 0) & (near[1][:, j] >= 0) & (near[2][:, k] >= 0))
                rows.append(ok)
                keys.append(near[0][ok, i] << 24 | near[1][ok, j] << 12 | near[2][ok, k])
    return np.concatenate(rows), np.concatenate(keys)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("print").to_numpy()
        rows, keys = keys_of(prints.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[rows])], names=["key", "node"])


# -- links ----------------------------------------------------------------------------------------


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of prints (rows of 64-bit words)."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _joining_links(prints: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of one block (as places in it) that join two parts of it; each part is then one."""
    part = np.arange(len(prints))
    for i in range(len(prints) - 1):
        near = i + 1 + np.flatnonzero(_apart(prints[i + 1 :], prints[i]) <= max_bits)
        near = near[part[near] != part[i]]
        if len(near):
            others, first = np.unique(part[near], return_index=True)
            yield np.full(len(others), i), near[first]
            part[np.isin(part, others)] = part[i]


def _links(max_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by block: (key, i, j, node, print); a print is a number or a row of 64-bit words."""

    def within(names: np.ndarray, nodes: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[new, len(prints)])
        size_of = np.repeat(sizes, sizes)
        out = [(np.empty(0, np.int64),) * 2]
        block = np.repeat(np.arange(len(new)), sizes)
        for s in range(1, min(PLAIN, int(sizes.max()))):
            same = np.flatnonzero((block[s:] == block[:-s]) & (size_of[s:] <= PLAIN))
            hit = same[_apart(prints[same], prints[same + s]) <= max_bits]
            out.append((hit, hit + s))
        for k in np.flatnonzero(sizes > PLAIN):
            out += [(a + new[k], b + new[k]) for a, b in _joining_links(prints[new[k] : new[k] + sizes[k]], max_bits)]
        a, b = (nodes[np.concatenate(x)] for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def words(column: pa.Array) -> np.ndarray:
        if pa.types.is_integer(column.type):
            return column.to_numpy().view(np.uint64)[:, None]
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], axis=1), batch.column("node").to_numpy(), words(batch.column("print"))]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            changes = np.flatnonzero((held[0][1:] != held[0][:-1]).any(axis=1))
            if len(changes):  # the last block may go on in the next batch
                end = changes[-1] + 1
                yield within(*(x[:end] for x in held))
                held = [x[end:] for x in held]
        if held is not None and len(held[0]):
            yield within(*held)

    return run


def _shared_rows(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by key: (key, node). Those of keys with two nodes or more, with their number ``n``; a key
    of more than ``most`` nodes passes through uncounted (null), so that no group is held."""

    def made(keys: np.ndarray, nodes: np.ndarray, sizes: np.ndarray | None) -> pa.RecordBatch:
        n = pa.nulls(len(keys), pa.int64()) if sizes is None else pa.array(sizes)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes), n], names=["key", "node", "n"])

    def counted(keys: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        _, of, sizes = np.unique(keys, return_inverse=True, return_counts=True)
        shared = sizes[of] > 1
        return made(keys[shared], nodes[shared], sizes[of[shared]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, large = np.empty(0, np.int64), np.empty(0, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, nodes = np.concatenate([keys, batch.column("key").to_numpy()]), np.concatenate([nodes, batch.column("node").to_numpy()])
            if large is not None:  # rows of a large key that goes on
                end = np.searchsorted(keys, large, "right")
                yield made(keys[:end], nodes[:end], None)
                keys, nodes = keys[end:], nodes[end:]
            if len(keys):
                large, end = None, np.searchsorted(keys, keys[-1])
                yield counted(keys[:end], nodes[:end])
                keys, nodes = keys[end:], nodes[end:]
                if len(keys) > most:
                    large = keys[0]
                    yield made(keys, nodes, None)
                    keys, nodes = keys[:0], nodes[:0]
        yield counted(keys, nodes)

    return run


def _blocks_of_keys(keys: DataFrame, block: int) -> DataFrame:
    """``key, i, j, node`` for the nodes of keys that two nodes or more share: a key's nodes are dealt into
    parts, and each pair of parts ``i <= j`` is a block of at most about twice ``block`` nodes. Keys are made
    and shuffled once; what only one node has ends there."""
    rows = keys.repartition("key").sortWithinPartitions("key").mapInArrow(_shared_rows(2 * block), "key long, node long, n long")
    shared = scratch_table(rows, "shared-keys")
    large = shared.where("n is null").drop("n")
    sized = large.join(scratch_table(large.groupBy("key").agg(F.count("*").alias("n")), "large-keys"), "key")
    return _dealt(shared.where("n is not null").unionByName(sized.select("key", "node", "n")), block)


#: Fingerprints whose keys one task makes (about 110 keys of 16 bytes each).
PRINTS_A_TASK = 1 << 16


def _evenly(rows: DataFrame, *columns: str) -> DataFrame:
    """Small rows dealt out before each becomes many; ``rows`` is a written table."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PRINTS_A_TASK))
    return rows.select(*columns).repartition(tasks, columns[0])


def _dealt(rows: DataFrame, block: int, *others: str) -> DataFrame:
    """``_blocks_of_keys`` of rows that hold the key's number of nodes ``n``; ``others`` pass."""
    parts = F.ceil(F.col("n") / block).cast("long")
    rows = rows.select("key", "node", *others, F.pmod(F.xxhash64("node"), parts).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other"))
    return rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", *others)


def _block_links(rows: DataFrame, max_bits: int) -> DataFrame:
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return rows.mapInArrow(_links(max_bits), "a long, b long").distinct()


def near_links(prints: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``print``) that give the same components as all
    pairs within ``max_bits`` (at most 4, the keys' guarantee)."""
    if max_bits > MAX_BITS:
        raise ValueError(f"the keys find pairs of up to {MAX_BITS} differing bits")
    keys = _evenly(prints, "print").mapInArrow(_key_rows, "key long, node long")
    return _block_links(_blocks_of_keys(keys, block).withColumn("print", F.col("node")), max_bits)


# -- components -----------------------------------------------------------------------------------


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``), the root being the least node reachable.

    Alternating large-star and small-star contractions; what a hub has is joined, never gathered. The minima are
    written before each join (and told to all tasks while they are few), so that a hub's rows can be split."""
    edges = scratch_table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    digest = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before, now = None, digest(edges)
    while now != before:
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select("v", "u"))
        least = _bounded(scratch_table(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m")), name))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch_table(large, name)
        least = scratch_table(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(_bounded(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch_table(small.union(least).distinct(), name)
        before, now = now, digest(edges)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, print, component_id`` for every row."""
    prints = scratch_table(fingerprints(docs, doc_id, text, shingle, seed), "prints")
    distinct = scratch_table(prints.groupBy("print").agg(F.min("doc_id").alias("least_id")), "distinct-prints")
    roots = connected_components(near_links(distinct, max_bits))
    rooted = distinct.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = rooted.join(least, "root").select("print", "component_id")
    return prints.join(classes, "print").select("doc_id", "print", "component_id")


# -- near duplicates by similarity ----------------------------------------------------------------

#: Word-set prints that give keys, and 64-bit words of the shingle-set print that pre-selects.
KEY_PRINTS, PROOF_WORDS = 8, 8
LEAST_ID = -(1 << 63)
#: Standard errors by which a print may be off (the default), and the least set that prints are asked about at all.
MARGIN, LEAST_PRINTED = 6, 64
#: Documents sampled for shingles that are frequent, and how many of these are told to the workers.
SAMPLE_DOCS, MOST_FREQUENT = 8_000, 1 << 16
#: Rows (16 bytes each) that may be broadcast.
BROADCAST_ROWS = 500_000


def _mixed(hashes: np.ndarray, rounds: int) -> np.ndarray:
    """``rounds`` independent 64-bit hashes of each hash, as rows."""
    x = hashes[:, None] + np.arange(rounds, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _set_print(hashes: np.ndarray, rounds: int) -> bytes:
    """SimHash of a set of hashes, ``rounds`` times 64 bits."""
    hashes = np.unique(hashes)
    if not len(hashes):
        return bytes(8 * rounds)
    sums = sum(_bit_sums(_mixed(hashes[i : i + 4096], rounds)) for i in range(0, len(hashes), 4096))
    return np.packbits(2 * sums > len(hashes)).tobytes()


def shingle_set(text: str | None, shingle: int, seed: int) -> tuple[np.ndarray, int]:
    """The distinct shingle hashes in order, and the number that stands for the set."""
    import xxhash

    hashes = np.unique(shingle_hashes(text, shingle, seed))
    return hashes, xxhash.xxh64_intdigest(hashes.tobytes(), seed) - (1 << 63)


def _least_shared(n: int, similarity: float) -> int:
    """Shingles of a set of ``n`` that any set alike must hold."""
    return max(1, math.ceil(similarity * n - 1e-9))


def prefix_of(hashes: np.ndarray, similarity: float, frequent: np.ndarray) -> np.ndarray:
    """The first shingles of a set, one more than a set alike can lack, so that sets alike share one of them.
    The order is the same for all sets: frequent ones last, the most frequent (last in ``frequent``) at the end."""
    if not len(hashes):
        return hashes
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    if not len(frequent):
        return hashes[np.argsort(mixed)][: len(hashes) - _least_shared(len(hashes), similarity) + 1]
    order = np.argsort(frequent)
    place = np.minimum(np.searchsorted(frequent, hashes, sorter=order), len(frequent) - 1)
    rank = np.where(frequent[order[place]] == hashes, order[place] + 1, 0)
    return hashes[np.lexsort((mixed, rank))][: len(hashes) - _least_shared(len(hashes), similarity) + 1]


def _sample_rows(shingle: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for text in batch.column("text"):
                hashes = shingle_set(text.as_py(), shingle, seed)[0]
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], names=["hash"])

    return run


def frequent_shingles(source: DataFrame, shingle: int, seed: int) -> np.ndarray:
    """Shingles of several documents of a sample, the most frequent last. What is missed costs time, not links."""
    sample = source.select("text").sample(min(1.0, SAMPLE_DOCS / max(1, source.count())), seed)
    counts = sample.mapInArrow(_sample_rows(shingle, seed), "hash long").groupBy("hash").agg(F.count("*").alias("n"))
    top = counts.where("n > 2").orderBy(F.desc("n"), "hash").limit(MOST_FREQUENT).select("hash").toPandas()
    return np.ascontiguousarray(top["hash"].to_numpy(np.int64).view(np.uint64)[::-1])


#: A prefix holds so many bytes of each of its hashes: keys that meet by chance only cost time.
KEY_BYTES = 5


def _sketch_rows(shingle: int, seed: int, similarity: float, frequent: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            made = []
            for text in batch.column("text").to_pylist():
                hashes, node = shingle_set(text, shingle, seed)
                prefix = prefix_of(hashes, similarity, frequent).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()
                made.append((node, len(hashes), _set_print(shingle_hashes(text, 1, seed), KEY_PRINTS), _set_print(hashes, PROOF_WORDS), prefix))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            columns = [pa.array(x, kind) for x, kind in zip(zip(*made, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", "node", "n", "words", "print", "prefix"])

    return run


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "prefix", 1 << 20):
        prefixes = batch.column("prefix").to_pylist()
        flat = np.frombuffer(b"".join(prefixes), np.uint8).reshape(-1, KEY_BYTES)
        keys = np.zeros((len(flat), 8), np.uint8)
        keys[:, :KEY_BYTES] = flat
        sizes = [len(x) // KEY_BYTES for x in prefixes]
        named = [pa.array(np.repeat(batch.column(c).to_numpy(), sizes)) for c in ("node", "root", "size")]
        place = np.arange(len(flat)) - np.repeat(np.cumsum([0, *sizes])[:-1], sizes)
        columns = [pa.array(keys.view(np.int64)[:, 0]), *named, pa.array(place.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "root", "size", "place"]).filter(_first_of_each(keys.view(np.int64)[:, 0], sizes))


def _first_of_each(keys: np.ndarray, sizes: list[int]) -> pa.Array:
    """Which keys are the first such of their row."""
    first = np.zeros(len(keys), bool)
    first[np.unique(np.repeat(np.arange(len(sizes)), sizes) << 8 * KEY_BYTES | keys, return_index=True)[1]] = True
    return pa.array(first)


def _word_key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = batch.column("node").to_numpy()
        prints = np.frombuffer(b"".join(batch.column("words").to_pylist()), np.uint64).reshape(len(nodes), KEY_PRINTS)
        for number in range(KEY_PRINTS):
            rows, keys = keys_of(np.ascontiguousarray(prints[:, number]), 1)
            yield pa.RecordBatch.from_arrays([pa.array(number << 36 | keys), pa.array(nodes[rows])], names=["key", "node"])


def bits_apart(similarity: float) -> int:
    """Bits by which the proof prints of two shingle sets of that Jaccard similarity differ on average."""
    return round(64 * PROOF_WORDS * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def _open_pairs(similarity: float, margin: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by block: (key, i, j, node, root, n, place, print). All pairs of different roots that
    their sizes, the places of the key and, unless ``margin`` is None, their prints allow to be alike.

    Sets alike meet in the first shingle that both hold, and there nothing before counts: what is left from it on
    in either set must be as many as sets alike share. Sets that pass a meeting further on have met before."""
    mean = bits_apart(similarity)
    most = math.inf if margin is None else mean + margin * math.sqrt(mean * (1 - mean / (64 * PROOF_WORDS)))

    def within(nodes: np.ndarray, roots: np.ndarray, sizes: np.ndarray, places: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        left = sizes - places
        for i in range(len(nodes) - 1):
            small, large = np.minimum(sizes[i + 1 :], sizes[i]), np.maximum(sizes[i + 1 :], sizes[i])
            enough = np.minimum(left[i + 1 :], left[i]) * (1 + similarity) >= similarity * (small + large) - 1e-9
            near = i + 1 + np.flatnonzero((roots[i + 1 :] != roots[i]) & enough & (small >= similarity * large - 1e-9))
            near = near[(np.minimum(sizes[near], sizes[i]) < LEAST_PRINTED) | (_apart(prints[near], prints[i]) <= most)]
            if len(near):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(nodes[near], nodes[i])), pa.array(np.maximum(nodes[near], nodes[i]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], axis=1), *(batch.column(c).to_numpy() for c in ("node", "root", "n", "place"))]
            now.append(np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint64).reshape(batch.num_rows, -1))
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            ends = np.r_[0, 1 + np.flatnonzero((held[0][1:] != held[0][:-1]).any(axis=1))]
            for start, end in zip(ends[:-1], ends[1:], strict=True):
                yield from within(*(x[start:end] for x in held[1:]))
            held = [x[ends[-1] :] for x in held]  # the last block may go on in the next batch
        if held is not None and len(held[0]):
            yield from within(*held[1:])

    return run


def _set_rows(shingle: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            made = [shingle_set(text.as_py(), shingle, seed) for text in batch.column("text")]
            nodes, sets = pa.array([x[1] for x in made], pa.int64()), pa.array([x[0].tobytes() for x in made], pa.binary())
            yield pa.RecordBatch.from_arrays([nodes, sets], names=["node", "hashes"])

    return run


def _alike(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("hashes_a"), batch.column("hashes_b"), strict=True):
                x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def verified(pairs: DataFrame, nodes: DataFrame, source: DataFrame, shingle: int, similarity: float, seed: int) -> DataFrame:
    """The pairs ``a, b`` of nodes whose shingle sets have that Jaccard similarity, counted on the sets."""
    pairs = scratch_table(pairs, "pairs")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = scratch_table(nodes.select("node", "least_id").join(asked, "node").select("node", F.col("least_id").alias("id")), "wanted")
    ids = _bounded(wanted.select("id").distinct())
    sets = source.join(ids, "id", "left_semi").select("text").mapInArrow(_set_rows(shingle, seed), "node long, hashes binary")
    sets = scratch_table(sets.join(_bounded(wanted.select("node")), "node", "left_semi").dropDuplicates(["node"]), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("hashes_a")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hashes_b")), "b")
    return scratch_table(both.mapInArrow(_alike(similarity), "a long, b long"), "verified")


def _by_size(rows: DataFrame, block: int, similarity: float) -> DataFrame:
    """``key, node, n, place`` of rows that also hold ``size``: a key of more than ``block`` nodes becomes a key for each
    band of sizes. Sets alike lie in one band or in neighbouring ones, so that each set goes to its own band and the next,
    and a frequent shingle pairs no sets that their sizes tell apart."""
    few = rows.where(F.col("n") <= block).select("key", "node", "n", "place")
    band = F.floor(F.log("size") / (1e-9 - math.log(similarity)))
    many = rows.where(F.col("n") > block).select("key", "node", "place", F.explode(F.array(band, band + 1)).alias("band"))
    many = scratch_table(many.select(F.xxhash64("key", "band").alias("key"), "node", "place"), "size-bands")
    sizes = scratch_table(many.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "band-sizes")
    return few.unionByName(many.join(_bounded(sizes), "key").select("key", "node", "n", "place"))


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    found = nodes.join(_bounded(scratch_table(connected_components(links), "roots")), "node", "left")
    return found.withColumn("root", F.coalesce("root", "node"))


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, seed: int = 42, block: int = BLOCK, margin: float | None = MARGIN) -> DataFrame:
    """``id, class_id`` for every row: documents linked by a similarity of their sets of ``shingle``-word runs.

    Every link is verified: the Jaccard similarity is counted on the sets. Large groups of copies are joined
    first: ``KEY_PRINTS`` fingerprints of the word sets give Golay keys with an excess of one bit, and a 512-bit
    SimHash of the run sets picks a forest of likely links in each block. Then all other pairs are found by an
    exact prefix filter (sets alike share one of their first shingles, frequent ones ordered last): pairs of
    different classes that sizes, places of the shared shingle and prints, with a margin of ``margin`` standard
    errors (None: prints rule out nothing), do not rule out. ``id`` is ``doc_id`` with null as the least number; ``class_id`` is the least id of the class."""
    source = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LEAST_ID)).alias("id"), F.col(text).cast("string").alias("text"))
    made = source.mapInArrow(_sketch_rows(shingle, seed, similarity, frequent_shingles(source, shingle, seed)), "id long, node long, n long, words binary, print binary, prefix binary")
    sketches = scratch_table(made, "sketches")
    firsts = [F.first(c).alias(c) for c in ("n", "words", "print", "prefix")]
    nodes = scratch_table(sketches.groupBy("node").agg(*firsts, F.min("id").alias("least_id")), "sketch-nodes")
    # likely links, verified
    keys = _evenly(nodes, "node", "words").mapInArrow(_word_key_rows, "key long, node long")
    rows = _blocks_of_keys(keys, block).join(nodes.select("node", "print"), "node")
    links = verified(_block_links(rows, bits_apart(similarity)), nodes, source, shingle, similarity, seed)
    # all other pairs: keys that nodes of different roots share
    rooted = _rooted(nodes, links)
    keys = rooted.select("node", "root", F.col("n").alias("size"), "prefix").mapInArrow(_prefix_rows, "key long, node long, root long, size long, place int")
    keys = scratch_table(keys, "prefix-keys")
    mixed = keys.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where("x <> y")
    mixed = scratch_table(mixed.select("key", "n"), "mixed-keys")
    rows = scratch_table(keys.select("key", "node", "size", "place").join(_bounded(mixed), "key"), "prefix-rows")
    rows = _dealt(_by_size(rows, block, similarity), block, "place").join(rooted.select("node", "root", "n", "print"), "node")
    rows = rows.select("key", "i", "j", "node", "root", "n", "place", "print").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    pairs = rows.mapInArrow(_open_pairs(similarity, margin), "a long, b long").distinct()
    links = links.union(verified(pairs, nodes, source, shingle, similarity, seed))
    rooted = _rooted(nodes.select("node", "least_id"), links)
    classes = rooted.join(rooted.groupBy("root").agg(F.min("least_id").alias("class_id")), "root").select("node", "class_id")
    return sketches.select("id", "node").join(classes, "node").select("id", "class_id")


def keep_one_of_each_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents of which the class has no lesser id, with all their columns.

    Defined results: null and wordless texts are alike, so one of them stays; a null id counts as the least;
    rows that share an id go if any of them is in a class of a lesser id, else all stay; an empty table gives an
    empty one; columns of any name pass."""
    (gone_id,) = fresh(docs.columns, "_id")
    gone = near_duplicate_classes(docs, doc_id, text, **options).where("id <> class_id").select(F.col("id").alias(gone_id)).distinct()
    return docs.join(gone, F.coalesce(F.col(doc_id).cast("long"), F.lit(LEAST_ID)) == F.col(gone_id), "left_anti")
