"""Benchmark decontamination by size-partitioned MinHash containment (operator 1), DataFrame functions only.

An item is contained in a document that holds at least ``containment`` of its distinct word shingles. Items
are partitioned by size; a partition keeps for each item as many of its smallest shingle hashes (a MinHash
sketch) as a containing document can miss, plus one, so every containing document holds a sketch hash: the
search loses no item, however short beside the document. Document shingles meet the sketches in one join
(broadcast while the sketches' counted bytes stay within ``BROADCAST_BYTES``, shuffled beyond), and each
candidate pair is verified on the shingles themselves.

Words are runs of letters and digits (any character beyond ASCII counts as a letter), lower-cased. An item
of fewer than ``shingle`` words is one shingle of all its words. Defined results: items and documents without
words match nothing; a repeated document row reports its own pairs; repeated item ids report each row's
match once per distinct text; a null ``doc_id`` is reported as null; empty tables give no pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import fresh, scratch_table

SHINGLE, CONTAINMENT = 5, 0.8
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of sketches or items, as counted from the written rows, that may be broadcast.
BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _windows(words: Column, k: Column | int, make: Callable[[Column], Column], kind: str) -> Column:
    """``make`` of each run of ``k`` words; an empty array where there are fewer."""
    k = k if isinstance(k, Column) else F.lit(k)
    none = F.array().cast(f"array<{kind}>")
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: make(F.slice(words, i, k)))).otherwise(none)


def _joined(run: Column) -> Column:
    return F.array_join(run, " ")


def _hash_with(k: Column | int) -> Callable[[Column], Column]:
    """Runs of different lengths hash apart."""
    return lambda run: F.xxhash64(run, k if isinstance(k, Column) else F.lit(k))


def _item_shingles(items: DataFrame, item_id: str, text: str, shingle: int, containment: float) -> DataFrame:
    """``item_id, k, shingles, n, need`` of every item that has words."""
    rows = items.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    rows = rows.withColumn("k", F.least(F.lit(shingle), F.size("words")))
    rows = rows.select("item_id", "k", F.array_sort(F.array_distinct(_windows(F.col("words"), F.col("k"), _joined, "string"))).alias("shingles")).distinct()
    rows = rows.withColumn("n", F.size("shingles"))
    return rows.withColumn("need", F.greatest(F.lit(1), F.ceil(F.lit(containment) * F.col("n") - F.lit(1e-9)).cast("int")))


def _sketches(items: DataFrame) -> DataFrame:
    """``hash, item`` rows: per size partition (sizes within a factor of two) the smallest hashes of each item."""
    sized = items.withColumn("part", F.floor(F.log2("n"))).withColumn("missed", F.col("n") - F.col("need"))
    depth = sized.groupBy("part").agg((F.max("missed") + 1).alias("depth"))
    of = _hash_with(F.col("k"))
    hashes = F.array_sort(F.transform("shingles", lambda s: of(F.split(s, " "))))
    kept = sized.join(depth, "part").select("item_id", F.explode(F.slice(hashes, F.lit(1), F.col("depth"))).alias("hash"))
    return kept.select("hash", "item_id").distinct()


def _bounded(df: DataFrame) -> DataFrame:
    """``df``, a written table, with the advice to broadcast it if its values are small together."""
    of = {"string": lambda c: F.octet_length(c), "array<string>": lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + 16 + F.octet_length(x))}
    size = sum((F.coalesce(of[kind](c), F.lit(0)) if kind in of else F.lit(8) for c, kind in df.dtypes), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES else df


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", shingle: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id, item_id, n_shared, n_shingles, containment`` of every item contained in a document."""
    known = scratch_table(_item_shingles(items, item_id, text, shingle, containment), "items")
    sketches = scratch_table(_sketches(known), "sketches")
    lengths = [r["k"] for r in known.select("k").distinct().collect()]  # at most ``shingle`` numbers
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    words = source.select("doc_id", words_of(F.col("text")).alias("words"))
    hashed = [_windows(F.col("words"), k, _hash_with(k), "bigint") for k in lengths]
    hashes = F.concat(*hashed) if hashed else F.array().cast("array<bigint>")
    # the search: every document shingle against the sketches
    candidates = words.select("doc_id", F.explode(hashes).alias("hash")).join(_bounded(sketches), "hash")
    candidates = scratch_table(candidates.select(F.col("doc_id").alias("candidate"), "item_id").distinct(), "candidates")
    # the proof: shared shingles, counted on the words themselves
    pairs = source.join(candidates, F.col("doc_id").eqNullSafe(F.col("candidate"))).select("doc_id", words_of(F.col("text")).alias("words"), "item_id")
    pairs = pairs.join(_bounded(known), "item_id")
    shared = F.size(F.array_intersect("shingles", _windows(F.col("words"), F.col("k"), _joined, "string")))
    found = pairs.select("doc_id", "item_id", shared.cast("long").alias("n_shared"), F.col("n").cast("long").alias("n_shingles"), "need").where("n_shared >= need")
    return found.select("doc_id", "item_id", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def remove_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents that contain no item, with all their columns.

    Defined results: null and wordless texts stay; rows that share an id with a contaminated one go with it (null
    ids too); with an empty table of items, or of documents, all stay; columns of any name pass."""
    (leak,) = fresh(docs.columns, "_leak")
    leaks = contained_items(docs, items, doc_id, **options).select(F.col("doc_id").alias(leak)).distinct()
    return docs.join(leaks, F.col(doc_id).eqNullSafe(F.col(leak)), "left_anti")
