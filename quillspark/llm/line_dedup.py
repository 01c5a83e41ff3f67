"""Line dedup over levelled sorted runs of line hashes (operator 4).

``LineRuns`` holds what is known of lines as runs: tables of (hash, documents, largest id), bucketed and sorted
by hash, one file a bucket. A new batch is counted per hash (its only shuffle, into as many parts as the runs have
buckets), merge-anti-joined bucket by bucket with the hashes that the runs already hold often enough, and what is
left is written as a run of level 0; when a level holds ``fanout`` runs they are merged into one of the next level.

``dedup_lines`` feeds the documents in batches of falling id, so that a hash found often enough in earlier
batches needs nothing from later ones, then drops each frequent line outside the largest document holding it.

Defined results: null text is one empty line; rows that share an id are one document to the count (and all keep
a line if their id is the largest that holds it); a row with a null id is a document of its own, of lesser id
than any other; lines whose key is shorter than ``min_chars`` always stay; an empty table gives an empty result.
Other columns pass; input columns named ``n_lines`` or ``n_dropped`` are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import md5

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import SPACES, fresh, scratch_buckets, scratch_table, slices

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 20, 3, 4, 3
LEAST_ID = -(1 << 63)


def line_keys(texts: pa.Array, min_chars: int) -> tuple[pa.Array, list[int], list[int], list[bytes]]:
    """All lines, and of those with a key of ``min_chars`` or more: place, row and hash."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    lines, rows = lists.flatten(), pc.list_parent_indices(lists)
    keys = pc.ascii_lower(pc.ascii_trim(lines, SPACES))
    at = pc.indices_nonzero(pc.greater_equal(pc.utf8_length(keys), min_chars))
    hashes = [md5(k.encode()).digest() for k in keys.take(at).to_pylist()]
    return lines, at.to_pylist(), rows.take(at).to_pylist(), hashes


def _line_rows(min_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            _, _, rows, hashes = line_keys(batch.column("text"), min_chars)
            pairs = list(dict.fromkeys(zip(rows, hashes, strict=True)))
            at = pa.array([r for r, _ in pairs], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([h for _, h in pairs], pa.binary()), batch.column("doc").take(at), batch.column("batch").take(at)], names=["h", "doc", "batch"])

    return run


class LineRuns:
    """Levelled runs of (h, n, last); see the module."""

    def __init__(self, buckets: int, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.buckets, self.min_docs, self.fanout = buckets, min_docs, fanout
        self.levels: list[list[DataFrame]] = []

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """Runs as one, by sort-merge joins of their buckets. (No union: Spark 4.1 takes a union of bucketed scans for
        bucketed and sums it without a shuffle, though its parts hold one file each.)"""

        def merge(left: DataFrame, right: DataFrame) -> DataFrame:
            right = right.select("h", F.col("n").alias("n_right"), F.col("last").alias("last_right"))
            n = F.coalesce("n", F.lit(0)) + F.coalesce("n_right", F.lit(0))
            return left.join(right.hint("merge"), "h", "full_outer").select("h", n.alias("n"), F.greatest("last", "last_right").alias("last"))

        return reduce(merge, runs)

    @property
    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unsettled(self, lines: DataFrame) -> DataFrame:
        """Counts of a batch of (h, doc) but for the hashes that the runs settle already."""
        own = lines.groupBy("h").agg(F.count("*").alias("n"), F.max("doc").alias("last"))
        for run in self.runs:
            # an anti-join by name would be moved below the count, and a frequent line's rows into one task with it
            settled = run.where(F.col("n") >= self.min_docs).select("h", F.lit(True).alias("settled"))
            own = own.join(settled.hint("merge"), "h", "left").where("settled IS NULL").drop("settled")
        return own

    def add(self, lines: DataFrame) -> None:
        """Add the unsettled counts of a batch of (h, doc) as a run."""
        self._push(0, self.unsettled(lines))

    def _push(self, level: int, rows: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(scratch_buckets(rows, f"line_run_{level}", self.buckets, "h"))
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._merged(full))

    def frequent(self) -> DataFrame:
        """(h, last) of lines in at least ``min_docs`` documents."""
        return self._merged(self.runs).where(F.col("n") >= self.min_docs).select("h", "last")


def _rewrite(kept: list[str], text: str, drops: str, min_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = pc.fill_null(batch.column(text), "")
            counts, dropped, new = pc.add(pc.count_substring(texts, "\n"), 1).cast(pa.int64()), [0] * batch.num_rows, {}
            touched = pc.indices_nonzero(pc.is_valid(batch.column(drops)))
            for i in touched.to_pylist():
                drop = set(batch.column(drops)[i].as_py())
                lines, at, _, hashes = line_keys(texts.slice(i, 1), min_chars)
                gone = {p for p, h in zip(at, hashes, strict=True) if h in drop}
                dropped[i] = len(gone)
                new[i] = "\n".join(x for p, x in enumerate(lines.to_pylist()) if p not in gone)
            if new:
                mask = pa.array([i in new for i in range(batch.num_rows)])
                texts = pc.replace_with_mask(texts, mask, pa.array([new[i] for i in sorted(new)], texts.type))
            columns = [texts if c == text else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, counts, pa.array(dropped, pa.int64())], names=[*kept, "n_lines", "n_dropped"])

    return run


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """The documents with ``text`` rewritten, ``n_lines`` before dropping and ``n_dropped``."""
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    doc, drop = fresh(docs.columns, "_doc", "_drop")
    id_or_least = F.coalesce(F.col(doc_id).cast("long"), F.lit(LEAST_ID))
    # batches of falling id: the cuts only set how much each batch holds
    cuts = docs.where(F.col(doc_id).isNotNull()).agg(F.percentile_approx(F.col(doc_id).cast("long"), [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    number = reduce(lambda a, c: a + F.when(F.col("doc") < c, 1).otherwise(0), cuts, F.lit(0))
    source = docs.select(id_or_least.alias("doc"), F.col(text).alias("text")).withColumn("batch", number.cast("int"))
    lines = source.mapInArrow(_line_rows(min_chars), "h binary, doc long, batch int")
    # a document's rows are in one batch; only ids that several rows share can repeat a line
    shared = scratch_table(docs.where(F.col(doc_id).isNotNull()).groupBy(id_or_least.alias("doc")).agg(F.count("*").alias("n")).where("n > 1").select("doc"), "shared-ids")
    if shared.count():
        again = lines.join(shared, "doc", "left_semi").distinct().select("h", "doc", "batch")
        lines = lines.join(shared, "doc", "left_anti").select("h", "doc", "batch").union(again)
    lines = scratch_table(lines, "lines", "batch")
    runs = LineRuns(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min_docs)
    for b in range(len(cuts) + 1):
        runs.add(lines.where(F.col("batch") == b).select("h", "doc"))
    # as a written table the state is dealt anew for the join, so that a frequent line's rows can be split
    frequent = scratch_table(runs.frequent(), "frequent-lines")
    drops = lines.join(frequent, "h").where("doc < last").groupBy("doc").agg(F.collect_set("h").alias(drop))
    joined = docs.select(*kept, id_or_least.alias(doc)).join(drops.withColumnRenamed("doc", doc), doc, "left").select(*kept, drop)
    fields = [T.StructField(f.name, f.dataType, True) for f in docs.schema if f.name in kept]
    out = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(_rewrite(kept, text, drop, min_chars), out)
