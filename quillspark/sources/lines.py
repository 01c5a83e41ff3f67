"""Numbered lines of text files of any size.

A file is read in splits by many tasks, and none knows how many lines lie before its split. One pass counts the lines of
each split; running sums over that table, a row a split, give the number of each split's first line; a second pass
counts on from there within the split. Lines end with LF; a CR before it stays. Compressed files are one split each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_PLACE = ["path", "split"]


def _scan(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"))


def split_counts(spark: SparkSession, path: str) -> DataFrame:
    """``path, split, n, first``: lines of each split (named by its first byte) and the number, from 0, of its first line in
    the file. Splits without the start of a line have no row."""
    counts = _scan(spark, path).groupBy(*_PLACE).agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("path").orderBy("split").rowsBetween(W.unboundedPreceding, -1))
    return counts.select(*_PLACE, "n", F.coalesce(before, F.lit(0)).alias("first"))


def _counted(rows: DataFrame) -> DataFrame:
    """Rows with their place within their split, ``k``: a split's rows come one after the other, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, 0
        for batch in batches:
            if not len(batch):
                continue
            split, paths = batch.column("split").to_numpy(), batch.column("path").dictionary_encode()
            file = paths.indices.to_numpy()
            starts = np.flatnonzero(np.append(True, (split[1:] != split[:-1]) | (file[1:] != file[:-1])))
            k = np.arange(len(batch)) - np.repeat(starts, np.diff(np.append(starts, len(batch))))
            if (batch.column("path")[0].as_py(), int(split[0])) == now:
                k[: starts[1] if len(starts) > 1 else len(batch)] += seen
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k)], [*batch.schema.names, "k"])
            now, seen = (batch.column("path")[-1].as_py(), int(split[-1])), int(k[-1]) + 1

    return rows.mapInArrow(run, "path string, split long, line string, k long")


def numbered_lines(spark: SparkSession, path: str, by_file: bool = True) -> DataFrame:
    """``path, line_no, line`` of every line of the text files at ``path``, numbered from 0 in each file, or over all files in
    the order of their paths. The table of splits is joined as its size allows: beside the lines, or, where it is small, as a
    copy in each task."""
    first = split_counts(spark, path)
    if not by_file:
        sizes = first.groupBy("path").agg(F.sum("n").alias("_n"))  # a row a file
        before = sizes.select("path", F.coalesce(F.sum("_n").over(W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        first = first.join(before, "path").withColumn("first", F.col("first") + F.col("_before"))
    first = first.select(*_PLACE, "first")
    return _counted(_scan(spark, path)).join(first, _PLACE).select("path", (F.col("first") + F.col("k")).alias("line_no"), "line")


def get_lines(spark: SparkSession, path: str, start: int, count: int, counts: DataFrame | None = None) -> DataFrame:
    """Lines ``start`` to ``start + count`` of one file. Rows of splits that hold none are left out as they are read, before
    they reach Python; ``counts`` (``split_counts``, kept from before) saves the first pass."""
    counts = split_counts(spark, path) if counts is None else counts
    wanted = counts.where((F.col("first") < start + count) & (F.col("first") + F.col("n") > start)).agg(F.min("split").alias("a"), F.max("split").alias("b")).first()
    if wanted.a is None:
        return numbered_lines(spark, path).where(F.lit(False))
    part = _scan(spark, path).where(F.col("split").between(wanted.a, wanted.b))
    numbered = _counted(part).join(counts.select(*_PLACE, "first"), _PLACE).select("path", (F.col("first") + F.col("k")).alias("line_no"), "line")
    return numbered.where(F.col("line_no").between(start, start + count - 1))
