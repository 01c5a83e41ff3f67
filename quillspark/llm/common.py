"""Shared helpers: scratch tables in the cluster's shared folder and bounded slices of Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Characters that separate words: space and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a regular expression class for Java and RE2.
SPACE_CLASS = r"[ \t-\r]"


def scratch_dir(spark: SparkSession) -> str:
    """The application's own part of the shared folder ``spark.checkpoint.dir``; where that is unset (tests), of
    the warehouse, which a cluster shares as well."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/scratch-{spark.sparkContext.applicationId}"


#: The part of the scratch folder that new tables go to; see ``scratch_scope``.
_scope: ContextVar[str] = ContextVar("scope", default="")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}{_scope.get()}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the shared file system, if it is there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are deleted at the end, also after a failure. What reads them must be written before,
    to a path taken outside."""
    inner = f"{_scope.get()}/scope-{uuid.uuid4().hex}"
    before = _scope.set(inner)
    try:
        yield
    finally:
        _scope.reset(before)
        delete(spark, scratch_dir(spark) + inner)


def scratch_table(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends there, columns prune,
    and a lost executor costs only the tasks it was running."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_buckets(df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
    """``scratch_table`` dealt into buckets of ``key`` and sorted in each: joins and sums on ``key`` with as many parts
    read it without a shuffle. The catalogue forgets the table once it is read; its files stay with the scratch ones."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", scratch_path(spark, name)).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    rows = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return rows


def remove_scratch(spark: SparkSession) -> None:
    """Delete all that this application's ``scratch_table`` calls have written. Results that still read it must be
    written before."""
    delete(spark, scratch_dir(spark))


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to clash with no column (in any case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text in each piece stays near ``most_bytes`` (one long row stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
