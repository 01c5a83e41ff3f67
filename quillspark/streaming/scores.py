"""Incremental scoring of arriving prediction files.

The running state is sums and counts per model and source, never means, and means are taken when it is read.
Repeated (model, id) rows count once if they arrive within a set time of the first: the stream keeps a key for so long
and no longer, in its own partitioned state on disk, so that the state holds the keys of that time only (about 100 bytes
each) and a batch reads nothing but what arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.scoring import score_rows

ARRIVAL = "model string, id string, source string, reference string, prediction string, at timestamp"
SUMS = ("n", "cer", "wer", "exact", "normalized")
#: How long after the first row of a key another counts as a repeat.
WITHIN = "1 hour"
#: State is kept in files beside the task and in the checkpoint, not in the executor's heap.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: A batch writes the keys that it changed, not the files of the whole store, and no key is looked up anew to count keys.
STATE_WRITES = {"changelogCheckpointing.enabled": "true", "trackTotalNumberOfRows": "false"}


def score_sums(scored: DataFrame) -> DataFrame:
    """Counts and error sums per model and source of scored rows."""
    return scored.groupBy("model", "source").agg(F.count("*").alias("n"), *(F.sum(m).alias(m) for m in SUMS[1:]))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The state so far: sums of all batches."""
    parts = spark.read.parquet(f"{path}/sums")
    return parts.groupBy("model", "source").agg(*(F.sum(m).alias(m) for m in SUMS))


def means(state: DataFrame) -> DataFrame:
    return state.select("model", "source", "n", *(F.try_divide(m, "n").alias(m) for m in SUMS[1:]))


def means_by_source(state: DataFrame) -> DataFrame:
    """``means`` per model and source, and per model over all sources (``source`` is then ``all``)."""
    whole = state.groupBy("model").agg(*(F.sum(m).alias(m) for m in SUMS)).withColumn("source", F.lit("all"))
    return means(state.unionByName(whole))


def add_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Write the sums of rows not seen before under the batch's number: a batch that is run again after a failure
    replaces what it wrote, so nothing counts twice."""
    score_sums(batch).write.mode("overwrite").parquet(f"{path}/sums/batch={batch_id}")


def scored_arrivals(arriving: DataFrame) -> DataFrame:
    """Rows of a stream with their scores in place of their texts, so that no text is shuffled to meet its repeats. Event
    time is ``at``, or else when the row's file was written."""
    timed = arriving.withColumn("at", F.coalesce("at", F.col("_metadata.file_modification_time")))
    return score_rows(timed, with_wer=True).drop("reference", "prediction")


def first_arrivals(timed: DataFrame, within: str = WITHIN) -> DataFrame:
    """Rows whose (model, id) has not come within the time before."""
    return timed.withWatermark("at", within).dropDuplicatesWithinWatermark(["model", "id"])


def score_stream(spark: SparkSession, source: str, path: str, checkpoint: str, within: str = WITHIN) -> StreamingQuery:
    """Score JSON files as they arrive under ``source``; the state is under ``path``. Runs until nothing is left, and
    goes on from ``checkpoint`` when it is started again."""
    spark.conf.set(*STATE_STORE)
    for key, value in STATE_WRITES.items():
        spark.conf.set(f"spark.sql.streaming.stateStore.rocksdb.{key}", value)
    arriving = first_arrivals(scored_arrivals(spark.readStream.schema(ARRIVAL).json(source)), within)
    return arriving.writeStream.foreachBatch(lambda batch, number: add_batch(batch, number, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
