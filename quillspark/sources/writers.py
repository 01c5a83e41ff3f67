"""Sinks: result documents, leaderboards, pair exports, caches and plain sentences."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are packed: those of several models, and their repeats, are much alike. The quickest level is nearly as small.
PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
#: Files that a task keeps open when it writes a folder a value; for more values its rows are sorted first.
OPEN_FILES = 32
#: Folders that files of their own are dealt into: more than Spark lists one after the other.
FOLDERS = 256


def csv_fields(df: DataFrame, names: list[str], numbers: list[str], digits: int = 6) -> DataFrame:
    """Numbers with ``digits`` places, -1 where missing."""
    return df.select(*names, *(F.format_string(f"%.{digits}f", F.coalesce(F.col(c).cast("double"), F.lit(-1.0))).alias(c) for c in numbers))


def write_leaderboard(df: DataFrame, path: str, names: list[str], numbers: list[str]) -> None:
    """CSV sorted by ``cer``, missing last. One row per model, so one file."""
    ordered = df.orderBy(F.col("cer").asc_nulls_last(), *names)
    csv_fields(ordered, names, numbers).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def run_folder(path: str, model: str, at: datetime) -> str:
    """Folder of one run: the model and the time."""
    return f"{path}/{model}_{at:%Y%m%d_%H%M%S}"


def run_metadata(files: DataFrame, model: str, at: datetime, modes: dict[str, list[str]], total: DataFrame) -> DataFrame:
    """One row: model, time, the inputs by hash (rows of the ``binaryFile`` source), the modes and the conjunctions of
    each, and the number of samples (``total``, one row)."""
    inputs = content_hashes(files).agg(F.array_sort(F.collect_list(F.struct("path", "sha256"))).alias("inputs"))  # a row per input file
    lists = F.create_map(*(c for mode, words in modes.items() for c in (F.lit(mode), F.array(*map(F.lit, words)).cast("array<string>"))))
    return inputs.crossJoin(total).select(F.lit(model).alias("model"), F.lit(at.isoformat()).alias("timestamp"), "inputs", F.array(*map(F.lit, modes)).alias("modes"), lists.alias("conjunctions"), "total_samples")


def mode_fields(modes: DataFrame) -> DataFrame:
    """The mode comparison as text: two places for BLEU and chrF, three for TER, one for segments."""
    places = {"bleu": 2, "chrf": 2, "ter": 3, "avg_segments": 1}
    text = lambda c: F.format_string(f"%.{places[c]}f", F.col(c)) if c in places else F.col(c).cast("string")
    return modes.select("mode", *(text(c).alias(c) for c in ("bleu", "chrf", "ter", "avg_segments", "samples_split", "total_samples")))


def write_mode_comparison(modes: DataFrame, path: str) -> None:
    """CSV, a row per mode, so one file."""
    mode_fields(modes).orderBy("mode").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_results(per_sample: DataFrame, aggregate: DataFrame, metadata: DataFrame, path: str) -> None:
    """JSON under the run's folder: the samples under ``samples``, and one document of metadata and aggregate
    metrics."""
    per_sample.write.mode("overwrite").json(f"{path}/samples")
    head = metadata.select(F.struct("*").alias("metadata")).crossJoin(aggregate.select(F.struct("*").alias("aggregate_metrics")))  # one row each
    head.write.mode("overwrite").json(f"{path}/summary")


@contextmanager
def open_folders(spark: SparkSession) -> Iterator[None]:
    """Tasks that write a folder a value do not sort (and spill) their rows by it while this lasts."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, OPEN_FILES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_json_folders(rows: DataFrame, path: str, by: str) -> None:
    """Packed JSON lines, a folder a value."""
    with open_folders(rows.sparkSession):
        rows.write.mode("overwrite").partitionBy(by).options(**PACKED).json(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Prediction cache, replaced as a whole, one folder per model so that readers prune."""
    write_json_folders(predictions, path, "model")


def append_memory(rows: DataFrame, path: str) -> None:
    """Append translations with the time; failures (``[Translation ...``) are never kept."""
    kept = rows.where(~F.col("translation").startswith("[Translation")).select("text", "translation", F.current_timestamp().alias("timestamp"))
    kept.write.mode("append").json(path)


def tsv_fields(pairs: DataFrame) -> DataFrame:
    """Values without tabs."""
    return pairs.select(*(F.replace(F.col(c), F.lit("\t"), F.lit(" ")).alias(c) if kind == "string" else F.col(c) for c, kind in pairs.dtypes))


def write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").json(f"{path}/jsonl")
    tsv_fields(pairs).write.mode("overwrite").option("sep", "\t").option("quote", "").csv(f"{path}/tsv")


def write_sentences(sentences: DataFrame, path: str, order: str = "idx", text: str = "text") -> None:
    """One sentence per line, in order over the files."""
    sentences.orderBy(order).select(text).write.mode("overwrite").text(path)


def write_split_experiment(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """Summary and rows as JSON, and the comparison as CSV, from rows that are computed once."""
    rows = rows.persist()
    rows.write.mode("overwrite").json(f"{path}/detail")
    flat = [c for c, kind in rows.dtypes if not kind.startswith("array")]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/comparison")
    summary.write.mode("overwrite").json(f"{path}/summary")
    rows.unpersist()


def content_hash() -> Column:
    return F.sha2("content", 256).alias("sha256")


def content_hashes(files: DataFrame) -> DataFrame:
    """``path, sha256`` of rows of the ``binaryFile`` source: what a run's metadata names its inputs by."""
    return files.select("path", content_hash())


def write_files(rows: DataFrame, path: str) -> list[str]:
    """Rows ``key, text`` as files of their own, each a text and a line end, named ``name=key.txt`` by the name of the first
    column, whose values are unique; the folders they are in, which a reader lists in parallel.

    Spark's writer makes a folder a key, moves each file twice and, on a local disk, starts a program for each; here a task
    opens its files itself and gives a file its name once it is whole, so that a task that runs again replaces what it
    wrote. Where Arrow does not know the file system, Spark's writer does it."""
    key, text = rows.columns
    try:
        system, root = fs.FileSystem.from_uri(path)
        for k in range(FOLDERS):
            system.create_dir(f"{root}/{k:03x}")
    except (pa.ArrowException, OSError, NotImplementedError):
        rows.write.partitionBy(key).text(path)
        return [path]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for k, content in zip(batch.column(0), batch.column(1), strict=True):
                folder = f"{root}/{zlib.crc32(str(k).encode()) % FOLDERS:03x}"
                made = f"{folder}/_{uuid.uuid4().hex}"  # hidden from readers
                with system.open_output_stream(made) as out:
                    out.write((content.as_py() or "").encode() + b"\n")
                system.move(made, f"{folder}/{key}={k}.txt")
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], ["n"])

    rows.mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()
    return [f"{path}/{k:03x}" for k in range(FOLDERS)]
