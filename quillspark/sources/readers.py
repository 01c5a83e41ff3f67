"""Scans: keyed JSON corpora, prediction and memory files, result documents, numbered lines, training logs.

Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import strip

ENTRY = "original string, translation string, original_formatted string, translation_formatted string"
PREDICTION = "id string, prediction string, reference string"
MEMORY = "text string, translation string, timestamp string"
_METRICS = "cer, wer, accuracy, normalized_accuracy, hf_cer, hf_wer, hf_accuracy, hf_normalized_accuracy, book_cer, book_wer, book_accuracy, book_normalized_accuracy"
RESULT = f"model string, status string, error string, num_samples int, hf_count int, book_count int, inference_time double, metrics struct<{', '.join(f'{m}:double' for m in _METRICS.split(', '))}>"


def keyed_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of entries by id; the scalar ``length`` and anything else that is no entry is left out."""
    whole = spark.read.text(path, wholetext=True)
    raw = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "entry"))
    return raw.where(F.col("id") != "length").select("id", F.from_json("entry", ENTRY).alias("e")).where("e is not null").select("id", "e.*")


def nonempty_pairs(corpus: DataFrame) -> DataFrame:
    """Stripped pairs in which both sides hold text; readers that need them in order sort by ``id`` as a number."""
    both = corpus.withColumns({"original": strip(F.col("original")), "translation": strip(F.col("translation"))})
    return both.where((F.col("original") != "") & (F.col("translation") != ""))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, blank lines skipped."""
    return spark.read.schema(PREDICTION).json(path).where("id is not null or prediction is not null")


def translation_memory(spark: SparkSession, path: str) -> DataFrame:
    """The last translation of each text."""
    rows = spark.read.schema(MEMORY).json(path).where("text is not null")
    return rows.groupBy("text").agg(F.max_by("translation", "timestamp").alias("translation"))


def model_results(spark: SparkSession, path: str) -> DataFrame:
    """Successful runs of a result document, rates in percent, best first."""
    rows = spark.read.schema(RESULT).option("multiLine", True).json(path).where("status = 'success'")
    flat = rows.select("model", "num_samples", "hf_count", "book_count", "inference_time", "metrics.*")
    percent = [(F.col(m) * 100).alias(m) if m in _METRICS.split(", ") else F.col(m) for m in flat.columns]
    return flat.select(*percent).orderBy(F.col("cer").asc_nulls_last(), "model")


def numbered_lines(text: Column) -> Column:
    """For ``select``: line number from 0, and line."""
    return F.posexplode(F.split(text, "\n")).alias("idx", "line")


def assets(paths: DataFrame, corpus_ids: DataFrame, rule: str = r"entry_(\w+)\.png$", path: str = "path") -> DataFrame:
    """Files whose name holds an id of the corpus."""
    found = paths.withColumn("id", F.regexp_extract(path, rule, 1)).where("id <> ''")
    return found.join(corpus_ids.select(F.col("id").cast("string").alias("id")).distinct(), "id")


def test_set(sampled: DataFrame, book: DataFrame) -> DataFrame:
    """Both sources with prefixed ids; a book text is its formatted form, or else its plain one, and not blank."""
    text = F.coalesce(F.nullif(F.col("original_formatted"), F.lit("")), F.col("original"))
    first = sampled.select(F.concat(F.lit("hf_"), F.col("id").cast("string")).alias("id"), F.lit("hf").alias("source"), "text")
    second = book.select(F.concat(F.lit("book_"), F.col("id").cast("string")).alias("id"), F.lit("book").alias("source"), text.alias("text"))
    return first.unionByName(second.where(strip(F.col("text")) != ""))


# -- training logs --------------------------------------------------------------------------------

FINAL, EPOCH_RATES = r"Training complete\. Best CER: ([\d.]+)", r"CER: ([\d.]+) \| WER: ([\d.]+)"
EPOCH = r"Epoch (\d+)/\d+ \| Train Loss: ([\d.]+) \| Val Loss: ([\d.]+) \| CER: ([\d.]+)"


def log_result(lines: DataFrame, log: str = "log", order: str = "line_no", text: str = "text") -> DataFrame:
    """Per log the final best CER, or else the last epoch's; the last epoch's WER; and whether either was found."""
    number = lambda rule, i: F.nullif(F.regexp_extract(text, rule, i), F.lit("")).cast("double")
    each = lines.select(log, order, number(FINAL, 1).alias("final"), number(EPOCH_RATES, 1).alias("cer"), number(EPOCH_RATES, 2).alias("wer"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    out = each.groupBy(log).agg(F.min_by("final", F.when(F.col("final").isNotNull(), F.col(order))).alias("final"), last("cer").alias("cer"), last("wer").alias("wer"))
    cer = F.coalesce("final", "cer")
    return out.select(log, cer.alias("cer"), "wer", cer.isNotNull().alias("success"))


def log_epochs(lines: DataFrame, log: str = "log", text: str = "text") -> DataFrame:
    """``epoch, train_loss, val_loss, cer`` of each epoch line."""
    part = lambda i, kind: F.regexp_extract(text, EPOCH, i).cast(kind)
    found = lines.where(F.col(text).rlike(EPOCH))
    return found.select(log, part(1, "int").alias("epoch"), part(2, "double").alias("train_loss"), part(3, "double").alias("val_loss"), part(4, "double").alias("cer"))


#: Lines that end a run: an error with its message, and the exit code of one that failed.
ERROR, EXIT = r"(?:Error|Exception): (.*)", r"Exit code: ([1-9]\d*)"


def run_outcomes(lines: DataFrame, idle_seconds: int = 3600, as_of: Column | None = None) -> DataFrame:
    """``log, status, best_cer, message, seconds`` of training logs ``(log, at, line_no, text)``.

    The first of these decides: a final line (``success``, with its value), an error line (``error``, with its message), a
    non-zero exit code (``failed``, with the code), or ``idle_seconds`` without a line (``timeout``). A log that has none
    is ``running`` until it has been silent so long before ``as_of`` (the time of the last line of all logs if not given).
    ``seconds`` run from the first line to that end, or to the last line of one that is running. Lines without a time are
    left out; of lines of one time the lower number comes first.

    A pause of that length cannot lie within a stretch of it, so lines are first reduced to the ends of each stretch, and
    only these are put in order: a log that holds a third of all lines is no more than its stretches."""
    lines = lines.withColumn("at", F.col("at").cast("timestamp"))
    text = F.coalesce("text", F.lit(""))
    kind = F.when(text.rlike(FINAL), "success").when(text.rlike(ERROR), "error").when(text.rlike(EXIT), "failed")
    value = F.when(kind == "success", F.regexp_extract(text, FINAL, 1).cast("double"))
    message = F.when(kind == "error", F.regexp_extract(text, ERROR, 1)).when(kind == "failed", F.regexp_extract(text, EXIT, 1))
    end = F.when(kind.isNotNull(), F.struct("at", "line_no", kind.alias("status"), value.alias("best_cer"), message.alias("message")))
    stretch = F.floor(F.unix_micros("at") / (idle_seconds * 1_000_000))
    parts = lines.where("at IS NOT NULL").select("log", "at", end.alias("end"), stretch.alias("stretch")).groupBy("log", "stretch").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.min("end").alias("end"))
    idle = F.make_dt_interval(secs=F.lit(idle_seconds))
    before = F.lag("last").over(W.partitionBy("log").orderBy("stretch"))
    parts = parts.withColumn("stall", F.when(F.col("first") > before + idle, before + idle))
    logs = parts.groupBy("log").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("end").alias("end"), F.min("stall").alias("stall"))
    if as_of is None:
        logs = logs.crossJoin(F.broadcast(lines.agg(F.max("at").alias("now"))))  # one row
    else:
        logs = logs.withColumn("now", as_of)
    stall = F.coalesce("stall", F.when(F.col("now") > F.col("last") + idle, F.col("last") + idle))
    ended = F.col("end").isNotNull() & (stall.isNull() | (F.col("end.at") <= stall))
    until = F.when(ended, F.col("end.at")).otherwise(F.coalesce(stall, F.col("last")))
    status = F.when(ended, F.col("end.status")).when(stall.isNotNull(), "timeout").otherwise("running")
    seconds = F.floor((F.unix_micros(until) - F.unix_micros("first")) / 1_000_000)
    return logs.select("log", status.alias("status"), *(F.when(ended, F.col(f"end.{c}")).alias(c) for c in ("best_cer", "message")), seconds.alias("seconds"))


# -- files as rows --------------------------------------------------------------------------------

#: The columns of a file as a row (fixed by the source).
FILE = "path string, modificationTime timestamp, length long, content binary"


def files(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """``path, modificationTime, length, content`` of files under ``path``, at any depth, whose names fit ``glob``. What is
    not selected is not read: without ``content`` no file is opened. Empty files are no rows: the source leaves them out."""
    return spark.read.format("binaryFile").schema(FILE).option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)


def file_assets(found: DataFrame, corpus_ids: DataFrame, rule: str = r"entry_(\w+)\.png$") -> DataFrame:
    """``id, path, length`` (and ``sha256``, where it was made) of files whose path holds an id of the corpus."""
    columns = [c for c in ("path", "length", "sha256") if c in found.columns]
    return assets(found.select(*columns), corpus_ids, rule).select("id", *columns)
