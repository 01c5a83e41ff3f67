"""WARC archives: writing with revisit records, and reading by boundary chains (operator 10).

Writing: equal payloads are found by SHA-1; of a group with payloads of at least ``min_bytes`` the page with
the largest id is a ``response`` and the others are ``revisit`` records that refer to it. Records are written by Spark's text
writer with the record terminator as line separator, so any store that Spark reaches will do.

Reading: tasks read splits of the files as pieces between record magics (``\\r\\nWARC/1.``, which cannot overlap
itself, so every way of splitting a file finds the same pieces). Each piece that holds a header becomes a
candidate with the offset of its successor (its start plus header plus ``Content-Length``). Within a split a candidate's chain is followed to its exit; across splits pointer
jumping from the start of each file doubles the distance each round; only candidates on the chain from the
file's start are records, so a record start written inside a payload is never taken for one. Payloads that
lie whole in their piece are digested where they are read; those that hold a magic are gathered by their byte
range.

Defined results: a null html is an empty payload; a null page id counts as less than any; equal rows of the
largest id are all responses; an empty table writes and reads nothing.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from hashlib import sha1

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import scratch_path, scratch_table

TERMINATOR = "\r\n\r\n"
MAGIC = "WARC/1."
#: What separates pieces when reading.
DELIMITER = "\r\n" + MAGIC
GAP = len(DELIMITER)
FIELD = re.compile(rb"\r\n([A-Za-z-]+):[ \t]*([^\r\n]*)")
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
EPOCH = "1970-01-01T00:00:00Z"
#: Byte ranges and pieces meet in buckets of this size.
BUCKET = 1 << 20


# -- writing --------------------------------------------------------------------------------------


def base32_of_sha1(hex_digest: Column) -> Column:
    """Base32 of a 40-digit hexadecimal digest: each five digits are four letters."""
    letters = []
    for i in range(8):
        bits = F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def record_id(page_id: Column) -> Column:
    digest = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit(""))))
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = EPOCH) -> None:
    """Write one record per row of ``pages`` to archives under ``path``."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    groups = rows.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    # as a written table its size is known: while it is small the pages are joined where they are
    rows = rows.join(scratch_table(groups, "warc-copies"), "digest", "left")
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    target = F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20")
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", target),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_sha1(F.col("digest")))),
        _line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("WARC-Refers-To", F.when(revisit, record_id(F.col("kept")))),
        _line("X-Refers-To-Page", F.when(revisit, F.col("kept"))),
        _line("X-Page-Id", F.col("page_id")),
        _line("X-Payload-Bytes", F.col("size")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        F.lit("Content-Length: "),
        F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string"),
        F.lit(TERMINATOR),
    )
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    rows.select(F.concat(header, body).alias("value")).write.option("lineSep", TERMINATOR).text(path)


# -- reading --------------------------------------------------------------------------------------

MARKS = "file string, split long, total long, rel long, body long, next long, exit long, length long, type string, page_id long, refers_to long, stated_digest string, stated_bytes long, url string, digest string"


MARKED = ["length", "type", "page_id", "refers_to", "stated_digest", "stated_bytes", "url", "digest"]


def _digest(payload: bytes) -> str:
    return base64.b32encode(sha1(payload).digest()).decode()


def _candidate(file: str, split: int, rel: int, body: int, head: bytes) -> dict | None:
    fields = {k.lower(): v.decode("utf-8", "replace") for k, v in FIELD.findall(head)}
    if not fields.get(b"content-length", "").isdigit():
        return None
    number = lambda name: int(v) if re.fullmatch(r"-?\d{1,18}", v := fields.get(name, "")) else None
    length = int(fields[b"content-length"])
    return {
        "file": file, "split": split, "total": None, "rel": rel, "body": body, "next": body + length + len(TERMINATOR), "exit": None, "length": length, "type": fields.get(b"warc-type"), "page_id": number(b"x-page-id"),
        "refers_to": number(b"x-refers-to-page"), "stated_digest": fields.get(b"warc-payload-digest", "").removeprefix("sha1:") or None, "stated_bytes": number(b"x-payload-bytes"), "url": fields.get(b"warc-target-uri"), "digest": None,
    }


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of each split with offsets relative to its first piece, then the split's length."""
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64()}[t]) for n, t in (x.split() for x in MARKS.split(", "))])

    def closed(found: list[dict], file: str, split: int, total: int) -> pa.RecordBatch:
        exits: dict[int, int] = {}
        for c in reversed(found):
            c["exit"] = exits[c["rel"]] = exits.get(c["next"], c["next"])
        return pa.RecordBatch.from_pylist([*found, {"file": file, "split": split, "total": total}], schema=schema)

    at, rel, found = None, 0, []
    for batch in batches:
        for file, split, piece in zip(batch.column("file").to_pylist(), batch.column("split").to_pylist(), batch.column("value").to_pylist(), strict=True):
            if (file, split) != at:
                if at:
                    yield closed(found, *at, rel)
                at, rel, found = (file, split), 0, []
            head, blank, body = piece.partition(TERMINATOR.encode())
            first = split == rel == 0
            end = rel + len(head) + len(blank)
            if not blank and piece.endswith(b"\r\n"):  # the payload begins with a magic: its line end ends the header
                end += 2
            if (not first or head.startswith(MAGIC.encode())) and end > rel + len(head):
                start = rel if first else rel - len(MAGIC)
                if c := _candidate(file, split, start, end, head):
                    if blank and len(body) >= c["length"]:
                        c["digest"] = _digest(body[: c["length"]])
                    found.append(c)
            rel += len(piece) + GAP
    if at:
        yield closed(found, *at, rel)


def _on_chain(frame: pd.DataFrame) -> pd.DataFrame:
    """Rows of one split that the chain from its entry visits."""
    rows = {o: i for i, o in enumerate(frame["off"])}
    at, visited = frame["entry"].iloc[0], []
    nexts = frame["next"].tolist()
    while at in rows:
        visited.append(rows[at])
        at = nexts[rows[at]]
    return frame.iloc[visited].drop(columns=["entry"])


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.option("lineSep", DELIMITER).text(path)
    return read.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, rel = None, 0
    for batch in batches:
        starts = []
        sizes = [len(x.as_buffer()) for x in batch.column("value")]
        for key, n in zip(zip(batch.column("file").to_pylist(), batch.column("split").to_pylist(), strict=True), sizes, strict=True):
            if key != at:
                at, rel = key, 0
            starts.append(rel)
            rel += n + GAP
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("split"), pa.array(starts, pa.int64()), batch.column("value")], names=["file", "split", "rel", "value"])


def _assembled(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("at")
    first = frame.iloc[0]
    whole = b"".join(bytes(v) + DELIMITER.encode() for v in frame["value"])
    start = int(first["body"] - first["at"])
    return pd.DataFrame({"file": [first["file"]], "off": [first["off"]], "gathered": [_digest(whole[start : start + int(first["length"])])]})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives under ``path``: ``file, off, length, type, page_id, url, refers_to,
    stated_digest, stated_bytes`` from the header and ``digest`` of the payload as it was read."""
    marks = scratch_table(_pieces(spark, path).mapInArrow(_marks, MARKS), "warc-marks")
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    bases = scratch_table(marks.where("total is not null").select("file", "split", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "warc-bases")
    found = marks.where("total is null").join(bases, ["file", "split"])
    found = scratch_table(found.select("file", "split", *((F.col("base") + F.col(a)).alias(b) for a, b in (("rel", "off"), ("body", "body"), ("next", "next"), ("exit", "exit"))), *MARKED), "warc-candidates")
    # pointer jumping from the start of each file, over exits of splits
    most = bases.groupBy("file").count().agg(F.max("count")).first()[0] or 1
    reached = bases.select("file", F.lit(0).cast("long").alias("off")).distinct()
    jump = found.select("file", "off", F.col("exit").alias("to"))
    for _ in range((most - 1).bit_length()):
        reached = scratch_table(reached.union(reached.join(jump, ["file", "off"]).select("file", F.col("to").alias("off"))).distinct(), "warc-reached")
        jump = scratch_table(jump.join(jump.select("file", F.col("off").alias("to"), F.col("to").alias("then")), ["file", "to"]).select("file", "off", F.col("then").alias("to")), "warc-jumps")
    entries = found.select("file", "split", "off").join(reached, ["file", "off"]).groupBy("file", "split").agg(F.min("off").alias("entry"))
    chained = found.join(entries, ["file", "split"]).groupBy("file", "split").applyInPandas(_on_chain, found.schema)
    records = scratch_table(chained, "warc-records")
    # payloads that are not one piece behind their header
    # (few: as a written table they are broadcast while small, and pieces stay where they are)
    ranges = records.where("digest is null and length > 0 and type <> 'revisit'").select("file", "off", "body", "length", F.explode(F.sequence(F.floor(F.col("body") / BUCKET), F.floor((F.col("body") + F.col("length") - 1) / BUCKET))).alias("bucket"))
    ranges = scratch_table(ranges, "warc-ranges")
    placed = _pieces(spark, path).mapInArrow(_placed, "file string, split long, rel long, value binary").join(bases, ["file", "split"]).select("file", (F.col("base") + F.col("rel")).alias("at"), "value")
    last = F.col("at") + F.octet_length("value") + (GAP - 1)
    placed = placed.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("at") / BUCKET), F.floor(last / BUCKET))))
    overlap = (F.col("at") < F.col("body") + F.col("length")) & (last >= F.col("body")) & (F.col("bucket") == F.floor(F.greatest("at", "body") / BUCKET))
    gathered = placed.join(ranges, ["file", "bucket"]).where(overlap).groupBy("file", "off").applyInPandas(_assembled, "file string, off long, gathered string")
    out = records.join(gathered, ["file", "off"], "left").withColumn("digest", F.coalesce("digest", "gathered"))
    return out.select("file", "off", "length", "type", "page_id", "url", "refers_to", "stated_digest", "stated_bytes", "digest")


def round_trip(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` and read them back; a revisit takes digest and size of the payload it stands for."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, min_bytes=min_bytes)
    return read_archives(spark, path)
