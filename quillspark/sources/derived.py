"""Tables that the queries work on, derived from the given ones: lines, mock predictions, pairs and the like.

Each has its SQL beside it, so that both engines start from the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The letters beyond ASCII of the texts, and the plain letter of each (fixed values).
ACCENTED = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
PLAIN = "ACEEEINOOUsaceeeinoou"
#: SQL that gives each of them a byte of its own, for a levenshtein that counts bytes.
_BYTES = "||".join(f"chr({i})" for i in [*range(1, 9), *range(14, 27)])
MODELS = ("strip", "trunc", "noisy")
#: A line's id is its document's times this plus its number: no document has so many lines.
LINES = 1 << 32
#: Where documents are cut, with what stays before the cut as the group: after the end of a sentence, and after each
#: fortieth word of a line. No text is left out.
CUTS = (r"([.!?])\s+", r"((?:[^ \t-\r]+ +){39}[^ \t-\r]+) +")
#: The same for an engine that tries a rule at each place anew: a cut is sought at the start of a line, or where the last
#: one was made, and nowhere else (from a later word on, a line holds fewer words), and no word is given back. So the time
#: is that of reading the text, however long its words are. White space after a sentence is what the SQL's engine takes
#: for it, which leaves out the vertical tab.
FAST_CUTS = (r"([.!?])[\t\n\f\r ]+", r"(?:\G|(?<=[\t-\r]))( *+(?:[^ \t-\r]++ ++){39}[^ \t-\r]++) ++")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_bytes_sql(x: str) -> str:
    return f"translate({x}, '{ACCENTED}', {_BYTES})"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, cut at ``CUTS``, that hold a character: ``doc_id, line_no, id, text``.

    Documents are dealt out first: what is done to their lines costs far more than reading them, and a table of one
    file is read by one task."""
    text = F.col("text")
    for rule in FAST_CUTS:
        text = F.regexp_replace(text, rule, "$1\n")
    cut = F.split(text, "\n")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    found = docs.select("doc_id", F.posexplode(cut).alias("line_no", "text")).where(F.length("text") > 0)
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), (F.col("doc_id") * LINES + F.col("line_no")).alias("id"), "text")


LINES_SQL = rf"""lines AS (
  SELECT doc_id, i - 1 AS line_no, doc_id * {LINES} + i - 1 AS id, text
  FROM (SELECT doc_id, unnest(a) AS text, generate_subscripts(a, 1) AS i
        FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '{CUTS[0]}', '\1' || chr(10), 'g'), '{CUTS[1]}', '\1' || chr(10), 'g'), chr(10)) AS a FROM documents))
  WHERE length(text) > 0)"""


def whole_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of documents as they are, of any length: ``doc_id, line_no, id, text``."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text")).where(F.length("text") > 0)
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), (F.col("doc_id") * LINES + F.col("line_no")).alias("id"), "text")


WHOLE_LINES_SQL = f"""lines AS (
  SELECT doc_id, i - 1 AS line_no, doc_id * {LINES} + i - 1 AS id, text
  FROM (SELECT doc_id, unnest(a) AS text, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))
  WHERE length(text) > 0)"""


def source_of(doc_id: Column) -> Column:
    return F.when(doc_id % 20 == 0, "book").otherwise("hf")


def plain(text: Column) -> Column:
    """Without accents; a text of as many bytes as characters has none."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, ACCENTED, PLAIN))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three mock recognizers over ``lines``: one strips accents, one stops at 110 characters, one strips and
    drops a letter. ``model, id, source, reference, prediction``."""
    made = F.array(
        F.struct(F.lit("strip").alias("model"), F.col("bare").alias("prediction")),
        F.struct(F.lit("trunc").alias("model"), F.left(F.col("text"), F.lit(110)).alias("prediction")),
        F.struct(F.lit("noisy").alias("model"), F.replace("bare", F.lit("h"), F.lit("")).alias("prediction")),
    )
    rows = lines(spark, sf_dir).withColumn("bare", plain(F.col("text"))).select("id", source_of(F.col("doc_id")).alias("source"), F.col("text").alias("reference"), F.inline(made))
    return rows.select("model", "id", "source", "reference", "prediction")


PREDICTIONS_SQL = f"""{LINES_SQL},
mock AS (SELECT id, CASE WHEN doc_id % 20 = 0 THEN 'book' ELSE 'hf' END AS source, text AS reference, translate(text, '{ACCENTED}', '{PLAIN}') AS bare FROM lines),
predictions AS (
  SELECT 'strip' AS model, id, source, reference, bare AS prediction FROM mock
  UNION ALL SELECT 'trunc', id, source, reference, left(reference, 110) FROM mock
  UNION ALL SELECT 'noisy', id, source, reference, replace(bare, 'h', '') FROM mock)"""


def cer_sql(r: str = "reference", p: str = "prediction") -> str:
    distance = f"levenshtein({to_bytes_sql(p)}, {to_bytes_sql(r)})"
    return f"CASE WHEN length({r}) > 0 THEN {distance} / length({r}) WHEN {p} <> '' THEN 1.0 ELSE 0.0 END"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the next line of its document as a mock translation: ``id, original, translation``."""
    from pyspark.sql import Window as W

    after = F.lead("text").over(W.partitionBy("doc_id").orderBy("line_no"))
    return lines(spark, sf_dir).select("id", F.col("text").alias("original"), F.coalesce(after, F.lit(" ")).alias("translation"))


PAIRS_SQL = f"""{LINES_SQL},
pairs AS (SELECT id, text AS original, coalesce(lead(text) OVER (PARTITION BY doc_id ORDER BY line_no), ' ') AS translation FROM lines)"""
