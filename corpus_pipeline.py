"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

A stage takes ``(spark, docs, sf_dir)``, works on every row its predecessor kept and returns the documents it
keeps with the columns of ``documents``; the last returns the encoded documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe_tree, decontamination, language_id, line_dedup, simhash_golay
from quillspark.llm.common import delete, fresh, scratch_path, scratch_scope

#: Documents whose language has a lesser posterior are rejected.
LEAST_SCORE = 0.5


def _aside(docs: DataFrame, *names: str) -> dict[str, str]:
    """Columns of the documents that a stage would replace, and names to keep them under meanwhile."""
    own = [c for c in docs.columns if c.lower() in names]
    return dict(zip(own, fresh([*docs.columns, *names], *own), strict=True))


def _back(kept: DataFrame, docs: DataFrame, aside: dict[str, str], *made: str) -> DataFrame:
    return kept.drop(*made).withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a determined language; the others get the predicted one as ``lang``.

    Null, empty and letterless texts go; repeated rows are judged alike; an empty table stays empty, and so does one
    without a labelled row, as no language is known; other columns pass, whatever their names."""
    made = ("held_out", "lang_pred", "score")
    aside = _aside(docs, *made)
    found = language_id.identify(docs.withColumnsRenamed(aside), public_tokenizers.path("piece_bpe_32k.model"), keep=True)
    kept = found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return _back(kept.withColumn("lang", F.col("lang_pred")), docs, aside, *made)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; documents left without a word go, ``n_chars`` follows the text.

    Null texts become empty and, as nothing of them was dropped, stay; rows that share an id are one document to the
    count; of a line in many documents the one of the largest id keeps it; an empty table stays empty; other columns
    pass, whatever their names."""
    made = ("n_lines", "n_dropped")
    aside = _aside(docs, *made)
    kept = line_dedup.dedup_lines(docs.withColumnsRenamed(aside)).where(F.col("text").rlike(r"[^ \t-\r]") | (F.col("n_dropped") == 0))
    return _back(kept.withColumn("n_chars", F.length("text").cast("long")), docs, aside, *made)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each class of near duplicates (see ``keep_one_of_each_class``)."""
    return simhash_golay.keep_one_of_each_class(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item (see ``remove_contaminated``)."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.remove_contaminated(docs, benchmark).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every document, one row per row; null texts count as empty."""
    return bpe_tree.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("bpe_encoding", encode),
]

#: Sketches, piece models and BPE are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``: rows of the last one. Each stage is written whole before the next begins; its
    own scratch tables go then, and what its predecessor wrote."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        with scratch_scope(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.option("compression", "zstd").parquet(path)
            docs = spark.read.schema(kept.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
