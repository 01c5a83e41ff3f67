"""Corpus preparation: spans, numbered lines, edits of an alignment, layout lines, content ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.functions.segmentation import matches

HEADER_RATIO, FOOTNOTE_RATIO = 1.15, 0.85


def occurrences(lines: DataFrame, rule: str, text: str = "low", key: str = "id") -> DataFrame:
    """``key, a, b``: start and end of each match of a one-group rule."""
    return lines.select(key, F.inline(matches(F.col(text), rule))).select(key, F.col("pos").alias("a"), F.col("end").alias("b"))


def outside(short: DataFrame, long: DataFrame, key: str) -> DataFrame:
    """Short spans whose start lies in no long span of the same key."""
    s, l = short.alias("s"), long.alias("l")
    inside = (F.col(f"s.{key}") == F.col(f"l.{key}")) & (F.col("l.a") <= F.col("s.a")) & (F.col("s.a") < F.col("l.b"))
    return s.join(l, inside, "left_anti")


def overlay(lines: DataFrame, deleted: DataFrame, merged: DataFrame, splits: DataFrame, view: bool = True) -> DataFrame:
    """Lines of each side under edits: deleted ones go, ``merged`` texts and ``splits`` parts replace.

    In a view a split shows before a merge, a row per part; on approval a merge counts before a split, whose
    parts are then joined by `` | ``."""
    keys = ["side", "idx"]
    out = lines.join(deleted, keys, "left_anti").join(merged.withColumnRenamed("text", "merged"), keys, "left").join(splits, keys, "left")
    whole = F.coalesce(F.col("merged"), F.col("text"))
    if view:
        parts = F.when(F.col("parts").isNotNull(), F.col("parts")).otherwise(F.array(whole))
        return out.select("side", "idx", F.posexplode(parts).alias("part", "text"))
    return out.select("side", "idx", F.coalesce(F.col("merged"), F.array_join("parts", " | "), F.col("text")).alias("text"))


def pair_lines(live: DataFrame, left: str, right: str, group: str | None = None) -> DataFrame:
    """The k-th live line of one side with the k-th of the other; pairs with a blank side are left out."""
    by = [group] if group else []
    ranked = live.withColumn("k", F.row_number().over(W.partitionBy("side", *by).orderBy("idx")))
    side = lambda s: ranked.where(F.col("side") == s).select(*by, "k", F.col("idx").alias(f"{s}_idx"), F.col("text").alias(s))
    pairs = side(left).join(side(right), [*by, "k"]).where((F.col(left) != "") & (F.col(right) != ""))
    return pairs.drop("k")


def merge_next(lines: DataFrame, wanted: Column, group: str, order: str = "idx") -> DataFrame:
    """One round of merges over live lines: a wanted line takes the next live line's text, which goes. A line
    that goes this way is not itself merged in the same round."""
    w = W.partitionBy(group).orderBy(order)
    flagged = lines.withColumns({"_want": wanted, "_next": F.lead("text").over(w)})
    # in a run of wanted lines every second one merges
    run = F.row_number().over(w) - F.sum(F.col("_want").cast("int")).over(w)
    place = F.row_number().over(W.partitionBy(group, "_want", "_run").orderBy(order))
    flagged = flagged.withColumn("_run", run).withColumn("_merge", F.col("_want") & (place % 2 == 1) & F.col("_next").isNotNull())
    gone = F.coalesce(F.lag("_merge").over(w), F.lit(False))
    text = F.when(F.col("_merge"), F.concat_ws(" ", "text", "_next")).otherwise(F.col("text"))
    return flagged.withColumn("_gone", gone).withColumn("text", text).where("not _gone").drop("_want", "_next", "_run", "_merge", "_gone")


def swap_next(lines: DataFrame, wanted: Column, group: str, order: str = "idx") -> DataFrame:
    """Each wanted line trades texts with the next line (deleted or not); runs of wanted lines trade pairwise."""
    w = W.partitionBy(group).orderBy(order)
    flagged = lines.withColumn("_want", wanted)
    run = F.row_number().over(w) - F.sum(F.col("_want").cast("int")).over(w)
    place = F.row_number().over(W.partitionBy(group, "_want", "_run").orderBy(order))
    flagged = flagged.withColumn("_run", run).withColumn("_swap", F.col("_want") & (place % 2 == 1) & F.lead("text").over(w).isNotNull())
    text = F.when(F.col("_swap"), F.lead("text").over(w)).when(F.lag("_swap").over(w), F.lag("text").over(w)).otherwise(F.col("text"))
    return flagged.withColumn("text", text).drop("_want", "_run", "_swap")


def body_size(layout: DataFrame) -> DataFrame:
    """The most frequent size rounded to a tenth, the least on ties (one row)."""
    counts = layout.groupBy(F.round("size", 1).alias("size")).agg(F.count("*").alias("n"))
    return counts.agg(F.max_by("size", F.struct("n", (-F.col("size")).alias("s"))).alias("body_size"))


def line_kinds(layout: DataFrame) -> DataFrame:
    """Header, footnote or body by size against the body size; texts under three characters go."""
    sized = layout.where(F.length("text") >= 3).crossJoin(F.broadcast(body_size(layout)))  # one row
    kind = F.when(F.col("size") >= F.col("body_size") * HEADER_RATIO, "header").when(F.col("size") <= F.col("body_size") * FOOTNOTE_RATIO, "footnote").otherwise("body")
    return sized.withColumn("kind", kind).drop("body_size")


def dropped_line(text: Column, kind: Column) -> Column:
    return (kind == "footnote") | tx.is_page_number(text) | tx.is_footnote(text) | tx.is_header_fragment(text)


def document_sentences(layout: DataFrame, doc: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Kept lines of each document joined in order and cut into sentences, footnotes left out again."""
    kept = line_kinds(layout).where(~dropped_line(F.col("text"), F.col("kind")))
    joined = kept.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ").alias("text"))
    each = joined.select(doc, F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))
    return each.where(~tx.is_footnote(F.col("sentence")))


def content_range(lines: DataFrame, start: Column, end: Column, group: str, order: str = "idx") -> DataFrame:
    """From the first start line to the first end line, both included; whole where a marker is missing."""
    w = W.partitionBy(group)
    marked = lines.withColumns({"_a": F.min(F.when(start, F.col(order))).over(w), "_b": F.min(F.when(end, F.col(order))).over(w)})
    inside = (F.col(order) >= F.coalesce("_a", F.col(order))) & (F.col(order) <= F.coalesce("_b", F.col(order)))
    return marked.where(inside).drop("_a", "_b")
