"""Row scores and their means: by model and source, by length, by rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import accuracy as acc

LONG = 80


def score_rows(predictions: DataFrame, with_wer: bool = False) -> DataFrame:
    """Add ``cer, exact, normalized`` (and ``wer``) to rows of ``reference, prediction``."""
    r, p = F.col("reference"), F.col("prediction")
    scored = predictions.withColumns({"cer": acc.cer(r, p), "exact": acc.exact(r, p), "normalized": acc.normalized(r, p)})
    return scored.withColumn("wer", acc.wer(r, p)) if with_wer else scored


def rollup_by_source(scored: DataFrame, metrics: list[str]) -> DataFrame:
    """Means per model and source, and per model over all sources (``source`` is then ``all``)."""
    means = [F.avg(m).alias(m) for m in metrics]
    out = scored.rollup("model", "source").agg(F.count("*").alias("n"), F.grouping("model").alias("_m"), F.grouping("source").alias("_s"), *means)
    return out.where("_m = 0").withColumn("source", F.when(F.col("_s") == 1, "all").otherwise(F.col("source"))).drop("_m", "_s")


def pipeline_means(scored: DataFrame) -> DataFrame:
    """One row per model: mean rates, mean token accuracy and rows without a wrong token."""
    accuracy = acc.token_accuracy(F.col("reference"), F.col("prediction"))
    return scored.withColumn("accuracy", accuracy).groupBy("model").agg(F.avg("cer").alias("cer"), F.avg("wer").alias("wer"), F.avg("accuracy").alias("accuracy"), F.count_if(F.col("accuracy") == 1).alias("exact_matches"), F.count("*").alias("n"))


def long_short_means(scored: DataFrame, value: str = "cer", longest_short: int = LONG) -> DataFrame:
    """Means overall, of long and of short references; 0 where there is none."""
    long = F.length("reference") > longest_short
    mean = lambda cond: F.coalesce(F.avg(F.when(cond, F.col(value))), F.lit(0.0))
    return scored.groupBy("model").agg(mean(F.lit(True)).alias("overall"), mean(long).alias("long"), mean(~long).alias("short"), F.count_if(long).alias("n_long"), F.count_if(~long).alias("n_short"))


def micro_positional(predictions: DataFrame) -> DataFrame:
    """Positional error rates in percent, summed before dividing: by characters and by words."""
    r, p = F.col("reference"), F.col("prediction")
    each = predictions.select(
        "model",
        acc.char_errors(r, p).alias("char_errors"), F.length(r).alias("chars"),
        acc.word_errors(r, p).alias("word_errors"), acc.n_words(r, p).alias("words"),
    )
    rate = lambda e, n: F.try_divide(100 * F.sum(e), F.sum(n))
    return each.groupBy("model").agg(rate("char_errors", "chars").alias("cer"), rate("word_errors", "words").alias("wer"))


def leaderboard(means: DataFrame, digits: int = 4, least: tuple[str, ...] = ("cer", "wer", "seconds"), most: tuple[str, ...] = ("exact", "normalized")) -> DataFrame:
    """Rank by ``cer`` (missing last) and flag the best of each column within half a unit of the last digit."""
    whole = W.partitionBy()  # one row per model
    best = lambda c, f: F.abs(F.col(c) - f(c).over(whole)) < F.lit(0.5 * 10**-digits)
    ranked = means.withColumn("rank", F.row_number().over(W.orderBy(F.col("cer").asc_nulls_last(), "model")))
    return ranked.withColumns({f"best_{c}": best(c, F.min) for c in least} | {f"best_{c}": best(c, F.max) for c in most})


def displayed(rollup: DataFrame, sources: list[str], below: float = 0.5) -> DataFrame:
    """Rows of a rollup worth showing: of models with an overall ``cer`` below the limit and a row of each source."""
    own = W.partitionBy("model")  # a few rows per model, made once
    cer = F.max(F.when(F.col("source") == "all", F.col("cer"))).over(own)
    n = F.count_if(F.col("source").isin(sources) & (F.col("n") > 0)).over(own)
    return rollup.withColumns({"_cer": cer, "_n": n}).where((F.col("_cer") < below) & (F.col("_n") == len(sources))).drop("_cer", "_n")


def domain_shift(scored: DataFrame) -> DataFrame:
    """Mean ``cer`` of the book source less that of the other, per model."""
    of = lambda s: F.avg(F.when(F.col("source") == s, F.col("cer")))
    return scored.groupBy("model").agg(of("hf").alias("hf"), of("book").alias("book"), (of("book") - of("hf")).alias("shift"))


def with_error_policy(results: DataFrame) -> DataFrame:
    """Rows of failed runs stay: the error as prediction, rates of 1, accuracy 0 and no translation."""
    failed = F.col("error").isNotNull()
    return results.withColumns({
        "prediction": F.when(failed, F.concat(F.lit("ERROR: "), F.col("error"))).otherwise(F.col("prediction")),
        "cer": F.when(failed, F.lit(1.0)).otherwise(F.col("cer")),
        "wer": F.when(failed, F.lit(1.0)).otherwise(F.col("wer")),
        "accuracy": F.when(failed, F.lit(0.0)).otherwise(F.col("accuracy")),
        "translation": F.when(failed, F.lit("")).otherwise(F.col("translation")),
    })
