"""Tables of runs: status, best configurations, early stopping, tail splits, dimension lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def recommendation(cer: Column) -> Column:
    """Tier of an error rate; missing means the run failed."""
    return F.when(cer.isNull(), "failed").when(cer < 0.1, "excellent").when(cer < 0.3, "good").when(cer < 0.5, "needs_sweep").otherwise("needs_investigation")


def status_counts(runs: DataFrame) -> DataFrame:
    """Runs per status and, for finished ones, per recommendation."""
    advice = F.when(F.col("status").isin("completed", "failed"), recommendation(F.col("cer")))
    return runs.groupBy("status", advice.alias("recommendation")).agg(F.count("*").alias("n"))


def latest_run(runs: DataFrame, key: str, order: Column) -> DataFrame:
    """The newest row of each key."""
    values = [c for c in runs.columns if c != key]
    return runs.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("v")).select(key, "v.*")


def best_config(runs: DataFrame, by: str, key: str, value: str = "cer") -> DataFrame:
    """Per group the successful run of the least value (the least key on ties)."""
    done = runs.where((F.col("status") == "success") & F.col(value).isNotNull())
    return done.groupBy(by).agg(F.min_by(F.struct(key, value), F.struct(value, key)).alias("v")).select(by, "v.*")


def nan_safe_means(metrics: DataFrame, by: str, *values: str) -> DataFrame:
    """Means of finite values only."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c))
    return metrics.groupBy(by).agg(*(F.avg(finite(c)).alias(c) for c in values))


def early_stop(curves: DataFrame, run: str, epoch: str, value: str, patience: int) -> DataFrame:
    """Each epoch with the best value before it, whether it improves, and epochs since the last improvement;
    rows end with the first epoch that has waited ``patience`` epochs."""
    w = W.partitionBy(run).orderBy(epoch)
    best = F.min(value).over(w.rowsBetween(W.unboundedPreceding, -1))
    out = curves.withColumn("best_before", best).withColumn("improved", F.col("best_before").isNull() | (F.col(value) < F.col("best_before")))
    n = F.row_number().over(w)
    waited = n - F.max(F.when(F.col("improved"), F.col("_n"))).over(w)
    out = out.withColumn("_n", n).withColumn("waited", waited)
    stopped = F.max((F.col("waited") >= patience).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1))
    return out.withColumn("_stopped", stopped).where(F.coalesce("_stopped", F.lit(0)) == 0).drop("_n", "_stopped")


def tail_split(rows: DataFrame, group: str, order: str, share: float = 0.1) -> DataFrame:
    """The last ``int(n * share)`` rows of each group are for validation."""
    size = F.count("*").over(W.partitionBy(group))
    place = F.row_number().over(W.partitionBy(group).orderBy(order))
    return rows.withColumn("part", F.when(place > size - F.floor(size * share), "validation").otherwise("train"))


def with_dimension(rows: DataFrame, dimension: DataFrame, key: str, value: str, default) -> DataFrame:
    """Left join to a dimension; keys it lacks take the default."""
    return rows.join(dimension.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def architecture(name: Column, known: list[str], default: str) -> Column:
    """The first known name that ``name`` contains."""
    out = F.when(F.lit(False), F.lit(default))
    for part in known:
        out = out.when(F.contains(name, F.lit(part)), part)
    return out.otherwise(default)


def unknown_names(requested: DataFrame, catalogue: DataFrame, name: str) -> DataFrame:
    return requested.select(name).distinct().join(catalogue.select(name), name, "left_anti")


def parameter_grid(configurations: DataFrame, axes: dict[str, list], only: dict[str, Column] | None = None) -> DataFrame:
    """Every combination of the axes' values per configuration; an axis with a condition in ``only`` takes its
    first value where the condition fails."""
    out = configurations
    for name, values in axes.items():
        options = F.array(*map(F.lit, values))
        cond = (only or {}).get(name)
        out = out.withColumn(name, F.explode(options if cond is None else F.when(cond, options).otherwise(F.slice(options, 1, 1))))
    return out


def width_plan(images: DataFrame, height: int, budget: int) -> DataFrame:
    """New width at a fixed height, and whether the budget pads, crops or fits it."""
    new = F.floor(F.col("w") * height / F.col("h"))
    action = F.when(F.col("new_w") < budget, "pad").when(F.col("new_w") > budget, "crop").otherwise("exact")
    return images.withColumn("new_w", new).withColumn("action", action).withColumn("padding", F.greatest(F.lit(0).cast("long"), budget - F.col("new_w")))
