"""Queries on scores of predictions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import accuracy as acc
from quillspark.functions import text as tx
from quillspark.operators import scoring
from quillspark.plans.register import registry, rounded
from quillspark.sources import derived as d
from quillspark.sources.scratch import scratch_path
from quillspark.sources.writers import write_json_folders
from quillspark.streaming import scores

QUERIES, ORACLE_SQL, query = registry()

PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
WITH = f"WITH {d.PREDICTIONS_SQL}"


def clean_sql(x: str) -> str:
    return rf"lower(trim(regexp_replace(translate({x}, '{PUNCT}', ''), '\s+', ' ', 'g')))"


def words_sql(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def distance_sql(a: str, b: str, distinct: str) -> str:
    """Edit distance of two token lists of which ``distinct`` holds each token once: a byte stands for each."""
    text = lambda x: f"list_reduce(list_transform({x}, lambda t: chr(list_position({distinct}, t)::INT)), lambda a, b: a || b, '')"
    return f"levenshtein({text(a)}, {text(b)})"


SCORED = f"""{WITH},
wordy AS (SELECT *, {words_sql('reference')} AS r, {words_sql('prediction')} AS p FROM predictions),
known AS (SELECT *, list_distinct(list_concat(r, p)) AS v FROM wordy),
apart AS (SELECT *, {distance_sql('r', 'p', 'v')} AS edits FROM known),
scored AS (SELECT *, {d.cer_sql()} AS cer, (reference = prediction)::INT AS exact,
           ({clean_sql('reference')} = {clean_sql('prediction')})::INT AS normalized,
           CASE WHEN len(r) > 0 THEN edits / len(r) WHEN len(p) > 0 THEN 1.0 ELSE 0.0 END AS wer,
           len(list_filter(list_zip(r[1:least(len(r), len(p))], p[1:least(len(r), len(p))]), lambda z: z[1] = z[2])) / nullif(greatest(len(r), len(p)), 0) AS accuracy FROM apart)"""
TOKEN_ACCURACY = f"""{WITH},
w AS (SELECT model, id, reference, prediction, {words_sql('reference')} AS r, {words_sql('prediction')} AS p FROM predictions),
acc AS (SELECT *, len(list_filter(list_zip(r[1:least(len(r), len(p))], p[1:least(len(r), len(p))]), lambda z: z[1] = z[2])) / nullif(greatest(len(r), len(p)), 0) AS accuracy FROM w)"""


ROLLUP = f"""{SCORED}, rollup_rows AS (SELECT model, CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS source, count(*) AS n,
  round(avg(cer), 6) AS cer, round(avg(wer), 6) AS wer, round(avg(exact), 6) AS exact, round(avg(normalized), 6) AS normalized
  FROM scored GROUP BY GROUPING SETS ((model, source), (model)))"""


@query(f"{ROLLUP} SELECT * FROM rollup_rows")
def score_rollup(spark, sf):
    scored = scoring.score_rows(d.predictions(spark, sf), with_wer=True)
    return rounded(scoring.rollup_by_source(scored, ["cer", "wer", "exact", "normalized"]))


@query(f"{ROLLUP} SELECT * FROM rollup_rows")
def stream_scores(spark, sf):
    """The same means from a stream: predictions arrive in three runs of it, each with repeats of those before. All that
    arrives is made at once, a folder a run, and a run of the stream sees the folders up to its own."""
    rows, path = d.predictions(spark, sf).withColumn("id", F.col("id").cast("string")), scratch_path(spark, "stream")
    part, again = F.pmod(F.xxhash64("id"), F.lit(3)), F.pmod(F.crc32("id"), F.lit(5))
    twice = F.when(F.pmod(F.crc32("id"), F.lit(7)) == 0, 2).otherwise(1)
    runs = F.flatten(F.array(*(F.array_repeat(F.lit(k), F.when((part == k) | ((part < k) & (again == k)), twice).otherwise(0)) for k in range(3))))
    arrived = rows.select("*", F.explode(runs).alias("run"))
    write_json_folders(arrived.withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + 600 * F.col("run"))), f"{path}/arrived", "run")
    for k in range(3):
        scores.score_stream(spark, f"{path}/arrived/run=[0-{k}]", f"{path}/state", f"{path}/checkpoint").awaitTermination()
    return rounded(scores.means_by_source(scores.read_state(spark, f"{path}/state")))


@query(f"""{ROLLUP} SELECT * FROM rollup_rows WHERE model IN (SELECT model FROM rollup_rows WHERE source = 'all' AND cer < 0.1)
  AND model IN (SELECT model FROM rollup_rows WHERE source IN ('hf', 'book') AND n > 0 GROUP BY model HAVING count(*) = 2)""")
def displayed(spark, sf):
    return scoring.displayed(score_rollup(spark, sf), ["hf", "book"], 0.1)


@query(f"{WITH} SELECT model, id, round({d.cer_sql()}, 6) AS cer FROM predictions")
def cer_rows(spark, sf):
    return rounded(d.predictions(spark, sf).select("model", "id", acc.cer(F.col("reference"), F.col("prediction")).alias("cer")))


@query(f"{SCORED} SELECT model, id, round(wer, 6) AS wer FROM scored")
def wer_rows(spark, sf):
    return rounded(d.predictions(spark, sf).select("model", "id", acc.wer(F.col("reference"), F.col("prediction")).alias("wer")))


@query(f"{TOKEN_ACCURACY} SELECT model, id, round(accuracy, 6) AS accuracy FROM acc")
def token_accuracy(spark, sf):
    return rounded(d.predictions(spark, sf).select("model", "id", acc.token_accuracy(F.col("reference"), F.col("prediction")).alias("accuracy")))


@query(f"{SCORED} SELECT model, id, exact, normalized FROM scored")
def accuracy_rows(spark, sf):
    return scoring.score_rows(d.predictions(spark, sf)).select("model", "id", "exact", "normalized")


@query(f"""{WITH},
w AS (SELECT model, string_split(reference, '') AS rc, string_split(prediction, '') AS pc, {words_sql('reference')} AS rw, {words_sql('prediction')} AS pw, length(reference) AS lr, length(prediction) AS lp FROM predictions),
e AS (SELECT model, lr, len(rw) AS nw, len(list_filter(list_zip(rc[1:least(lr, lp)], pc[1:least(lr, lp)]), lambda z: z[1] <> z[2])) + abs(lr - lp) AS ce,
  len(list_filter(list_zip(rw[1:least(len(rw), len(pw))], pw[1:least(len(rw), len(pw))]), lambda z: z[1] <> z[2])) + abs(len(rw) - len(pw)) AS we FROM w)
SELECT model, round(100 * sum(ce) / nullif(sum(lr), 0), 6) AS cer, round(100 * sum(we) / nullif(sum(nw), 0), 6) AS wer FROM e GROUP BY model""")
def hamming_micro(spark, sf):
    return rounded(scoring.micro_positional(d.predictions(spark, sf)))


@query(f"""{SCORED} SELECT model, round(coalesce(avg(cer), 0), 6) AS overall, round(coalesce(avg(cer) FILTER (WHERE length(reference) > 80), 0), 6) AS long,
  round(coalesce(avg(cer) FILTER (WHERE length(reference) <= 80), 0), 6) AS short, count(*) FILTER (WHERE length(reference) > 80) AS n_long,
  count(*) FILTER (WHERE length(reference) <= 80) AS n_short FROM scored GROUP BY model""")
def long_short(spark, sf):
    return rounded(scoring.long_short_means(scoring.score_rows(d.predictions(spark, sf))))


MEANS = f"{SCORED}, means AS (SELECT model, round(avg(cer), 6) AS cer, round(avg(wer), 6) AS wer, round(avg(exact), 6) AS exact, round(avg(normalized), 6) AS normalized, round(avg(length(reference)) / 1000, 6) AS seconds FROM scored GROUP BY model)"


def _means(spark, sf):
    """Means per model; a mock recognizer takes a millisecond a character."""
    scored = scoring.score_rows(d.predictions(spark, sf), with_wer=True)
    return rounded(scored.groupBy("model").agg(*(F.avg(m).alias(m) for m in ("cer", "wer", "exact", "normalized")), (F.avg(F.length("reference")) / 1000).alias("seconds")))


BEST = ", ".join(f"abs({c} - {f}({c}) OVER ()) < 0.00005 AS best_{c}" for f, names in (("min", ("cer", "wer", "seconds")), ("max", ("exact", "normalized"))) for c in names)


@query(f"{MEANS} SELECT *, row_number() OVER (ORDER BY cer ASC NULLS LAST, model)::INT AS rank, {BEST} FROM means")
def leaderboard(spark, sf):
    return scoring.leaderboard(_means(spark, sf))


@query("{} SELECT model, {}, {} FROM means".format(MEANS, ", ".join(f"format('{{:.6f}}', {c}::DOUBLE) AS {c}" for c in ("cer", "wer", "exact", "seconds")), "format('{:.6f}', coalesce(CASE WHEN normalized > 0 THEN normalized END, -1)::DOUBLE) AS normalized"))
def leaderboard_csv(spark, sf):
    from quillspark.sources.writers import csv_fields

    means = _means(spark, sf).withColumn("normalized", F.when(F.col("normalized") > 0, F.col("normalized")))
    return csv_fields(means, ["model"], ["cer", "wer", "exact", "normalized", "seconds"])


@query(f"""{SCORED}, s AS (SELECT model, avg(cer) FILTER (WHERE source = 'hf') AS hf, avg(cer) FILTER (WHERE source = 'book') AS book FROM scored GROUP BY model)
SELECT model, round(hf, 6) AS hf, round(book, 6) AS book, round(book - hf, 6) AS shift FROM s""")
def domain_shift(spark, sf):
    return rounded(scoring.domain_shift(scoring.score_rows(d.predictions(spark, sf))))


@query(f"""{SCORED} SELECT model, id, CASE WHEN bad THEN 'ERROR: no image' ELSE prediction END AS prediction, CASE WHEN bad THEN 1.0 ELSE round(cer, 6) END AS cer,
  CASE WHEN bad THEN 1.0 ELSE round(wer, 6) END AS wer, CASE WHEN bad THEN 0.0 ELSE round(accuracy, 6) END AS accuracy, CASE WHEN bad THEN '' ELSE reference END AS translation
  FROM (SELECT *, id % 50 = 7 AS bad FROM scored)""")
def error_rows(spark, sf):
    scored = scoring.score_rows(d.predictions(spark, sf), with_wer=True)
    accuracy = acc.token_accuracy(F.col("reference"), F.col("prediction"))
    rows = scored.select("model", "id", "prediction", "cer", "wer", accuracy.alias("accuracy"), F.col("reference").alias("translation"), F.when(F.col("id") % 50 == 7, "no image").alias("error"))
    return rounded(scoring.with_error_policy(rows).drop("error"))


@query(f"WITH {d.LINES_SQL} SELECT id, {clean_sql('text')} AS cleaned FROM lines")
def clean_text(spark, sf):
    return d.lines(spark, sf).select("id", tx.clean_text(F.col("text")).alias("cleaned"))


@query(rf"""WITH {d.LINES_SQL}, t AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')) AS token FROM lines)
SELECT token, count(*) AS n FROM t GROUP BY token""")
def token_counts(spark, sf):
    return d.lines(spark, sf).select(F.explode(tx.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"""{SCORED}, a AS (SELECT model, 100 - 100 * cer AS share FROM scored)
SELECT model, CASE WHEN share >= 100 THEN 'Perfect' WHEN share >= 95 THEN 'Excellent' WHEN share >= 80 THEN 'Good' ELSE 'Poor' END AS tier, count(*) AS n FROM a GROUP BY ALL""")
def quality_tier(spark, sf):
    accuracy = 100 - 100 * F.col("cer")
    tier = F.when(accuracy >= 100, "Perfect").when(accuracy >= 95, "Excellent").when(accuracy >= 80, "Good").otherwise("Poor")
    return scoring.score_rows(d.predictions(spark, sf)).groupBy("model", tier.alias("tier")).agg(F.count("*").alias("n"))


@query(f"""{SCORED}, r AS (SELECT model, 100 - 100 * avg(cer) AS accuracy, sum(length(reference)) AS chars, count(*) AS n FROM scored GROUP BY model)
SELECT model, round(accuracy, 6) AS accuracy, round(greatest(0, accuracy), 6) AS clamped, round(chars / 1000 / n, 6) AS seconds_per_image,
  round(3600 * n / (chars / 1000), 6) AS images_per_hour, round(max(chars) OVER () / chars, 6) AS speed_up FROM r""")
def derived_rates(spark, sf):
    from pyspark.sql import Window as W

    rows = scoring.score_rows(d.predictions(spark, sf)).groupBy("model").agg((100 - 100 * F.avg("cer")).alias("accuracy"), F.sum(F.length("reference")).alias("chars"), F.count("*").alias("n"))
    seconds = F.col("chars") / 1000
    return rounded(rows.select("model", "accuracy", F.greatest(F.lit(0.0), "accuracy").alias("clamped"), F.try_divide(seconds, F.col("n")).alias("seconds_per_image"), F.try_divide(3600 * F.col("n"), seconds).alias("images_per_hour"), (F.max("chars").over(W.partitionBy()) / F.col("chars")).alias("speed_up")))
