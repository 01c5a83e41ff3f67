"""Queries on conjunction splits and on the experiment that compares predictions before and after."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import accuracy as acc
from quillspark.functions import segmentation as seg
from quillspark.operators import inference, statistics
from quillspark.plans.register import registry, rounded
from quillspark.sources import derived as d

QUERIES, ORACLE_SQL, query = registry()

#: Conjunctions of the given tables' languages.
TEST = ["and", "or", "but", "und", "oder", "et", "ou", "y"]
TEST_MODES = {"simple": ["and", "und", "et", "y"], "full": TEST}


def _rule(words: list[str]) -> str:
    return r"\b(" + "|".join(sorted(words, key=len, reverse=True)) + r")\b"


def spans_sql(words: list[str], name: str = "spans") -> str:
    """CTE of lines with their spans. Accented letters become q, so that ASCII word bounds are the right ones."""
    return rf"""low AS (SELECT id, text, lower(translate(text, '{d.ACCENTED}', '{"q" * len(d.ACCENTED)}')) AS low FROM lines),
cut AS (SELECT id, text, regexp_extract_all(low, '{_rule(words)}') AS m, string_split_regex(low, '{_rule(words)}') AS g FROM low),
{name} AS (SELECT id, text, list_transform(range(1, len(m) + 1), lambda k: {{'pos': (list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))::INT, 'conj': m[k]}}) AS spans FROM cut)"""


SPANS = f"WITH {d.LINES_SQL}, {spans_sql(TEST)}"
GREEDY = f"""{SPANS},
greedy AS (SELECT id, text, CASE WHEN length(text) <= 80 THEN []::INT[] ELSE
  list_reduce(list_transform(spans, lambda s: {{'s': s.pos, 'c': []::INT[]}}), lambda a, p:
    CASE WHEN p.s - a.s >= 80 AND length(trim(substr(text, a.s + 1, p.s - a.s))) >= 20 THEN {{'s': p.s, 'c': list_append(a.c, p.s)}} ELSE a END, {{'s': 0, 'c': []::INT[]}}).c END AS cuts FROM spans)"""


def segments_sql(source: str, name: str) -> str:
    return f"""{name} AS (SELECT id, text, cuts, CASE WHEN len(parts) <= 1 THEN [trim(text)] ELSE parts END AS segments FROM (
  SELECT id, text, cuts, list_filter(list_transform(range(1, len(cuts) + 2), lambda k: trim(substr(text, b[k] + 1, b[k + 1] - b[k]))), lambda s: s <> '') AS parts
  FROM (SELECT *, list_concat(list_concat([0], cuts), [length(text)::INT]) AS b FROM {source})))"""


SEGMENTS = f"{GREEDY}, {segments_sql('greedy', 'split')}"


def whole(sql: str) -> str:
    """The same over lines as they are."""
    return sql.replace(d.LINES_SQL, d.WHOLE_LINES_SQL)


def _lines_with_spans(spark, sf, words=TEST, lines=d.whole_lines):
    return lines(spark, sf).select("id", "text", seg.spans(F.col("text"), words).alias("spans"))


def _greedy(spark, sf, lines=d.whole_lines):
    cut = _lines_with_spans(spark, sf, lines=lines).withColumn("cuts", seg.greedy_cuts(F.col("text"), F.col("spans")))
    return cut.select("id", "text", "spans", "cuts", seg.segments(F.col("text"), F.col("cuts")).alias("segments"))


def _ints(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query(f"{whole(SPANS)} SELECT id, s.pos::BIGINT AS pos, (s.pos + length(s.conj))::BIGINT AS stop, s.conj AS conj FROM (SELECT id, unnest(spans) AS s FROM spans)")
def conj_spans(spark, sf):
    s = _lines_with_spans(spark, sf).select("id", F.inline("spans"))
    return s.select("id", F.col("pos").cast("long").alias("pos"), F.col("end").cast("long").alias("stop"), "conj")


@query(f"{whole(SEGMENTS)} SELECT id, array_to_string(cuts, ',') AS cuts, len(segments)::BIGINT AS n, array_to_string(segments, '|') AS segments FROM split")
def split_greedy(spark, sf):
    return _greedy(spark, sf).select("id", _ints("cuts").alias("cuts"), F.size("segments").cast("long").alias("n"), F.array_join("segments", "|").alias("segments"))


@query(f"""{whole(SPANS)},
aggressive AS (SELECT id, text, coalesce(list_reduce(list_transform(spans, lambda s: {{'s': s.pos, 'c': []::INT[]}}), lambda a, p:
    CASE WHEN length(trim(substr(text, a.s + 1, p.s - a.s))) >= 20 AND length(trim(substr(text, p.s + 1))) >= 20 THEN {{'s': p.s, 'c': list_append(a.c, p.s)}} ELSE a END, {{'s': 0, 'c': []::INT[]}}).c, []::INT[]) AS cuts FROM spans),
{segments_sql('aggressive', 'split')} SELECT id, array_to_string(cuts, ',') AS cuts, array_to_string(segments, '|') AS segments FROM split""")
def split_aggressive(spark, sf):
    cut = _lines_with_spans(spark, sf).withColumn("cuts", seg.aggressive_cuts(F.col("text"), F.col("spans")))
    return cut.select("id", _ints("cuts").alias("cuts"), F.array_join(seg.segments(F.col("text"), F.col("cuts")), "|").alias("segments"))


@query(f"{whole(SEGMENTS)} SELECT id, array_to_string(segments, ' ') AS joined FROM split")
def split_rejoin(spark, sf):
    return _greedy(spark, sf).select("id", seg.rejoin(F.col("segments")).alias("joined"))


@query(f"""{whole(SPANS)}, c AS (SELECT id, text, list_transform(spans, lambda s: s.conj) AS c, list_transform(spans, lambda s: s.pos) AS p FROM spans)
SELECT id, length(text)::BIGINT AS text_length, len(p)::BIGINT AS total, array_to_string(p, ',') AS positions, length(text) > 80 AND len(p) > 0 AS could_split,
  array_to_string(list_transform(list_sort(list_distinct(c)), lambda x: x || '=' || len(list_filter(c, lambda y: y = x))), ',') AS counts FROM c""")
def conj_profile(spark, sf):
    p = _lines_with_spans(spark, sf).select("id", seg.profile(F.col("text"), F.col("spans")).alias("p")).select("id", "p.*")
    counts = F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return p.select("id", F.col("text_length").cast("long").alias("text_length"), F.col("total").cast("long").alias("total"), _ints("positions").alias("positions"), "could_split", F.array_join(counts, ",").alias("counts"))


def _mode_sql(mode: str) -> str:
    return f"""SELECT '{mode}' AS mode, * FROM (WITH {spans_sql(TEST_MODES[mode])},
every AS (SELECT id, text, list_filter(list_transform(spans, lambda s: s.pos), lambda p: p > 0) AS cuts FROM spans), {segments_sql('every', 'split')}
SELECT id, unnest(segments) AS segment, generate_subscripts(segments, 1)::BIGINT - 1 AS pos FROM split)"""


@query(f"WITH {d.LINES_SQL} {_mode_sql('simple')} UNION ALL {_mode_sql('full')}")
def mode_split(spark, sf):
    def one(mode):
        s = _lines_with_spans(spark, sf, TEST_MODES[mode], d.lines)
        parts = seg.segments(F.col("text"), seg.all_cuts(F.col("spans")))
        return s.select(F.lit(mode).alias("mode"), "id", F.posexplode(parts).alias("pos", "segment")).withColumn("pos", F.col("pos").cast("long"))

    return one("simple").unionByName(one("full"))


def mode_counts(spark, sf):
    """``mode, id, n``: how many segments ``mode_split`` makes of each line, without making rows of them."""
    one = lambda mode: _lines_with_spans(spark, sf, TEST_MODES[mode], d.lines).select(F.lit(mode).alias("mode"), "id", seg.n_segments(F.col("text"), seg.all_cuts(F.col("spans"))).alias("n"))
    return one("simple").unionByName(one("full")).groupBy("mode", "id").agg(F.sum("n").alias("n"))


@query(rf"""WITH {d.LINES_SQL}, low AS (SELECT id, ' ' || lower(translate(text, '{d.ACCENTED}', '{'q' * len(d.ACCENTED)}')) || ' ' AS low FROM lines),
long AS (SELECT id, i AS a, i + 3 AS b FROM (SELECT id, low, unnest(range(1, length(low) - 3)) AS i FROM low) WHERE substr(low, i + 1, 3) = 'and' AND regexp_matches(substr(low, i, 1) || '|' || substr(low, i + 4, 1), '^[^a-z0-9_]\|[^a-z0-9_]$')),
short AS (SELECT id, i AS a, i + 2 AS b FROM (SELECT id, low, unnest(range(1, length(low) - 2)) AS i FROM low) WHERE substr(low, i + 1, 2) = 'an')
SELECT id, count(*) AS n FROM short s WHERE NOT EXISTS (SELECT 1 FROM long l WHERE l.id = s.id AND l.a <= s.a AND s.a < l.b) GROUP BY id""")
def span_antijoin(spark, sf):
    """Starts of ``an`` that do not lie inside a span of the word ``and``: the relational form of skipping
    short spans inside long ones. The ranges meet within a line only."""
    from quillspark.operators.corpus import occurrences, outside

    lines = d.lines(spark, sf).select("id", F.lower("text").alias("low"))
    long, short = occurrences(lines, r"(?U)\b(and)\b"), occurrences(lines, "(an)")
    return outside(short, long, "id").groupBy("id").agg(F.count("*").alias("n"))


EXPERIMENT = f"""{SEGMENTS},
x AS (SELECT id, text AS reference, left(text, 60) AS prediction, segments, len(segments)::BIGINT AS num_segments,
  CASE WHEN len(segments) > 1 THEN array_to_string(list_filter(list_transform(segments, lambda s: trim(left(s, 60))), lambda s: s <> ''), ' ') ELSE left(text, 60) END AS split_prediction FROM split),
e AS (SELECT *, 100 * ({d.cer_sql()}) AS cer_before, 100 * ({d.cer_sql('reference', 'split_prediction')}) AS cer_after FROM x),
r AS (SELECT *, cer_before - cer_after AS improvement FROM e)"""


def _experiment(spark, sf):
    """Rates in percent before and after: rows without a cut keep their prediction."""
    split = _greedy(spark, sf, d.lines).select("id", F.col("text").alias("reference"), "segments", F.size("segments").cast("long").alias("num_segments"))
    rows = inference.predict_split(split, "first60")
    rate = lambda p: 100 * acc.cer(F.col("reference"), F.col(p))
    rows = rows.withColumns({"cer_before": rate("prediction"), "cer_after": rate("split_prediction")})
    return rows.withColumn("improvement", F.col("cer_before") - F.col("cer_after"))


@query(f"{EXPERIMENT} SELECT id, num_segments, split_prediction, round(cer_before, 6) AS cer_before, round(cer_after, 6) AS cer_after FROM r")
def split_predict(spark, sf):
    return rounded(_experiment(spark, sf).select("id", "num_segments", "split_prediction", "cer_before", "cer_after"))


@query(f"{whole(SEGMENTS)} SELECT round(avg(len(segments)), 6) AS avg_segments, count(*) FILTER (WHERE len(segments) > 1) AS samples_split, count(*) FILTER (WHERE len(segments) = 1) AS unchanged, sum(len(segments))::BIGINT AS total_segments FROM split")
def split_stats(spark, sf):
    n = F.size("segments")
    return rounded(_greedy(spark, sf).agg(F.avg(n).alias("avg_segments"), F.count_if(n > 1).alias("samples_split"), F.count_if(n == 1).alias("unchanged"), F.sum(n.cast("long")).alias("total_segments")))


@query(f"""{EXPERIMENT}, s AS (SELECT count(*) AS n, avg(cer_before) AS mean_before, avg(cer_after) AS mean_after, avg(improvement) AS mean_diff, stddev_samp(improvement) AS sd FROM r WHERE num_segments > 1)
SELECT n, round(mean_before, 6) AS mean_before, round(mean_after, 6) AS mean_after, round(mean_diff, 6) AS mean_diff, round(mean_diff / sd, 6) AS cohens_d, round(mean_diff / sd * sqrt(n), 4) AS t FROM s""")
def paired_ttest(spark, sf):
    one = statistics.paired_ttest(_experiment(spark, sf).where("num_segments > 1"), "cer_before", "cer_after")
    return rounded(one.select("n", "mean_before", "mean_after", "mean_diff", "cohens_d", F.round("t", 4).alias("t")))


@query(f"{EXPERIMENT} SELECT round(regr_slope(cer_before, length(reference)), 6) AS slope, round(regr_intercept(cer_before, length(reference)), 6) AS intercept, count(*) AS n FROM r")
def trend_linear(spark, sf):
    return rounded(statistics.linear_trend(_experiment(spark, sf), F.length("reference"), F.col("cer_before")))


@query(f"""{EXPERIMENT}, u AS (SELECT length(reference) - avg(length(reference)) OVER () AS u, avg(length(reference)) OVER () AS mid, cer_before AS y FROM r),
s AS (SELECT any_value(mid) AS mid, count(*)::DOUBLE AS s0, sum(u) AS s1, sum(u*u) AS s2, sum(u*u*u) AS s3, sum(u*u*u*u) AS s4, sum(y) AS t0, sum(y*u) AS t1, sum(y*u*u) AS t2 FROM u),
f AS (SELECT mid, s0, s4*(s2*s0-s1*s1) - s3*(s3*s0-s1*s2) + s2*(s3*s1-s2*s2) AS det, t2*(s2*s0-s1*s1) - s3*(t1*s0-s1*t0) + s2*(t1*s1-s2*t0) AS a,
  s4*(t1*s0-s1*t0) - t2*(s3*s0-s1*s2) + s2*(s3*t0-t1*s2) AS b, s4*(s2*t0-t1*s1) - s3*(s3*t0-t1*s2) + t2*(s3*s1-s2*s2) AS c FROM s)
SELECT round(a / det, 6) AS a, round(b / det - 2 * a / det * mid, 6) AS b, round(c / det - b / det * mid + a / det * mid * mid, 6) AS c, s0::BIGINT AS n FROM f""")
def trend_quadratic(spark, sf):
    rows = _experiment(spark, sf).select(F.lit("all").alias("model"), F.length("reference").cast("double").alias("x"), F.col("cer_before").alias("y"))
    return rounded(statistics.quadratic_trend(rows, "x", "y", "model").drop("model"))


@query(f"""{EXPERIMENT}, v AS (SELECT round(improvement, 6) AS v FROM r WHERE num_segments > 1), b AS (SELECT min(v) - 1 AS lo, max(v) + 1 AS hi FROM v),
k AS (SELECT least(29, floor((v - lo) * 29 / (hi - lo)) + 1)::BIGINT AS bin, lo, hi FROM v, b)
SELECT bin, round(lo + (bin - 1) * (hi - lo) / 29, 6) AS "from", round(lo + bin * (hi - lo) / 29, 6) AS "to", count(*) AS n FROM k GROUP BY bin, lo, hi""")
def improve_hist(spark, sf):
    rows = _experiment(spark, sf).where("num_segments > 1").select(F.round("improvement", 6).alias("improvement"))
    return rounded(statistics.histogram(rows, "improvement").withColumn("bin", F.col("bin").cast("long")))


@query(f"{EXPERIMENT} SELECT num_segments, round(avg(improvement), 6) AS mean, round(stddev_pop(improvement), 6) AS sd, count(*) AS n FROM r GROUP BY num_segments")
def improve_by_segments(spark, sf):
    rows = _experiment(spark, sf).groupBy("num_segments").agg(F.avg("improvement").alias("mean"), F.stddev_pop("improvement").alias("sd"), F.count("*").alias("n"))
    return rounded(rows)


@query(f"""{EXPERIMENT} SELECT count(*) FILTER (WHERE round(improvement, 9) > 0) AS improved, count(*) FILTER (WHERE round(improvement, 9) < 0) AS degraded,
  round(count(*) FILTER (WHERE round(improvement, 9) > 0) / count(*), 6) AS improved_rate FROM r WHERE num_segments > 1""")
def split_outcome(spark, sf):
    gain = F.round("improvement", 9)
    rows = _experiment(spark, sf).where("num_segments > 1").agg(F.count_if(gain > 0).alias("improved"), F.count_if(gain < 0).alias("degraded"), F.count("*").alias("n"))
    return rounded(rows.select("improved", "degraded", F.try_divide("improved", "n").alias("improved_rate")))


@query(f"""{EXPERIMENT}, v AS (SELECT id, round(improvement, 6) AS improvement FROM r WHERE num_segments > 1)
SELECT * FROM (SELECT 'best' AS which, id, improvement FROM v ORDER BY improvement DESC, id LIMIT 1) UNION ALL SELECT * FROM (SELECT 'worst', id, improvement FROM v ORDER BY improvement, id LIMIT 1)""")
def best_worst(spark, sf):
    rows = _experiment(spark, sf).where("num_segments > 1").select("id", F.round("improvement", 6).alias("improvement"))
    return statistics.best_and_worst(rows, "improvement", "id")
