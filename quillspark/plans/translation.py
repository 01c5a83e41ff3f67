"""Queries on translations: BLEU, chrF, TER, modes, resamples and the translation memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import inference
from quillspark.operators import translation as mt
from quillspark.operators import scoring
from quillspark.operators.memory import Memory
from quillspark.plans import splitting
from quillspark.plans.register import registry, rounded
from quillspark.plans.scoring import SCORED, distance_sql
from quillspark.sources import derived as d
from quillspark.sources import readers, writers
from quillspark.sources.scratch import scratch_path

QUERIES, ORACLE_SQL, query = registry()

RESAMPLES = 1000
#: A row's weights in SQL: its seed, and the numbers that the seed is multiplied with, one for each resample.
_SEED = f"('0x' || left(md5({{}}::VARCHAR), 15))::BIGINT % {mt.MODULUS - 1} + 1"
JUMPS = f"jumps AS (SELECT 0 AS b, {mt.MULTIPLIER}::BIGINT AS x UNION ALL SELECT b + 1, x * {mt.MULTIPLIER} % {mt.MODULUS} FROM jumps WHERE b < {RESAMPLES - 1})"
_WEIGHT = "CASE " + " ".join(f"WHEN seed * x % {mt.MODULUS} * 1000 // {mt.MODULUS} < {most} THEN {k}" for k, most in enumerate(mt.POISSON)) + f" ELSE {len(mt.POISSON)} END"


def tok(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')"


def _mock(spark, sf):
    """The accent-stripping recognizer's output scored as a translation: ``id, hypothesis, reference``."""
    return d.predictions(spark, sf).where("model = 'noisy'").select("id", F.col("prediction").alias("hypothesis"), "reference")


MOCK = f"WITH {d.PREDICTIONS_SQL}, t AS (SELECT id, prediction AS hypothesis, reference FROM predictions WHERE model = 'noisy')"
BLEU_STATS = f"""{MOCK},
k AS (SELECT id, {tok('hypothesis')} AS h, {tok('reference')} AS r FROM t),
g AS (SELECT id, n, array_to_string(h[i:i + n - 1], ' ') AS gram, 1 AS h FROM (SELECT id, h, n, unnest(range(1, len(h) - n + 2)) AS i FROM k, range(1, 5) o(n))
  UNION ALL SELECT id, n, array_to_string(r[i:i + n - 1], ' '), 0 FROM (SELECT id, r, n, unnest(range(1, len(r) - n + 2)) AS i FROM k, range(1, 5) o(n))),
c AS (SELECT id, n, gram, sum(h) AS hyp, sum(1 - h) AS ref FROM g GROUP BY ALL),
o AS (SELECT id, n, sum(least(hyp, ref)) AS m, sum(hyp) AS h FROM c GROUP BY ALL),
s AS (SELECT k.id, len(k.h) AS hyp_len, len(k.r) AS ref_len, {', '.join(f'coalesce(sum(o.{c}) FILTER (WHERE n = {n}), 0) AS {c}{n}' for n in range(1, 5) for c in 'mh')}
  FROM k LEFT JOIN o ON o.id = k.id GROUP BY k.id, k.h, k.r)"""
BLEU = ("CASE WHEN least(m1, m2, m3, m4) = 0 OR hyp_len = 0 THEN 0.0 ELSE least(1.0, exp(1 - ref_len / hyp_len)) * exp((ln(m1 / h1) + ln(m2 / h2) + ln(m3 / h3) + ln(m4 / h4)) / 4) * 100 END")
SUMS = ", ".join(f"sum({c}) AS {c}" for c in ["hyp_len", "ref_len", *(f"{x}{n}" for n in range(1, 5) for x in "mh")])


@query(f"{BLEU_STATS} SELECT id, round({BLEU}, 6) AS bleu FROM s")
def sentence_bleu(spark, sf):
    return rounded(mt.bleu_stats(_mock(spark, sf)).select("id", mt.bleu_of().alias("bleu")))


@query(f"{BLEU_STATS}, a AS (SELECT {SUMS} FROM s) SELECT round({BLEU}, 6) AS bleu FROM a")
def corpus_bleu(spark, sf):
    return rounded(mt.add_up(mt.bleu_stats(_mock(spark, sf))).select(mt.bleu_of().alias("bleu")))


CHRF_STATS = f"""{MOCK},
k AS (SELECT id, replace(hypothesis, ' ', '') AS h, replace(reference, ' ', '') AS r FROM t),
g AS (SELECT id, n, substr(h, i, n) AS gram, 1 AS h FROM (SELECT id, h, n, unnest(range(1, length(h) - n + 2)) AS i FROM k, range(1, 7) o(n))
  UNION ALL SELECT id, n, substr(r, i, n), 0 FROM (SELECT id, r, n, unnest(range(1, length(r) - n + 2)) AS i FROM k, range(1, 7) o(n))),
c AS (SELECT id, n, gram, sum(h) AS hyp, sum(1 - h) AS ref FROM g GROUP BY ALL),
o AS (SELECT id, n, sum(least(hyp, ref)) AS m, sum(hyp) AS h, sum(ref) AS r FROM c GROUP BY ALL)"""
CHRF = "CASE WHEN coalesce(count(*) FILTER (WHERE h > 0 AND r > 0), 0) = 0 OR sum(m) FILTER (WHERE h > 0 AND r > 0) = 0 THEN 0.0 ELSE 100 * 5 * avg(m / h) FILTER (WHERE h > 0 AND r > 0) * avg(m / r) FILTER (WHERE h > 0 AND r > 0) / (4 * avg(m / h) FILTER (WHERE h > 0 AND r > 0) + avg(m / r) FILTER (WHERE h > 0 AND r > 0)) END"


@query(f"{CHRF_STATS} SELECT t.id, round({CHRF}, 6) AS chrf FROM t LEFT JOIN o ON o.id = t.id GROUP BY t.id")
def sentence_chrf(spark, sf):
    return rounded(mt.chrf_stats(_mock(spark, sf)).select("id", mt.chrf_of().alias("chrf")))


@query(f"{CHRF_STATS}, a AS (SELECT n, sum(m) AS m, sum(h) AS h, sum(r) AS r FROM o GROUP BY n) SELECT round({CHRF}, 6) AS chrf FROM a")
def corpus_chrf(spark, sf):
    return rounded(mt.add_up(mt.chrf_stats(_mock(spark, sf))).select(mt.chrf_of().alias("chrf")))


TER_STATS = f"""{MOCK},
k AS (SELECT id, {tok('hypothesis')} AS h, {tok('reference')} AS r FROM t), v AS (SELECT *, list_distinct(list_concat(h, r)) AS v FROM k),
s AS (SELECT id, len(h) AS hyp_len, len(r) AS ref_len, levenshtein(list_reduce(list_transform(h, lambda x: chr(list_position(v, x)::INT)), lambda a, b: a || b, ''),
  list_reduce(list_transform(r, lambda x: chr(list_position(v, x)::INT)), lambda a, b: a || b, '')) AS edits FROM v)"""
TER = "CASE WHEN ref_len > 0 THEN 100 * edits / ref_len WHEN hyp_len > 0 THEN 100.0 ELSE 0.0 END"


@query(f"{TER_STATS} SELECT id, round({TER}, 6) AS ter FROM s")
def sentence_ter(spark, sf):
    return rounded(mt.ter_stats(_mock(spark, sf)).select("id", mt.ter_of().alias("ter")))


@query(f"{TER_STATS}, a AS (SELECT sum(edits) AS edits, sum(ref_len) AS ref_len, sum(hyp_len) AS hyp_len, avg({TER}) AS mean FROM s) SELECT round({TER}, 6) AS ter, round(mean, 6) AS mean_ter FROM a")
def corpus_ter(spark, sf):
    rows = mt.ter_stats(_mock(spark, sf)).withColumn("row_ter", mt.ter_of())
    sums = rows.agg(*(F.sum(c).alias(c) for c in ("edits", "ref_len", "hyp_len")), F.avg("row_ter").alias("mean_ter"))
    return rounded(sums.select(mt.ter_of().alias("ter"), "mean_ter"))


ALL_SUMS = ", ".join(f"sum({c} * w) AS {c}" for c in ["hyp_len", "ref_len", *(f"{x}{n}" for n in range(1, 5) for x in "mh")])


@query(f"""{BLEU_STATS.replace('WITH ', 'WITH RECURSIVE ', 1)}, {JUMPS}, w AS (SELECT s.*, b, {_WEIGHT} AS w FROM (SELECT *, {_SEED.format('id')} AS seed FROM s) s, jumps),
a AS (SELECT b, {ALL_SUMS} FROM w GROUP BY b),
x AS (SELECT {BLEU} AS bleu FROM a) SELECT round(avg(bleu), 6) AS mean, round(quantile_cont(bleu, 0.025), 6) AS ci_lower, round(quantile_cont(bleu, 0.975), 6) AS ci_upper FROM x""")
def bootstrap_bleu(spark, sf):
    scores = mt.resamples(mt.bleu_stats(_mock(spark, sf)), "id", RESAMPLES).select(mt.bleu_of().alias("bleu"))
    return rounded(mt.interval(scores, "bleu"))


def corpus_sql(rows: str, by: str) -> str:
    """CTEs up to ``corpus_scores (by, bleu, chrf, ter, total_samples)`` of ``rows`` (by, id, hypothesis, reference)."""
    grams = lambda unit, size, gram, orders: " UNION ALL ".join(f"SELECT {by}, id, n, {gram.format(side)} AS gram, {1 - k} AS h FROM (SELECT {by}, id, {side}, n, unnest(range(1, {size.format(side)} - n + 2)) AS i FROM {unit}, range(1, {orders + 1}) o(n))" for k, side in enumerate("hr"))
    counted = lambda name: f"SELECT {by}, n, sum(least(hyp, ref)) AS m, sum(hyp) AS h, sum(ref) AS r FROM (SELECT {by}, id, n, gram, sum(h) AS hyp, sum(1 - h) AS ref FROM {name} GROUP BY ALL) GROUP BY ALL"
    return f"""kt AS (SELECT {by}, id, {tok('hypothesis')} AS h, {tok('reference')} AS r FROM {rows}),
kc AS (SELECT {by}, id, replace(hypothesis, ' ', '') AS h, replace(reference, ' ', '') AS r FROM {rows}),
gt AS ({grams('kt', 'len({})', "array_to_string({}[i:i + n - 1], ' ')", 4)}), ct AS ({counted('gt')}),
gc AS ({grams('kc', 'length({})', 'substr({}, i, n)', 6)}), cc AS ({counted('gc')}),
sized AS (SELECT {by}, sum(len(h)) AS hyp_len, sum(len(r)) AS ref_len, count(*) AS total_samples, sum({distance_sql('h', 'r', 'v')}) AS edits FROM (SELECT *, list_distinct(list_concat(h, r)) AS v FROM kt) GROUP BY {by}),
bleus AS (SELECT {by}, CASE WHEN count(*) FILTER (WHERE m > 0) < 4 THEN 0.0 ELSE exp(sum(ln(m / h)) FILTER (WHERE m > 0) / 4) * 100 END AS precision FROM ct GROUP BY {by}),
chrfs AS (SELECT {by}, {CHRF} AS chrf FROM cc GROUP BY {by}),
corpus_scores AS (SELECT s.{by}, CASE WHEN hyp_len = 0 THEN 0.0 ELSE least(1.0, exp(1 - ref_len / hyp_len)) * precision END AS bleu, chrf, {TER} AS ter, total_samples
  FROM sized s JOIN bleus b ON s.{by} = b.{by} JOIN chrfs c ON s.{by} = c.{by})"""


@query(f"""{SCORED}, tr AS (SELECT model, id, prediction AS hypothesis, reference FROM predictions), {corpus_sql('tr', 'model')},
m AS (SELECT model, round(avg(cer), 6) AS cer, round(avg(wer), 6) AS wer, round(avg(accuracy), 6) AS accuracy, count(*) FILTER (WHERE accuracy = 1) AS exact_matches, count(*) AS n FROM scored GROUP BY model)
SELECT m.*, round(bleu, 6) AS bleu, round(chrf, 6) AS chrf, round(ter, 6) AS ter FROM m JOIN corpus_scores USING (model)""")
def pipeline_aggregate(spark, sf):
    """Means of the rows' rates, and corpus scores of the predictions taken as translations."""
    rows = d.predictions(spark, sf)
    scores = mt.corpus_scores(rows.select("model", F.col("prediction").alias("hypothesis"), "reference"), "model").drop("total_samples")
    return rounded(scoring.pipeline_means(scoring.score_rows(rows, with_wer=True)).join(scores, "model"))


def _modes(spark, sf):
    """Three mock modes of one translator over the same lines, as ``mode, id, hypothesis, reference``."""
    names = F.create_map(*(F.lit(x) for pair in (("strip", "baseline"), ("trunc", "simple"), ("noisy", "full")) for x in pair))
    rows = d.predictions(spark, sf)
    return rows.select(F.element_at(names, F.col("model")).alias("mode"), "id", F.col("prediction").alias("hypothesis"), "reference")


MODE_ROWS = f"WITH {d.PREDICTIONS_SQL}, modes AS (SELECT CASE model WHEN 'strip' THEN 'baseline' WHEN 'trunc' THEN 'simple' ELSE 'full' END AS mode, id, prediction AS hypothesis, reference FROM predictions)"
MODE_TABLE = f"""{MODE_ROWS}, {corpus_sql('modes', 'mode')}, per_line AS (SELECT mode, id, count(*) AS n FROM ({splitting.ORACLE_SQL['mode_split']}) GROUP BY mode, id),
splits AS (SELECT mode, avg(n) AS avg_segments, count(*) FILTER (WHERE n > 1) AS samples_split FROM per_line GROUP BY mode),
mode_table AS (SELECT s.mode, s.bleu, s.chrf, s.ter, s.bleu - b.bleu AS delta_bleu, s.chrf - b.chrf AS delta_chrf, s.ter - b.ter AS delta_ter, coalesce(avg_segments, 1.0) AS avg_segments, coalesce(samples_split, 0) AS samples_split, s.total_samples
  FROM corpus_scores s CROSS JOIN (SELECT * FROM corpus_scores WHERE mode = 'baseline') b LEFT JOIN splits p ON p.mode = s.mode)"""


def _mode_table(spark, sf):
    rows = _modes(spark, sf)
    scores = mt.corpus_scores(rows.drop("id"), "mode")
    splits = splitting.mode_counts(spark, sf).groupBy("mode").agg(F.avg("n").alias("avg_segments"), F.count_if(F.col("n") > 1).alias("samples_split"))
    return mt.mode_table(scores, splits, "baseline")


@query(f"{MODE_TABLE} SELECT mode, round(bleu, 6) AS bleu, round(chrf, 6) AS chrf, round(ter, 6) AS ter, round(delta_bleu, 6) AS delta_bleu, round(delta_chrf, 6) AS delta_chrf, round(delta_ter, 6) AS delta_ter, round(avg_segments, 6) AS avg_segments, samples_split, total_samples FROM mode_table")
def mode_compare(spark, sf):
    """Each mode's corpus scores, their differences from the baseline's, and how much it splits."""
    return rounded(_mode_table(spark, sf))


@query(f"{MODE_TABLE} SELECT mode, format('{{:.2f}}', bleu) AS bleu, format('{{:.2f}}', chrf) AS chrf, format('{{:.3f}}', ter) AS ter, format('{{:.1f}}', avg_segments::DOUBLE) AS avg_segments, samples_split::VARCHAR AS samples_split, total_samples::VARCHAR AS total_samples FROM mode_table")
def mode_csv(spark, sf):
    """The comparison as the CSV sink writes it."""
    return writers.mode_fields(_mode_table(spark, sf))


@query(f"""{MODE_ROWS.replace('WITH ', 'WITH RECURSIVE ', 1)}, t AS (SELECT mode || ':' || id AS id, hypothesis, reference FROM modes), {BLEU_STATS.split(MOCK, 1)[1].lstrip(', ')},
{JUMPS}, w AS (SELECT s.*, b, {_WEIGHT} AS w FROM (SELECT *, split_part(id, ':', 1) AS mode, {_SEED.format("split_part(id, ':', 2)")} AS seed FROM s) s, jumps),
a AS (SELECT mode, b, {ALL_SUMS} FROM w GROUP BY mode, b), x AS (SELECT mode, {BLEU} AS bleu FROM a),
i AS (SELECT mode, avg(bleu) AS mean, quantile_cont(bleu, 0.025) AS ci_lower, quantile_cont(bleu, 0.975) AS ci_upper FROM x GROUP BY mode)
SELECT i.mode, round(i.mean, 6) AS mean, round(i.ci_lower, 6) AS ci_lower, round(i.ci_upper, 6) AS ci_upper, round(i.ci_lower - o.mean, 6) AS delta_lower, round(i.ci_upper - o.mean, 6) AS delta_upper,
  o.ci_upper < i.ci_lower OR i.ci_upper < o.ci_lower AS significant FROM i, (SELECT * FROM i WHERE mode = 'baseline') o""")
def mode_significance(spark, sf):
    """Bootstrap intervals of BLEU per mode against the baseline's."""
    stats = mt.bleu_stats(_modes(spark, sf).withColumn("key", F.struct("mode", "id")), "key").select("key.mode", "key.id", "*").drop("key")
    scores = mt.resamples(stats, "id", RESAMPLES, "mode").select("mode", mt.bleu_of().alias("bleu"))
    return rounded(mt.significance(mt.interval(scores, "bleu", "mode"), "baseline"))


@query(f"""{MODE_ROWS}, r AS (SELECT id, any_value(hypothesis) FILTER (WHERE mode = 'baseline') AS baseline, any_value(hypothesis) FILTER (WHERE mode = 'simple') AS simple, any_value(hypothesis) FILTER (WHERE mode = 'full') AS "full" FROM modes GROUP BY id)
SELECT *, baseline = simple AND simple = "full" AS alike FROM r""")
def mode_rows(spark, sf):
    rows = _modes(spark, sf)
    of = lambda m: F.max(F.when(F.col("mode") == m, F.col("hypothesis"))).alias(m)
    joined = rows.groupBy("id").agg(*map(of, ("baseline", "simple", "full")))  # three rows per id, made once
    return joined.withColumn("alike", (F.col("baseline") == F.col("simple")) & (F.col("simple") == F.col("full")))


@query(rf"""{CHRF_STATS.split(', a AS')[0]}, sign AS (SELECT '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~' AS signs),
ws AS (SELECT id, side, list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '') AS w FROM (SELECT id, 1 AS side, hypothesis AS x FROM t UNION ALL SELECT id, 0, reference FROM t)),
wu AS (SELECT id, side, flatten(list_transform(w, lambda x: CASE WHEN length(x) > 1 AND contains(signs, right(x, 1)) THEN [left(x, length(x) - 1), right(x, 1)] WHEN length(x) > 1 AND contains(signs, left(x, 1)) THEN [left(x, 1), substr(x, 2)] ELSE [x] END)) AS w FROM ws, sign),
wg AS (SELECT id, side, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT id, side, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM wu, range(1, 3) q(n))),
wc AS (SELECT id, n, gram, sum(side) AS hyp, sum(1 - side) AS ref FROM wg GROUP BY ALL),
every AS (SELECT n, m, h, r FROM o UNION ALL SELECT 6 + n, sum(least(hyp, ref)), sum(hyp), sum(ref) FROM wc GROUP BY id, n),
a AS (SELECT n, sum(m) AS m, sum(h) AS h, sum(r) AS r FROM every GROUP BY n) SELECT round({CHRF}, 6) AS chrf FROM a""")
def corpus_chrf_words(spark, sf):
    """chrF with word grams up to order 2."""
    return rounded(mt.add_up(mt.chrf_stats(_mock(spark, sf), word_order=2)).select(mt.chrf_of(word_order=2).alias("chrf")))


PAIRS = f"WITH {d.PAIRS_SQL}"


@query(f"{PAIRS} SELECT id, trim(original) AS original, trim(translation) AS translation FROM pairs WHERE trim(original) <> '' AND trim(translation) <> ''")
def nonempty_pairs(spark, sf):
    return readers.nonempty_pairs(d.pairs(spark, sf))


@query(f"{PAIRS} SELECT original AS text, arg_max(translation, id) AS translation FROM pairs GROUP BY original")
def memory_latest(spark, sf):
    return inference.latest(d.pairs(spark, sf).withColumnRenamed("original", "text"), "text", "translation", "id")


@query(f"""{PAIRS}, m AS (SELECT original AS text, arg_max(translation, id) AS translation FROM pairs WHERE id % 3 = 0 GROUP BY original),
w AS (SELECT DISTINCT original AS text FROM pairs)
SELECT w.text, CASE WHEN m.text IS NOT NULL THEN m.translation WHEN left(w.text, 1) IN ('z', 'Z') THEN '[Translation failed: no translation]' ELSE reverse(w.text) END AS translation, m.text IS NOT NULL AS hit
FROM w LEFT JOIN m USING (text)""")
def cache_hits_misses(spark, sf):
    pairs = d.pairs(spark, sf).withColumnRenamed("original", "text")
    memory = inference.latest(pairs.where("id % 3 = 0"), "text", "translation", "id")
    return inference.with_cache(pairs, memory, "reverse")


def _memory(spark, sf):
    """The pairs of the given table as a memory of three runs, two of which are merged before the third comes."""
    rows = d.pairs(spark, sf).select(F.col("original").alias("text"), "translation", "id", F.timestamp_micros("id").alias("at"))
    folder = scratch_path(spark, "memory")
    memory = Memory(spark, "memory_" + folder.rpartition("-")[2], folder, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for k in range(3):
        if k == 2:
            memory.compact()
        memory.append(rows.where(F.pmod(F.xxhash64("id"), F.lit(3)) == k))
    return memory


@query(f"{PAIRS} SELECT original AS text, arg_max(translation, id) AS translation FROM pairs GROUP BY original")
def memory_runs(spark, sf):
    """The last translation of each text, looked up in a memory of several runs."""
    memory = _memory(spark, sf)
    found = memory.lookup(d.pairs(spark, sf).select(F.col("original").alias("text"))).select("text", "translation")
    memory.forget()  # what is read stays
    return found


@query(f"WITH {d.LINES_SQL} SELECT id, left(text, 60) AS prediction FROM lines")
def batch_infer(spark, sf):
    return inference.batch_infer(d.lines(spark, sf).select("id", "text"), "first60").select("id", "prediction")
