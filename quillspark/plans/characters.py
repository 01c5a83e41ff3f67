"""Queries on characters, words, vocabularies, frames and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.text import words
from quillspark.operators import characters as ch
from quillspark.plans.register import registry, rounded
from quillspark.sources import derived as d

QUERIES, ORACLE_SQL, query = registry()

#: Letters whose accuracy is followed in the given tables, and how many words or letters a top list holds.
TRACKED = d.ACCENTED
TOP = 20


def _aligned(spark, sf):
    """Alignments of every prediction of every model."""
    return ch.alignments(d.predictions(spark, sf).select("model", "id", "reference", "prediction"), "model", "id")


def _confusions(spark, sf):
    return ch.count_confusions(d.predictions(spark, sf).select("model", "reference", "prediction"), "model")


@query()
def char_alignment(spark, sf):
    return _aligned(spark, sf)


@query(f"""WITH {d.PREDICTIONS_SQL}, c AS (SELECT model, id, reference, prediction, levenshtein({d.to_bytes_sql('prediction')}, {d.to_bytes_sql('reference')})::BIGINT AS n_wrong FROM predictions)
SELECT model, id, md5(reference) AS reference_md5, md5(prediction) AS prediction_md5, n_wrong FROM c""")
def alignment_certificate(spark, sf):
    """Every row's sides, put together again from its alignment, and the wrong pairs, which are as many as edits."""
    found = ch.certificate(d.predictions(spark, sf), "model", "id")
    return found.select("model", "id", F.md5("reference").alias("reference_md5"), F.md5("prediction").alias("prediction_md5"), "n_wrong")


# A letter stands against its like as often as the recognizer left it in place: one writes no accents, one writes no
# accents and no h, and one keeps the front. How the other letters stand is the alignment's choice.
LIKE = f"""WITH {d.PREDICTIONS_SQL}, r AS (SELECT model, unnest(string_split(reference, '')) AS ref_char FROM predictions),
p AS (SELECT unnest(string_split(prediction, '')) AS ref_char FROM predictions WHERE model = 'trunc'), front AS (SELECT ref_char, count(*) AS n FROM p GROUP BY ref_char),
t AS (SELECT model, ref_char, count(*) AS total FROM r GROUP BY model, ref_char),
like_counts AS (SELECT model, t.ref_char, total, CASE WHEN model = 'trunc' THEN coalesce(n, 0) WHEN contains('{d.ACCENTED}', t.ref_char) OR (model = 'noisy' AND t.ref_char = 'h') THEN 0 ELSE total END AS correct
  FROM t LEFT JOIN front f ON f.ref_char = t.ref_char)"""


@query(f"{LIKE} SELECT model, ref_char, total, correct::BIGINT AS correct FROM like_counts")
def confusions(spark, sf):
    right = F.when(F.col("ref_char") == F.col("pred_char"), F.col("n")).otherwise(0)
    return _confusions(spark, sf).groupBy("model", "ref_char").agg(F.sum("n").alias("total"), F.sum(right).alias("correct"))


@query(f"{LIKE} SELECT model, ref_char, total, correct::BIGINT AS correct FROM like_counts")
def align_table(spark, sf):
    """``confusions`` in SQL, over a table function that counts the pairs of the rows of a task."""
    ch.register_count_function(spark)
    d.predictions(spark, sf).select("model", "reference", "prediction").createOrReplaceTempView("predictions_to_align")
    return spark.sql("""SELECT model, ref_char, sum(n) AS total, sum(if(ref_char = pred_char, n, 0)) AS correct
        FROM count_aligned(TABLE(SELECT * FROM predictions_to_align)) GROUP BY model, ref_char""")


@query()
def confusion_pairs(spark, sf):
    return _confusions(spark, sf)


def _tracked(spark, sf):
    """The tracked letters that the texts hold, in both cases."""
    lower = d.lines(spark, sf).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"([{TRACKED.lower()}])"), F.lit(1))).alias("char")).distinct()
    return ch.tracked_chars(lower)


@query(f"""WITH {d.LINES_SQL}, c AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[{TRACKED.lower()}]')) AS c FROM lines)
SELECT c AS char FROM c UNION SELECT CASE c WHEN 'ß' THEN 'SS' ELSE upper(c) END FROM c""")
def tracked_chars(spark, sf):
    return _tracked(spark, sf)


@query(f"""{LIKE}, a AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[{TRACKED.lower()}]')) AS c FROM lines),
k AS (SELECT c AS char FROM a UNION SELECT CASE c WHEN 'ß' THEN 'SS' ELSE upper(c) END FROM a), m AS (SELECT DISTINCT model FROM predictions)
SELECT m.model, char, coalesce(correct, 0)::BIGINT AS correct, coalesce(total, 0) AS total, round(correct / total, 6) AS accuracy FROM k CROSS JOIN m LEFT JOIN like_counts l ON l.model = m.model AND l.ref_char = char""")
def char_accuracy(spark, sf):
    return rounded(ch.char_accuracy(_confusions(spark, sf), _tracked(spark, sf), "model"))


@query()
def top_confusions(spark, sf):
    return ch.top_confusions(_confusions(spark, sf), "model")


@query(f"WITH {d.LINES_SQL}, c AS (SELECT unnest(string_split(text, '')) AS c FROM lines), n AS (SELECT c, count(*) AS n FROM c GROUP BY c HAVING n >= 5) SELECT string_agg(c, '' ORDER BY c) AS charset FROM n")
def charset(spark, sf):
    return ch.charset(d.lines(spark, sf), 5)


@query(f"WITH {d.LINES_SQL}, w AS (SELECT unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS word FROM lines) SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT {TOP}")
def top_words(spark, sf):
    counts = d.lines(spark, sf).select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "word").limit(TOP)


@query(f"WITH {d.LINES_SQL}, c AS (SELECT unnest(string_split(text, '')) AS letter FROM lines) SELECT letter, count(*) AS n FROM c WHERE regexp_matches(letter, '^\\p{{L}}$') GROUP BY letter ORDER BY n DESC, letter LIMIT {TOP}")
def top_letters(spark, sf):
    counts = ch.char_counts(d.lines(spark, sf)).where(F.col("char").rlike(r"^\p{L}$")).withColumnRenamed("char", "letter")
    return counts.orderBy(F.col("n").desc(), "letter").limit(TOP)


#: A fixed vocabulary of plain letters and the space.
VOCABULARY = "abcdefghijklmnopqrstuvwxyz "


@query(f"WITH {d.LINES_SQL} SELECT id, array_to_string(list_filter(list_transform(string_split(text, ''), lambda c: strpos('{VOCABULARY}', c)), lambda i: i > 0), ',') AS ids FROM lines")
def encode_ids(spark, sf):
    ids = ch.encode_ids(F.col("text"), F.lit(VOCABULARY))
    return d.lines(spark, sf).select("id", F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("ids"))


@query(f"WITH {d.LINES_SQL} SELECT id, regexp_replace(text, '[^{VOCABULARY}]', '', 'g') AS decoded FROM lines")
def decode_ids(spark, sf):
    return d.lines(spark, sf).select("id", ch.decode_ids(ch.encode_ids(F.col("text"), F.lit(VOCABULARY)), F.lit(VOCABULARY)).alias("decoded"))


@query("""WITH f AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS labels FROM f WHERE (before IS NULL OR before <> event_type) AND event_type <> 'error' GROUP BY user_id""")
def run_collapse(spark, sf):
    frames = d.table(spark, sf, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_type")
    return ch.run_collapse(frames, "user_id", "at", "event_type", "error").select("user_id", F.array_join("labels", ">").alias("labels"))


#: Classes of a frame: an embedding of the given table is read as so many scores a step, one step after the other.
CLASSES = 8


# a label's vectors, in order, are the frames of one long sample
@query(f"""WITH f AS (SELECT label AS sample, vec_id * 1024 + (i - 1) // {CLASSES} AS t, (i - 1) % {CLASSES} AS class, embedding[i] AS score FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
a AS (SELECT sample, t, list(class ORDER BY score DESC, class)[1] AS class FROM f GROUP BY sample, t),
c AS (SELECT *, lag(class) OVER (PARTITION BY sample ORDER BY t) AS before FROM a)
SELECT sample, count(*) FILTER (class <> 0 AND class IS DISTINCT FROM before) AS n_labels, md5(coalesce(string_agg(class::VARCHAR, ',' ORDER BY t) FILTER (class <> 0 AND class IS DISTINCT FROM before), '')) AS labels_md5 FROM c GROUP BY sample""")
def frame_collapse(spark, sf):
    scores = d.table(spark, sf, "embeddings").select(F.col("label").alias("sample"), "vec_id", F.posexplode("embedding").alias("i", "score"))
    frames = scores.select("sample", (F.col("vec_id") * 1024 + F.floor(F.col("i") / CLASSES)).alias("t"), (F.col("i") % CLASSES).alias("class"), "score")
    found = ch.frame_collapse(frames, "sample", "t", "class", "score")
    return found.select("sample", F.size("labels").cast("long").alias("n_labels"), F.md5(F.array_join(F.col("labels").cast("array<string>"), ",")).alias("labels_md5"))


# the label vectors are those of the least vec_id of each label: a table of as many rows as there are labels
@query("""WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
l AS (SELECT label, arg_min(v, vec_id) AS lv FROM u GROUP BY label),
s AS (SELECT vec_id, l.label, 100 * list_dot_product(v, lv) AS s FROM u, l),
m AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id)) AS e FROM s)
SELECT vec_id, label, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS probability FROM m""")
def zero_shot(spark, sf):
    items = d.table(spark, sf, "embeddings")
    labels = items.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("label_vec"))
    return rounded(ch.zero_shot(items, labels))
