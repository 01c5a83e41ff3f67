"""Queries on corpus preparation: lines, layout, edits, pairs, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import corpus
from quillspark.plans.register import registry
from quillspark.sources import derived as d
from quillspark.sources import lines, readers, writers
from quillspark.sources.scratch import scratch_path

QUERIES, ORACLE_SQL, query = registry()


@query("SELECT doc_id, i::BIGINT - 1 AS idx, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)")
def numbered_lines(spark, sf):
    rows = d.table(spark, sf, "documents").select("doc_id", readers.numbered_lines(F.col("text")))
    return rows.withColumn("idx", F.col("idx").cast("long"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS line_no, md5(line) AS line_md5 FROM l""")
def file_lines(spark, sf):
    """All texts, one after the other, as text files, and their lines numbered from the files."""
    path = scratch_path(spark, "texts")
    texts = d.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("text").write.text(path)
    return lines.numbered_lines(spark, path, by_file=False).select("line_no", F.md5("line").alias("line_md5"))


@query("""SELECT page_id::VARCHAR AS id, sha256(coalesce(html, '') || chr(10)) AS sha256, strlen(coalesce(html, '')) + 1 AS length FROM pages WHERE page_id IN (SELECT doc_id FROM documents)""")
def page_files(spark, sf):
    """Pages as files of their own: those with an id of the corpus, found by their paths, and their hashes."""
    pages = d.table(spark, sf, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    folders = writers.write_files(pages.repartition("page_id"), scratch_path(spark, "pages"))
    found = readers.files(spark, folders, "*.txt").select("path", "length", writers.content_hash())
    ids = d.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return readers.file_assets(found, ids, r"/page_id=(\d+)(?:/[^/]+)?\.txt$").select("id", "sha256", "length")


@query(r"SELECT p.page_id, regexp_extract(p.url, '/(\d+)(?:#\w+)?$', 1) AS id FROM pages p WHERE regexp_extract(p.url, '/(\d+)(?:#\w+)?$', 1) IN (SELECT doc_id::VARCHAR FROM documents)")
def asset_join(spark, sf):
    paths = d.table(spark, sf, "pages").select("page_id", "url")
    ids = d.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return readers.assets(paths, ids, r"/(\d+)(?:#\w+)?$", "url").select("page_id", "id")


@query(f"""WITH {d.LINES_SQL} SELECT 'hf_' || id AS id, 'hf' AS source, text FROM lines
UNION ALL SELECT 'book_' || item_id, 'book', text FROM benchmark WHERE trim(text) <> ''""")
def assemble_testset(spark, sf):
    book = d.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.lit("").alias("original_formatted"), F.col("text").alias("original"))
    return readers.test_set(d.lines(spark, sf), book)


_SIGNS = "[,.;:!?()\\[\\]«»\"''–—]"


@query(rf"WITH {d.LINES_SQL} SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\s*({_SIGNS})\s*', '\1', 'g'), '({_SIGNS})', ' \1 ', 'g'), ' +', ' ', 'g')) AS formatted FROM lines")
def format_sentence(spark, sf):
    return d.lines(spark, sf).select("id", tx.format_sentence(F.col("text")).alias("formatted"))


# lines of three kinds that the texts lack are made from them, so that every test has hits
@query(rf"""WITH {d.LINES_SQL}, v AS (SELECT id, CASE id % 5 WHEN 0 THEN (id % 900)::VARCHAR || ' .' WHEN 1 THEN upper(replace(left(text, 30), 'ß', 's')) WHEN 2 THEN (id % 900)::VARCHAR || ' Turi refers to ' || left(text, 50) ELSE text END AS text FROM lines)
SELECT id, regexp_matches(trim(text), '^\d+\s*\.?\s*$') AS page_number,
  length(text) < 40 AND upper(text) = text AND lower(text) <> text AND len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) <= 4 AS header_fragment,
  regexp_matches(text, '^\d{{1,3}}\s+[A-Z]') AND (contains(text, 'refers to') OR contains(text, 'refers here') OR contains(text, 'i.e.') OR contains(text, 'i . e .') OR contains(text, 'see') OR contains(text, 'See') OR contains(text, 'cf.') OR contains(text, 'cf .')) AS footnote FROM v""")
def line_filter(spark, sf):
    kind, t = F.col("id") % 5, F.col("text")
    number = (F.col("id") % 900).cast("string")
    made = F.when(kind == 0, F.concat(number, F.lit(" ."))).when(kind == 1, F.upper(F.replace(F.left(t, F.lit(30)), F.lit("ß"), F.lit("s")))).when(kind == 2, F.concat(number, F.lit(" Turi refers to "), F.left(t, F.lit(50)))).otherwise(t)
    rows = d.lines(spark, sf).select("id", made.alias("text"))
    return rows.select("id", tx.is_page_number(t).alias("page_number"), tx.is_header_fragment(t).alias("header_fragment"), tx.is_footnote(t).alias("footnote"))


def _layout(spark, sf):
    """Lines with arithmetic sizes: mostly 10, some headers of 12 and footnotes of 8."""
    size = F.when(F.col("id") % 11 == 0, 12.04).when(F.col("id") % 7 == 0, 8.0).otherwise(9.96 + (F.col("id") % 3) * 0.02)
    return d.lines(spark, sf).select("doc_id", "line_no", "id", "text", size.cast("double").alias("size"))


LAYOUT = f"WITH {d.LINES_SQL}, layout AS (SELECT *, (CASE WHEN id % 11 = 0 THEN 12.04 WHEN id % 7 = 0 THEN 8.0 ELSE 9.96 + (id % 3) * 0.02 END)::DOUBLE AS size FROM lines)"
BODY = f"{LAYOUT}, body AS (SELECT arg_max(s, (n, -s)) AS body_size FROM (SELECT round(size, 1) AS s, count(*) AS n FROM layout GROUP BY 1))"
KINDS = f"{BODY}, kinds AS (SELECT *, CASE WHEN size >= body_size * 1.15 THEN 'header' WHEN size <= body_size * 0.85 THEN 'footnote' ELSE 'body' END AS kind FROM layout, body WHERE length(text) >= 3)"


@query(f"{BODY} SELECT body_size FROM body")
def body_size(spark, sf):
    return corpus.body_size(_layout(spark, sf))


@query(f"{KINDS} SELECT id, kind FROM kinds")
def line_kind(spark, sf):
    return corpus.line_kinds(_layout(spark, sf)).select("id", "kind")


_FOOT = r"(regexp_matches({0}, '^\d{{1,3}}\s+[A-Z]') AND regexp_matches({0}, 'refers to|refers here|i\.e\.|i \. e \.|see|See|cf\.|cf \.'))"


@query(rf"""{KINDS}, kept AS (SELECT doc_id, string_agg(text, ' ' ORDER BY line_no) AS text FROM kinds WHERE kind <> 'footnote' AND NOT regexp_matches(trim(text), '^\d+\s*\.?\s*$')
  AND NOT (length(text) < 40 AND upper(text) = text AND lower(text) <> text AND len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) <= 4) AND NOT {_FOOT.format('text')} GROUP BY doc_id),
s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS s FROM kept),
e AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1)::BIGINT - 1 AS pos FROM s) SELECT * FROM e WHERE NOT {_FOOT.format('sentence')}""")
def sentences(spark, sf):
    return corpus.document_sentences(_layout(spark, sf)).withColumn("pos", F.col("pos").cast("long"))


# the given texts hold no character that NFKC changes
@query(rf"WITH {d.LINES_SQL} SELECT id, trim(regexp_replace(regexp_replace(text, '[\p{{C}}]', '', 'g'), '[^\S\n]+', ' ', 'g')) AS cleaned FROM lines")
def nfkc_clean(spark, sf):
    return d.lines(spark, sf).select("id", tx.nfkc_clean(F.col("text")).alias("cleaned"))


_SMALL = ", ".join(f"'{w}'" for w in tx.HEADER_SMALL)
_SPACED = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"


@query(rf"""WITH {d.LINES_SQL}, f AS (SELECT id, text, array_to_string(list_transform({_SPACED.format('text')}[1:5], lambda w: CASE left(w, 1) WHEN 'ß' THEN 'Ss' ELSE upper(left(w, 1)) END || lower(substr(w, 2))), ' ') AS front FROM lines),
m AS (SELECT id, CASE id % 3 WHEN 0 THEN front || ' ' || text WHEN 1 THEN front || ' And then ' || text ELSE text END AS text FROM f),
h AS (SELECT id, text, regexp_extract(text, '^([A-Z][a-z]+(?:\s+[A-Z][a-z]+){{3,}})\s+And\s+(?:{tx.BODY_STARTS})\s+', 1) AS header, {_SPACED.format('text')} AS w FROM m),
c AS (SELECT *, list_position(list_transform(w, lambda x: x IN ({_SMALL}) OR regexp_matches(x, '^\p{{Lu}}[^\p{{Lu}}]*\p{{Ll}}[^\p{{Lu}}]*$')), false) AS first FROM h),
n AS (SELECT *, CASE WHEN coalesce(first, 0) = 0 THEN len(w) ELSE first - 1 END AS n FROM c),
p AS (SELECT id, CASE WHEN header <> '' THEN [trim(header) || ' .', trim(substr(text, length(header) + 1))]
  WHEN len(w) >= 8 AND n >= 4 AND len(w) - n >= 3 AND (lower(w[1]) = lower(w[n + 1]))::INT + (lower(w[2]) = lower(w[n + 2]))::INT + (lower(w[3]) = lower(w[n + 3]))::INT >= 2
  THEN [array_to_string(w[1:n], ' ') || ' .', array_to_string(w[n + 1:], ' ')] ELSE [text] END AS parts FROM n)
SELECT id, unnest(parts) AS text, generate_subscripts(parts, 1)::INT - 1 AS part FROM p""")
def header_split(spark, sf):
    """Lines with a title-case form of their first words in front."""
    t = F.col("text")
    front = F.initcap(F.array_join(F.slice(tx.words(t), 1, 5), " "))
    made = F.when(F.col("id") % 3 == 0, F.concat_ws(" ", front, t)).when(F.col("id") % 3 == 1, F.concat_ws(" ", front, F.lit("And then"), t)).otherwise(t)
    return d.lines(spark, sf).select("id", F.posexplode(tx.header_split(made)).alias("part", "text"))


def _sides(spark, sf):
    """Two sides of lines per conversation: user turns and assistant turns."""
    c = d.table(spark, sf, "conversations").where("role in ('user', 'assistant')")
    return c.select("conv_id", F.col("role").alias("side"), F.col("turn").alias("idx"), "text")


SIDES = "WITH sides AS (SELECT conv_id, role AS side, turn AS idx, text FROM conversations WHERE role IN ('user', 'assistant'))"


#: No conversation has so many turns.
TURNS = 1 << 20


def _flat(spark, sf):
    """The same as two long files: the line number counts over conversations."""
    return _sides(spark, sf).select("side", (F.col("conv_id") * TURNS + F.col("idx")).alias("idx"), "text")


FLAT = f"{SIDES}, flat AS (SELECT side, conv_id * {TURNS} + idx AS idx, text FROM sides)"


@query(f"""{FLAT} SELECT side, idx, generate_subscripts(p, 1)::BIGINT - 1 AS part, unnest(p) AS text FROM (
  SELECT side, idx, CASE WHEN idx % 5 = 0 THEN [left(text, 20), substr(text, 21)] WHEN idx % 4 = 0 THEN [text || ' +'] ELSE [text] END AS p FROM flat WHERE idx % 7 <> 0)""")
def edit_overlay(spark, sf):
    lines = _flat(spark, sf)
    deleted = lines.where("idx % 7 = 0").select("side", "idx")
    merged = lines.where("idx % 4 = 0").select("side", "idx", F.concat("text", F.lit(" +")).alias("text"))
    splits = lines.where("idx % 5 = 0").select("side", "idx", F.array(F.left("text", F.lit(20)), F.substr("text", F.lit(21))).alias("parts"))
    return corpus.overlay(lines, deleted, merged, splits).withColumn("part", F.col("part").cast("long"))


@query(f"""{SIDES}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY idx) AS k FROM sides)
SELECT u.conv_id, u.idx AS user_idx, u.text AS user, a.idx AS assistant_idx, a.text AS assistant FROM r u JOIN r a ON u.conv_id = a.conv_id AND u.k = a.k AND u.side = 'user' AND a.side = 'assistant' WHERE u.text <> '' AND a.text <> ''""")
def pair_lines(spark, sf):
    return corpus.pair_lines(_sides(spark, sf), "user", "assistant", "conv_id").select("conv_id", "user_idx", "user", "assistant_idx", "assistant")


# merges wanted at every third live line, so that no two wanted lines are neighbours
@query("""WITH live AS (SELECT conv_id, turn AS idx, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
m AS (SELECT *, k % 3 = 1 AS want, lead(text) OVER w AS next, lag(k % 3 = 1) OVER w AS gone FROM live WINDOW w AS (PARTITION BY conv_id ORDER BY idx))
SELECT conv_id, idx, CASE WHEN want AND next IS NOT NULL THEN text || ' ' || next ELSE text END AS text FROM m WHERE NOT coalesce(gone, false)""")
def merge_next(spark, sf):
    from pyspark.sql import Window as W

    rows = d.table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("idx"), "text")
    k = F.row_number().over(W.partitionBy("conv_id").orderBy("idx"))
    return corpus.merge_next(rows.withColumn("k", k), F.col("k") % 3 == 1, "conv_id").drop("k")


@query("""WITH live AS (SELECT conv_id, turn AS idx, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
SELECT conv_id, idx, coalesce(CASE WHEN k % 3 = 1 THEN lead(text) OVER w WHEN k % 3 = 2 THEN lag(text) OVER w END, text) AS text FROM live WINDOW w AS (PARTITION BY conv_id ORDER BY idx)""")
def swap_next(spark, sf):
    from pyspark.sql import Window as W

    rows = d.table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("idx"), "text")
    k = F.row_number().over(W.partitionBy("conv_id").orderBy("idx"))
    return corpus.swap_next(rows.withColumn("k", k), F.col("k") % 3 == 1, "conv_id").drop("k")


@query(f"""WITH {d.LINES_SQL}, m AS (SELECT *, min(line_no) FILTER (WHERE contains(text, 'the') AND NOT contains(text, '#')) OVER (PARTITION BY doc_id) AS a,
  min(line_no) FILTER (WHERE contains(text, 'ble')) OVER (PARTITION BY doc_id) AS b FROM lines)
SELECT doc_id, line_no AS idx, text FROM m WHERE line_no >= coalesce(a, line_no) AND line_no <= coalesce(b, line_no)""")
def content_range(spark, sf):
    rows = d.lines(spark, sf).select("doc_id", F.col("line_no").alias("idx"), "text")
    start = F.contains("text", F.lit("the")) & ~F.contains("text", F.lit("#"))
    return corpus.content_range(rows, start, F.contains("text", F.lit("ble")), "doc_id")


@query(f"WITH {d.PAIRS_SQL} SELECT id, replace(original || chr(9) || 'x', chr(9), ' ') AS original, replace(translation, chr(9), ' ') AS translation FROM pairs")
def pair_export_tsv(spark, sf):
    return writers.tsv_fields(d.pairs(spark, sf).withColumn("original", F.concat("original", F.lit("\tx"))))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark, sf):
    files = d.table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    return writers.content_hashes(files).withColumnRenamed("path", "doc_id")


#: Rows of the seeded sample and of the head: the features under test.
SAMPLE, SEED = 100, 42


@query(f"WITH {d.LINES_SQL} SELECT id, text FROM (SELECT id, text FROM lines ORDER BY md5('{SEED}' || ':' || id), id LIMIT {SAMPLE})")
def seeded_sample(spark, sf):
    rows = d.lines(spark, sf).select("id", "text")
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(SEED)), F.col("id").cast("string"))), "id").limit(SAMPLE)


@query(f"WITH {d.LINES_SQL} SELECT id, text FROM lines ORDER BY id LIMIT {SAMPLE}")
def head_n(spark, sf):
    return d.lines(spark, sf).select("id", "text").orderBy("id").limit(SAMPLE)
