from __future__ import annotations

import random
import re
from collections import defaultdict

from quillspark.llm import line_dedup as d


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute(rows):
    held = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k].append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= 20 and len(held[key(x)]) >= 3 and max(held[key(x)]) != i for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return sorted(out)


def test_dedup_equals_brute_force(spark):
    rng = random.Random(1)
    pool = [f"This is shared line number {i} É" for i in range(30)] + ["short", "", "  THIS is shared line number 3 É\t", "\x0bthis is shared line number 4 É\r"]
    rows = [(i * 7 % 101, "\n".join(rng.choices(pool, k=rng.randint(0, 9)) + [f"own line of document {i} only"])) for i in range(90)] + [(5, None), (200, ""), (201, "x"), (201, pool[0] + "\n" + pool[0])]
    df = spark.createDataFrame([(i, t, 1.5, "z") for i, t in rows], "doc_id long, text string, n_lines double, h string").repartition(5)
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in d.dedup_lines(df).collect())
    assert got == brute(rows)
    assert d.dedup_lines(df).columns == ["doc_id", "text", "h", "n_lines", "n_dropped"]
    empty = d.dedup_lines(df.limit(0))
    assert empty.count() == 0


def test_null_ids_count_as_least(spark):
    line = "a line of more than twenty characters"
    df = spark.createDataFrame([(None, line), (None, line), (1, line)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_dropped) for r in d.dedup_lines(df).collect()) == [(-1, 1), (-1, 1), (1, 0)]


def test_runs_are_compacted_by_level(spark):
    runs = d.LineRuns(4, min_docs=3, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(bytes([i]), 100 - 10 * b - i) for i in range(b, b + 4)], "h binary, doc long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {(r.h[0], r.last) for r in runs.frequent().collect()} == {(2, 98), (3, 97), (4, 86), (5, 75)}


def test_rows_that_share_an_id_are_one_document_and_names_may_clash(spark):
    line, other = "a line of more than twenty characters", "another line of over twenty characters"
    rows = [(1, line), (1, line), (1, f"{line}\n{other}"), (2, f"{line}\n{other}"), (5, other), (None, ""), (6, None)]
    df = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], "doc_id long, text string, _doc int, _drop int, h int, batch string")
    got = d.dedup_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    # ``line`` is in two documents, ``other`` in three: it stays in 5 alone
    assert sorted((r.doc_id or 0, r.n_lines, r.n_dropped) for r in got.collect()) == [(0, 1, 0), (1, 1, 0), (1, 1, 0), (1, 2, 1), (2, 2, 1), (5, 1, 0), (6, 1, 0)]
    assert d.dedup_lines(df.limit(0)).count() == 0


def test_only_the_count_of_a_batch_shuffles(spark):
    runs = d.LineRuns(int(spark.conf.get("spark.sql.shuffle.partitions")))
    batches = [spark.createDataFrame([(bytes([i % 50]), 1000 - 100 * b - i) for i in range(90)], "h binary, doc long") for b in range(2)]
    for batch in batches:
        runs.add(batch)

    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange")

    assert exchanges(runs.unsettled(batches[0])) == 1
    assert exchanges(runs.frequent()) == 0


def test_runs_of_a_line_are_summed_across_levels(spark):
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = d.LineRuns(buckets, min_docs=4, fanout=3)
    for b in range(5):
        runs.add(spark.createDataFrame([(bytes([i]), 100 - b) for i in range(60)], "h binary, doc long"))
    # the fifth batch still counts, as three runs of one document each settle nothing
    assert [len(x) for x in runs.levels] == [2, 1]
    assert {(r.h[0], r.last) for r in runs.frequent().collect()} == {(i, 100) for i in range(60)}
