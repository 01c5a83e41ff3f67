from __future__ import annotations

import base64
import random
from hashlib import sha1

from quillspark.llm import warc

TRICKS = ["", None, "\r\n", "\r\n\r\n", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "WARC/1.1\r\nContent-Length: 999999\r\n\r\n", "tail\r", "tail\r\n", "tail\r\n\r", "é" * 50, "WARC/1.0\r\nno header"]


def brute(rows):
    out = []
    for i, html in rows:
        same = [j for j, h in rows if (h or "") == (html or "")]
        data = (html or "").encode()
        digest = base64.b32encode(sha1(data).digest()).decode()
        out.append((i, len(data), digest, *(("response", None) if max(same) == i else ("revisit", max(same)))))
    return sorted(out)


def test_round_trip_equals_brute_force_across_splits(spark):
    rng = random.Random(9)
    rows = []
    for i in range(250):
        html = rng.choice(TRICKS) if rng.random() < 0.4 else "".join(rng.choice(["<p>x</p>", "\r\n\r\n", "WARC/1.1\r\n", f"{i} "]) for _ in range(rng.randint(1, 60)))
        rows.append((i, html))
    rows.append((250, "y" * 9000 + "\r\n\r\n" + "z" * 5000))
    df = spark.createDataFrame([(i, f"http://x/{i}\r\nb", h, 3) for i, h in rows], "page_id long, url string, html string, length int")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        path = warc.scratch_path(spark, "warc")
        warc.write_archives(df.coalesce(2), path)
        assert spark.read.text(path).rdd.getNumPartitions() > 20
        got = [(r.page_id, r.stated_bytes if r.type == "revisit" else r.length, r.stated_digest if r.type == "revisit" else r.digest, r.type, r.refers_to) for r in warc.read_archives(spark, path).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got) == brute(rows)


def test_small_payloads_nulls_and_empty_tables(spark):
    rows = [(1, "ab"), (2, "ab"), (3, "abcdef"), (4, "abcdef"), (4, "abcdef"), (None, "abcdef")]
    df = spark.createDataFrame([(i, None, h) for i, h in rows], "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.type, r.refers_to) for r in warc.round_trip(df, min_bytes=3).collect())
    assert got == [(0, "revisit", 4), (1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None), (4, "response", None)]
    assert warc.round_trip(df.limit(0)).count() == 0
