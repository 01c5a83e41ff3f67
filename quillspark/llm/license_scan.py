"""License scans by a positional rare-token index (operator 5).

The index holds the positions of each template's words, but for those that many templates share. One reading of
a text yields its word count, the places of fixed phrases and the places of licence words. A licence word's IDF is
taken over all files. Spark looks up the places of the highest-IDF words alone: of each template as many postings
as a match can miss and one more, so that every match is met. They give candidates of template and shift (place in
the text minus place in the template). A candidate is kept if each mandatory key phrase of the template stands
where its shift puts it and enough of all the template's postings agree with the shift.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. Base phrases label a text
wherever their words stand consecutively. Defined results: a null or empty text has no words and no label;
``score`` is 1 with a base phrase, else the greatest share of a verified template's postings that voted, else
0; repeated rows keep their rows; empty tables give empty results; ``doc_id`` may be null.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import scratch_table, slices

#: Base phrases and labels (fixed values).
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Templates (fixed values, public licence notices): label, text, mandatory key phrases.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge", "sublicense and or sell copies")),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license version 2 0", "except in compliance with the license")),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ("redistribution and use in source and binary forms", "must retain the above copyright notice")),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license", "free software foundation", "version 3")),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("for any purpose with or without fee", "permission notice appear in all copies")),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license v 2 0",)),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ("unencumbered software released into the public domain",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial 4 0",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ("gnu general public license", "free software foundation", "version 2 of the license")),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", ("gnu lesser general public license", "version 2 1 of the license")),
    ("lgpl-3", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu lesser general public license", "version 3 of the license")),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu affero general public license", "version 3 of the license")),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("neither the name of", "endorse or promote products derived from this software")),
    ("mit-0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED AS IS", ("furnished to do so the software is provided as is",)),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ("without any express or implied warranty", "alter it and redistribute it freely")),
    ("bsl-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software", ("any person or organization obtaining a copy", "prepare derivative works of the software")),
    ("bsl-1", "Distributed under the Boost Software License, Version 1.0", ("boost software license version 1 0",)),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license 2 0",)),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike 4 0",)),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", ("creative commons attribution noderivatives 4 0",)),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", ("creative commons attribution noncommercial sharealike 4 0",)),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at", ("sil open font license version 1 1",)),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed", ("changing it is allowed as long as the name is changed",)),
)
#: Words in more than this share of the templates are never indexed.
COMMON = 0.34
#: Share of a template's postings that must vote for a shift, and words that a key phrase may be off.
VOTES, SLACK = 0.6, 3

_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_WORDS).split()


@lru_cache(maxsize=1)
def index() -> tuple[dict[bytes, int], list[tuple[int, int, int]], list[tuple[list[bytes], int]], list[list[tuple[int, int]]]]:
    """Index words by number; postings (word, template, place); phrases with the place of their rarest word,
    base phrases first; and per template the phrases it must hold with their places."""
    texts = [words_of(t) for _, t, _ in TEMPLATES]
    df = Counter(w for t in texts for w in set(t))
    idf = {w: math.log(len(texts) / n) for w, n in df.items()}
    numbers: dict[bytes, int] = {}
    postings = []
    for t, words in enumerate(texts):
        for place, w in enumerate(words):
            if df[w] <= COMMON * len(texts):
                postings.append((numbers.setdefault(w, len(numbers)), t, place))
    phrases = [words_of(p) for p, _ in BASE]
    needed = []
    for (_, _, keys), words in zip(TEMPLATES, texts, strict=True):
        own = []
        for key in map(words_of, keys):
            if key not in phrases:
                phrases.append(key)
            place = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
            own.append((phrases.index(key), place))
        needed.append(own)
    anchored = [(p, max(range(len(p)), key=lambda i, p=p: (idf.get(p[i], 9.0), len(p[i])))) for p in phrases]
    return numbers, postings, anchored, needed


def least_votes(size: int) -> int:
    return math.ceil(VOTES * size)


FOUND = "row long, doc_id long, n_words long, phrases array<struct<phrase:int,place:long>>, words array<struct<word:int,place:long>>"


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers, _, anchored, _ = index()
    anchors: dict[bytes, list[tuple[int, int, list[bytes]]]] = {}
    for number, (phrase, at) in enumerate(anchored):
        anchors.setdefault(phrase[at], []).append((number, at, phrase))
    wanted = {*numbers, *anchors}
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("phrases", pa.list_(pa.struct([("phrase", pa.int32()), ("place", pa.int64())]))), ("words", pa.list_(pa.struct([("word", pa.int32()), ("place", pa.int64())])))])
    for batch in slices(batches, "text"):
        counts, phrases, places = [], [], []
        for text in batch.column("text").to_pylist():
            words = words_of(text)
            hits = [(i, w) for i, w in enumerate(words) if w in wanted]
            counts.append(len(words))
            phrases.append([{"phrase": n, "place": i - at} for i, w in hits for n, at, p in anchors.get(w, ()) if i >= at and words[i - at : i - at + len(p)] == p])
            places.append([{"word": numbers[w], "place": i} for i, w in hits if w in numbers])
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(phrases, schema.field(3).type), pa.array(places, schema.field(4).type)], schema=schema)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` for every row;
    ``spans`` holds label, first word and score of each verified template place."""
    spark = docs.sparkSession
    _, postings, _, needed = index()
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = scratch_table(source.mapInArrow(_places, FOUND), "licence-places")
    # the index, the templates and their key phrases are fixed tables of a few hundred rows
    sizes = Counter(t for _, t, _ in postings)
    listed = spark.createDataFrame(postings, "word int, template int, at int")
    rules = [(t, label, sizes[t], len(needed[t]), least_votes(sizes[t])) for t, (label, _, _) in enumerate(TEMPLATES)]
    templates = F.broadcast(spark.createDataFrame(rules, "template int, label string, size int, n_needed int, least int"))
    keys = F.broadcast(spark.createDataFrame([(t, p, k, at) for t, own in enumerate(needed) for k, (p, at) in enumerate(own)], "template int, phrase int, need int, key_at int"))
    # at most one row a licence word: in how many files it stands
    files = found.select(F.explode(F.array_distinct(F.transform("words", lambda w: w["word"]))).alias("word")).groupBy("word").agg(F.count("*").alias("files"))
    rarest_first = Window.partitionBy("template").orderBy(F.coalesce("files", F.lit(0)), "word", "at")
    leading = (
        listed.join(F.broadcast(files), "word", "left")
        .withColumn("rank", F.row_number().over(rarest_first))
        .join(templates, "template")
        .where(F.col("rank") <= F.col("size") - F.col("least") + 1)
        .select("word", "template", "at")
    )
    placed = found.where(F.size("words") > 0).select("row", F.inline("words"))
    candidates = placed.join(F.broadcast(leading), "word").select("row", "template", (F.col("place") - F.col("at")).alias("shift")).distinct()
    # a key phrase may be SLACK words off: each shift that it allows is one row of an equi-join, so that a file of many
    # notices costs its places, not their product with its shifts
    off = F.explode(F.array(*(F.lit(d) for d in range(-SLACK, SLACK + 1)))).alias("off")
    standing = found.where(F.size("phrases") > 0).select("row", F.inline("phrases")).join(keys, "phrase").select("*", off)
    allowed = standing.select("row", "template", (F.col("place") - F.col("key_at") + F.col("off")).alias("shift"), "need")
    keyed = candidates.join(allowed, ["row", "template", "shift"]).groupBy("row", "template", "shift").agg(F.count_distinct("need").alias("n_found"))
    expected = keyed.join(templates, "template").where("n_found = n_needed").join(F.broadcast(listed), "template").withColumn("place", F.col("shift") + F.col("at"))
    verified = expected.join(placed, ["row", "word", "place"]).groupBy("row", "template", "label", "size", "least", "shift").agg(F.count("*").alias("votes")).where("votes >= least")
    spans = verified.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("label", F.col("shift").alias("first_word"), (F.col("votes") / F.col("size")).alias("score")))).alias("spans"))
    base = F.filter("phrases", lambda h: h["phrase"] < len(BASE))
    label_of = F.array(*(F.lit(label) for _, label in BASE))
    out = found.join(spans, "row", "left").withColumn("base", base)
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda h: F.get(label_of, h["phrase"]))))
    own = F.coalesce(F.transform("spans", lambda s: s["label"]), F.array().cast("array<string>"))
    starts = F.transform("base", lambda h: h["place"])
    return out.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, own)), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))).alias("score"),
        "spans",
    )
