from __future__ import annotations

import random
import re

from quillspark.llm import license_scan as s

FILLER = "ton thre la éa "


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for p, label in s.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in hits]
    return len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))


def test_base_equals_brute_force_and_templates_are_found(spark):
    mit, apache, bsd = s.TEMPLATES[0][1], s.TEMPLATES[1][1], s.TEMPLATES[2][1]
    texts = [
        None, "", "!!", "Under the MIT-License and under the mit license; CC BY NC", "the apache license, version 2.0", FILLER * 30,
        FILLER * 9 + mit + " " + FILLER * 4, mit.replace("granted, free", "granted at last, and free"), FILLER + bsd.upper(), bsd.replace("copyright", "COPYLEFT"),
        apache, "software permission copy version license public " * 50, "This work is licensed under the GNU General Public License, version 3.", "under the mité license", "Licensed under CC BY-NC 4.0.",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(5, texts[4], "y")], "doc_id long, text string, labels string").repartition(3)
    rows = s.scan(df).collect()
    got = {r.doc_id: r for r in rows if r.doc_id != 5 or r.n_base == 0}
    assert len(rows) == len(texts) + 1 and sum(r.doc_id == 5 for r in rows) == 2
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    labels = [got[i].labels for i in range(len(texts))]
    assert labels[5:] == ["", "mit", "", "bsd-3", "", "apache-2", "", "gpl-3", "", "cc-by-nc"]
    assert got[6].score == 1 and got[6].spans[0].first_word == 36
    assert s.scan(df.limit(0)).count() == 0


def test_every_template_is_found_and_many_notices_in_one_file(spark):
    texts = [FILLER * 20 + text + " " + FILLER * 20 for _, text, _ in s.TEMPLATES]
    everything = (" " + FILLER * 5).join([t for _, t, _ in s.TEMPLATES] * 8)
    df = spark.createDataFrame(list(enumerate([*texts, everything])), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in s.scan(df).collect()}
    for i, (label, _, _) in enumerate(s.TEMPLATES):
        assert label in got[i].labels.split(",") and (80, label, 1.0) in {(x.first_word, x.label, x.score) for x in got[i].spans}
    whole = got[len(texts)]
    assert set(whole.labels.split(",")) == {label for label, _, _ in s.TEMPLATES}
    assert sum(x.score == 1 for x in whole.spans) >= 8 * len(s.TEMPLATES)


def test_close_relatives_are_told_apart(spark):
    by_label = {}
    for label, text, _ in s.TEMPLATES:
        by_label.setdefault(label, text)
    names = ["gpl-2", "gpl-3", "lgpl-2.1", "lgpl-3", "agpl-3", "cc-by", "cc-by-sa", "cc-by-nd", "cc-by-nc", "cc-by-nc-sa"]
    df = spark.createDataFrame([(i, FILLER + by_label[n]) for i, n in enumerate(names)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in s.scan(df).collect()}
    assert [got[i] for i in range(len(names))] == names


def plain_spans(text):
    """Each shift of each template tried on its own: no index, no rare words."""
    words, spans = s.words_of(text), set()
    numbers, postings, anchored, needed = s.index()
    named = {n: w for w, n in numbers.items()}
    for t, (label, _, _) in enumerate(s.TEMPLATES):
        own = [(named[w], at) for w, x, at in postings if x == t]
        for shift in {i - at for i, w in enumerate(words) for x, at in own if x == w}:
            votes = sum(0 <= shift + at < len(words) and words[shift + at] == w for w, at in own)
            phrases = [(anchored[p][0], shift + at) for p, at in needed[t]]
            stand = all(any(words[q : q + len(p)] == p for q in range(max(0, at - s.SLACK), at + s.SLACK + 1)) for p, at in phrases)
            if stand and votes >= s.VOTES * len(own):
                spans.add((label, shift, round(votes / len(own), 9)))
    return spans


def test_spans_equal_a_plain_search_without_the_index(spark, sf_dir):
    rng = random.Random(5)

    def damaged(text):
        words = [w if rng.random() < 0.93 else rng.choice(["software", "the", "license", "la"]) for w in text.split()]
        for _ in range(rng.randint(0, 2)):
            words.insert(rng.randrange(len(words)), "quite")
        return FILLER * rng.randint(0, 3) + " ".join(words)

    texts = [damaged(text) for _, text, _ in s.TEMPLATES for _ in range(6)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    # words of one licence in most files are no longer rare: which words lead must not matter
    texts += ["mozilla public affero lesser eclipse boost permission redistribution"] * 300
    got = {r.doc_id: r for r in s.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = 0
    for i, text in enumerate(texts):
        want = plain_spans(text)
        found += bool(want)
        assert {(x.label, x.first_word, round(x.score, 9)) for x in got[i].spans or []} == want
        base = set(filter(None, brute(text)[4].split(",")))
        assert got[i].labels == ",".join(sorted(base | {label for label, _, _ in want}))
        assert round(got[i].score, 9) == (1 if base else max((score for _, _, score in want), default=0))
    assert found > 60
