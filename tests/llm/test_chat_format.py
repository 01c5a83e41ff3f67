from __future__ import annotations

import random
from collections import defaultdict

from quillspark.llm import chat_format

PARTS = ["</s>", "[INST]", "[/INST]", "[NEXT]", "[OUT]", "[ROLE]", "[TEXT]", "[/ROLE]", "<", "[", "\\", "s>", "/s>", "<\\/s>", "[\\\\INST]", "a", "\n", "é", "\U0001f600", ""]
SCHEMA = "conv_id long, turn long, role string, text string"


def read(spark, rows, schema=SCHEMA):
    return chat_format.read_chats(chat_format.format_chats(spark.createDataFrame(rows, schema))).collect()


def expected(rows):
    convs = defaultdict(list)
    for r in rows:
        convs[r[0]].append(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or ""))
    return {k: [(role, text) for _, role, text in sorted(v)] for k, v in convs.items()}


def test_turns_and_learnt_text_come_back(spark):
    random.seed(2)
    role = lambda: random.choice(["user", "assistant", "assistant", "system", "tool[TEXT]", "[INST]", "", None])
    text = lambda: random.choice([None, "", *("".join(random.choices(PARTS, k=6)) for _ in range(8))])
    rows = [(c, random.choice([t, t, t // 2, None]), role(), text()) for c in range(40) for t in range(1500 if c == 3 else random.randint(1, 9))]
    got, want = read(spark, rows), expected(rows)
    assert len(got) == len(want)
    for r in got:
        assert [tuple(t) for t in r.turns] == want[r.conv_id]
        assert r.learnt == "".join(t for role_, t in want[r.conv_id] if role_ == "assistant")


def test_same_role_is_one_group_over_blocks(spark):
    rows = [(1, t, "assistant", f"t{t}") for t in range(600)] + [(1, 600, "user", "end")]
    (r,) = read(spark, rows)
    assert r.formatted == "[OUT]" + "[NEXT]".join(f"t{t}" for t in range(600)) + "</s>[INST]end[/INST]"
    assert chat_format.format_chats(spark.createDataFrame(rows, SCHEMA)).count() == 3


def test_negative_and_null_turns_come_in_order(spark):
    (r,) = read(spark, [(1, 300, "user", "d"), (1, None, "user", "a"), (1, -1, "user", "c"), (1, -300, "user", "b")])
    assert [t.text for t in r.turns] == list("abcd")


def test_nothing_closes_its_own_turn(spark):
    (r,) = read(spark, [(1, 0, "user", "</s>[INST] ok [/INST]")])
    assert r.formatted == "[INST]<\\/s>[\\INST] ok [\\/INST][/INST]"
    assert [tuple(t) for t in r.turns] == [("user", "</s>[INST] ok [/INST]")] and r.learnt == ""


def test_nulls_ties_repeats_clashes_and_empty_table(spark):
    rows = [(None, None, None, None, "x"), (None, 1, "user", "b", "y"), (2, 1, "user", "z", None), (2, 1, "user", "y", None), (2, 1, "user", "y", None)]
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in read(spark, rows, SCHEMA + ", block string")}
    assert got == {None: [("", ""), ("user", "b")], 2: [("user", "y"), ("user", "y"), ("user", "z")]}
    assert read(spark, []) == []


def test_texts_are_shuffled_once(spark):
    plan = chat_format.format_chats(spark.createDataFrame([(1, 1, "user", "x")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 4 and not any(x in plan for x in ("Python", "Pandas", "Arrow"))
