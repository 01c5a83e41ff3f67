"""Chat formatting: turns of a conversation become one marked text with a loss mask, by Spark expressions alone.

Template: adjacent turns of one role are one group. A group is ``[INST]`` texts ``[/INST]`` for users, ``[OUT]`` texts
``</s>`` for assistants, ``[SYS]`` texts ``[/SYS]`` for systems and ``[ROLE]`` role ``[TEXT]`` texts ``[/ROLE]`` for any
other role; the texts of a group are parted by ``[NEXT]``. A control string inside a text or role gets a backslash after
its first character (one more, if it has some already), so that none is left and reading back takes one away. As each
control string opens with ``<`` or ``[`` and holds neither again, no text makes one with the mark beside it.

A conversation is cut into blocks of 256 turn numbers, so that a group of rows stays small however long the
conversation is; the texts of its blocks in order, put together, are the conversation. Which roles stand before and
after a block comes from a narrow table of roles, so that texts are shuffled once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A block holds two to this power of turn numbers.
BLOCK_BITS = 8
#: Marks before and after the texts of a group by role (fixed values of the template), of other roles, and between texts.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>"), "system": ("[SYS]", "[/SYS]")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
NEXT = "[NEXT]"
#: The role whose texts are under the loss mask.
LEARNT = "assistant"
#: What follows ``<`` or ``[`` and perhaps backslashes in a control string.
_REST = r"(/?(?:s>|INST\]|OUT\]|SYS\]|ROLE\]|TEXT\]|NEXT\]))"
#: The place before the first mark of a group, and the marks after its texts.
_STARTS = r"(?=\[(?:INST|OUT|SYS|ROLE)\])"
_ENDS = r"(?:\[/(?:INST|SYS|ROLE)\]|</s>)\z"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, "$1$2$3")


def opening(role: Column) -> Column:
    other = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1]))
    return reduce(lambda rest, x: F.when(role == x[0], x[1][0]).otherwise(rest), MARKS.items(), other)


def closing(role: Column) -> Column:
    return reduce(lambda rest, x: F.when(role == x[0], x[1][1]).otherwise(rest), MARKS.items(), F.lit(OTHER[2]))


#: A null id and a null turn number as keys that join and group alike, so that the join deals the turns out for both.
_KEY = ["conv", "no_id", "block"]


def _turns(conversations: DataFrame) -> DataFrame:
    """Rows with their block. Null roles and texts are empty; null turn numbers have a block of their own, the first."""
    block = F.coalesce(F.shiftright(F.col("turn").cast("long"), BLOCK_BITS), F.lit(-(1 << 62)))
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    return conversations.select(F.coalesce("conv_id", F.lit(0)).alias("conv"), F.isnull("conv_id").alias("no_id"), block.alias("block"), turn.alias("t"))


def _groups(turns: Column) -> Column:
    """Sorted turns as an array of (role, texts), adjacent ones of a role together: where the role changes a group
    starts, and each takes the turns up to the next start."""
    n = F.size(turns)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, F.greatest(i - 1, F.lit(0)))["role"]))
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(n))
    return F.zip_with(starts, ends, lambda a, b: F.struct(F.get(turns, a)["role"].alias("role"), F.transform(F.slice(turns, a + 1, b - a), lambda t: t["text"]).alias("texts")))


def format_chats(conversations: DataFrame) -> DataFrame:
    """``conv_id, block, formatted, loss_spans`` of ``conversations(conv_id, turn, role, text)``: a row for each block
    of a conversation, with the places (``start`` from 1, ``length``, in code points of ``formatted``, escapes included)
    of assistants' texts.

    Turns go by number (null first), ties by role and text; null texts and roles are empty, empty texts keep their
    place; repeated rows are turns each; rows without a conversation id are one conversation of null id; an empty
    table gives none; other columns are not looked at. Rows of one turn number are in one block, however many."""
    rows = _turns(conversations)
    key = F.struct("t.turn", "t.role")
    ends = rows.groupBy(*_KEY).agg(F.min(key)["role"].alias("first"), F.max(key)["role"].alias("last"))
    beside = W.partitionBy("conv", "no_id").orderBy("block")
    ends = ends.select(*_KEY, F.lag("last").over(beside).eqNullSafe(F.col("first")).alias("goes_on"), F.lead("first").over(beside).eqNullSafe(F.col("last")).alias("open"))
    held = rows.join(ends, _KEY).groupBy(*_KEY)
    blocks = held.agg(F.sort_array(F.collect_list("t")).alias("turns"), F.max("goes_on").alias("goes_on"), F.max("open").alias("open"))
    id_ = F.when(~F.col("no_id"), F.col("conv")).alias("conv_id")
    blocks = blocks.select(id_, "block", "goes_on", "open", _groups(F.col("turns")).alias("groups"))
    blocks = blocks.select("conv_id", "block", _pieces(F.col("groups"), F.col("goes_on"), F.col("open")).alias("pieces"))
    return blocks.select("conv_id", "block", F.array_join("pieces.text", "").alias("formatted"), _spans(F.col("pieces")).alias("loss_spans"))


def _pieces(groups: Column, goes_on: Column, open_: Column) -> Column:
    """Marks and escaped texts in order, each with whether it is learnt. A block that goes on its neighbour's group
    starts with ``NEXT``; one that the next block goes on has no closing mark."""

    def piece(text: Column, learnt: Column) -> Column:
        return F.struct(text.alias("text"), learnt.alias("learnt"))

    def of(group: Column, i: Column) -> Column:
        learnt = group["role"] == LEARNT
        head = F.when((i == 0) & goes_on, F.lit(NEXT)).otherwise(opening(group["role"]))
        tail = F.when((i == F.size(groups) - 1) & open_, F.lit("")).otherwise(closing(group["role"]))
        texts = F.transform(group["texts"], lambda t, k: F.array(piece(F.when(k == 0, head).otherwise(F.lit(NEXT)), F.lit(False)), piece(escape(t), learnt)))
        return F.concat(F.flatten(texts), F.array(piece(tail, F.lit(False))))

    return F.flatten(F.transform(groups, of))


def _spans(pieces: Column) -> Column:
    start = F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))

    def add(done: Column, x: Column) -> Column:
        n = F.length(x["text"])
        span = F.struct(done["at"].alias("start"), n.alias("length"))
        return F.struct((done["at"] + n).alias("at"), F.when(x["learnt"], F.array_append(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    return F.aggregate(pieces, start, add, lambda done: done["spans"])


def learnt_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, escapes taken back."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"], s["length"]))), "")


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) of a whole formatted conversation."""

    def read(group: Column) -> Column:
        bare = F.regexp_replace(group, _ENDS, "")
        parts = F.split(bare, r"\[TEXT\]", 2)
        role, body = unescape(F.substr(parts[0], F.lit(len(OTHER[0]) + 1))), F.get(parts, F.lit(1))
        for name, (mark, _) in MARKS.items():
            own = F.startswith(group, F.lit(mark))
            role, body = F.when(own, F.lit(name)).otherwise(role), F.when(own, F.substr(bare, F.lit(len(mark) + 1))).otherwise(body)
        return F.transform(F.split(body, r"\[NEXT\]"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(F.filter(F.split(formatted, _STARTS), lambda x: x != ""), read))


def read_chats(blocks: DataFrame) -> DataFrame:
    """``conv_id, formatted, turns, learnt`` of the rows of ``format_chats``: whole conversations, read back. One has
    to fit in a row (2 GB)."""
    each = blocks.select("conv_id", F.struct("block", "formatted", learnt_text(F.col("formatted"), F.col("loss_spans")).alias("learnt")).alias("b"))
    whole = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("b")).alias("b"))
    joined = whole.select("conv_id", *(F.array_join(f"b.{c}", "").alias(c) for c in ("formatted", "learnt")))
    return joined.select("conv_id", "formatted", turns_of(F.col("formatted")).alias("turns"), "learnt")
