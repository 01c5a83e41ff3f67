"""Quality rules as a bitmask ledger (operator 9), in DataFrame functions only.

``ledger`` evaluates every rule once per row and stores the measurements and one failure bit per rule.
``apply_policy`` keeps rows whose failure bits miss a versioned policy's mask, so a policy change never
re-reads text. ``ablations`` counts, from the bits alone, what each rule of a policy removes on its own.

Defined results: a null or empty text has no words and fails ``few_words``; repeated rows are judged alike;
empty tables give empty results; other input columns pass through (``ledger`` columns of the same name
are replaced).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import SPACE_CLASS, SPACES, fresh, scratch_table

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Rules in bit order: a name and the condition under which a row fails.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("many_symbols", "n_symbols > 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Versioned policies: the rules that remove a row.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "many_symbols", "long_words"),
    "strict": tuple(BIT),
}


def policy_mask(policy: str) -> int:
    return reduce(lambda mask, rule: mask | BIT[rule], POLICIES[policy], 0)


def _covered(starts: Column) -> Column:
    """Words covered by windows of ``WINDOW`` words at the ascending ``starts``."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda acc, s: F.struct((acc["n"] + F.least(F.lit(WINDOW), s - acc["last"])).alias("n"), s.alias("last"))
    return F.aggregate(starts, zero, step, lambda acc: acc["n"])


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and ``failure_bits`` for every row, from one reading of the text."""
    kept = [c for c in docs.columns if c.lower() not in {*MEASURES, "failure_bits"}]
    q_words, q_lines, q_windows, q_sorted = fresh(docs.columns, "_words", "_lines", "_windows", "_sorted")
    body = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACES))
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    n = F.size(q_words)
    df = docs.select(
        *kept,
        F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE_CLASS + "+")).alias(q_words),
        lines.alias(q_lines),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    # each window of five words is hashed once; only rows that repeat a window go on to sort them
    windows = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(q_words, i, WINDOW)))
    df = df.select(
        *kept,
        "n_symbols",
        n.cast("long").alias("n_words"),
        F.length(F.array_join(q_words, "")).cast("long").alias("word_chars"),
        F.size(q_lines).cast("long").alias("n_lines"),
        (F.size(q_lines) - F.size(F.array_distinct(q_lines))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias(q_windows),
    )
    repeats = F.size(F.array_distinct(q_windows)) < F.size(q_windows)
    at = F.transform(q_windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn(q_sorted, F.when(repeats, F.array_sort(at)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop(q_windows)
    again = lambda x, k: (F.get(q_sorted, k - 1)["h"] == x["h"]) | (F.get(q_sorted, k + 1)["h"] == x["h"])
    starts = F.array_sort(F.transform(F.filter(q_sorted, again), lambda x: x["i"]))
    df = df.withColumn("n_repeat_words", _covered(starts)).drop(q_sorted)
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, rule) in enumerate(RULES)))
    return df.select(*kept, *MEASURES, bits.alias("failure_bits"))


def stored_ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger of ids, measurements and bits as a written table: policies and ablations read this alone."""
    return scratch_table(ledger(docs.select(doc_id, text), text).drop(text), "quality-ledger")


def apply_policy(ledger_df: DataFrame, policy: str = "v1") -> DataFrame:
    """Add ``kept``: no failure bit of the policy is set."""
    return ledger_df.withColumn("kept", F.col("failure_bits").bitwiseAND(F.lit(policy_mask(policy))) == 0)


def ablations(ledger_df: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of the policy: rows it fails, rows only it removes, and rows kept if it were dropped.

    Rows are first counted per distinct bit pattern (at most 2 ** number of rules), so the rest works on
    a handful of rows whatever the size of the ledger."""
    mask = policy_mask(policy)
    patterns = ledger_df.groupBy(F.col("failure_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in POLICIES[policy]))
    each = patterns.select("bits", "n", F.inline(rules))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return each.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_only"),
        total((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("n_kept_without"),
    )
