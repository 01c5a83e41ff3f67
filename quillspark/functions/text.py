"""Column functions on text: cleaning, tokens, punctuation spacing, line tests, sentences."""

from __future__ import annotations

import re
import string
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A word or one sign; ``(?U)`` so that letters beyond ASCII count as word characters.
TOKEN = r"(?U)\w+|[^\w\s]"
SPACES = r"(?U)\s+"
#: Signs that stand alone in spaced sentences (fixed values).
SIGNS = "[,.;:!?()\\[\\]«»\"'–—]"
#: Phrases of footnotes (fixed values).
FOOTNOTE_PHRASES = ["refers to", "refers here", "i.e.", "i . e .", "see", "See", "cf.", "cf ."]
SENTENCE_END = r"([.!?])\s+"


def strip(text: Column) -> Column:
    """Without white space at both ends (any Unicode white space, unlike ``trim``)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_text(text: Column) -> Column:
    """No ASCII punctuation, single spaces, lower case."""
    bare = F.translate(text, string.punctuation, "")
    return F.lower(F.trim(F.regexp_replace(bare, SPACES, " ")))


@F.pandas_udf(StringType())
def nfkc_clean(text: pd.Series) -> pd.Series:
    """NFKC, no-break and zero-width space to space, no control characters (line ends too), single spaces."""

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        s = unicodedata.normalize("NFKC", s).replace("\xa0", " ").replace("​", " ")
        s = "".join(c for c in s if not unicodedata.category(c).startswith("C"))
        return re.sub(r"[^\S\n]+", " ", s).strip()

    return text.map(one)


def tokens(text: Column) -> Column:
    """Lower-case words and signs."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """Runs between white space."""
    return F.array_remove(F.split(text, SPACES), "")


def format_sentence(text: Column) -> Column:
    """One space on either side of each sign."""
    tight = F.regexp_replace(text, rf"(?U)\s*({SIGNS})\s*", "$1")
    spaced = F.regexp_replace(tight, rf"({SIGNS})", " $1 ")
    return F.trim(F.regexp_replace(spaced, " +", " "))


def is_page_number(text: Column) -> Column:
    return strip(text).rlike(r"^\d+\s*\.?\s*$")


def is_header_fragment(text: Column) -> Column:
    """Short, at most four words, upper case with a cased letter."""
    cased = (F.upper(text) == text) & (F.lower(text) != text)
    return (F.length(text) < 40) & cased & (F.size(words(text)) <= 4)


def is_footnote(text: Column) -> Column:
    """A number, a capitalised word and a phrase that footnotes use."""
    phrase = F.exists(F.array(*map(F.lit, FOOTNOTE_PHRASES)), lambda p: F.contains(text, p))
    return text.rlike(r"^\d{1,3}\s+[A-Z]") & phrase


def sentences(text: Column) -> Column:
    """Array of stripped sentences: a cut after each ``.``, ``!`` or ``?`` with white space."""
    cut = F.split(F.regexp_replace(text, SENTENCE_END, "$1\n"), "\n")
    return F.filter(F.transform(cut, strip), lambda s: s != "")


def chars(text: Column) -> Column:
    """Array of the characters."""
    return F.filter(F.split(text, ""), lambda c: c != "")


# -- embedded headers -----------------------------------------------------------------------------

#: Words after "And" that begin body text, and small words that a header may hold (fixed values).
BODY_STARTS = "then|when|if|while|so|they|the|it|this|there"
HEADER_SMALL = ["The", "A", "An", "And", "Of", "To", "In", "On", "For", "With", "At"]


def header_split(text: Column) -> Column:
    """Array of one or two texts: a title-case header in front is cut off and ends with `` .``.

    A header is four or more title-case words before ``And then`` and the like, or four or more whose first
    three words the rest repeats in any case (two of three suffice)."""
    header = F.regexp_extract(text, rf"^([A-Z][a-z]+(?:\s+[A-Z][a-z]+){{3,}})\s+And\s+(?:{BODY_STARTS})\s+", 1)
    by_pattern = F.array(F.concat(strip(header), F.lit(" .")), strip(F.substr(text, F.length(header) + 1)))
    w = words(text)
    titled = lambda x: x.isin(HEADER_SMALL) | x.rlike(r"(?U)^\p{Lu}[^\p{Lu}]*\p{Ll}[^\p{Lu}]*$")
    # the number of title-case words in front
    n = F.aggregate(w, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + (a["on"] & titled(x)).cast("int")).alias("n"), (a["on"] & titled(x)).alias("on")), lambda a: a["n"])
    same = lambda i: (F.lower(F.get(w, F.lit(i))) == F.lower(F.get(w, n + i))).cast("int")
    repeated = (F.size(w) >= 8) & (n >= 4) & (F.size(w) - n >= 3) & (same(0) + same(1) + same(2) >= 2)
    by_repeat = F.array(F.concat(F.array_join(F.slice(w, F.lit(1), F.greatest(n, F.lit(1))), " "), F.lit(" .")), F.array_join(F.slice(w, n + 1, F.size(w)), " "))
    return F.when(header != "", by_pattern).when(repeated, by_repeat).otherwise(F.array(text))


def first_sentence_repair(text: Column, prefix: str | Column) -> Column:
    """If ``text`` begins with ``prefix`` twice and then " who": the prefix as a sentence, and the rest."""
    front = F.lit(prefix) if isinstance(prefix, str) else prefix
    double = F.startswith(text, F.concat(front, F.lit(" "), front, F.lit(" who")))
    return F.when(double, F.array(F.concat(front, F.lit(" .")), F.substr(text, F.length(front) + 2))).otherwise(F.array(text))
