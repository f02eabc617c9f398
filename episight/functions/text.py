"""Text figures of instruction and response pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: openers that say nothing, at the start of a response.
BOILERPLATE = (
    r"(?i)^(sure,?\s+here(?:'s| is| are)\b|of course[,!]|certainly[,!]|as an ai\b|i'?d be happy to\b|great[,!]\s+here\b"
    r"|absolutely[,!]|thanks for asking\b|no problem[,!]|i\s+hope\s+this\s+helps\b|hello[,!]|hi[,!]\s+there\b)"
)


def words(text: Column) -> Column:
    """The words of a text; white space at its ends is cut off first, so that no word is empty."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\s+"))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def repetition_of(w: Column) -> Column:
    """1 - distinct over all pairs of a word array; 0 below 4 words.  ``w`` is read several times and should be a column of its own."""
    pairs = F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(w) < 4, F.lit(0.0)).otherwise(1.0 - F.size(F.array_distinct(pairs)) / (F.size(w) - 1))


def repetition(text: Column) -> Column:
    """``repetition_of`` the lower-cased words."""
    return repetition_of(words(F.lower(text)))


def template_share(text: Column) -> Column:
    """Words of a boilerplate opener over all words."""
    t = F.trim(F.coalesce(text, F.lit("")))
    opener = F.regexp_extract(t, BOILERPLATE, 1)
    return F.when(opener == "", F.lit(0.0)).otherwise(word_count(opener) / F.greatest(word_count(t), F.lit(1)))
