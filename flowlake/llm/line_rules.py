"""Line-first quality rules: clean a document line by line, then judge what is left.

Each line is tested alone. A line fails if it is navigation (several short items between
bars), a boilerplate line, does not begin a sentence or end one and is short, or is mostly
symbols. Failing lines are removed; a document is rejected once the removed words exceed a
share of all its words.

Null and empty texts: no words, all counts 0, cleaned text empty, rejected by ``min_words``.
Repeated rows each get their own result; nulls in other columns pass through; only the text
column is read, and new columns replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import once, words_of

SYMBOLS = r"[#*$%&|<>]"
BOILERPLATE = (
    "all rights reserved",
    "terms of service",
    "terms of use",
    "privacy policy",
    "cookie policy",
    "accept cookies",
    "enable javascript",
    "click here",
    "sign up for our newsletter",
    "subscribe to our newsletter",
)
RESULT = "array<struct<words:int,chars:bigint,repeats:bigint>>"


def word_chars(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.char_length(w))


def repeat_words(words: Column) -> Column:
    """Word positions that lie in some 3-word window found at least twice (first included).

    Windows are told apart by 64-bit hashes. Sorting them beside their positions finds the
    repeated ones in O(n log n); the covered positions are the gaps, cut at three, between
    consecutive starts.
    """
    zero = F.lit(0).cast("long")

    def covered(starts: Column) -> Column:
        gaps = F.zip_with(
            starts,
            F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(1))),
            lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))),
        )
        return F.aggregate(gaps, zero, lambda a, g: a + g)

    def repeated(marks: Column) -> Column:
        at = lambda i: marks[i]["h"]
        last = F.size(marks) - 1
        kept = F.filter(
            marks,
            lambda m, i: F.when(i > 0, at(F.greatest(i - 1, F.lit(0))) == m["h"]).otherwise(F.lit(False))
            | F.when(i < last, at(F.least(i + 1, last)) == m["h"]).otherwise(F.lit(False)),
        )
        return once(F.sort_array(F.transform(kept, lambda m: m["p"])), covered)

    def windows(words: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(1), F.size(words) - 2),
            lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)),
        )
        return once(
            hashes,
            lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), zero).otherwise(
                once(F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("p")))), repeated)
            ),
        )

    return F.when(F.size(words) < 4, zero).otherwise(windows(words))


def word_facts(text: Column) -> Column:
    """struct(words, chars, repeats) of a text, its words split once."""
    return once(
        words_of(text),
        lambda w: F.struct(F.size(w).cast("long").alias("words"), word_chars(w).alias("chars"), repeat_words(w).alias("repeats")),
    )


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def line_fails(line: Column) -> Column:
    """True for a line that navigation, boilerplate, punctuation or symbol rules remove."""
    low, letters = F.lower(line), F.regexp_replace(line, r"[^\p{L}]", "")
    navigation = F.regexp_count(line, F.lit(r"[|>»•·]")) >= 3
    boilerplate = F.lit(False)
    for phrase in BOILERPLATE:
        boilerplate = boilerplate | low.contains(phrase)
    shouting = (F.char_length(letters) >= 20) & (letters == F.upper(letters))
    symbols = F.regexp_count(line, F.lit(SYMBOLS + r"|!!")) * 10 > F.char_length(line)
    unfinished = ~line.rlike(r"[.!?…:;\"'”»)\]][\x20\x09-\x0D]*$") & (F.char_length(F.btrim(line)) < 20)
    return navigation | boilerplate | shouting | symbols | unfinished


def judge(
    df: DataFrame,
    text: str = "text",
    min_words: int = 50,
    max_repeat_pct: int = 50,
    max_lost_pct: int = 50,
) -> DataFrame:
    """Add word figures, ``clean_text``, ``n_lines_removed``, ``lost_words``, ``base_failed`` and ``kept``."""
    col = F.col(text)
    lines = lines_with_words(col)
    duplicates = once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    kept_lines = F.filter(lines, lambda x: ~line_fails(x))
    n_repeat = F.col("_facts.repeats")
    return (
        df.withColumn("_facts", word_facts(col))
        .withColumn("clean_text", F.array_join(kept_lines, "\n"))
        .withColumns(
            {
                "n_words": F.col("_facts.words"),
                "word_chars": F.col("_facts.chars"),
                "n_symbols": F.coalesce(F.regexp_count(col, F.lit(SYMBOLS)), F.lit(0)).cast("long"),
                "n_dup_lines": duplicates.cast("long"),
                "n_repeat_words": n_repeat,
                "n_lines_removed": (F.size(lines) - F.size(F.split("clean_text", "\n")) + F.when(F.col("clean_text") == "", 1).otherwise(0)).cast("long"),
                "lost_words": F.col("_facts.words") - F.size(words_of(F.col("clean_text"))),
            }
        )
        .withColumn("base_failed", (F.col("n_words") < min_words) | (100 * n_repeat > max_repeat_pct * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_words") <= max_lost_pct * F.col("n_words")))
        .drop("_facts")
    )
