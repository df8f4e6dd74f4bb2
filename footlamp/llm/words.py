"""Word rules shared by the corpus operators.

A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java and RE2 class body of the word separators.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def word_array(text: Column) -> Column:
    """The words in order; an empty array for null, empty and blank texts.

    The ends are trimmed by a character set, in linear time even where white space runs over megabytes.
    """
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, rf"[{SPACE}]+"))


def ascii_lower(text: Column) -> Column:
    """Only A-Z lower-cased."""
    return F.translate(text, UPPER, UPPER.lower())


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, even when ``use`` names it many times or inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def text_key(text: Column) -> Column:
    """A 64-bit key of a whole text, with null told from empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def held_out(doc_id: Column) -> Column:
    """The fixed third of documents that no model learns from: crc32 of the id's digits, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
