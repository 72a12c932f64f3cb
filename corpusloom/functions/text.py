"""Column builders for text: normalisation, words, n-grams, shingles, tokens."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of Unicode white space, no-break spaces too.
SPACE = r"(?U)\s+"
#: English stop words of the retrieval index: a fixed list.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row; a lambda would otherwise compute an outer expression for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalised(text: Column) -> Column:
    """Lower case, white space collapsed to one blank, trimmed; null stays null."""
    return F.trim(F.regexp_replace(F.lower(text), SPACE, " "))


def words(text: Column) -> Column:
    """The words of the normalised text; the empty text has none."""
    return let(normalised(text), lambda n: F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " ")))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def shingles(text: Column, k: int = 5) -> Column:
    """The distinct word k-grams; a text of fewer words is one shingle as a whole, and the empty text is the shingle ''."""
    def grams(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(F.size(w) < k, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(each))

    return let(F.split(normalised(text), " "), grams)


def tokens(text: Column) -> Column:
    """Lower-case runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)


def without_accents(text: Column) -> Column:
    """Text without combining marks after canonical decomposition; needs an Arrow function, as no built-in decomposes."""
    @F.pandas_udf("string")
    def strip(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKD").str.replace(r"[̀-ͯ]", "", regex=True)

    return strip(text)


def with_bigrams(toks: Column) -> Column:
    """Tokens and pairs of neighbours joined by a blank."""
    def pairs(t: Column) -> Column:
        two = F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: F.concat(F.element_at(t, i), F.lit(" "), F.element_at(t, (i + 1).cast("int"))))
        return F.concat(t, F.when(F.size(t) >= 2, two).otherwise(F.array().cast("array<string>")))

    return let(toks, pairs)


def content_id(text: Column) -> Column:
    """The first 16 hex digits of the SHA-1 of the UTF-8 text."""
    return F.substring(F.sha1(text), 1, 16)


def clipped(text: Column, n: int = 300) -> Column:
    """The first n code points, for display."""
    return F.substring(text.cast("string"), 1, n)
