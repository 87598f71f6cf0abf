"""Tokens and character n-grams as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"


def tokens(c: Column) -> Column:
    """All [a-z0-9]+ runs of the lower-cased text, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def word_places(c: Column) -> Column:
    """The same runs with their places: one blank between runs that one blank parts, else two.

    The i-th piece between blanks is the word at place i, and an empty piece is a gap. So runs
    at neighbouring places are exactly those that can make a phrase, and a phrase is in the
    text if and only if it is in here.
    """
    return F.regexp_replace(F.lower(c), "[^a-z0-9]{2,}|[^a-z0-9 ]", "  ")


def ngrams(c: Column, n: int) -> Column:
    """Distinct code-point n-grams; an empty array when the text is shorter than n.

    The characters are zipped with shifted slices of themselves. Calling substr once per
    position would walk the UTF-8 bytes from the start each time, quadratic in the length.
    """
    chars = F.split(c, "")
    grams = chars
    for shift in range(1, n):
        later = F.slice(chars, F.lit(shift + 1), F.greatest(F.length(c) - shift, F.lit(0)))
        grams = F.zip_with(grams, later, lambda a, b: F.concat(a, b))
    # zip_with pads the shorter side with null and concat passes the null on.
    return F.array_distinct(F.filter(grams, lambda g: g.isNotNull() & (g != "")))
