"""String expressions: white space, case, numbers, language, HTML and percent coding.

Every function takes and returns Columns, so all of it stays inside the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of the citation grammar and of term splitting (the ECMAScript
# set), which Java's \s does not cover, and the code points taken as Chinese.
WS = (
    "[\\t-\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
)
CJK = "[\\u3400-\\u9FFF\\uF900-\\uFAFF]"

# Largest number a citation part can be, that of an INT column.
MAX_NUMBER = 2_147_483_647
# Stands for a larger number: no chapter or verse has it.
NO_NUMBER = -1

# Unicode noncharacters, reserved for internal use, so they cannot be part of valid text.
MARK_OPEN = "﷐"
MARK_CLOSE = "﷑"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c: Column | str) -> Column:
    """Strip leading and trailing white space (the WS set, not only blanks)."""
    return F.regexp_replace(_col(c), f"^{WS}+|{WS}+\\z", "")


def drop_ws(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"{WS}+", "")


def split_ws(c: Column | str) -> Column:
    """Whitespace-separated parts, without empty ones."""
    return F.filter(F.split(_col(c), f"{WS}+"), lambda p: p != "")


def present(c: Column | str) -> Column:
    """Text with the empty string read as missing."""
    return F.nullif(_col(c), F.lit(""))


def has_cjk(c: Column | str) -> Column:
    return _col(c).rlike(CJK)


def language_of(c: Column | str) -> Column:
    return F.when(has_cjk(c), "cn").otherwise("en")


def normalise_name(c: Column | str) -> Column:
    """Book name key: lower case, without dots and white space."""
    return F.regexp_replace(F.lower(_col(c)), f"\\.|{WS}+", "")


def number_of(digits: Column | str, beyond: int = NO_NUMBER) -> Column:
    """Digit string to INT; null stays null, and what an INT can't hold is ``beyond``.

    A plain try_cast would turn an overlong verse into NULL, which means "whole chapter".
    """
    significant = F.regexp_replace(_col(digits), "^0+(?=[0-9])", "")
    too_long = F.length(significant) > 10
    number = F.when(~too_long, significant.try_cast("long"))
    return F.when(too_long | (number > MAX_NUMBER), F.lit(beyond)).otherwise(number.try_cast("int"))


def escape_html(c: Column | str) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
    return reduce(lambda s, p: F.replace(s, F.lit(p[0]), F.lit(p[1])), pairs, _col(c))


def quote_regex(c: Column | str) -> Column:
    """Make a string match itself in a Java pattern."""
    inner = F.replace(_col(c), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("\\Q"), inner, F.lit("\\E"))


def caseless_regex(c: Column | str) -> Column:
    """A Java pattern that matches a string without regard to case, under (?iu).

    ASCII letters fold among themselves only, and the four other letters that Unicode folds to
    ASCII ones (I with dot, dotless i, long s, Kelvin sign) match just themselves.
    """
    quoted = F.regexp_replace(_col(c), "([\\x00-\\x7F&&[^A-Za-z0-9]])", "\\\\$1")
    ascii_ = F.regexp_replace(quoted, "[\\x00-\\x7F]+", "(?-u:$0)")
    return F.regexp_replace(ascii_, "[\\u0130\\u0131\\u017F\\u212A]+", "(?-iu:$0)")


def percent_encode(c: Column | str) -> Column:
    """URI component encoding: blanks as %20 and ! ' ( ) ~ left bare."""
    pairs = [
        ("+", "%20"),
        ("%21", "!"),
        ("%27", "'"),
        ("%28", "("),
        ("%29", ")"),
        ("%7E", "~"),
    ]
    start = F.url_encode(_col(c))
    return reduce(lambda s, p: F.replace(s, F.lit(p[0]), F.lit(p[1])), pairs, start)


def percent_decode(c: Column | str) -> Column:
    """URI component decoding; '+' stays '+', malformed input gives NULL."""
    raw = _col(c)
    out = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    # The decoder writes U+FFFD for bytes that are not UTF-8; only text that really
    # holds that character may come back with it.
    honest = raw.contains("�") | F.upper(raw).contains("%EF%BF%BD")
    return F.when(~out.contains("�") | honest, out)


def utf16_length(c: Column | str) -> Column:
    """Length in UTF-16 units, the unit of the minimum query length."""
    return F.length(F.regexp_replace(_col(c), "[\\x{10000}-\\x{10FFFF}]", ".."))
