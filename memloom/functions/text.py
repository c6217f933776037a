"""Text and key expressions shared by the operators (all of them JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """The text without surrounding white space."""
    return F.btrim(c, F.lit(WHITESPACE))


def key(c: Column) -> Column:
    """Ids and keys compare trimmed and in lower case; a blank key is no key."""
    k = F.lower(strip(c.cast("string")))
    return F.when(k != "", k)


def squeeze(c: Column) -> Column:
    """Runs of white space become one space, outer ones go."""
    return strip(F.regexp_replace(c, "[\\p{IsWhite_Space}\\x1c-\\x1f]+", " "))


def is_blank(c: Column) -> Column:
    """Null, empty or only white space."""
    return F.coalesce(strip(c) == "", F.lit(True))


def is_visible(c: Column) -> Column:
    """Has a character that is no white space, control or zero-width (format) character."""
    return F.coalesce(c.rlike("[^\\p{IsWhite_Space}\\p{Cc}\\p{Cf}]"), F.lit(False))


def digest(c: Column) -> Column:
    """16 bytes that stand for a text wherever only equality matters; null stays null."""
    return F.unhex(F.md5(c))


def instant(c: Column) -> Column:
    """Microseconds since the epoch of an ISO text or a timestamp; unreadable is null."""
    return F.unix_micros(c.try_cast("timestamp"))
