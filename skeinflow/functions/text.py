"""Column functions on text that stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space at the ends of identifiers and in blank texts.
WHITESPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trimmed(col: Column) -> Column:
    """``col`` without surrounding white space of any kind."""
    return F.trim(col, F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    """True for null and for texts of nothing but white space, no-break spaces included."""
    return F.coalesce(trimmed(col) == "", F.lit(True))


def name_fold(col: Column) -> Column:
    """Lower case with surplus blanks (leading, trailing, repeated) removed."""
    return F.lower(trimmed(F.regexp_replace(col, r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " ")))
