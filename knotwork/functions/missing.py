"""Missing values: null, blank, or a word or sign that stands for "no value"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words and signs that stand for "no value", lower case.
NO_VALUE = ["", "nan", "none", "na", "n/a", "-", "null"]

# Characters without width, and spaces other than U+0020.
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
WIDE_SPACES = "\u00a0\u2007\u202f\u2009\u3000\t\r\n"
# Full-width forms U+FF01..U+FF5E stand for U+0021..U+007E.
_FULL = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
_HALF = "".join(chr(c) for c in range(0x21, 0x7F))
TRANSLATE_FROM = _FULL + WIDE_SPACES + ZERO_WIDTH
TRANSLATE_TO = _HALF + " " * len(WIDE_SPACES)


def plain(col: Column) -> Column:
    """Half-width characters, one kind of space, no zero-width marks, trimmed."""
    return F.trim(F.translate(col, TRANSLATE_FROM, TRANSLATE_TO))


_BLANKS = rf"[\s{WIDE_SPACES}{ZERO_WIDTH}]*"
MISSING = rf"^(?i){_BLANKS}(?:nan|none|na|n/a|-|null)?{_BLANKS}$"


def is_missing(col: Column) -> Column:
    """True for null, blank and the words of NO_VALUE, in any case."""
    return col.isNull() | col.rlike(MISSING)


def or_null(col: Column) -> Column:
    """The value, null where it is missing."""
    return F.when(~is_missing(col), col)
