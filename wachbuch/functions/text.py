"""Column expressions on strings that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that counts as spacing, also the ones Java's ``\s`` leaves out.
SPACING = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
#: A character that isn't plainly something else than spacing. A negated class of few ranges is many times faster than a
#: list of all spacing.
_DOUBTFUL = r"[^ -~\x{a1}-\x{167f}\x{2010}-\x{2027}]"


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def squeeze(c: Column) -> Column:
    """Runs of spacing become one blank, none is left at the ends. Most texts are even, and a look is cheaper than a rewrite."""
    return let(c, lambda x: F.trim(F.when(x.contains("  ") | x.rlike(_DOUBTFUL), F.regexp_replace(x, SPACING, " ")).otherwise(x)))


def filled(c: Column) -> Column:
    """``squeeze``, with the empty string read as missing."""
    return F.nullif(squeeze(c), F.lit(""))


def release_number(pm_id: Column) -> Column:
    """The number a ``pm_id`` stands for: blanks, leading zeros and a trailing ``.0`` don't count.

    NULL for anything that isn't such a number.
    """
    s = F.regexp_extract(squeeze(pm_id), r"^0*(\d{1,18})(?:\.0*)?$", 1)
    # no digits give NULL
    return s.try_cast("long")


def page_number(url: Column) -> Column:
    """The number that ends the path of a page address, without query, fragment and slash."""
    path = F.rtrim(F.substring_index(F.substring_index(squeeze(url), "?", 1), "#", 1), F.lit("/"))
    s = F.regexp_extract(F.right(path, F.lit(18)), r"(\d+)$", 1)
    # no digits give NULL
    return s.try_cast("long")
