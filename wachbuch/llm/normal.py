"""Spellings of German text brought to one form, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wachbuch.functions.text import let, squeeze

#: Letters whose UTF-8 bytes were read as a Western code page.
MANGLED = {
    "Ã¤": "ä", "Ã¶": "ö", "Ã¼": "ü", "Ã„": "Ä", "Ã\x84": "Ä", "Ã–": "Ö", "Ã\x96": "Ö", "Ãœ": "Ü", "Ã\x9c": "Ü", "ÃŸ": "ß", "Ã\x9f": "ß",
    "Ã©": "é", "â€“": "–", "â\x80\x93": "–", "â€ž": "„", "â€œ": "“", "â€¦": "…", "â\x80¦": "…",
}


def unmangle(c: Column) -> Column:
    """Most texts have none of the letters that mangled ones begin with, so these are looked for first."""

    def mend(x: Column) -> Column:
        y = x
        for bad, good in MANGLED.items():
            y = F.replace(y, F.lit(bad), F.lit(good))
        return F.when(x.rlike("[Ãâ]"), y).otherwise(x)

    return let(c, mend)


def fold(c: Column) -> Column:
    """Lower case, umlauts and their transcriptions as two letters, spacing squeezed."""
    return fold_letters(F.lower(squeeze(c)))


def fold_letters(c: Column) -> Column:
    """Umlauts and sharp s of a lower-case string as two letters."""
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def collapse(c: Column) -> Column:
    """Two-letter umlauts and double s of a folded string as one letter."""
    for a, b in (("ae", "a"), ("oe", "o"), ("ue", "u")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, "ss+", "s")


def plain(c: Column) -> Column:
    """Lower case, umlauts as their base letter (but transcriptions as written), spacing squeezed."""
    return plain_letters(F.lower(squeeze(c)))


def plain_letters(c: Column) -> Column:
    """Umlauts of a lower-case string as their base letter, sharp s as two letters."""
    for a, b in (("ä", "a"), ("ö", "o"), ("ü", "u"), ("ß", "ss")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def words(c: Column) -> Column:
    """The words and numbers of a folded text."""
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
