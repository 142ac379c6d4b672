"""Districts that a place line names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- fixed values ------------------------------------------------------------------------------
DISTRICTS = (
    "Mitte", "Östliche Vorstadt", "Findorff", "Walle", "Gröpelingen", "Häfen", "Vegesack", "Burglesum", "Blumenthal",
    "Schwachhausen", "Vahr", "Horn-Lehe", "Oberneuland", "Osterholz", "Hemelingen", "Woltmershausen", "Huchting",
    "Obervieland", "Neustadt", "Borgfeld", "Blockland", "Seehausen", "Strom",
)
QUARTERS = {
    "Mitte": ("Altstadt", "Bahnhofsvorstadt", "Ostertor"),
    "Häfen": ("Industriehäfen", "Neustädter Hafen", "Hohentorshafen"),
    "Neustadt": ("Alte Neustadt", "Hohentor", "Südervorstadt", "Gartenstadt Süd", "Buntentor", "Neuenland", "Huckelriede"),
    "Obervieland": ("Habenhausen", "Arsten", "Kattenturm", "Kattenesch"),
    "Huchting": ("Mittelshuchting", "Sodenmatt", "Kirchhuchting", "Grolland"),
    "Woltmershausen": ("Rablinghausen",),
    "Östliche Vorstadt": ("Steintor", "Fesenfeld", "Peterswerder", "Hulsberg"),
    "Schwachhausen": ("Neu-Schwachhausen", "Bürgerpark", "Barkhof", "Riensberg", "Radio Bremen", "Gete"),
    "Vahr": ("Gartenstadt Vahr", "Neue Vahr Nord", "Neue Vahr Südwest", "Neue Vahr Südost", "Neue Vahr"),
    "Horn-Lehe": ("Horn", "Lehe", "Lehesterdeich"),
    "Osterholz": ("Ellener Feld", "Ellenerbrok-Schevemoor", "Tenever", "Blockdiek"),
    "Hemelingen": ("Sebaldsbrück", "Hastedt", "Arbergen", "Mahndorf"),
    "Findorff": ("Regensburger Straße", "Findorff-Bürgerweide", "Bürgerweide", "Weidedamm", "In den Hufen"),
    "Walle": ("Utbremen", "Steffensweg", "Westend", "Osterfeuerberg", "Hohweg", "Überseestadt"),
    "Gröpelingen": ("Lindenhof", "Ohlenhof", "In den Wischen", "Oslebshausen"),
    "Burglesum": ("Burg-Grambke", "Werderland", "Burgdamm", "Lesum", "St. Magnus"),
    "Vegesack": ("Grohn", "Schönebeck", "Aumund-Hammersbeck", "Fähr-Lobbendorf"),
    "Blumenthal": ("Rönnebeck", "Lüssum-Bockhorn", "Farge", "Rekum"),
}
SPELLINGS = {"innenstadt": "Mitte", "ueberseestadt": "Walle", "sebaldsbrueck": "Hemelingen"}
LANDMARKS = {
    "weserstadion": "Östliche Vorstadt", "innenstadt": "Mitte", "altstadt": "Mitte", "ueberseestadt": "Walle",
    "überseestadt": "Walle", "arsten": "Obervieland", "kattenturm": "Obervieland", "huckelriede": "Neustadt",
    "steintor": "Östliche Vorstadt", "sebaldsbrueck": "Hemelingen", "sebaldsbrück": "Hemelingen",
}
# -----------------------------------------------------------------------------------------------

_PLACES = {d.lower(): d for d in DISTRICTS} | {q.lower(): d for d, qs in QUARTERS.items() for q in qs} | SPELLINGS
_BY_LENGTH = "|".join(re.escape(d) for d in sorted(DISTRICTS, key=lambda d: (-len(d), d)))
_NONE = "cast(array() as array<string>)"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def place(name: Column) -> Column:
    """The district that a name is, or that the quarter of that name lies in; else NULL."""
    return F.try_element_at(_map(_PLACES), F.lower(F.trim(name)))


def other_city(line: Column) -> Column:
    """Whether a line names the neighbouring city (a street named after it doesn't)."""
    return F.coalesce(line.rlike(r"Bremerhaven(?!er)"), F.lit(False))


def quarter(line: Column) -> Column:
    """What follows ``OT``, up to a comma or the end."""
    return F.nullif(F.trim(F.regexp_extract(line, r"OT\s+([A-Za-zÄÖÜäöüß/\s.-]+?)(?:,|$)", 1)), F.lit(""))


def _compound(parts: Column) -> Column:
    """The districts of all parts, if every part is a place."""
    found = F.transform(parts, place)
    return F.when(F.forall(found, lambda x: x.isNotNull()), F.array_distinct(found))


def canonical(raw: Column) -> Column:
    """Districts (array, maybe empty) of one mention: the name itself, what stands before OT, a hyphenated
    compound of places, a quarter, or the only district whose name occurs in it."""
    name = F.trim(raw)
    before = F.trim(F.regexp_extract(name, r"(?i)^(.+?)\s+OT\s+", 1))
    parts = F.split(name, "-")
    inside = F.filter(F.array(*[F.lit(d) for d in DISTRICTS]), lambda d: F.lower(name).contains(F.lower(d)))
    known = [F.lit(d) for d in DISTRICTS]
    return (
        F.when(name.isin(*DISTRICTS), F.array(name))
        .when(F.array_contains(F.array(*known), before), F.array(before))
        .when((F.size(parts) > 1) & _compound(parts).isNotNull(), _compound(parts))
        .when(place(name).isNotNull(), F.array(place(name)))
        .when(F.size(inside) == 1, inside)
        .otherwise(F.expr(_NONE))
    )


def mentions(line: Column) -> Column:
    """District mentions as written: behind the city's name and a hyphen, or in looser spellings where a
    known district follows, unless it lies within a mention found before."""
    strict = F.regexp_extract_all(line, F.lit(r"Bremen-([A-Za-zÄÖÜäöüß/\s.-]+?)(?:,|$)"), F.lit(1))
    strict = F.filter(F.transform(F.flatten(F.transform(strict, lambda m: F.split(m, "/"))), lambda m: F.trim(m)), lambda m: F.length(m) > 0)
    loose = F.regexp_extract_all(line, F.lit(r"(?:Bremen|Bemen)\s*(?:[-–]\s*|,\s*|\s+)(" + _BY_LENGTH + r")(?=\s*(?:,|/|$|-?\s*OT\b))"), F.lit(1))
    return F.aggregate(loose, strict, lambda acc, m: F.when(F.exists(acc, lambda f: f.contains(m)), acc).otherwise(F.concat(acc, F.array(m))))


def named_parts(line: Column) -> Column:
    """Districts named by whole comma-separated parts of a line that starts with the city."""
    prefix = r"(?i)^(?:Bremen|Bemen)\s*(?:[-–]\s*(?:Nord|West|Süd|Ost)\b)?\s*[-–]?\s*"
    parts = F.transform(F.split(line, ","), lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), prefix, ""), r"(?i)^OT[\s-]*", ""))
    pieces = F.flatten(F.transform(parts, lambda p: F.split(p, r"\s+und\s+|/")))
    found = F.transform(pieces, lambda p: F.when(place(p).isNotNull(), F.array(place(p))).otherwise(F.coalesce(_compound(F.split(p, "-")), F.expr(_NONE))))
    starts = line.rlike(r"^\s*(?:Bremen|Bemen)\b(?!haven)")
    return F.when(starts, F.array_distinct(F.flatten(found))).otherwise(F.expr(_NONE))


def districts_of(line: Column) -> Column:
    """The districts a line names, in the order named; empty for NULL, other places and the other city."""
    text = F.coalesce(line, F.lit(""))
    first = F.array_distinct(F.flatten(F.transform(mentions(text), canonical)))
    return F.when(other_city(text), F.expr(_NONE)).when(F.size(first) > 0, first).otherwise(named_parts(text))


def district_in_text(text: Column) -> Column:
    """The first district (by name) that stands in running text as a whole word, else that of a landmark."""
    out = None
    for d in sorted(DISTRICTS):
        hit = text.rlike(r"(?U)\b" + re.escape(d) + r"\b")
        out = F.when(hit, F.lit(d)) if out is None else out.when(hit, F.lit(d))
    for mark, d in LANDMARKS.items():
        out = out.when(F.lower(text).contains(mark), F.lit(d))
    return out


def street(line: Column) -> Column:
    """The street behind ``OT <quarter>,``; NULL where only the city stands there."""
    s = F.trim(F.regexp_extract(line, r"OT\s+[^,]+,\s*(.+)$", 1))
    return F.when((F.length(s) > 0) & ~F.lower(s).isin("bremen", "stadtgebiet"), s)
