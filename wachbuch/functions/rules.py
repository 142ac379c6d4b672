"""Ordered text rules on releases and court texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- fixed values: first match wins, letter case doesn't count ----------------------------------
CATEGORY_RULES = (
    ("Toetungsdelikt", (r"\btot(e|en)?\b", r"leiche", r"t[öo]dlich", r"mordkommission", r"erschossen", r"get[öo]tet")),
    ("Raub", (r"\braub\b", r"raubten", r"überfiel", r"überfielen", r"überfallen", r"ausgeraubt", r"räuber")),
    ("Einbruch", (r"einbruch", r"einbrecher", r"einbrach", r"eingebrochen", r"hebelte.*t[üu]r", r"aufgehebelt")),
    ("Fahrzeugaufbruch", (r"auto(s)? aufgebrochen", r"fahrzeug(e)? aufgebrochen", r"autoaufbrecher")),
    ("Sexualdelikt", (r"sexuelle(n|r)? (n[öo]tigung|bel[äa]stigung|übergriff)", r"vergewaltig", r"exhibitionist")),
    ("Waffendelikt", (r"schusswaffe", r"schuss(abgabe|verletzung)", r"angeschossen", r"mit messer", r"messerverletzung", r"dienstwaffe")),
    ("Hasskriminalitaet", (r"antisemitisch", r"homophob", r"rassistisch", r"sexuelle(n)? orientierung", r"fremdenfeindlich")),
    ("Brandstiftung", (r"brandstiftung", r"brandsätze", r"in brand gesetzt", r"anz[üu]ndete")),
    ("Drogendelikt", (r"marihuana", r"kokain", r"cannabis", r"betäubungsmittel", r"drogendealer", r"drogenfahrt", r"rauschgift")),
    ("Koerperverletzung", (r"k[öo]rperverletzung", r"schlug", r"schlugen", r"attackiert", r"angegriffen", r"verprügelt", r"schlägerei", r"auseinandersetzung")),
    ("Sachbeschaedigung", (r"sachbeschädigung", r"vandalismus", r"graffiti", r"sprayer", r"beschädigt(en)?")),
    ("Diebstahl", (r"diebstahl", r"\bdieb(e)?\b", r"entwendet", r"gestohlen", r"taschendieb")),
    ("Verkehrsunfall", (r"verkehrsunfall", r"kollidiert", r"fahrzeugführer verletzt", r"unfallflucht")),
)
OTHER = "Sonstiges"
#: Categories shown on the map under the catch-all.
FOLDED = ("Verkehrsunfall", "Brandstiftung", "Hasskriminalitaet")
STAGES = (
    ("rechtskraft", r"rechtskraft|rechtskräftig"),
    ("terminaenderung", r"termins?(verschiebung|verlegung|aufhebung|änderung)|verlegung des termins|änderung des beginns|neubeginn|aussetzung|termine\b.*\baufgehoben"),
    ("urteilstermin", r"urteilsverkündung"),
    ("urteil", r"\burteil"),
    ("auftakt", r"auftakt|fortsetzung"),
    ("anklage", r"anklage"),
)
STAGE_RANKS = {"anklage": 0, "auftakt": 1, "urteilstermin": 2, "urteil": 3, "rechtskraft": 4, "sonstiges": -1}
SENTENCE = (
    r"(?iu)lebenslange[n]?\s+(?:Gesamt)?Freiheitsstrafe|Freiheitsstrafe[n]?\s+von\s+\d+\s*Jahren?(?:\s*und\s*\d+\s*Monaten?)?"
    r"|Jugendstrafe\s+von\s+\d+\s*Jahren?(?:\s*und\s*\d+\s*Monaten?)?|Freispruch|freigesprochen"
)
STREET_WORD = r"(?U)\b((?:[A-ZÄÖÜ][a-zäöüß]+\s+)?[A-ZÄÖÜ][A-Za-zäöüßÄÖÜ-]*(?:straße|strasse|weg|platz|allee|damm|ring|chaussee|wall))\b"
# -----------------------------------------------------------------------------------------------


def first_rule(text: Column, rules: tuple[tuple[str, str], ...], other: str, flags: str = "(?iud)") -> Column:
    """The name of the first pattern found in the text; a CASE chain, so later rules aren't tried."""
    out = None
    for name, pattern in rules:
        hit = text.rlike(flags + pattern)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(other))


def category(title: Column, text: Column) -> Column:
    """The offence a release is about. NULL title or text counts as empty."""
    hay = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    return first_rule(hay, tuple((c, "|".join(ps)) for c, ps in CATEGORY_RULES), OTHER)


def shown_category(c: Column) -> Column:
    return F.when(c.isin(*FOLDED) | c.isNull(), F.lit(OTHER)).otherwise(c)


def court_stage(headline: Column) -> Column:
    return first_rule(F.lower(F.coalesce(headline, F.lit(""))), STAGES, "sonstiges")


def outcome(title: Column, text: Column) -> Column:
    """``stage, summary, day`` of a court release: a verdict counts as given only if the text says so."""
    t, x = F.lower(F.coalesce(title, F.lit(""))), F.coalesce(text, F.lit(""))
    given = x.rlike(r"(?iU)\bverurteilt\b|\bfreigesprochen\b")
    summary = F.nullif(F.trim(F.regexp_replace(F.regexp_extract(x, SENTENCE, 0), r"\s+", " ")), F.lit(""))
    p = r"Urteil(?:s)?\s+vom\s+(\d{1,2})\.(\d{1,2})\.(\d{4})"
    day = F.when(F.regexp_extract(x, p, 3) != "", F.concat(F.regexp_extract(x, p, 3), F.lit("-"), F.lpad(F.regexp_extract(x, p, 2), 2, "0"), F.lit("-"), F.lpad(F.regexp_extract(x, p, 1), 2, "0")))
    stage = (
        F.when(t.contains("rechtskraft"), "rechtskraft").when(t.contains("urteil") & given, "urteil").when(t.contains("urteil"), "urteilstermin")
        .when(t.contains("auftakt") | t.contains("fortsetzung"), "auftakt").when(t.contains("anklage"), "anklage").otherwise("sonstiges")
    )
    told = stage.isin("rechtskraft", "urteil", "sonstiges")
    return F.struct(stage.alias("stage"), F.when(told, summary).alias("summary"), F.when(told, day).alias("day"))


def case_key(text: Column) -> Column:
    """``number/yyyy`` of the first file number ``Js n/yy``."""
    p = r"Js\s*(\d+)\s*/\s*(\d{2,4})"
    y = F.regexp_extract(text, p, 2)
    return F.when(F.regexp_extract(text, p, 1) != "", F.concat(F.regexp_extract(text, p, 1), F.lit("/"), F.when(F.length(y) == 4, y).otherwise((y.try_cast("int") + 2000).cast("string"))))


def release_refs(text: Column) -> Column:
    """Distinct ``n/yyyy`` of the releases (``PM n/yy``) a text refers to."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)(PM\s*\d+\s*/\s*\d{2,4})"), F.lit(1))
    n = lambda x: F.regexp_extract(x, r"(\d+)\s*/", 1)
    y = lambda x: F.regexp_extract(x, r"/\s*(\d+)", 1)
    return F.array_distinct(F.transform(found, lambda x: F.concat(n(x), F.lit("/"), F.when(F.length(y(x)) == 2, F.concat(F.lit("20"), y(x))).otherwise(y(x)))))


def street_tokens(text: Column) -> Column:
    """Distinct street-like names of a text, lower case and letters only."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(STREET_WORD), F.lit(1)), lambda x: F.regexp_replace(F.lower(x), r"[^a-zäöüß]", "")))


def age(text: Column) -> Column:
    """The first two-digit age of the first 800 characters."""
    return F.nullif(F.regexp_extract(F.left(text, F.lit(800)), r"(?iu)(\d{2})\s*-?\s*j[äa]hrige[nr]?(?U)\b", 1), F.lit(""))


def headline(text: Column) -> Column:
    """The paragraph behind the one with the release's number, among the first four."""
    paras = F.slice(F.split(text, "\n\n"), 1, 4)
    at = F.array_position(F.transform(paras, lambda p: p.rlike(r"Pressemitteilung\s*Nr\.")), True).cast("int")
    head = F.trim(F.replace(F.try_element_at(F.split(text, "\n\n"), at + 1), F.lit("\n"), F.lit(" ")))
    return F.when((at > 0) & F.length(head).between(10, 200) & ~head.rlike(r"^\d"), head)


def without_imprint(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.element_at(F.split(text, r"\n\s*Verantwortlich\b", 2), 1), r"\s+", " "))


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), r"[^0-9a-z]+", "-"), F.lit("-"))


def fingerprint(c: Column, length: int) -> Column:
    return F.left(F.sha1(c), F.lit(length))


def percent_text(x: Column, digits: int = 0) -> Column:
    """A share as German text: 0.664 -> ``66 %``."""
    return F.concat(F.replace(F.format_string(f"%.{digits}f", x * 100), F.lit("."), F.lit(",")), F.lit(" %"))


def model_note(hit_rate: Column, random_rate: Column, busiest: Column) -> Column:
    """One sentence on how the ranking did, and whether it beats always naming the busiest districts."""
    said = F.concat(F.lit("Trefferquote "), percent_text(hit_rate), F.lit(", zufällig "), percent_text(random_rate), F.lit(", immer die meistgenannten "), percent_text(busiest), F.lit(": "))
    return F.concat(said, F.when(hit_rate > busiest + 0.02, "besser als die einfache Regel.").otherwise("nicht besser als die einfache Regel."))
