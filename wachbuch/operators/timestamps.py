"""Mixed timestamp formats and zones to one unambiguous form.

``normalize`` reads a raw string column by a list of formats, and resolves local times by an
as-of join to zone-offset intervals that are exploded by year: two matching intervals mean an
ambiguous wall time (the earlier instant is taken), none a skipped one (the offset in force
before the change is taken), one gives the offset directly. The interval table has one row per
zone and year of 1900 to 2199, so its size has a fixed bound and it is broadcast.

Defined results: NULL, empty, unreadable or impossible values (31.02., 25 o'clock, a three-digit
year, a month without a day) give ``status = 'unreadable'`` and no instant; a value without time of
day gives ``status = 'day'``. Repeated rows are kept, other columns pass through unchanged.
"""

from __future__ import annotations

import datetime as dt
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wachbuch.functions.text import squeeze

CITY_ZONE = "Europe/Berlin"
FIRST_YEAR, LAST_YEAR = 1900, 2199
FAR = 1 << 60

#: Names of months and the zone abbreviations in use.
MONTHS = {
    "januar": 1, "jänner": 1, "jan": 1, "january": 1, "februar": 2, "feb": 2, "february": 2,
    "märz": 3, "maerz": 3, "mrz": 3, "mar": 3, "march": 3, "april": 4, "apr": 4, "mai": 5, "may": 5,
    "juni": 6, "jun": 6, "june": 6, "juli": 7, "jul": 7, "july": 7, "august": 8, "aug": 8,
    "september": 9, "sep": 9, "sept": 9, "oktober": 10, "okt": 10, "oct": 10, "october": 10,
    "november": 11, "nov": 11, "dezember": 12, "dez": 12, "dec": 12, "december": 12,
}
ABBREVIATIONS = {"Z": 0, "UTC": 0, "GMT": 0, "MEZ": 3600, "CET": 3600, "MESZ": 7200, "CEST": 7200}

_ZONE = r"\(?(Z|UTC|GMT|MESZ|MEZ|CEST|CET|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Z][a-z]+/[A-Za-z_]+)?\)?"
#: A German clock with an optional end of a span.
_CLOCK = (
    r"(?:,? ?(?:um |gegen |ca\. ?|zwischen |von |ab |seit )?"
    r"(\d{1,2})(?:[.:](\d{2})(?:[.:](\d{2})(?:[.,]\d+)?)?(?: ?Uhr)?| ?Uhr(?: (\d{2}))?|(?= ?(?:bis|und|-|–) ?\d))"
    r"(?: ?(?:bis|und|-|–) ?\d{1,2}(?:[.:]\d{2})?(?: ?Uhr)?)? ?" + _ZONE + r")?"
)
#: name -> (pattern, the groups of year, month, day, hour, minute, second, half of the day, zone)
_ISO_CLOCK = r"(\d{2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?"
FORMATS: dict[str, tuple[str, tuple[int, ...]]] = {
    "dotted": (r"^\(?(\d{1,2})\. ?(\d{1,2})\. ?(\d{4}|\d{2})(?!\d)" + _CLOCK + r"\)?$", (3, 2, 1, 4, 5, 6, 0, 8)),
    "named": (r"^(\d{1,2})\. ?(\p{L}+)\.? (\d{4}|\d{2})(?!\d)" + _CLOCK + r"$", (3, 2, 1, 4, 5, 6, 0, 8)),
    "iso": (r"^(\d{4})-(\d{2})-(\d{2})(?:[T ]" + _ISO_CLOCK + r" ?" + _ZONE + r")?$", (1, 2, 3, 4, 5, 6, 0, 7)),
    "basic": (r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})?" + _ZONE + r"$", (1, 2, 3, 4, 5, 6, 0, 7)),
    "mail": (r"^(\d{1,2}) (\p{L}+) (\d{4}) " + _ISO_CLOCK + r" ?" + _ZONE + r"$", (3, 2, 1, 4, 5, 6, 0, 7)),
    "us": (r"^(\p{L}+)\.? (\d{1,2}), (\d{4})(?:,? (\d{1,2}):(\d{2})(?::(\d{2}))? ?([AaPp])\.?[Mm]\.? ?" + _ZONE + r")?$", (3, 1, 2, 4, 5, 6, 7, 8)),
}
_EPOCH = r"^(\d{10})(\d{3})?$"
_WEEKDAY = r"^(?:(?:Mon|Diens|Donners|Frei|Sams|Sonn)tag|Mittwoch|Sonnabend|Mo|Di|Mi|Do|Fr|Sa|So|Mon|Tue|Wed|Thu|Fri|Sat|Sun)\.?, ?"


@lru_cache(maxsize=64)
def _transitions(zone: str) -> tuple[tuple[int, int], ...]:
    """(first second in UTC, offset in seconds) of each interval of a zone, from the JVM's rules."""
    jvm = SparkSession.getActiveSession()._jvm
    rules = jvm.java.time.ZoneId.of(zone).getRules()
    at = jvm.java.time.Instant.ofEpochSecond(int((dt.datetime(FIRST_YEAR, 1, 1) - dt.datetime(1970, 1, 1)).total_seconds()))
    end = int((dt.datetime(LAST_YEAR + 1, 1, 1) - dt.datetime(1970, 1, 1)).total_seconds())
    found = [(-FAR, rules.getOffset(at).getTotalSeconds())]
    while (t := rules.nextTransition(at)) is not None and (s := t.toEpochSecond()) < end:
        found.append((s, t.getOffsetAfter().getTotalSeconds()))
        at = t.getInstant()
    return tuple(found)


def _since_epoch(year: int) -> int:
    return int((dt.datetime(year, 1, 1) - dt.datetime(1970, 1, 1)).total_seconds())


def zone_intervals(spark: SparkSession, zones: tuple[str, ...]) -> DataFrame:
    """Zone-offset intervals exploded by year: ``(zone, bucket, spans)``.

    A span is valid for the local seconds [lo, hi) and the instants [u_lo, u_hi); ``as_of`` ends the
    wall times for which it is the last valid one, so that it covers the skipped times after it. The
    first and last year also stand for all years before and after.
    """
    rows = []
    for zone in zones:
        found = _transitions(zone)
        spans = []
        for k, (u, off) in enumerate(found):
            nxt = found[k + 1] if k + 1 < len(found) else (FAR, off)
            lo, hi = (u + off if u > -FAR else -FAR), (nxt[0] + off if nxt[0] < FAR else FAR)
            as_of = max(hi, nxt[0] + nxt[1]) if nxt[0] < FAR else FAR
            spans.append((lo, hi, as_of, u, nxt[0], off))
        for year in range(FIRST_YEAR, LAST_YEAR + 1):
            a, b = _since_epoch(year) - 86400, _since_epoch(year + 1) + 86400
            rows.append((zone, year, [x for x in spans if max(x[2], x[4]) >= a and min(x[0], x[3]) < b]))
    schema = "zone string, bucket int, spans array<struct<lo: bigint, hi: bigint, as_of: bigint, u_lo: bigint, u_hi: bigint, off: int>>"
    return spark.createDataFrame(rows, schema)


def _part(raw: Column, fmt: Column, k: int) -> Column:
    """Group for the k-th part by the format; NULL if it is absent."""
    out = None
    for name, (pattern, at) in FORMATS.items():
        if at[k]:
            v = F.regexp_extract(raw, pattern, at[k])
            out = F.when(fmt == name, v) if out is None else out.when(fmt == name, v)
    return F.nullif(out, F.lit(""))


def _number(c: Column) -> Column:
    return c.try_cast("int")


def _bucket(seconds: Column) -> Column:
    lo, hi = _since_epoch(FIRST_YEAR), _since_epoch(LAST_YEAR + 1) - 1
    day = F.date_from_unix_date(F.floor(F.greatest(F.lit(lo), F.least(F.lit(hi), seconds)) / 86400).cast("int"))
    return F.year(day)


def normalize(df: DataFrame, column: str, zone: str = CITY_ZONE, zones: tuple[str, ...] = (), prefix: str = "ts_") -> DataFrame:
    """Read ``column`` and add what it says, each name with ``prefix``.

    ``instant`` (bigint, seconds of the epoch; NULL for days and unreadable values), ``day`` (date in
    ``zone``), ``status``: fixed (offset or epoch given), unique, ambiguous, skipped, day, unreadable.
    ``zones``: further zone names that may stand in the values; others are unreadable.
    """
    p = "__" + prefix
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    shorts = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    raw = F.regexp_replace(squeeze(F.col(column)), _WEEKDAY, "")
    d = df.withColumn(f"{p}raw", raw)
    r = F.col(f"{p}raw")
    fmt = F.when(r.rlike(_EPOCH), "epoch")
    for name, (pattern, _) in FORMATS.items():
        fmt = fmt.when(r.rlike(pattern), name)
    d = d.withColumn(f"{p}fmt", fmt)
    f = F.col(f"{p}fmt")
    names = ["y", "mo", "d", "h", "mi", "s", "half", "zone"]
    d = d.withColumns({f"{p}{n}": _part(r, f, k) for k, n in enumerate(names)})
    c = {n: F.col(f"{p}{n}") for n in names}
    year = F.when(F.length(c["y"]) == 2, _number(c["y"]) + 2000).otherwise(_number(c["y"]))
    month = F.when(c["mo"].rlike(r"^\d"), _number(c["mo"])).otherwise(F.try_element_at(months, F.lower(c["mo"])))
    hour = _number(c["h"])
    half = F.lower(c["half"])
    hour = F.when(half.isNull(), hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0)).when(hour.isNotNull(), -1)
    offset = F.coalesce(
        F.try_element_at(shorts, c["zone"]),
        F.when(
            c["zone"].rlike(r"^[+-]\d"),
            (F.when(c["zone"].startswith("-"), -1).otherwise(1))
            * (_number(F.substring(c["zone"], 2, 2)) * 3600 + F.coalesce(_number(F.nullif(F.regexp_extract(c["zone"], r"^...:?(\d{2})$", 1), F.lit(""))), F.lit(0)) * 60),
        ),
    )
    d = d.withColumns({f"{p}y": year, f"{p}mo": month, f"{p}d": _number(c["d"]), f"{p}h": hour, f"{p}mi": F.coalesce(_number(c["mi"]), F.lit(0)), f"{p}s": F.coalesce(_number(c["s"]), F.lit(0)), f"{p}off": offset})
    y, mo, day_no = F.col(f"{p}y"), F.col(f"{p}mo"), F.col(f"{p}d")
    fits = y.between(1, 9999) & mo.between(1, 12)
    day = F.when(fits & (day_no >= 1), F.when(day_no <= F.dayofmonth(F.last_day(F.make_date(F.when(fits, y), F.when(fits, mo), F.lit(1)))), F.make_date(F.when(fits, y), F.when(fits, mo), F.least(day_no, F.lit(28)))))
    day = F.date_add(day, F.greatest(day_no - 28, F.lit(0)))
    h, mi, s = F.col(f"{p}h"), F.col(f"{p}mi"), F.col(f"{p}s")
    clock = F.when(h.isNotNull() & (h.between(0, 23) | ((h == 24) & (mi == 0) & (s == 0))) & mi.between(0, 59) & s.between(0, 60), h * 3600 + mi * 60 + s)
    known = [zone, *[z for z in zones if z != zone]]
    named = F.when(c["zone"].contains("/"), c["zone"]).otherwise(F.lit(zone))
    epoch = F.regexp_extract(r, _EPOCH, 1).try_cast("long")
    d = d.withColumns({f"{p}day": day, f"{p}clock": clock, f"{p}named": named, f"{p}epoch": epoch})
    local = F.unix_date(F.col(f"{p}day")).cast("long") * 86400 + F.col(f"{p}clock")
    readable = F.col(f"{p}day").isNotNull() & (h.isNull() | F.col(f"{p}clock").isNotNull()) & F.col(f"{p}named").isin(known)
    d = d.withColumns({f"{p}ok": F.coalesce(readable, F.lit(False)), f"{p}local": local})
    fixed = F.when(f == "epoch", F.col(f"{p}epoch")).when(F.col(f"{p}ok"), F.col(f"{p}local") - F.col(f"{p}off"))
    d = d.withColumn(f"{p}fixed", fixed)
    # where the offset is known, the lookup turns the instant into the day in the wanted zone
    d = d.withColumns({f"{p}jz": F.when(F.col(f"{p}fixed").isNotNull(), F.lit(zone)).otherwise(F.col(f"{p}named")), f"{p}jb": _bucket(F.coalesce(F.col(f"{p}fixed"), F.col(f"{p}local")))})
    iv = zone_intervals(df.sparkSession, tuple(known)).select(F.col("zone").alias(f"{p}iz"), F.col("bucket").alias(f"{p}ib"), F.col("spans").alias(f"{p}spans"))
    # null-safe, though the interval's ends are never NULL: for a plain equality the planner looks for a partitioned column
    # behind each key and writes out all the columns above, once for every path to them, a second column's through the first's
    d = d.join(F.broadcast(iv), F.col(f"{p}jz").eqNullSafe(F.col(f"{p}iz")) & F.col(f"{p}jb").eqNullSafe(F.col(f"{p}ib")), "left")
    at, loc = F.col(f"{p}fixed"), F.col(f"{p}local")
    valid = F.filter(f"{p}spans", lambda x: (x.lo <= loc) & (loc < x.hi))
    held = F.filter(f"{p}spans", lambda x: (x.lo <= loc) & (loc < x.as_of))
    then = F.filter(f"{p}spans", lambda x: (x.u_lo <= at) & (at < x.u_hi))
    d = d.withColumns({f"{p}n": F.size(valid), f"{p}first": F.array_max(F.transform(F.when(F.size(valid) > 0, valid).otherwise(held), lambda x: x.off)), f"{p}then": F.try_element_at(F.transform(then, lambda x: x.off), F.lit(1))})
    instant = F.when(at.isNotNull(), at).when(F.col(f"{p}ok"), loc - F.col(f"{p}first"))
    city_day = F.when(at.isNotNull(), F.date_from_unix_date(F.floor((at + F.col(f"{p}then")) / 86400).cast("int"))).when(F.col(f"{p}ok"), F.date_from_unix_date(F.floor(F.coalesce(loc / 86400, F.unix_date(F.col(f"{p}day")))).cast("int")))
    n = F.col(f"{p}n")
    status = F.when(at.isNotNull(), "fixed").when(~F.col(f"{p}ok"), "unreadable").when(loc.isNull(), "day").when(n == 1, "unique").when(n > 1, "ambiguous").otherwise("skipped")
    d = d.withColumns({f"{prefix}instant": instant, f"{prefix}day": city_day, f"{prefix}status": status})
    return d.drop(*[x for x in d.columns if x.startswith(p)])


def utc_text(seconds: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of seconds of the epoch, whatever the session's zone."""
    of_day = F.pmod(seconds, F.lit(86400))
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    day = F.date_from_unix_date(F.floor(seconds / 86400).cast("int")).cast("string")
    return F.concat(day, F.lit(" "), two(of_day / 3600), F.lit(":"), two(of_day % 3600 / 60), F.lit(":"), two(of_day % 60))


def found(press: DataFrame) -> DataFrame:
    """p1_found: the readable values of zeit_raw and publish_date of each record."""
    cols = press.select("rec_id", F.explode(F.array(F.struct(F.lit("zeit_raw").alias("field"), F.col("zeit_raw").alias("raw")), F.struct(F.lit("publish_date").alias("field"), F.col("publish_date").alias("raw")))).alias("v"))
    d = normalize(cols.select("rec_id", "v.field", "v.raw").where(F.col("raw").isNotNull()), "raw")
    norm = F.when((F.col("field") == "zeit_raw") & F.col("ts_instant").isNotNull(), utc_text(F.col("ts_instant"))).otherwise(F.col("ts_day").cast("string"))
    return d.select("rec_id", "field", norm.alias("norm")).where(F.col("norm").isNotNull())
