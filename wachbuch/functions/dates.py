"""Day rules of releases. ``today`` is always a parameter, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
MONTHS = ("januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember")


def _rebuilt(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def _group(c: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))


def date_line(line: Column) -> Column:
    """``(D.M.YY[YY])``, brackets optional, as ``DD.MM.YYYY``; NULL for other year lengths."""
    p = r"^\s*\(?\s*(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})\s*\)?\s*$"
    y = _group(line, p, 3)
    return F.concat(F.lpad(_group(line, p, 1), 2, "0"), F.lit("."), F.lpad(_group(line, p, 2), 2, "0"), F.lit("."), F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y))


def iso_day(c: Column) -> Column:
    """The day of a full ``D.M.YYYY`` of the years 2000 to 2100; NULL for anything else."""
    p = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$"
    d = _rebuilt(_group(c, p, 3), _group(c, p, 2), _group(c, p, 1))
    return F.when(F.year(d).between(2000, 2100), d)


def first_day(c: Column) -> Column:
    """The first ``D.M.YY[YY]`` of a text, of 2020 to 2030; NULL if its year has another length or it doesn't exist."""
    p = r"(\d{1,2})\.(\d{1,2})\.(\d{2,4})"
    y = _group(c, p, 3)
    y = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).when(F.length(y) == 4, y)
    return F.when(y.try_cast("int").between(2020, 2030), _rebuilt(y, _group(c, p, 2), _group(c, p, 1)))


def incident_day(time_line: Column, published: Column, today: Column) -> Column:
    """The day of a release's incident: the time line's, if it lies 0 to 90 days before publication (or,
    without publication, isn't in the future), else the day of publication. A publication day that
    hasn't come yet counts as unknown. ``published`` is a date."""
    pub = F.when(published <= today, published)
    at = first_day(time_line)
    good = (pub.isNotNull() & F.datediff(pub, at).between(0, 90)) | (pub.isNull() & (at <= today))
    return F.when(F.coalesce(good, F.lit(False)), at).otherwise(pub)


def court_day(text: Column) -> Column:
    """The day in "Pressemitteilung Nr. n/yyyy ... vom D. <month> yyyy", as ISO text."""
    p = r"(?is)Pressemitteilung\s*Nr\.\s*\d+\s*/\s*\d{4}.*?vom\s*(\d{1,2})\.\s*([A-Za-zäöü]+)\s*(\d{4})"
    months = F.create_map(*[F.lit(x) for k, m in enumerate(MONTHS) for x in (m, f"{k + 1:02d}")])
    m = F.try_element_at(months, F.lower(_group(text, p, 2)))
    return F.concat(_group(text, p, 3), F.lit("-"), m, F.lit("-"), F.lpad(_group(text, p, 1), 2, "0"))


def page_day(url: Column) -> Column:
    """The day an archive page starts, from ``pressemeldungen-ab-DDMMYYYY-<id>``."""
    p = r"pressemeldungen-ab-(\d{2})(\d{2})(\d{4})"
    return _rebuilt(_group(url, p, 3), _group(url, p, 2), _group(url, p, 1))


def page_order(url: Column) -> Column:
    """Sort key of archive pages: start day as ISO text, then the page's number."""
    return F.struct(F.coalesce(page_day(url).cast("string"), F.lit("")).alias("day"), F.coalesce(F.regexp_extract(url, r"-(\d+)/?$", 1).try_cast("long"), F.lit(0)).alias("number"))
