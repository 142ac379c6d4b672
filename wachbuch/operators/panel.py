"""Dense date x district panels and day features.

Counts are aggregated before anything else, so every later window runs over one row per day and
district, however many events there are. Events without a day or district are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spine(first: Column, last: Column) -> Column:
    """Every day from ``first`` to ``last``, as rows."""
    return F.explode(F.sequence(first, last, F.expr("interval 1 day")))


def skeleton(events: DataFrame, districts: DataFrame, day: str = "day") -> DataFrame:
    """Every day between the first and the last event, with every district (a short dimension)."""
    span = events.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a is not null")
    days = span.select(spine(F.col("a"), F.col("b")).alias(day))
    return days.crossJoin(F.broadcast(districts.select("district").distinct()))


def daily(events: DataFrame, districts: DataFrame, categories: list[str] | None = None, day: str = "day") -> DataFrame:
    """``day, district, n_total`` and, for each listed category, ``n_<k>`` in list order; zeros included."""
    kept = events.where(F.col(day).isNotNull() & F.col("district").isNotNull())
    cats = [F.count_if(F.col("category") == c).alias(f"n_{k}") for k, c in enumerate(categories or [])]
    n = kept.groupBy(day, "district").agg(F.count("*").alias("n_total"), *cats)
    return skeleton(kept, districts, day).join(n, [day, "district"], "left").fillna(0)


def city_totals(panel: DataFrame, day: str = "day") -> DataFrame:
    return panel.groupBy(day).agg(F.sum("n_total").alias("n_total"))


def calendar_features(days: DataFrame, ranges: DataFrame | None = None, day: str = "day") -> DataFrame:
    """Weekday (Monday 0), weekend, start-of-month payday, and the first named range that covers the day.

    ``ranges``: ``ord, name, first, last``; a short table, so the range join broadcasts it. Where
    several cover a day, the one with the smallest ``ord`` wins.
    """
    d = days.select(day, F.weekday(day).alias("weekday"), (F.weekday(day) >= 5).alias("is_weekend"), (F.dayofmonth(day) <= 3).alias("is_payday"))
    if ranges is None:
        return d
    r = F.broadcast(ranges.select("ord", F.col("name").alias("range_name"), "first", "last"))
    hit = d.join(r, (F.col(day) >= F.col("first")) & (F.col(day) <= F.col("last")), "left")
    return hit.groupBy(day, "weekday", "is_weekend", "is_payday").agg(F.min_by("range_name", "ord").alias("range_name"))


def with_features(totals: DataFrame, features: DataFrame, day: str = "day") -> DataFrame:
    """Left join of daily features (holidays, weather) to totals."""
    return totals.join(features, day, "left")


def easter(year: Column) -> Column:
    """Easter Sunday of a year of the Gregorian calendar (the anonymous algorithm, integer arithmetic)."""
    div = lambda a, b: F.floor(a / b).cast("int")
    a, b, c = year % 19, div(year, 100), year % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    w = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    m = div(a + 11 * h + 22 * w, 451)
    n = h + w - 7 * m + 114
    return F.make_date(year, div(n, 31), n % 31 + 1)


#: Holidays of the region, by month and day or by distance from Easter Sunday.
FIXED_HOLIDAYS = (("Neujahr", 1, 1), ("Tag der Arbeit", 5, 1), ("Tag der Deutschen Einheit", 10, 3), ("Reformationstag", 10, 31), ("1. Weihnachtstag", 12, 25), ("2. Weihnachtstag", 12, 26))
EASTER_HOLIDAYS = (("Karfreitag", -2), ("Ostermontag", 1), ("Christi Himmelfahrt", 39), ("Pfingstmontag", 50))


def holidays(years: DataFrame, year: str = "year") -> DataFrame:
    """``day, holiday`` of the given years."""
    y = F.col(year).cast("int")
    fixed = [F.struct(F.make_date(y, F.lit(m), F.lit(d)).alias("day"), F.lit(n).alias("holiday")) for n, m, d in FIXED_HOLIDAYS]
    moving = [F.struct(F.date_add(easter(y), k).alias("day"), F.lit(n).alias("holiday")) for n, k in EASTER_HOLIDAYS]
    return years.where(y.isNotNull()).select(F.explode(F.array(*fixed, *moving)).alias("h")).select("h.day", "h.holiday").distinct()


# -- coverage -----------------------------------------------------------------------------------


def coverage_spans(days: DataFrame, gap: int = 7, shortest: int = 5, day: str = "day") -> DataFrame:
    """Spans of days with publications: a gap of more than ``gap`` days starts a new span, spans shorter
    than ``shortest`` days are dropped. ``span_no, first, last, n_days`` (n_days: calendar days)."""
    w = Window.partitionBy(F.lit(1)).orderBy(day)  # one row per calendar day
    d = days.select(day).where(F.col(day).isNotNull()).distinct()
    d = d.withColumn("new", (F.coalesce(F.datediff(day, F.lag(day).over(w)), F.lit(gap + 1)) > gap).cast("int"))
    d = d.withColumn("s", F.sum("new").over(w))
    s = d.groupBy("s").agg(F.min(day).alias("first"), F.max(day).alias("last"))
    s = s.withColumn("n_days", F.datediff("last", "first") + 1).where(F.col("n_days") >= shortest)
    return s.select(F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("first")).alias("span_no"), "first", "last", "n_days")


def covered_days(spans: DataFrame, shift: int = 0) -> DataFrame:
    """Every day within a span; ``shift`` -1 gives incident days, reported the day after."""
    return spans.select(spine(F.date_add("first", shift), F.date_add("last", shift)).alias("day")).distinct()


def coverage_summary(spans: DataFrame) -> DataFrame:
    """First and last covered day, covered days, all days and the holes between spans."""
    a = spans.agg(F.min("first").alias("first_day"), F.max("last").alias("last_day"), F.sum("n_days").alias("n_covered"), F.count("*").alias("n_spans"))
    return a.select("first_day", "last_day", "n_covered", (F.datediff("last_day", "first_day") + 1).alias("n_days"), F.greatest(F.col("n_spans") - 1, F.lit(0)).alias("n_holes"))
