"""Identity of releases: keys, running numbers, repaired days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wachbuch.functions.dates import iso_day, page_day


def release_key(pm_id: Column, title: Column) -> Column:
    """The number as text, however it is written; ``t:`` and the title without one."""
    return F.coalesce(F.trim(pm_id).try_cast("double").try_cast("long").cast("string"), F.concat(F.lit("t:"), F.coalesce(title, F.lit(""))))


def number_and_year(key: Column) -> tuple[Column, Column]:
    """Running number and two-digit year that a key encodes; NULL if it doesn't look like one."""
    digits = F.when(key.rlike(r"^\d{3,18}$"), key)
    number = F.left(digits, F.length(digits) - 2).try_cast("long")
    year = F.right(digits, F.lit(2)).try_cast("int")
    ok = year.between(20, 60) & (number > 0)
    return F.when(ok, number), F.when(ok, year)


def with_keys(releases: DataFrame) -> DataFrame:
    """Adds ``key``: of several releases under one number the earliest (by day, then title) keeps the bare
    number, every other one gets a suffix that depends on itself only. Equal title and day share a key."""
    base = release_key(F.col("pm_id"), F.col("title"))
    title, day = F.coalesce("title", F.lit("")), F.coalesce("publish_date", F.lit(""))
    d = releases.withColumn("__base", base)
    order = F.struct(F.coalesce(iso_day(F.col("publish_date")).cast("string"), F.lit("9999")).alias("d"), title.alias("t"), day.alias("p"))
    # an aggregation and a join: a window would gather all rows of a hot key in one task unaggregated
    first = d.groupBy("__base").agg(F.min(order).alias("__first"))
    d = d.join(first, "__base")
    mark = F.left(F.sha1(F.concat(title, F.lit("|"), day)), F.lit(6))
    kept = (title == F.col("__first.t")) & (day == F.col("__first.p"))
    return d.withColumn("key", F.when(kept, F.col("__base")).otherwise(F.concat("__base", F.lit("~"), mark))).drop("__base", "__first")


def release_days(keyed: DataFrame, today: Column, slack: int = 3, page_span: int = 75) -> DataFrame:
    """``key, day``: the day typed, unless it is missing, in the future, or outside the days of the three
    releases numbered before and after (give or take ``slack``) and of its own archive page; then the
    neighbour's. One row per key. Windows run per year of the number."""
    number, year = number_and_year(F.element_at(F.split("key", "~"), 1))
    typed = iso_day(F.col("publish_date"))
    d = keyed.select("key", F.when(typed <= today, typed).alias("typed"), number.alias("no"), year.alias("yy"), page_day(F.col("source_url")).alias("page"))
    d = d.groupBy("key").agg(*[F.max_by(c, F.struct(F.col("typed").isNotNull(), "typed", "page")).alias(c) for c in ("typed", "no", "yy", "page")])
    w = Window.partitionBy("yy").orderBy("no", "key")
    n = d.where("no is not null").withColumns({"before": F.collect_list("typed").over(w.rowsBetween(-3, -1)), "after": F.collect_list("typed").over(w.rowsBetween(1, 3))})
    around = F.concat("before", "after")
    lo, hi = F.array_min(around), F.array_max(around)
    fits = F.col("typed").between(F.date_sub("page", slack), F.date_add("page", page_span))
    out_of_line = F.col("typed").isNull() | (F.col("typed") < F.date_sub(lo, slack)) | (F.col("typed") > F.date_add(hi, slack))
    neighbour = F.coalesce(F.try_element_at("before", F.lit(-1)), F.try_element_at("after", F.lit(1)))
    day = F.when(F.size(around) == 0, F.coalesce("typed", "page")).when(out_of_line & ~F.coalesce(fits, F.lit(False)), neighbour).otherwise(F.col("typed"))
    rest = d.where("no is null").select("key", F.coalesce("typed", "page").alias("day"))
    return n.select("key", day.alias("day")).unionByName(rest)
