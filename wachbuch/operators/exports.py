"""Reading lists and map records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wachbuch.functions import dates, keys, places, rules


class Stale(RuntimeError):
    """An input is older than the one it is joined to."""


def incidents(releases: DataFrame, today: str) -> DataFrame:
    """One row per release and district (releases without a district keep one row): key, category, day,
    publication day, district, other_city, and the raw fields."""
    t = F.lit(today).cast("date")
    keyed = keys.with_keys(releases)
    days = keys.release_days(keyed, t).withColumnRenamed("day", "pub")
    d = keyed.join(days, "key", "left")
    return d.select(
        "key", "pm_id", "title", "text", "ort_raw", "zeit_raw", "publish_date", "source_url", "pub",
        dates.incident_day(F.col("zeit_raw"), F.col("pub"), t).alias("day"), rules.category(F.col("title"), F.col("text")).alias("category"),
        places.other_city(F.col("ort_raw")).alias("other_city"), F.explode_outer(places.districts_of(F.col("ort_raw"))).alias("district"),
    )


def located(inc: DataFrame, addresses: DataFrame, centroids: DataFrame) -> DataFrame:
    """Incidents with coordinates: the address's, else the district's; rows with neither are left out.

    Both lookups are joined as they are: the address cache grows with the archive, the planner broadcasts
    it only while it is small.
    """
    a = addresses.select(F.col("street").alias("a_street"), F.col("district").alias("a_district"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    c = centroids.select(F.col("district"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    d = inc.withColumn("street", places.street(F.col("ort_raw")))
    d = d.join(a, (d["street"] == a["a_street"]) & (d["district"] == a["a_district"]), "left").join(c, "district", "left")
    exact = F.col("a_lat").isNotNull()
    d = d.withColumns({"lat": F.coalesce("a_lat", "c_lat"), "lon": F.coalesce("a_lon", "c_lon"), "precision": F.when(exact, "address").otherwise("district")})
    return d.where("lat is not null").drop("a_street", "a_district", "a_lat", "a_lon", "c_lat", "c_lon")


def check_fresh(releases: DataFrame, inc: DataFrame) -> None:
    """Raises if a release has no incident row: then the incidents were built from an older archive."""
    missing = keys.with_keys(releases).select("key").distinct().join(inc.select("key"), "key", "left_anti").limit(1).count()
    if missing:
        raise Stale("releases without incident rows")


def police_index(releases: DataFrame, inc: DataFrame, on_map: DataFrame, today: str) -> DataFrame:
    """One row per release, newest first: day (typed or repaired, else the incident's), category, districts
    joined in order, and the full text of releases that aren't on the map (``x``)."""
    keyed = keys.with_keys(releases)
    days = keys.release_days(keyed, F.lit(today).cast("date")).withColumnRenamed("day", "pub")
    g = inc.groupBy("key").agg(F.min("day").alias("first_day"), F.first("category").alias("category"), F.array_join(F.array_sort(F.collect_set("district")), " / ").alias("districts"))
    shown = on_map.select("key").distinct().withColumn("shown", F.lit(True))
    d = keyed.join(days, "key", "left").join(g, "key", "left").join(shown, "key", "left")
    number, _ = keys.number_and_year(F.element_at(F.split("key", "~"), 1))
    d = d.select("key", "title", F.coalesce("pub", "first_day").alias("day"), "category", "districts", F.when(F.col("shown").isNull(), F.col("text")).alias("x"), number.alias("number"))
    return d.orderBy(F.desc_nulls_last("day"), F.desc_nulls_last("number"), "key")


def map_records(geo: DataFrame, series: DataFrame, courts: DataFrame, features: DataFrame) -> DataFrame:
    """Points of the map: rounded place, folded category, and what is known of each incident's series
    (``series_id, ids``; the last one wins), court case (``pm_id, js_key``) and day."""
    s = series.select("series_id", F.explode("ids").alias("key")).groupBy("key").agg(F.max("series_id").alias("series_id"))
    d = geo.join(s, "key", "left").join(courts.select(F.col("pm_id").alias("key"), "js_key"), "key", "left").join(features, "day", "left")
    known = [c for c in features.columns if c != "day"]
    return d.select("key", "title", "day", "district", rules.shown_category(F.col("category")).alias("category"), F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), "precision", "series_id", F.col("js_key").alias("court_match"), *known)


def court_list(releases: DataFrame, kept: DataFrame) -> DataFrame:
    """Court releases of this run, and those kept from earlier runs that it doesn't replace, newest first.
    Both: id, day, time, title."""
    d = releases.unionByName(kept.join(releases.select("id"), "id", "left_anti"), allowMissingColumns=True)
    return d.orderBy(F.desc_nulls_last("day"), F.desc_nulls_last("time"), F.desc("id"))


def court_index(listed: DataFrame) -> DataFrame:
    """The court list without the texts."""
    return listed.select(*[c for c in listed.columns if c not in ("text", "narrative")])
