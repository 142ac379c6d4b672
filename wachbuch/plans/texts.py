"""Queries of text, key, join, graph and export operators on the driver's tables, with SQL twins where
SQL can say the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wachbuch.functions import dates, geo, keys, places, rules
from wachbuch.functions.text import page_number, release_number
from wachbuch.operators import archive, courts, exports, series
from wachbuch.plans.incidents import feed
from wachbuch.session import cut, shared_folder, table
from wachbuch.sources import files, pages, sinks

TODAY = "2026-10-11"


def press(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "press_releases")


def court_rows(s: SparkSession, d: str) -> DataFrame:
    """Court releases of the case table, one row each, with the case's text."""
    m = table(s, d, "court_matches")
    r = m.select("js_key", "case_text", F.explode("releases").alias("r")).select("js_key", "case_text", "r.*")
    text = F.concat(F.lit("Aktenzeichen Js "), F.col("js_key"), F.lit(". "), F.col("case_text"), F.lit(" Die Tat war am "), F.date_format(F.to_date("publish_date"), "dd.MM.yyyy"), F.lit("."))
    return r.select("pm_id", "title", text.alias("text"), "publish_date", rules.court_stage(F.col("title")).alias("stage"), "pdf_url", rules.category(F.col("title"), F.col("case_text")).alias("category"))


def points(s: SparkSession, d: str) -> DataFrame:
    """Incidents with derived coordinates within a square of about 5 km."""
    f = feed(s, d)
    return f.select("id", "category", "day", (53.05 + (F.col("id") * 7919 % 4500) / 100000).alias("lat"), (8.75 + (F.col("id") * 104729 % 7500) / 100000).alias("lon"))


def html_pages(s: SparkSession, d: str) -> DataFrame:
    """Archive pages made from release records: one page per source page, all its records as blocks."""
    e = F.concat(
        F.lit('<div class="entry-wrapper-1col" id="'), F.coalesce("pm_id", F.lit("")), F.lit('"><h2>'), F.coalesce("title", F.lit("")), F.lit("</h2><p>("), F.coalesce("publish_date", F.lit("")), F.lit(")</p><p>Ort: "),
        F.coalesce("ort_raw", F.lit("")), F.lit("<br>Zeit: "), F.coalesce("zeit_raw", F.lit("")), F.lit("</p><p>"), F.coalesce("text", F.lit("")), F.lit("</p></div>"),
    )
    p = press(s, d).select(F.regexp_replace(F.lower("source_url"), r"[?#/]*(?:\?.*|#.*)?$", "").alias("url"), "rec_id", e.alias("e"))
    # a page holds at most some hundred blocks; its hot page is split by record number
    return p.groupBy("url", (F.col("rec_id") % 64).alias("version")).agg(F.concat(F.lit("<html>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rec_id", "e"))), lambda x: x.e), ""), F.lit("</html>")).alias("html"))


def versions(s: SparkSession, d: str) -> DataFrame:
    return press(s, d).select(*[F.col(c) for c in archive.FIELDS], F.col("fetched_at").cast("string").alias("version"), F.col("rec_id").alias("pos"))


def incident_rows(s: SparkSession, d: str) -> DataFrame:
    return exports.incidents(press(s, d), TODAY)


def centroids(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(n, 53.0 + k / 100, 8.7 + k / 100) for k, n in enumerate(places.DISTRICTS)], "district string, lat double, lon double")


def map_rows(s: SparkSession, d: str) -> DataFrame:
    inc = incident_rows(s, d).where("district is not null")
    streets = s.createDataFrame([], "street string, district string, lat double, lon double")
    geo_rows = exports.located(inc, streets, centroids(s))
    ser = table(s, d, "series").select("series_id", F.transform("pm_ids", lambda x: keys.release_key(x, F.lit(""))).alias("ids"))
    none = s.createDataFrame([], "pm_id string, js_key string")
    days = geo_rows.select("day").where("day is not null").distinct().select("day", (F.weekday("day") >= 5).alias("is_weekend"))
    return exports.map_records(geo_rows, ser, none, days)


def case_events(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "court_matches").where("tat_date_min is not null")
    return m.select("match_id", "category", "tat_date_min", "tat_date_max", "district")


def interval_match(s: SparkSession, d: str) -> DataFrame:
    """Cases and series of one category whose days come within ten days of each other, counted."""
    c, x = case_events(s, d), table(s, d, "series").select("series_id", "category", "date_start", "date_end")
    month = lambda v: F.year(v) * 12 + F.month(v)
    c = c.withColumns({"lo": F.date_sub("tat_date_min", 10), "hi": F.date_add("tat_date_max", 10)}).withColumn("m", F.explode(F.sequence(month(F.col("lo")), month(F.col("hi")))))
    x = x.withColumn("m", F.explode(F.sequence(month(F.col("date_start")), month(F.col("date_end")))))
    j = c.join(x, ["category", "m"]).where("date_start <= hi and date_end >= lo").select("match_id", "series_id").distinct()
    return j.groupBy("match_id").agg(F.count("*").alias("n"))


def followups(s: SparkSession, d: str) -> DataFrame:
    return series.without_followups(points(s, d), 400.0).select("id", "day")


def clusters(s: SparkSession, d: str) -> DataFrame:
    return series.groups(points(s, d), 1000.0, 14, 3).select("root", "category", "n", "date_start", "date_end", "span_days")


def csv_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Incident columns written as CSV and read again."""
    cols = press(s, d).select("rec_id", "pm_id", "title", "publish_date", F.to_date("fetched_at").alias("day"))
    place = f"{shared_folder(s)}/csv-{uuid.uuid4().hex}"
    sinks.write_csv(cols, place, keep_empty=True)
    return files.csv(s, place, "rec_id long, pm_id string, title string, publish_date string, day date", keep_empty=True)


def court_list(s: SparkSession, d: str) -> DataFrame:
    """Court releases of the case table, and the scanned ones that it doesn't name, as one list."""
    r = table(s, d, "court_matches").select(F.explode("releases").alias("r")).groupBy(F.col("r.pm_id").alias("id")).agg(F.min("r.publish_date").alias("day"), F.min("r.title").alias("title"))
    k = table(s, d, "raw_courts").where("pm_number is not null").groupBy(F.concat_ws("/", "pm_number", "pm_year").alias("id")).agg(F.min("court").alias("title"))
    none = F.lit(None).cast("string")
    return exports.court_list(r.withColumn("time", none), k.select("id", none.alias("day"), "title", none.alias("time")))


def rekeyed(s: SparkSession, d: str) -> DataFrame:
    """The archive under numbers as written, without what the parsed pages hold under the plain number."""
    a = press(s, d).where("pm_id is not null").groupBy(F.col("pm_id").alias("key"), "source_url", "title", "publish_date", "text").agg(F.count("*").alias("n"))
    p = a.withColumn("key", release_number(F.col("key")).cast("string")).where("key is not null")
    return archive.drop_rekeyed(a, p).groupBy("key").agg(F.sum("n").alias("n"))


def _press_cols(*cols):
    return lambda s, d: press(s, d).select("rec_id", *[c() for c in cols])


QUERIES = {
    "csv_round_trip": csv_round_trip,
    "court_list": lambda s, d: exports.court_index(court_list(s, d)).select("id", "day", "title"),
    "court_stats": lambda s, d: (lambda c: courts.stats(courts.match(c, incident_rows(s, d).select(F.col("key").alias("pm_id"), "category", "day", "district", "ort_raw", "other_city")), c))(cut(courts.cases(court_rows(s, d)))),
    "rekeyed": rekeyed,
    "text_slugs": lambda s, d: press(s, d).select("rec_id", rules.slug(F.col("title")).alias("slug"), rules.fingerprint(F.col("title"), 8).alias("mark")),
    "release_refs": lambda s, d: table(s, d, "raw_courts").select("court_doc_id", F.nullif(F.array_join(rules.release_refs(F.col("text")), "|"), F.lit("")).alias("refs")),
    "without_imprint": lambda s, d: table(s, d, "raw_courts").select("court_doc_id", F.length(rules.without_imprint(F.col("text"))).alias("n")),
    "size_rollup": lambda s, d: table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("total"), F.max(F.length("text")).alias("largest"), F.count_if(F.length("text") > 1000).alias("n_large")),
    "distinct_sketch": lambda s, d: table(s, d, "press_releases").groupBy("origin").agg(F.hll_sketch_agg("source_url", 12).alias("h")).agg(F.hll_sketch_estimate(F.hll_union_agg("h", True)).alias("pages")),
    "lookup_texts": lambda s, d: press(s, d).select(geo.lookup_text(places.street(F.col("ort_raw"))).alias("asked")).where("asked is not null").distinct(),
    "lookup_box": lambda s, d: table(s, d, "series").where(geo.in_lookup_box(F.col("centroid_lat"), F.col("centroid_lon"))).groupBy("area_no").agg(F.count("*").alias("n")),
    "classify_documents": lambda s, d: table(s, d, "documents").select("doc_id", rules.category(F.lit(""), F.col("text")).alias("category")),
    "classify_counts": lambda s, d: press(s, d).groupBy(rules.shown_category(rules.category(F.col("title"), F.col("text"))).alias("category")).agg(F.count("*").alias("n")),
    "districts_of_place": lambda s, d: press(s, d).select("rec_id", F.array_join(places.districts_of(F.col("ort_raw")), "|").alias("districts"), places.other_city(F.col("ort_raw")).alias("other_city")),
    "quarter_and_street": lambda s, d: press(s, d).select("rec_id", places.quarter(F.col("ort_raw")).alias("quarter"), places.street(F.col("ort_raw")).alias("street")),
    "date_parse_matrix": lambda s, d: press(s, d).select("rec_id", dates.date_line(F.col("publish_date")).alias("line"), dates.iso_day(F.col("publish_date")).alias("iso"), dates.first_day(F.col("zeit_raw")).alias("first")),
    "incident_days": lambda s, d: press(s, d).select("rec_id", dates.incident_day(F.col("zeit_raw"), dates.first_day(F.col("publish_date")), F.lit(TODAY).cast("date")).alias("day")),
    "release_numbers": lambda s, d: press(s, d).select("rec_id", release_number(F.col("pm_id")).alias("no"), page_number(F.col("source_url")).alias("page"), dates.page_day(F.col("source_url")).alias("page_day")),
    "release_keys": lambda s, d: keys.with_keys(press(s, d)).select("rec_id", "key"),
    "release_days": lambda s, d: keys.release_days(keys.with_keys(press(s, d)), F.lit(TODAY).cast("date")),
    "court_text_fields": lambda s, d: table(s, d, "raw_courts").select("court_doc_id", dates.court_day(F.col("text")).alias("day"), rules.headline(courts.reflow(F.col("text"))).alias("headline"), rules.age(F.col("text")).alias("age")),
    "reflow_text": lambda s, d: table(s, d, "raw_courts").select("court_doc_id", courts.reflow(F.col("text")).alias("text")),
    "court_stages": lambda s, d: table(s, d, "court_matches").select("match_id", F.explode("releases").alias("r")).select("match_id", "r.pm_id", rules.court_stage(F.col("r.title")).alias("stage")),
    "case_events": lambda s, d: courts.cases(court_rows(s, d)).select("js_key", "category", "outcome_stage", "district", F.size("events").alias("n_events"), F.size("releases").alias("n_releases")),
    "case_matches": lambda s, d: courts.match(courts.cases(court_rows(s, d)), incident_rows(s, d).select(F.col("key").alias("pm_id"), "category", "day", "district", "ort_raw", "other_city")).select("js_key", "event_no", "confidence", "category", F.size("matched_pm_ids").alias("n")),
    "case_reports": lambda s, d: (lambda i: courts.reports(courts.match(courts.cases(court_rows(s, d)), i), i.withColumn("key", F.col("pm_id"))).select("js_key", F.size("keys").alias("n")))(incident_rows(s, d).select(F.col("key").alias("pm_id"), "category", "day", "district", "ort_raw", "other_city")),
    "series_spread": lambda s, d: series.find(points(s, d), 1000.0, 14, 3).select("root", "n", "centroid_lat", "centroid_lon", "max_spread_m"),
    "tokens_overlap_match": lambda s, d: (lambda t: t.join(t.withColumnRenamed("match_id", "b"), "token").where("match_id < b").groupBy("match_id", "b").agg(F.count("*").alias("n")).where("n >= 1"))(table(s, d, "court_matches").select("match_id", F.explode(rules.street_tokens(F.col("case_text"))).alias("token"))),
    "interval_match": interval_match,
    "range_dimension_join": lambda s, d: feed(s, d).join(F.broadcast(s.createDataFrame([(1, "a", "1996-01-01", "1996-06-30"), (2, "b", "1996-06-01", "1997-12-31")], "ord int, name string, a string, b string").select("ord", "name", F.to_date("a").alias("a"), F.to_date("b").alias("b"))), F.expr("day between a and b")).groupBy("id").agg(F.min_by("name", "ord").alias("name")),
    "geocode_fallback": lambda s, d: table(s, d, "customer").join(table(s, d, "nation").where("n_nationkey % 2 = 0"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(s, d, "region").where("r_regionkey < 3"), F.col("c_nationkey") % 5 == F.col("r_regionkey"), "left").select("c_custkey", F.coalesce("n_name", "r_name").alias("place"), F.when(F.col("n_name").isNotNull(), "address").otherwise("district").alias("precision")).where("place is not null"),
    "semi_on_map": lambda s, d: table(s, d, "customer").join(table(s, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"),
    "anti_off_map": lambda s, d: table(s, d, "customer").join(table(s, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"),
    "case_fold": lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct(F.col("event_type") != "error", "ts", "event_id")).alias("anchor"), F.count("*").alias("n"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type")),
    "union_override": lambda s, d: (lambda e: e.where("event_id % 3 = 0").withColumn("src", F.lit("new")).unionByName(e.where("event_id % 2 = 0").withColumn("src", F.lit("kept")).join(e.where("event_id % 3 = 0").select("event_id"), "event_id", "left_anti")))(table(s, d, "events").select("event_id", "user_id")),
    "priority_dedupe": lambda s, d: files.first_source_wins([table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.lit("F").alias("src")).distinct(), table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.lit("any").alias("src")).distinct()], ["k"]),
    "latest_release_per_case": lambda s, d: table(s, d, "court_matches").select("match_id", F.explode("releases").alias("r")).groupBy("match_id").agg(F.max_by("r.pm_id", F.struct(F.coalesce("r.publish_date", F.lit("")), "r.pm_id")).alias("pm_id")),
    "series_of_release": lambda s, d: table(s, d, "series").select("series_id", F.explode("pm_ids").alias("pm_id")).select(release_number(F.col("pm_id")).alias("no"), "series_id").where("no is not null").groupBy("no").agg(F.max("series_id").alias("series_id")),
    "series_by_size": lambda s, d: table(s, d, "series").select("series_id", "n", F.row_number().over(Window.orderBy(F.desc("n"), "category", "series_id")).alias("place")).where("place <= 100"),
    "haversine_pairs": lambda s, d: table(s, d, "forecast").alias("a").join(table(s, d, "forecast").alias("b"), F.expr("a.area_no = b.area_no and a.forecast_id < b.forecast_id")).select(F.col("a.forecast_id").alias("a"), F.col("b.forecast_id").alias("b"), F.round(geo.haversine_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")), 3).alias("metres")),
    "tile_math": lambda s, d: table(s, d, "forecast").select("forecast_id", *[c.alias(n) for c, n in zip(geo.tile_xy(F.col("lat"), F.col("lon"), 13), ("x", "y"), strict=True)]),
    "followup_dedupe": followups,
    "series_clusters": clusters,
    "parse_pages": lambda s, d: pages.parse(html_pages(s, d)),
    "page_catalogue": lambda s, d: pages.discover(html_pages(s, d).select(F.concat(F.lit('<a href="'), "url", F.lit('">')).alias("html")), s.createDataFrame([], "url string")),
    "similar_merge": lambda s, d: archive.merge(versions(s, d)).select("key", "title", "publish_date"),
    "incidents": lambda s, d: incident_rows(s, d).select("key", "category", "day", "pub", "district", "other_city"),
    "police_index": lambda s, d: exports.police_index(press(s, d), incident_rows(s, d), incident_rows(s, d).where("district is not null").select("key"), TODAY).select("key", "title", "day", "category", "districts", "number"),
    "map_records": map_rows,
    "json_props": lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("int")).alias("k_sum"), F.count("*").alias("n")),
    "rollup_any": lambda s, d: feed(s, d).groupingSets([["district", "category"], ["district"]], "district", "category").agg(F.count("*").alias("n")).select("district", F.coalesce("category", F.lit("_any")).alias("category"), "n"),
}

_CAT = "case " + " ".join(f"when regexp_matches(coalesce(text, ''), '(?i){'|'.join(p for p in ps)}') then '{c}'" for c, ps in rules.CATEGORY_RULES) + " else 'Sonstiges' end"
_NO = r"try_cast(nullif(regexp_extract(trim(regexp_replace({0}, '[\s\x{{a0}}]+', ' ', 'g')), '^0*(\d{{1,18}})(?:\.0*)?$', 1), '') as bigint)"
_ISO = r"try_cast(strftime(try_strptime(regexp_extract({0}, '^(\d{{1,2}}\.\d{{1,2}}\.\d{{4}})$', 1), '%d.%m.%Y'), '%Y-%m-%d') as date)"
_FIRST = r"""case when length(regexp_extract({0}, '(\d{{1,2}})\.(\d{{1,2}})\.(\d{{2,4}})', 3)) in (2, 4) then (select case when year(v) between 2020 and 2030 then v end from (select try_cast(
  lpad(case when length(regexp_extract({0}, '(\d{{1,2}})\.(\d{{1,2}})\.(\d{{2,4}})', 3)) = 2 then '20' else '' end || regexp_extract({0}, '(\d{{1,2}})\.(\d{{1,2}})\.(\d{{2,4}})', 3), 4, '0') || '-' ||
  lpad(regexp_extract({0}, '(\d{{1,2}})\.(\d{{1,2}})\.(\d{{2,4}})', 2), 2, '0') || '-' || lpad(regexp_extract({0}, '(\d{{1,2}})\.(\d{{1,2}})\.(\d{{2,4}})', 1), 2, '0') as date) as v)) end"""
_STAGE = "case " + " ".join(f"when regexp_matches(lower(r.title), '{p}') then '{n}'" for n, p in rules.STAGES) + " else 'sonstiges' end"
_FEED = "with feed as (select o_orderkey as id, 'D' || lpad(cast(c_nationkey as varchar), 2, '0') as district, o_orderpriority as category, cast(o_orderdate as date) as day from orders join customer on o_custkey = c_custkey where c_nationkey < 23)"
_HAV = "2 * 6371000.0 * asin(sqrt(least(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2), 1.0)))"
_POINTS = _FEED.replace("with feed", "with recursive feed") + ", pts as (select id, category, day, 53.05 + (id * 7919 % 4500) / 100000 as lat, 8.75 + (id * 104729 % 7500) / 100000 as lon from feed)"


def _components(days: int, metres: float) -> str:
    near = _HAV.format(a="x.lat", b="x.lon", c="y.lat", d="y.lon")
    return f"""{_POINTS},
edges as (select x.id as a, y.id as b from pts x join pts y on x.category = y.category and x.id <> y.id and abs(date_diff('day', x.day, y.day)) <= {days} and abs(x.lat - y.lat) < 0.01 where {near} <= {metres}),
reach(node, root) as (select a, a from edges union select e.b, r.root from reach r join edges e on e.a = r.node),
comp as (select node, min(root) as root from reach group by node)"""

_DATED = r"regexp_extract(publish_date, '^\s*\(?\s*(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}})\s*\)?\s*$', {0})"
_LINE = f"case when {_DATED.format(3)} <> '' then lpad({_DATED.format(1)}, 2, '0') || '.' || lpad({_DATED.format(2)}, 2, '0') || '.' || case when length({_DATED.format(3)}) = 2 then '20' else '' end || {_DATED.format(3)} end"

SQL = {
    "csv_round_trip": "select rec_id, pm_id, title, publish_date, cast(fetched_at as date) as day from press_releases",
    "court_list": """with r as (select r.pm_id as id, min(r.publish_date) as day, min(r.title) as title from (select unnest(releases) as r from court_matches) group by 1)
select * from r union all select id, null, min(court) from (select pm_number || '/' || pm_year as id, court from raw_courts where pm_number is not null) where id not in (select id from r) group by id""",
    "text_slugs": "select rec_id, trim(regexp_replace(lower(title), '[^0-9a-z]+', '-', 'g'), '-') as slug, left(sha1(title), 8) as mark from press_releases",
    "release_refs": r"""select court_doc_id, array_to_string((select list(x order by i) from (select x, min(i) as i from (select unnest(list_transform(regexp_extract_all(text, '(?i)PM\s*\d+\s*/\s*\d{2,4}'),
  lambda v: regexp_extract(v, '(\d+)\s*/', 1) || '/' || case when length(regexp_extract(v, '/\s*(\d+)', 1)) = 2 then '20' else '' end || regexp_extract(v, '/\s*(\d+)', 1))) as x, generate_subscripts(regexp_extract_all(text, '(?i)PM\s*\d+\s*/\s*\d{2,4}'), 1) as i) group by x)), '|') as refs from raw_courts""",
    "without_imprint": r"select court_doc_id, cast(length(trim(regexp_replace(regexp_replace(text, '(?s)\n\s*Verantwortlich\b.*$', ''), '\s+', ' ', 'g'))) as integer) as n from raw_courts",
    "size_rollup": "select source, count(*) as n, cast(sum(length(text)) as bigint) as total, cast(max(length(text)) as integer) as largest, count(*) filter (where length(text) > 1000) as n_large from documents group by source",
    "lookup_box": "select area_no, count(*) as n from series where centroid_lat between 52.95 and 53.22 and centroid_lon between 8.45 and 9.05 group by area_no",
    "classify_counts": f"""select case when category in ({', '.join(repr(x) for x in rules.FOLDED)}) then 'Sonstiges' else category end as category, count(*) as n
  from (select {_CAT} as category from (select coalesce(title, '') || chr(10) || coalesce(text, '') as text from press_releases)) group by 1""",
    "date_parse_matrix": f"""select rec_id, {_LINE} as line, {_ISO.format('publish_date')} as iso, {_FIRST.format('zeit_raw')} as first from press_releases""",
    "release_keys": """with b as (select rec_id, coalesce(title, '') as t, coalesce(publish_date, '') as p, coalesce(cast(cast(trunc(try_cast(trim(pm_id) as double)) as bigint) as varchar), 't:' || coalesce(title, '')) as base,
  coalesce(strftime(try_strptime(regexp_extract(publish_date, '^([0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4})$', 1), '%d.%m.%Y'), '%Y-%m-%d'), '9999') as d from press_releases),
f as (select base, arg_min({'t': t, 'p': p}, (d, t, p)) as first from b group by base)
select rec_id, case when t = first.t and p = first.p then base else base || '~' || left(sha1(t || '|' || p), 6) end as key from b join f using (base)""",
    "classify_documents": f"select doc_id, {_CAT} as category from documents",
    "release_numbers": f"""select rec_id, {_NO.format('pm_id')} as no, try_cast(nullif(regexp_extract(regexp_replace(source_url, '[?#].*$', ''), '(\\d{{1,18}})/*$', 1), '') as bigint) as page,
  try_cast(regexp_extract(source_url, 'ab-(\\d{{2}})(\\d{{2}})(\\d{{4}})', 3) || '-' || regexp_extract(source_url, 'ab-(\\d{{2}})(\\d{{2}})(\\d{{4}})', 2) || '-' || regexp_extract(source_url, 'ab-(\\d{{2}})(\\d{{2}})(\\d{{4}})', 1) as date) as page_day from press_releases""",
    "incident_days": f"""with p as (select rec_id, {_FIRST.format('zeit_raw')} as seen, {_FIRST.format('publish_date')} as typed from press_releases),
q as (select rec_id, seen, case when typed <= date '{TODAY}' then typed end as pub from p)
select rec_id, case when pub is not null and date_diff('day', seen, pub) between 0 and 90 then seen when pub is null and seen <= date '{TODAY}' then seen else pub end as day from q""",
    "court_stages": f"select match_id, r.pm_id as pm_id, {_STAGE} as stage from (select match_id, unnest(releases) as r from court_matches)",
    "interval_match": "select m.match_id, count(*) as n from court_matches m join series s on m.category = s.category and s.date_start <= m.tat_date_max + 10 and s.date_end >= m.tat_date_min - 10 group by m.match_id",
    "range_dimension_join": f"{_FEED}, r(ord, name, a, b) as (values (1, 'a', date '1996-01-01', date '1996-06-30'), (2, 'b', date '1996-06-01', date '1997-12-31')) select id, arg_min(name, ord) as name from feed join r on day between a and b group by id",
    "geocode_fallback": "select c_custkey, coalesce(n_name, r_name) as place, case when n_name is not null then 'address' else 'district' end as precision from customer left join nation on c_nationkey = n_nationkey and n_nationkey % 2 = 0 left join region on c_nationkey % 5 = r_regionkey and r_regionkey < 3 where coalesce(n_name, r_name) is not null",
    "semi_on_map": "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'P')",
    "anti_off_map": "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')",
    "case_fold": "select user_id, (select e2.event_id from events e2 where e2.user_id = e.user_id order by e2.event_type <> 'error', ts, event_id limit 1) as anchor, count(*) as n, (select e2.event_type from events e2 where e2.user_id = e.user_id order by ts desc, event_id desc limit 1) as last_type from events e group by user_id",
    "union_override": "select event_id, user_id, 'new' as src from events where event_id % 3 = 0 union all select event_id, user_id, 'kept' from events where event_id % 2 = 0 and event_id % 3 <> 0",
    "priority_dedupe": "select o_custkey as k, case when bool_or(o_orderstatus = 'F') then 'F' else 'any' end as src from orders group by o_custkey",
    "latest_release_per_case": "select match_id, arg_max(r.pm_id, coalesce(r.publish_date, '') || '|' || r.pm_id) as pm_id from (select match_id, unnest(releases) as r from court_matches) group by match_id",
    "series_of_release": f"select no, max(series_id) as series_id from (select series_id, {_NO.format('p')} as no from (select series_id, unnest(pm_ids) as p from series)) where no is not null group by no",
    "series_by_size": "select series_id, n, place from (select series_id, n, row_number() over (order by n desc, category, series_id) as place from series) where place <= 100",
    "haversine_pairs": f"select a.forecast_id as a, b.forecast_id as b, round({_HAV.format(a='a.lat', b='a.lon', c='b.lat', d='b.lon')}, 3) as metres from forecast a join forecast b on a.area_no = b.area_no and a.forecast_id < b.forecast_id",
    "tile_math": "select forecast_id, cast(floor((lon + 180) / 360 * 8192) as integer) as x, cast(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 8192) as integer) as y from forecast",
    "followup_dedupe": f"{_components(0, 400.0)} select id, day from pts where id not in (select node from comp where node <> root)",
    "json_props": "select event_type, cast(sum(cast(props->>'$.k' as integer)) as bigint) as k_sum, count(*) as n from events group by event_type",
    "rollup_any": f"{_FEED} select district, category, count(*) as n from feed group by all union all select district, '_any', count(*) from feed group by district",
}
