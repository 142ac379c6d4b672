"""Queries of the incident operators on the driver's tables, with SQL twins.

Orders stand for incidents: the customer's nation below 23 is the district, the priority the category,
the order date the incident's day; publication follows key % 4 days later, and one week in 13 has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wachbuch.operators import hotspot, panel, stats, timing
from wachbuch.session import cut, table

CATEGORIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def feed(spark: SparkSession, d: str) -> DataFrame:
    """``id, district, category, day, pub``."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey).where("c_nationkey < 23")
    return j.select(F.col("o_orderkey").alias("id"), F.format_string("D%02d", "c_nationkey").alias("district"), F.col("o_orderpriority").alias("category"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderstatus").alias("status")).withColumn("pub", F.date_add("day", (F.col("id") % 4).cast("int")))


def districts(spark: SparkSession) -> DataFrame:
    return spark.range(23).select(F.format_string("D%02d", "id").alias("district"))


def pub_days(f: DataFrame) -> DataFrame:
    """Publication days without the holes."""
    p = f.select(F.col("pub").alias("day")).distinct()
    first = p.agg(F.min("day").alias("first"))
    return p.crossJoin(F.broadcast(first)).where(F.floor(F.datediff("day", "first") / 7) % 13 != 5).select("day")


def daily(spark: SparkSession, d: str) -> DataFrame:
    return panel.daily(feed(spark, d), districts(spark), CATEGORIES)


def observed(spark: SparkSession, d: str) -> DataFrame:
    return panel.covered_days(panel.coverage_spans(pub_days(feed(spark, d))), -1)


def forecast_day(spark: SparkSession, d: str) -> str:
    """The day after the last one that has an incident or is covered."""
    last = daily(spark, d).select("day").unionByName(observed(spark, d)).agg(F.date_add(F.max("day"), 1)).first()[0]
    return str(last)


def forecast_rows(spark: SparkSession, d: str) -> DataFrame:
    p = daily(spark, d)
    # the 23 forecast points of the first area stand for the districts' centroids
    c = table(spark, d, "forecast").where("area_no = 1 or area_no = 0").groupBy("stadtteil").agg(F.min_by(F.struct("lat", "lon"), "forecast_id").alias("c"))
    c = c.select(F.format_string("D%02d", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("stadtteil")) - 1).alias("district"), "c.lat", "c.lon")
    doc = hotspot.forecast_document(p, forecast_day(spark, d), c, last_day(timing.windows(post(spark, d))))
    return doc.select("generated_for", "district", "lat", "lon", "score", "rank", "elevated", F.size("timing").alias("n_said"), F.round(F.aggregate("timing", F.lit(0.0), lambda acc, x: acc + x["p14"]), 4).alias("sum_p14"))


def marked_shown(spark: SparkSession, d: str) -> DataFrame:
    p = cut(post(spark, d))
    m = hotspot.marked(feed(spark, d), p.select("day").distinct())
    return timing.shown(p, marked=m)


def p_values(spark: SparkSession, d: str) -> DataFrame:
    t = cut(totals(spark, d))
    r, w, u = stats.pearson(t, "weekday", "n_total"), stats.welch(t, "is_weekend", "n_total"), stats.mann_whitney(t, "is_weekend", "n_total")
    rows = [r.select(F.lit("weekday, correlation").alias("name"), F.lit("r").alias("kind"), F.col("r").alias("statistic"), F.col("n").cast("double").alias("dof")), w.select(F.lit("weekend, Welch"), F.lit("t"), "t", "dof"), u.select(F.lit("weekend, ranks"), F.lit("z"), "z", F.lit(0.0))]
    return stats.benjamini_hochberg(stats.p_values(rows[0].union(rows[1]).union(rows[2])))


def score_query(model: str):
    return lambda s, d: hotspot.scores(daily(s, d)).select("day", "district", F.round(model, 6).alias("score"))


def time_grid(spark: SparkSession, d: str) -> DataFrame:
    f = feed(spark, d)
    return timing.grid(f, panel.covered_days(panel.coverage_spans(pub_days(f)), -1))


def post(spark: SparkSession, d: str) -> DataFrame:
    return timing.posterior(time_grid(spark, d))


def last_day(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(df.agg(F.max("day").alias("day"))), "day")


def features(spark: SparkSession, d: str) -> DataFrame:
    ranges = spark.createDataFrame([(k, n, a, b) for k, n, a, b in RANGES], "ord int, name string, first string, last string").select("ord", "name", F.to_date("first").alias("first"), F.to_date("last").alias("last"))
    return panel.calendar_features(panel.city_totals(daily(spark, d)).select("day"), ranges)


RANGES = [(1, "spring", "1996-03-25", "1996-04-10"), (2, "long", "1996-04-01", "1996-05-31"), (3, "summer", "1997-07-01", "1997-08-15"), (4, "winter", "1998-12-20", "1999-01-06")]


def totals(spark: SparkSession, d: str) -> DataFrame:
    return panel.with_features(panel.city_totals(daily(spark, d)), features(spark, d))


def forecast(spark: SparkSession, d: str) -> DataFrame:
    p = daily(spark, d)
    day = p.agg(F.date_add(F.max("day"), 1)).first()[0]
    return hotspot.ranking(p, str(day))


QUERIES = {
    "panel_daily": lambda s, d: daily(s, d).select("day", "district", "n_total"),
    "panel_wide": lambda s, d: daily(s, d),
    "city_totals": lambda s, d: panel.city_totals(daily(s, d)),
    "category_counts": lambda s, d: feed(s, d).groupBy("category").agg(F.count("*").alias("n")),
    "score_naive": score_query("naive"),
    "score_exp_decay": score_query("exp_decay"),
    "score_dow": score_query("dow"),
    "score_long_run": score_query("long_run"),
    "score_ensemble": score_query("ensemble"),
    "coverage_spans": lambda s, d: panel.coverage_spans(pub_days(feed(s, d))),
    "coverage_summary": lambda s, d: panel.coverage_summary(panel.coverage_spans(pub_days(feed(s, d)))),
    "observed_days": observed,
    "backtest_summary": lambda s, d: hotspot.backtest(daily(s, d), observed(s, d)),
    "forecast_ranking": forecast,
    "marked_as_of": lambda s, d: hotspot.marked(feed(s, d), panel.city_totals(daily(s, d))),
    "known_by_day": lambda s, d: hotspot.known_by(feed(s, d), panel.city_totals(daily(s, d))).select("day", "district", "n_known", F.round("score", 6).alias("score")),
    "timing_posterior": lambda s, d: post(s, d).select("district", "category", "day", "seen", F.round("a", 6).alias("a"), F.round("b", 6).alias("b")),
    "timing_windows": lambda s, d: last_day(timing.windows(post(s, d))),
    "top_offenses": lambda s, d: last_day(timing.top_offenses(post(s, d))).select("district", "category", "day", "seen", "rank"),
    "timing_shown": lambda s, d: last_day(timing.shown(post(s, d))).select("district", "category", "day", "seen", "shown"),
    "timing_backtest": lambda s, d: timing.calibration(timing.backtest(timing.shown(cut(post(s, d))))),
    "timing_marked": lambda s, d: marked_shown(s, d).where("shown").select("district", "category", "day", F.col("seen").cast("long").alias("seen")),
    "timing_block": lambda s, d: timing.calibration(timing.backtest(marked_shown(s, d))).where("cls like 'shown%'"),
    "forecast_document": forecast_rows,
    "test_p_values": p_values,
    "timing_scores": lambda s, d: timing.proper_scores(post(s, d)),
    "timing_reliability": lambda s, d: timing.reliability(post(s, d)),
    "timing_models": lambda s, d: timing.compare(time_grid(s, d)),
    "hotspot_check": lambda s, d: hotspot.check(daily(s, d), observed(s, d)),
    "public_holidays": lambda s, d: panel.holidays(table(s, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()),
    "condition_days": lambda s, d: stats.conditions(totals(s, d), {"weekend": F.col("is_weekend"), "payday": F.col("is_payday"), "holiday": F.col("range_name").isNotNull()}, ["weekend", "payday"]).select("day", "n_total"),
    "calendar_features": features,
    "feature_totals": totals,
    "corr_fisher": lambda s, d: stats.pearson(totals(s, d), "weekday", "n_total"),
    "welch_moments": lambda s, d: stats.welch(totals(s, d), "is_weekend", "n_total"),
    "mann_whitney_u": lambda s, d: stats.mann_whitney(totals(s, d), "is_weekend", "n_total"),
    "bh_fdr": lambda s, d: stats.benjamini_hochberg(feed(s, d).groupBy("district").agg((F.count_if(F.col("id") % 97 < 3) / F.count("*")).alias("p")).select(F.col("district").alias("name"), F.round("p", 6).alias("p"))),
    "block_permutation": lambda s, d: stats.block_permutation(totals(s, d), "weekday", "n_total", 50),
}

FEED = """
feed as (select o_orderkey as id, 'D' || lpad(cast(c_nationkey as varchar), 2, '0') as district, o_orderpriority as category, cast(o_orderdate as date) as day,
  o_orderstatus as status, cast(o_orderdate as date) + cast(o_orderkey % 4 as integer) as pub from orders join customer on o_custkey = c_custkey where c_nationkey < 23)"""


def _pub(src: str) -> str:
    return f"""
pubs as (select distinct pub as day from {src}),
pub_days as (select day from pubs where (date_diff('day', (select min(day) from pubs), day) // 7) % 13 <> 5),
marked_gap as (select day, case when coalesce(date_diff('day', lag(day) over (order by day), day), 8) > 7 then 1 else 0 end as new from pub_days),
numbered as (select day, sum(new) over (order by day) as s from marked_gap),
raw_spans as (select s, min(day) as first, max(day) as last, date_diff('day', min(day), max(day)) + 1 as n_days from numbered group by s),
spans as (select row_number() over (order by first) as span_no, first, last, n_days from raw_spans where n_days >= 5),
observed as (select distinct cast(unnest(generate_series(first - 1, last - 1, interval 1 day)) as date) as day from spans)"""


PANEL = """
span as (select min(day) as a, max(day) as b from feed),
days as (select cast(unnest(generate_series(a, b, interval 1 day)) as date) as day from span),
ds as (select 'D' || lpad(cast(range as varchar), 2, '0') as district from range(23)),
n as (select day, district, count(*) as n_total, """ + ", ".join(f"count(*) filter (where category = '{c}') as n_{k}" for k, c in enumerate(CATEGORIES)) + """ from feed group by all),
panel as (select day, district, coalesce(n_total, 0) as n_total, """ + ", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in range(5)) + """ from days cross join ds left join n using (day, district)),
indexed as (select *, row_number() over (partition by district order by day) - 1 as i from panel),
scored as (select *,
  coalesce(sum(n_total) over (partition by district order by day rows between 7 preceding and 1 preceding), 0) as naive,
  coalesce(sum(n_total * pow(2, i / 7.0)) over (partition by district order by day rows between unbounded preceding and 1 preceding), 0) * pow(2, -(i - 1) / 7.0) as exp_decay,
  coalesce(avg(n_total) over (partition by district, isodow(day) order by day rows between unbounded preceding and 1 preceding), 0) * 7 as dow,
  coalesce(sum(n_total) over (partition by district order by day rows between unbounded preceding and 1 preceding), 0) as long_run from indexed),
ranged as (select *, min(exp_decay) over w as e0, max(exp_decay) over w as e1, min(dow) over w as d0, max(dow) over w as d1 from scored window w as (partition by day)),
models as (select *, (case when e1 - e0 < 1e-9 then 0 else (exp_decay - e0) / (e1 - e0) end + case when d1 - d0 < 1e-9 then 0 else (dow - d0) / (d1 - d0) end) / 2 as ensemble from ranged)"""


def _score(model: str) -> str:
    return f"with {FEED}, {PANEL} select day, district, round(cast({model} as double), 6) as score from models"


GRID = """
sfeed as (select * from feed),""" + _pub("sfeed") + """,
cdays as (select day, date_diff('day', min(day) over (), day) as t, row_number() over (order by day) - 1 as j from observed),
ev as (select district, category, day, count(*) as n from sfeed where day in (select day from observed) group by all
  union all select district, '_any', day, count(*) from sfeed where day in (select day from observed) group by all),
ser as (select * from (select distinct district from sfeed) cross join (select distinct category from sfeed union all select '_any')),
grid as (select district, category, day, t, j, coalesce(n, 0) as n from cdays cross join ser left join ev using (district, category, day)),
runs as (select *, coalesce(sum(n * pow(2, t / 120.0)) over w, 0) * pow(2, -t / 120.0) as nt, coalesce(sum(pow(2, t / 120.0)) over w, 0) * pow(2, -t / 120.0) as exposure, coalesce(sum(n) over w, 0) as seen
  from grid window w as (partition by district, category order by t rows between unbounded preceding and 1 preceding)),
shares as (select *, sum(case when category = '_any' then nt else 0 end) over (partition by t, district) as of_district, sum(case when category = '_any' then nt else 0 end) over (partition by t) as of_city,
  sum(nt) over (partition by t, category) as of_category from runs),
nd as (select count(distinct district) as k from sfeed),
post as (select district, category, day, t, j, n, seen,
  greatest(case when category = '_any' then 7.0 * (of_city / k / greatest(exposure, 1e-9)) else 90.0 * (of_category * (case when of_city > 0 then of_district / of_city else 1.0 / k end) / greatest(exposure, 1e-9)) end + nt, 1e-9) as a,
  (case when category = '_any' then 7.0 else 90.0 end) + exposure as b from shares cross join nd),
top as (select *, row_number() over (partition by district, day order by seen desc, round(a / b, 9) desc, category) as rank from post where category <> '_any'),
busy as (select district, day from (select *, row_number() over (partition by day order by round(a / b, 9) desc, district) as place from post where category = '_any') where place <= 5),
shown as (select p.*, (b2.district is not null and (p.category = '_any' or t3.category is not null)) as shown from post p left join busy b2 using (district, day)
  left join (select district, category, day from top where rank <= 3 and seen >= 3) t3 on p.district = t3.district and p.category = t3.category and p.day = t3.day)"""

TOTALS = """
totals as (select day, sum(n_total) as n_total from panel group by day),
ranges(ord, name, first, last) as (values """ + ", ".join(f"({k}, '{n}', date '{a}', date '{b}')" for k, n, a, b in RANGES) + """),
feats as (select day, isodow(day) - 1 as weekday, isodow(day) >= 6 as is_weekend, day(day) <= 3 as is_payday, (select name from ranges where day between first and last order by ord limit 1) as range_name from totals),
joined as (select * from totals left join feats using (day))"""
_T = f"with {FEED}, {PANEL}, {TOTALS}"
_G = f"with {FEED}, {GRID}"
_C = f"with {FEED}, {_pub('feed')}"
_K = """
first as (select min(day) as first from feed),
known as (select o.day, ds.district, count(f.id) as n_known, coalesce(sum(pow(2, date_diff('day', first, f.day) / 7.0)), 0) * pow(2, -(date_diff('day', first, o.day) - 1) / 7.0) as score
  from {origins} o cross join ds cross join first left join feed f on f.district = ds.district and f.pub < o.day group by o.day, ds.district, first)"""

_TESTED = """cum as (select *, sum(n) over (partition by district, category order by j rows between unbounded preceding and current row) as cum, max(j) over (partition by district, category) as last from shown),
said as (select *, cast(ceil(least(b * (pow(1 - q, -1 / a) - 1), 1e9)) as integer) as win from cum cross join (values (cast(0.5 as double)), (cast(0.8 as double))) as v(q) where j >= 120),
tested as (select s.q, s.category, s.shown, 1 - pow(s.b / (s.b + s.win), s.a) as said, case when z.cum - (s.cum - s.n) > 0 then 1 else 0 end as came from said s join cum z on z.district = s.district and z.category = s.category and z.j = s.j + s.win - 1
  where s.win between 1 and 180 and s.j + s.win <= s.last + 1),
classes as (select q, said, came, 'offense' as cls from tested where category <> '_any' union all select q, said, came, 'any' from tested where category = '_any'
  union all select q, said, came, 'shown_offense' from tested where category <> '_any' and shown union all select q, said, came, 'shown_any' from tested where category = '_any' and shown)
select q, cls, count(*) as n, cast(sum(came) as bigint) as n_true, round(avg(said), 6) as said, round(avg(came), 6) as came_true from classes"""
_MARKED = """first as (select min(day) as first from feed),
known as (select o.day, ds.district, coalesce(sum(pow(2, date_diff('day', first, f.day) / 7.0)), 0) * pow(2, -(date_diff('day', first, o.day) - 1) / 7.0) as score
  from cdays o cross join (select distinct district from feed) ds cross join first left join feed f on f.district = ds.district and f.pub < o.day group by o.day, ds.district, first),
mk as (select day, district from (select *, row_number() over (partition by day order by round(score, 9) desc, district) as rank from known) where rank <= 5),
mshown as (select p.*, (mk.district is not null and (p.category = '_any' or t3.category is not null)) as shown from post p left join mk using (district, day)
  left join (select district, category, day from top where rank <= 3 and seen >= 3) t3 on p.district = t3.district and p.category = t3.category and p.day = t3.day)"""

_BACKTEST = f"""with {FEED}, {_pub('feed')}, {PANEL},
obs as (select m.*, case when o.day is null then 0 else 1 end as obs from models m left join observed o using (day)),
tested as (select *, case when sum(n_total) over a > 0 then 1 else 0 end as hot, count(*) over a as k, min(obs) over a as all_obs, coalesce(sum(obs) over b, 0) as before from obs
  window a as (partition by district order by day rows between current row and 6 following), b as (partition by district order by day rows between unbounded preceding and 1 preceding)),
st as (unpivot (select day, district, hot, cast(naive as double) as naive, cast(exp_decay as double) as exp_decay, cast(dow as double) as dow, cast(long_run as double) as long_run, cast(ensemble as double) as ensemble from tested where k = 7 and all_obs = 1 and before >= 21)
  on naive, exp_decay, dow, long_run, ensemble into name model value score),
rk as (select *, row_number() over (partition by model, day order by round(score, 9) desc, district) as rank from st),
per as (select model, day, sum(case when rank <= 5 then hot else 0 end) as hits, sum(hot) as hot, count(*) as n from rk group by model, day)
select model, count(*) as test_days, cast(sum(hits) as bigint) as hits, cast(sum(hot) as bigint) as hot_districts, round(sum(hits) / (count(*) * 5), 6) as precision_at_k, round(sum(hot) / sum(n), 6) as random_rate,
  round((sum(hits) / (count(*) * 5)) / (sum(hot) / sum(n)), 6) as lift, round(avg(case when hits > 0 then 1 else 0 end), 6) as any_hit from per group by model"""

SQL = {
    "panel_daily": f"with {FEED}, {PANEL} select day, district, n_total from panel",
    "panel_wide": f"with {FEED}, {PANEL} select * from panel",
    "city_totals": f"with {FEED}, {PANEL} select day, cast(sum(n_total) as bigint) as n_total from panel group by day",
    "category_counts": f"with {FEED} select category, count(*) as n from feed group by category",
    **{f"score_{m}": _score(m) for m in hotspot.MODELS},
    "coverage_spans": f"{_C} select * from spans",
    "coverage_summary": f"{_C} select min(first) as first_day, max(last) as last_day, cast(sum(n_days) as bigint) as n_covered, date_diff('day', min(first), max(last)) + 1 as n_days, count(*) - 1 as n_holes from spans",
    "observed_days": f"{_C} select day from observed",
    "backtest_summary": _BACKTEST,
    "hotspot_check": f"""with b as ({_BACKTEST}), r as (select max(test_days) as test_days, max(case when model = 'ensemble' then precision_at_k end) as hit_rate, max(case when model = 'ensemble' then random_rate end) as random_rate,
  max(case when model = 'long_run' then precision_at_k end) as always_busiest from b)
select *, 'Trefferquote ' || printf('%.0f', hit_rate * 100) || ' %, zufällig ' || printf('%.0f', random_rate * 100) || ' %, immer die meistgenannten ' || printf('%.0f', always_busiest * 100) || ' %: ' ||
  case when hit_rate > always_busiest + 0.02 then 'besser als die einfache Regel.' else 'nicht besser als die einfache Regel.' end as note from r where test_days is not null""",
    "public_holidays": f"""with y as (select distinct cast(year(o_orderdate) as integer) as y from orders),
e1 as (select y, y % 19 as a, y // 100 as b, y % 100 as c from y),
e2 as (select *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 as h from e1),
e3 as (select *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 as w from e2),
e4 as (select y, h + w - 7 * ((a + 11 * h + 22 * w) // 451) + 114 as n from e3),
e as (select y, make_date(y, n // 31, n % 31 + 1) as easter from e4)
select make_date(y, m, d) as day, name as holiday from y cross join (values {', '.join(str(x) for x in panel.FIXED_HOLIDAYS)}) as f(name, m, d)
union all select easter + o, name from e cross join (values {', '.join(str(x) for x in panel.EASTER_HOLIDAYS)}) as f(name, o)""",
    "forecast_ranking": f"""with {FEED}, span0 as (select max(day) + 1 as nxt from feed), {PANEL.replace("select min(day) as a, max(day) as b from feed", "select min(day) as a, max(day) + 1 as b from feed")},
today as (select district, round(ensemble, 9) as score from models where day = (select nxt from span0)),
rk as (select district, round(score, 6) as score, row_number() over (order by score desc, district) as rank from today)
select *, rank <= 5 as elevated from rk""",
    "marked_as_of": f"with {FEED}, {PANEL}, {_K.format(origins="days")} select day, district, rank, n_known from (select *, row_number() over (partition by day order by round(score, 9) desc, district) as rank from known) where rank <= 5",
    "known_by_day": f"with {FEED}, {PANEL}, {_K.format(origins="days")} select day, district, n_known, round(score, 6) as score from known",
    "timing_posterior": f"{_G} select district, category, day, cast(seen as bigint) as seen, round(a, 6) as a, round(b, 6) as b from post",
    "timing_windows": f"""{_G} select district, category, day, cast(seen as bigint) as seen, round(a / b * 30, 6) as rate_per_30d, round(1 - pow(b / (b + 14), a), 6) as p14, round(1 - pow(b / (b + 30), a), 6) as p30,
  case when ceil(least(b * (pow(0.5, -1 / a) - 1), 1e9)) <= 180 then cast(ceil(b * (pow(0.5, -1 / a) - 1)) as integer) end as t50,
  case when ceil(least(b * (pow(1.0 - 0.8, -1 / a) - 1), 1e9)) <= 180 then cast(ceil(b * (pow(1.0 - 0.8, -1 / a) - 1)) as integer) end as t80 from post where day = (select max(day) from post)""",
    "top_offenses": f"{_G} select district, category, day, cast(seen as bigint) as seen, rank from top where rank <= 3 and day = (select max(day) from post)",
    "timing_shown": f"{_G} select district, category, day, cast(seen as bigint) as seen, shown from shown where day = (select max(day) from post)",
    "timing_backtest": f"""{_G}, {_TESTED} group by q, cls""",
    "timing_marked": f"""{_G}, {_MARKED} select district, category, day, cast(seen as bigint) as seen from mshown where shown""",
    "timing_block": f"""{_G}, {_MARKED}, {_TESTED.replace("from shown)", "from mshown)")} where cls like 'shown%' group by q, cls""",
    "forecast_document": f"""with {FEED}, {GRID}, nxt as (select greatest((select max(day) from feed), (select max(day) from observed)) + 1 as nxt), {PANEL.replace("select min(day) as a, max(day) as b from feed", "select min(day) as a, (select nxt from nxt) as b from feed")},
c as (select 'D' || lpad(cast(row_number() over (order by stadtteil) - 1 as varchar), 2, '0') as district, lat, lon from (select stadtteil, arg_min(lat, forecast_id) as lat, arg_min(lon, forecast_id) as lon from forecast where area_no in (0, 1) group by stadtteil)),
today as (select district, round(ensemble, 9) as score from models where day = (select nxt from nxt)),
rk as (select district, score, row_number() over (order by score desc, district) as rank from today),
w as (select district, count(*) as n_said, round(sum(round(1 - pow(b / (b + 14), a), 6)), 4) as sum_p14 from post where day = (select max(day) from post) group by district)
select (select nxt from nxt) as generated_for, district, round(lat, 5) as lat, round(lon, 5) as lon, round(round(score, 6), 3) as score, rank, rank <= 5 as elevated, cast(n_said as integer) as n_said, sum_p14 from rk join c using (district) left join w using (district)""",
    "timing_scores": f"""{_G},
ys as (select *, case when sum(n) over w > 0 then 1 else 0 end as y, count(*) over w as k from post window w as (partition by district, category order by j rows between current row and 13 following)),
ps as (select case when category = '_any' then 'any' else 'offense' end as cls, y, 1 - pow(b / (b + 14), a) as p from ys where k = 14 and j >= 120),
s as (select cls, count(*) as n, sum(y) as n_true, avg(p) as mean_p, avg(-(y * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - y) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)))) as log_loss, avg(pow(p - y, 2)) as brier, avg(y) as base from ps group by cls)
select cls, n, cast(n_true as bigint) as n_true, round(mean_p, 6) as mean_p, round(log_loss, 6) as log_loss, round(brier, 6) as brier, case when base * (1 - base) > 0 then round(1 - brier / (base * (1 - base)), 6) end as skill from s""",
    "timing_reliability": f"""{_G},
ys as (select *, case when sum(n) over w > 0 then 1 else 0 end as y, count(*) over w as k from post window w as (partition by district, category order by j rows between current row and 13 following)),
ps as (select y, round(1 - pow(b / (b + 14), a), 9) as p from ys where k = 14 and j >= 120)
select case when p < 0.05 then 0 when p < 0.15 then 1 when p < 0.3 then 2 when p < 0.6 then 3 else 4 end as bin, count(*) as n, round(avg(p), 6) as mean_p, cast(sum(y) as bigint) as n_true from ps group by bin""",
    "timing_models": f"""with {FEED}, {GRID.split("runs as")[0]}
par as (select * from (values (cast(30.0 as double)), (60.0), (120.0), (240.0), (480.0)) as h(half_life) cross join (values (cast(15.0 as double)), (30.0), (60.0), (90.0), (180.0)) as p(prior)),
runs as (select *, coalesce(sum(n * pow(2, t / half_life)) over w, 0) * pow(2, -t / half_life) as nt, coalesce(sum(pow(2, t / half_life)) over w, 0) * pow(2, -t / half_life) as exposure
  from grid cross join par window w as (partition by half_life, prior, district, category order by t rows between unbounded preceding and 1 preceding)),
shares as (select *, sum(case when category = '_any' then nt else 0 end) over (partition by half_life, prior, t, district) as of_district, sum(case when category = '_any' then nt else 0 end) over (partition by half_life, prior, t) as of_city,
  sum(nt) over (partition by half_life, prior, t, category) as of_category from runs),
nd as (select count(distinct district) as k from sfeed),
post as (select *, greatest(prior * (of_category * (case when of_city > 0 then of_district / of_city else 1.0 / k end) / greatest(exposure, 1e-9)) + nt, 1e-9) as a, prior + exposure as b from shares cross join nd),
ys as (select *, case when sum(n) over w > 0 then 1 else 0 end as y, count(*) over w as full_days from post where category <> '_any' window w as (partition by half_life, prior, district, category order by j rows between current row and 13 following)),
ps as (select half_life, prior, y, 1 - pow(b / (b + 14), a) as p from ys where full_days = 14 and j >= 120 and (j - 120) % 2 = 0)
select half_life, prior, count(*) as n, round(avg(-(y * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - y) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)))), 6) as log_loss, round(avg(pow(p - y, 2)), 6) as brier from ps group by half_life, prior""",
    "condition_days": f"{_T} select day, cast(n_total as bigint) as n_total from joined where is_weekend and is_payday",
    "calendar_features": f"{_T} select * from feats",
    "feature_totals": f"{_T} select day, cast(n_total as bigint) as n_total, weekday, is_weekend, is_payday, range_name from joined",
    "corr_fisher": f"{_T}, r as (select count(*) as n, corr(n_total, weekday) as r from joined) select n, round(r, 6) as r, round(tanh(atanh(r) - 1.959964 / sqrt(n - 3)), 6) as low, round(tanh(atanh(r) + 1.959964 / sqrt(n - 3)), 6) as high from r",
    "welch_moments": f"""{_T}, m as (select count(*) filter (where is_weekend) as n1, count(*) filter (where not is_weekend) as n0, avg(n_total) filter (where is_weekend) as m1, avg(n_total) filter (where not is_weekend) as m0,
  var_samp(n_total) filter (where is_weekend) as v1, var_samp(n_total) filter (where not is_weekend) as v0 from joined)
select n1, n0, round(m1, 6) as mean1, round(m0, 6) as mean0, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) as t, round(pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)), 4) as dof from m""",
    "mann_whitney_u": f"""{_T}, r as (select is_weekend as f, n_total as y, rank() over (order by n_total) + (count(*) over (partition by n_total) - 1) / 2.0 as rk, count(*) over (partition by n_total) as t from joined),
s as (select count(*) as n, count(*) filter (where f) as n1, count(*) filter (where not f) as n0, sum(rk) filter (where f) as r1, sum(t * t - 1.0) as ties from r),
u as (select *, r1 - n1 * (n1 + 1) / 2 as u from s)
select n1, n0, round(cast(u as double), 1) as u, round((greatest(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5) / sqrt(n1 * n0 / 12 * ((n + 1) - ties / (n * (n - 1.0)))), 6) as z from u""",
    "bh_fdr": f"""with {FEED}, t as (select district as name, round(count(*) filter (where id % 97 < 3) / count(*), 6) as p from feed group by district),
r as (select *, row_number() over (order by p, name) as rank, count(*) over () as n from t),
l as (select max(rank) as last from r where p <= rank / n * 0.05)
select name, p, rank, coalesce(rank <= last, false) as kept from r cross join l""",
}
