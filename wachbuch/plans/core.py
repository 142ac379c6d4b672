"""Queries of the general data operators, as ``name -> (spark, folder) -> DataFrame``."""

from __future__ import annotations

from wachbuch.operators import proximity, snapshots, timestamps
from wachbuch.session import table

QUERIES = {
    "p1_found": lambda s, d: timestamps.found(table(s, d, "press_releases")),
    "p4_found": lambda s, d: proximity.found(table(s, d, "series"), table(s, d, "forecast")),
    "p6_found": lambda s, d: snapshots.changes(table(s, d, "release_snapshots")),
}

_HAV = "2 * 6371000.0 * asin(sqrt(least(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2), 1.0)))"
_SPACE = r"'[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+'"
_CLOCK = r"(?:(?:, ?| )(?:um |gegen |ca\. |zwischen )?(\d{1,2})(?:[.:](\d{2}))?(?:[.:](\d{2}))?(?: ?Uhr)?(?: (?:bis|und) \d{1,2}(?:[.:]\d{2})?(?: Uhr)?)? ?\(?(UTC|MESZ|MEZ)?\)?)?"
_ZONED = r"(\d{2}):(\d{2})(?::(\d{2})(?:\.\d+)?)? ?(Z|UTC|GMT|[+-]\d{2}:?\d{2}|Europe/Berlin)?"
_READ = {
    "dotted": (r"^\(?(\d{1,2})\. ?(\d{1,2})\. ?(\d{4}|\d{2})" + _CLOCK + r"\)?$", "d m y h i sec z"),
    "named": (r"^(\d{1,2})\. (\p{L}+) (\d{4})" + _CLOCK + "$", "d m y h i sec z"),
    "iso": (r"^(\d{4})-(\d{2})-(\d{2})(?:[T ]" + _ZONED + ")?$", "y m d h i sec z"),
    "basic": (r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(Z)?$", "y m d h i sec z"),
    "mail": (r"^(\d{1,2}) (\p{L}+) (\d{4}) " + _ZONED + "$", "d m y h i sec z"),
    "us": (r"^(\p{L}+) (\d{1,2}), (\d{4}) (\d{1,2}):(\d{2})(?::(\d{2}))? (AM|PM) ?(CEST|CET)?$", "m d y h i sec half z"),
}
_MONTH_CASE = "case " + " ".join(f"when lower(m) in ({', '.join(repr(k) for k, v in timestamps.MONTHS.items() if v == n)}) then {n}" for n in range(1, 13)) + " else try_cast(m as integer) end"


def _part(name: str) -> str:
    """The named part of whichever pattern fits."""
    return "coalesce(" + ", ".join(f"nullif({f}.{name}, '')" for f, (_, ns) in _READ.items() if name in ns.split()) + ")"


_P1 = f"""with raw as (select rec_id, 'zeit_raw' as field, zeit_raw as v from press_releases union all select rec_id, 'publish_date', publish_date from press_releases),
s as (select rec_id, field, regexp_replace(trim(regexp_replace(v, {_SPACE}, ' ', 'g')), '^((Mon|Diens|Donners|Frei|Sams|Sonn)tag|Mittwoch|Mon|Tue|Wed|Thu|Fri|Sat|Sun), ', '') as s from raw where v is not null),
p as (select *, {", ".join(f"regexp_extract(s, '{r}', [{', '.join(repr(n) for n in ns.split())}]) as {f}" for f, (r, ns) in _READ.items())} from s),
c as (select rec_id, field, try_cast(regexp_extract(s, '^(\\d{{10}})(\\d{{3}})?$', 1) as bigint) as epoch, {", ".join(f"{_part(n)} as {n}" for n in ("y", "m", "d", "h", "i", "sec", "z", "half"))} from p),
t as (select *, try_cast(lpad(case when length(y) = 2 then '20' || y else y end, 4, '0') || '-' || lpad(cast({_MONTH_CASE} as varchar), 2, '0') || '-' || lpad(d, 2, '0') as date) as day,
  case when half is null then cast(h as integer) else cast(h as integer) % 12 + case when half = 'PM' then 12 else 0 end end as hour,
  case when z in ('Z', 'UTC', 'GMT') then 0 when z in ('MESZ', 'CEST') then 7200 when z in ('MEZ', 'CET') then 3600 when z[1] in ('+', '-') then (case when z[1] = '-' then -1 else 1 end) * (cast(z[2:3] as integer) * 3600 + cast(right(z, 2) as integer) * 60) end as off from c),
u as (select *, day + to_hours(hour) + to_minutes(coalesce(cast(i as integer), 0)) + to_seconds(coalesce(cast(sec as integer), 0)) as wall from t where (h is null or hour between 0 and 23)),
w as (select *, case when epoch is not null then make_timestamp(epoch * 1000000) when off is not null then wall - to_seconds(off)
  when timezone('Europe/Berlin', timezone('UTC', wall - interval 2 hour)) = wall then wall - interval 2 hour else wall - interval 1 hour end as utc from u)
select rec_id, field, case when field = 'zeit_raw' and utc is not null then strftime(utc, '%Y-%m-%d %H:%M:%S') when utc is not null then strftime(timezone('Europe/Berlin', timezone('UTC', utc)), '%Y-%m-%d') else strftime(day, '%Y-%m-%d') end as norm
from w where utc is not null or day is not null"""
_FIELDS = ("title", "publish_date", "ort_raw", "zeit_raw", "text")

SQL: dict[str, str] = {
    "p1_found": _P1,
    "p4_found": f"""with s as (select series_id as id, centroid_lat as lat, centroid_lon as lon from series where centroid_lat is not null and centroid_lon is not null and not isnan(centroid_lat) and not isnan(centroid_lon) and not (centroid_lat = 0 and centroid_lon = 0)),
f as (select forecast_id as id, lat, lon from forecast where lat is not null and lon is not null and not isnan(lat) and not isnan(lon) and not (lat = 0 and lon = 0))
select 'series' as kind, a.id as id_a, b.id as id_b from s a join s b on a.id < b.id and b.lat between a.lat - 0.003 and a.lat + 0.003 where {_HAV.format(a='a.lat', b='a.lon', c='b.lat', d='b.lon')} <= 300
union all select 'forecast', a.id, b.id from s a join f b on b.lat between a.lat - 0.014 and a.lat + 0.014 where {_HAV.format(a='a.lat', b='a.lon', c='b.lat', d='b.lon')} <= 1500""",
    "p6_found": f"""with r as (select cast(snapshot_no as bigint) as s, delivered_at, snap_row_id, cast(regexp_extract(trim(regexp_replace(pm_id, {_SPACE}, ' ', 'g')), '^0*(\\d{{1,18}})(?:\\.0*)?$', 1) as bigint) as no,
  cast(regexp_extract(regexp_replace(source_url, '[?#].*$', ''), '(\\d{{1,18}})/*$', 1) as bigint) as page, {", ".join(f"nullif(trim(regexp_replace({c}, {_SPACE}, ' ', 'g')), '') as {c}" for c in _FIELDS)} from release_snapshots),
k as (select * from r qualify row_number() over (partition by s, no, page order by delivered_at desc, snap_row_id desc) = 1)
select n.s as snapshot_no, n.no as pm_no, n.page as page_no, 'added' as change_kind from k n left join k o on o.s = n.s - 1 and o.no = n.no and o.page = n.page where n.s > 1 and o.s is null
union all select o.s + 1, o.no, o.page, 'removed' from k o left join k n on n.s = o.s + 1 and o.no = n.no and o.page = n.page where o.s < (select max(s) from k) and n.s is null
union all select n.s, n.no, n.page, 'changed' from k n join k o on o.s = n.s - 1 and o.no = n.no and o.page = n.page where {" or ".join(f"n.{c} is distinct from o.{c}" for c in _FIELDS)}""",
}
