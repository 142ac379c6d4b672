"""Registered queries take all rows of the feed and return all of their results."""

import math
from datetime import datetime
from itertools import combinations

from wachbuch.operators import series
from wachbuch.operators.components import components
from wachbuch.plans import incidents, texts


def metres(p, q):
    a, b, c, d = map(math.radians, (p.lat, p.lon, q.lat, q.lon))
    return 2 * 6371000 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))


def roots(rows, most, days):
    root = {r.id: r.id for r in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, q in combinations(rows, 2):
        if p.category == q.category and abs((p.day - q.day).days) <= days and metres(p, q) <= most:
            a, b = sorted((top(p.id), top(q.id)))
            root[b] = a
    return {x: top(x) for x in root}


def test_series_and_followups_of_the_whole_feed(spark, data):
    rows = texts.points(spark, data).collect()
    assert {r.id for r in rows} == {r.id for r in incidents.feed(spark, data).select("id").collect()}
    near = roots(rows, 400, 0)
    assert {r.id for r in texts.QUERIES["followup_dedupe"](spark, data).collect()} == {x for x in near if near[x] == x}
    series = {}
    for x, r in roots(rows, 1000, 14).items():
        series.setdefault(r, []).append(x)
    want = {r: len(m) for r, m in series.items() if len(m) >= 3}
    assert {r.root: r.n for r in texts.QUERIES["series_clusters"](spark, data).collect()} == want
    assert {r.root: r.n for r in texts.QUERIES["series_spread"](spark, data).collect()} == want


def test_components_of_a_long_chain_in_few_rounds(spark):
    x = [(k * 7919) % 3001 for k in range(3001)]
    edges = spark.createDataFrame(list(zip(x, x[1:])), "a long, b long")
    got = components(edges, max_rounds=16).collect()
    assert {r.node for r in got} == set(x) and {r.root for r in got} == {0}


def test_posterior_of_every_day(spark, data):
    got = incidents.QUERIES["timing_posterior"](spark, data)
    days = {r.day for r in incidents.time_grid(spark, data).select("day").distinct().collect()}
    series = {(r.district, r.category) for r in got.select("district", "category").distinct().collect()}
    assert {(r.district, r.category, r.day) for r in got.collect()} == {(*s, x) for s in series for x in days}


def test_a_text_without_references_has_none(spark, tmp_path):
    told = {1: "Siehe PM 7/26, pm 12 / 2025 und PM 07/26, PM 7/2026.", 2: "Ohne Verweis.", 3: "", 4: None}
    spark.createDataFrame([*told.items()], "court_doc_id long, text string").write.parquet(str(tmp_path / "raw_courts.parquet"))
    got = {r.court_doc_id: r.refs for r in texts.QUERIES["release_refs"](spark, str(tmp_path)).collect()}
    assert got == {1: "7/2026|12/2025|07/2026", 2: None, 3: None, 4: None}


def test_csv_gives_back_empty_and_missing_values(spark, tmp_path):
    odd = ["", None, " ", "\t", "\n", "a\r\nb", "a\r", '"', '""', '"a", b', "a\\", "null", "\ufeffx", "\x00", "a\u2028b", "#x", ""]
    rows = [(k, x, odd[-1 - k], x, datetime(2026, 5, 4, 23, 59) if k % 2 else None) for k, x in enumerate(odd)]
    spark.createDataFrame(rows, "rec_id long, pm_id string, title string, publish_date string, fetched_at timestamp_ntz").write.parquet(str(tmp_path / "press_releases.parquet"))
    got = sorted(tuple(r) for r in texts.QUERIES["csv_round_trip"](spark, str(tmp_path)).collect())
    assert got == [(*r[:4], r[4] and r[4].date()) for r in rows]


def dense(spark, monkeypatch):
    """Makes the feed two crowds about 8 km apart; returns the numbers of links that series are made from."""
    lat, lon = "53 + (id * 7919 % 400) / 1e5 + (id % 2) * 0.07 as lat", "8.8 + (id * 104729 % 600) / 1e5 as lon"
    df = spark.range(2000).selectExpr("id", "'a' as category", "date_add(date'2026-01-01', cast(id % 20 as int)) as day", lat, lon)
    links, join = [], series.components

    def counted(edges, *args):
        links.append(edges.count())
        return join(edges, *args)

    monkeypatch.setattr(texts, "points", lambda s, d: df)
    monkeypatch.setattr(series, "components", counted)
    return links


def test_clusters_of_a_dense_feed_need_few_links(spark, monkeypatch):
    links = dense(spark, monkeypatch)
    assert {(r.root, r.n) for r in texts.QUERIES["series_clusters"](spark, "").collect()} == {(0, 1000), (1, 1000)}
    assert sum(links) < 2000


def test_spread_of_a_dense_feed_needs_few_links(spark, monkeypatch):
    links = dense(spark, monkeypatch)
    points = texts.points(spark, "").collect()
    for r in texts.QUERIES["series_spread"](spark, "").collect():
        own = [p for p in points if p.id % 2 == r.root]
        far = max(metres(p, q) for p in own[::5] for q in own)
        assert r.n == 1000 and far * 0.998 - 1 <= r.max_spread_m <= 800
        assert abs(r.centroid_lat - sum(p.lat for p in own) / 1000) <= 1e-5
    assert sum(links) < 2000
