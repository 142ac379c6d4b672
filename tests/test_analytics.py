import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wachbuch.operators import archive, exports, hotspot, panel, series, stats, timing
from wachbuch.operators.components import components
from wachbuch.operators.skew import split_join
from wachbuch.sources import files, pages, sinks
from wachbuch.streaming import jobs

START = date(2025, 1, 1)


def history(spark, days=200, rate=0.2, holes=(), seed=1):
    rnd = random.Random(seed)
    rows = [(START + timedelta(d), f"D{k}", "Raub" if rnd.random() < 0.5 else "Einbruch") for d in range(days) for k in range(4) if rnd.random() < rate and not any(a <= d <= b for a, b in holes)]
    covered = [(START + timedelta(d),) for d in range(days) if not any(a <= d <= b for a, b in holes)]
    return spark.createDataFrame(rows, "day date, district string, category string"), spark.createDataFrame(covered, "day date")


def test_no_look_ahead(spark):
    e, c = history(spark, 90)
    cut = START + timedelta(60)
    changed = e.where(F.col("day") < F.lit(cut)).unionByName(e.where(F.col("day") >= F.lit(cut)).unionByName(e.where(F.col("day") >= F.lit(cut))))
    ds = e.select("district").distinct()
    for f in (lambda x: hotspot.scores(panel.daily(x, ds)).select("day", "district", *[F.round(m, 9) for m in hotspot.MODELS]), lambda x: timing.posterior(timing.grid(x, c)).select("day", "district", "category", F.round("a", 9), F.round("b", 9))):
        a, b = (sorted(map(tuple, f(x).where(F.col("day") <= F.lit(cut)).collect())) for x in (e, changed))
        assert a == b


def test_holes_change_no_rate(spark):
    e, c = history(spark, 240, holes=((100, 179),))
    last = timing.posterior(timing.grid(e, c)).where((F.col("category") == timing.ANY) & (F.col("day") == F.lit(START + timedelta(239))))
    rates = [r.a / r.b for r in last.collect()]
    assert abs(sum(rates) / len(rates) - 0.2) < 0.05


def test_spans_split_only_beyond_seven_days(spark):
    days = [0, 1, 2, 3, 4, 5, 12, 13, 14, 15, 16, 17, 18, 26, 27, 40]
    d = spark.createDataFrame([(START + timedelta(x),) for x in days], "day date")
    got = [((r["first"] - START).days, (r["last"] - START).days) for r in panel.coverage_spans(d).collect()]
    assert got == [(0, 18)]


def test_components_and_split_join(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (None, 1), (3, 1), (7, 6), (6, 5)], "a long, b long")
    assert {r.node: r.root for r in components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4}
    assert components(e.where("false")).count() == 0
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    assert components(chain).where("root <> 0").count() == 0
    left = spark.createDataFrame([(k % 3, k) for k in range(60)] + [(None, 99)], "k int, x int")
    right = spark.createDataFrame([(0, k) for k in range(100)] + [(1, 7), (None, 8)], "k int, y int")
    assert split_join(left, right, ["k"], 10).count() == left.join(right, "k").count() == 2020


def test_series_against_brute_force_in_any_order(spark):
    rnd = random.Random(2)
    rows = [(k, rnd.choice("ab"), START + timedelta(rnd.randrange(60)), 53 + rnd.random() * 0.02, 8.8 + rnd.random() * 0.02) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, category string, day date, lat double, lon double")
    from tests.test_proximity import metres

    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and abs((a[2] - b[2]).days) <= 7 and metres(*a[3:], *b[3:]) <= 500}
    assert {(r.a, r.b) for r in series.close_pairs(df, 500.0, 7).collect()} == want
    again = spark.createDataFrame(rows[::-1], df.schema)
    one, two = (sorted(map(str, series.find(x, 500.0, 7).collect())) for x in (df, again))
    assert one == two and one
    assert series.without_followups(df, 30.0).count() <= 120
    where = {r[0]: r for r in rows}
    for r in series.find(df, 500.0, 7).collect():
        far = max(metres(*where[a][3:], *where[b][3:]) for a in r.ids for b in r.ids)
        assert abs(r.max_spread_m - far) <= 1 + 0.002 * far


def test_statistics(spark):
    rnd = random.Random(4)
    df = spark.createDataFrame([(k, k % 2 == 0, float(k % 7), float(k % 7) + rnd.random()) for k in range(100)], "i int, f boolean, x double, y double")
    r = stats.pearson(df, "x", "y").first()
    assert 0.9 < r.low < r.r < r.high < 1
    assert stats.student_p(2.0, 10) == pytest.approx(0.0734, abs=2e-4) and stats.normal_p(1.96) == pytest.approx(0.05, abs=1e-3)
    assert stats.welch(df.limit(3), "f", "y").count() == 0
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "name string, p double")
    assert {x.name for x in stats.benjamini_hochberg(t).where("kept").collect()} == {"a"}
    with pytest.raises(ValueError):
        stats.conditions(df, {"a": F.lit(True)}, ["b"])


def test_archive_never_forgets(spark):
    cols = ", ".join(f"{f} string" for f in archive.FIELDS) + ", version string, pos long"
    old = ("1", "T", "1.1.2026", "Bremen", None, "x" * 100, "u")
    short = ("1", "T", "1.1.2026", None, None, "x" * 10, "u")
    other = ("1", "U", "1.1.2026", "Bremen", None, "ganz anders, mit anderen Worten und Zahlen 123", "u")
    nothing = (None, None, None, None, None, None, None)
    rows = [(*r, v, 0) for v, r in zip("1234567", (old, short, other, nothing, old, (None, None, "2.1.2026", None, None, "eins zwei drei", "u"), nothing), strict=True)]
    got = {r.key: tuple(r)[1:] for r in archive.merge(spark.createDataFrame(rows, cols)).collect()}
    assert got["1"] == old and len(got) == 4 and sum(k.startswith("1#") for k in got) == 1 and sum(k.startswith("no-id:") for k in got) == 2
    assert archive.merge(spark.createDataFrame([], cols)).count() == 0


def test_share_of_text_found_again():
    assert archive.found_again("", "x") == 0 and archive.found_again("abcdefghij", "abcdefghiX") == 0.9 == archive.found_again("abcdefghiX and more", "abcdefghij")


def test_merge_and_stream_merge(spark, tmp_path):
    cols = ", ".join(f"{f} string" for f in archive.FIELDS)
    v = spark.createDataFrame([("1", "T", None, "o", None, "text eins zwei drei", "u", "1", 0), ("1", "T", "d", None, None, "text eins zwei drei", "u", "2", 0), (None, "N", None, None, None, None, "u", "1", 1)], f"{cols}, version string, pos long")
    got = {r.key: (r.publish_date, r.ort_raw) for r in archive.merge(v).collect()}
    assert got == {"1": ("d", "o"), "no-id:N": (None, None)}
    run = jobs.merging(str(tmp_path / "a"))
    run(v.where("version = '1'"), 0)
    run(v.where("version = '2'"), 1)
    assert {r.key: (r.publish_date, r.ort_raw) for r in spark.read.parquet(str(tmp_path / "a/generation=1")).collect()} == got


def test_pages(spark):
    html = '<html><div class="entry-wrapper-1col" id="7"><h2> A &amp; B </h2><p>(1.2.26)</p><p>Ort: Bremen<br>Zeit: 3.4.26</p><p>Eins<br>zwei</p></div><div class="x"></div><div class="entry-wrapper-1col" id=""><h2>C</h2><p>(1.2.2026)<br>Ort: Hier</p><p>Ort: dort'
    df = spark.createDataFrame([("u", html), ("v", None), ("w", "")], "url string, html string")
    got = [(r.pm_id, r.title, r.publish_date, r.ort_raw, r.zeit_raw, r.text) for r in pages.parse(df).orderBy("pos").collect()]
    assert got == [("7", "A & B", "01.02.2026", "Bremen", "3.4.26", "Eins\nzwei"), ("", "C", "01.02.2026", "Hier", None, "Ort: dort")]
    assert pages.complete(df).count() == 0


def test_files_and_sinks(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"pm_id": "1", "title": "a b"}\n{"pm_id": "2", "ti', encoding="utf-8")
    good, bad = files.jsonl_tolerant(spark, str(p), "pm_id string, title string")
    assert [r.title for r in good.collect()] == ["a b"] and bad.count() == 1
    with pytest.raises(Exception):
        files.jsonl(spark, str(p), "pm_id string, title string").collect()
    df = spark.createDataFrame([(1, float("nan")), (2, 1.5)], "key int, x double")
    sinks.publish({"a": df}, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out/a")).collect()) == ['{"key":1}', '{"key":2,"x":1.5}']
    with pytest.raises(sinks.Shrunk):
        sinks.write_archive(df, str(tmp_path / "x"), str(tmp_path / "y"), 3)
    log = str(tmp_path / "log")
    assert sinks.append_new(spark, df, log, "key").count() == 2 and sinks.append_new(spark, df, log, "key").count() == 0
    with pytest.raises(ValueError):
        sinks.document({"x": float("nan")})


def test_stale_input_is_refused(spark):
    rel = spark.createDataFrame([("1", "t", "x", "Bremen-Mitte", None, "1.1.2026", "u")], "pm_id string, title string, text string, ort_raw string, zeit_raw string, publish_date string, source_url string")
    inc = exports.incidents(rel, "2026-02-01")
    exports.check_fresh(rel, inc)
    assert [tuple(r) for r in inc.select("key", "district", "day").collect()] == [("1", "Mitte", date(2026, 1, 1))]
    with pytest.raises(exports.Stale):
        exports.check_fresh(rel, inc.where("false"))


def test_update_gate(spark):
    now = datetime(2026, 1, 3, 12)
    h = lambda x: None if x is None else now - timedelta(hours=x)
    rows = [(h(None), h(None)), (h(3), h(3)), (h(30), h(30)), (h(30), h(0.5)), (h(30), h(3))]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, d timestamp, t timestamp")
    got = [r.g for r in df.select("k", jobs.hour_gate(F.col("d"), F.col("t"), F.lit(now)).alias("g")).orderBy("k").collect()]
    assert got == [True, False, True, False, True]


def test_holidays(spark):
    got = {(str(r.day), r.holiday) for r in panel.holidays(spark.createDataFrame([(2024,), (2025,), (2025,), (None,)], "year int")).collect()}
    assert len(got) == 20 and {("2024-03-29", "Karfreitag"), ("2025-04-21", "Ostermontag"), ("2025-05-29", "Christi Himmelfahrt"), ("2025-06-09", "Pfingstmontag"), ("2024-10-31", "Reformationstag")} <= got


def test_archive_comes_back_from_its_copy(spark):
    cols = ", ".join(f"{f} string" for f in archive.FIELDS)
    a = spark.createDataFrame([("1", "T", None, None, None, "x", "u")], cols)
    b = spark.createDataFrame([("1", "T", "d", None, None, "x", "u"), ("2", "U", None, None, None, "y", "u")], cols)
    assert sorted((r.key, r.publish_date) for r in archive.load(a, b).collect()) == [("1", "d"), ("2", None)]
    assert [r.key for r in archive.lost(archive.load(b, b), archive.load(a, a)).collect()] == ["2"]


def test_p_values_and_marked_districts(spark):
    t = spark.createDataFrame([("a", "t", 2.0, 10.0), ("b", "z", 1.96, 0.0), ("c", "r", 0.5, 20.0), ("d", "t", None, 5.0)], "name string, kind string, statistic double, dof double")
    got = {r.name: r.p for r in stats.p_values(t).collect()}
    assert got["a"] == pytest.approx(0.0734, abs=2e-4) and got["b"] == pytest.approx(0.05, abs=1e-3) and got["c"] == pytest.approx(0.0248, abs=2e-4) and got["d"] is None
    e, c = history(spark, 60)
    p = timing.posterior(timing.grid(e, c))
    marked = spark.createDataFrame([("D2", START + timedelta(50))], "district string, day date")
    said = timing.shown(p, marked=marked).where("shown").select("district", "day").distinct().collect()
    assert [(r.district, r.day) for r in said] == [("D2", START + timedelta(50))]


def test_forecast_document_and_csv(spark, tmp_path):
    e, c = history(spark, 60)
    now = timing.windows(timing.posterior(timing.grid(e, c)).where(F.col("day") == F.lit(START + timedelta(59))))
    centroids = spark.createDataFrame([("D0", 53.0, 8.8), ("D1", 53.1, 8.9), ("X", 1.0, 1.0)], "district string, lat double, lon double")
    doc = hotspot.forecast_document(panel.daily(e, e.select("district").distinct()), str(START + timedelta(60)), centroids, now).collect()
    assert {r.district for r in doc} == {"D0", "D1"} and all(len(r.timing) == 3 and [x.category for x in r.timing] == sorted(x.category for x in r.timing) for r in doc)
    rows = [(1, ' a "b", c\nd', START), (2, "", None), (3, None, START)]
    back = [rows[0], (2, None, None), rows[2]]
    sinks.write_csv(spark.createDataFrame(rows, "k int, t string, day date").coalesce(1), str(tmp_path / "c"))
    assert sorted(tuple(r) for r in files.csv(spark, str(tmp_path / "c"), "k int, t string, day date").collect()) == back
