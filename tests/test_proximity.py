import math
import random

from wachbuch.operators import proximity


def metres(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))


def test_against_brute_force_with_a_crowded_place_poles_and_the_date_line(spark):
    rnd = random.Random(3)
    pts = [(k, 53 + rnd.random() * 0.05, 8.8 + rnd.random() * 0.05) for k in range(300)]
    pts += [(1000 + k, 53.01, 8.81) for k in range(80)]
    pts += [(2000 + k, 89.999 + rnd.random() * 0.001, rnd.uniform(-180, 180)) for k in range(20)] + [(3000, 10.0, 179.9999), (3001, 10.0, -179.9999)]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    got = {(r.id_a, r.id_b) for r in proximity.near_pairs(df, df, 300.0, True, hot=20).collect()}
    want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and metres(*a[1:], *b[1:]) <= 300}
    assert got == want and (3000, 3001) in got


def test_points_without_a_place(spark):
    rows = [(1, 53.0, 8.8), (2, 53.0, 8.8), (3, None, 8.8), (4, float("nan"), 8.8), (5, 0.0, 0.0), (6, 0.0, 0.0), (None, 53.0, 8.8)]
    s = spark.createDataFrame([(*r, "x", 1) for r in rows], "series_id long, centroid_lat double, centroid_lon double, code string, cell int")
    f = spark.createDataFrame([(1, 53.0, 8.8)], "forecast_id long, lat double, lon double")
    got = sorted(tuple(r) for r in proximity.found(s, f).collect())
    assert got == [("forecast", 1, 1), ("forecast", 2, 1), ("series", 1, 2)]
    assert proximity.found(s.where("false"), f.where("false")).count() == 0
