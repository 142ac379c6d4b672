"""Points near other points.

Points lie on the unit sphere in space, which is cut into cubes; a cube's number is its place on a
three-dimensional Z-order curve, so there are no special cases at poles or at the date line. A fine
code has ``FINE`` more bits along each axis than the cell that joins. The disc around a query point is
covered by the cells it meets, each a range [cell << 3 * FINE, (cell + 1) << 3 * FINE) of sorted fine
codes. Since these ranges are aligned, "code within range" is equality of the code's prefix with the
cell, and the range join is a sort-merge join on prefixes; every candidate is then measured exactly.

A crowded cell may hold a third of all points. Cells are counted first (a map-side combined
aggregation); those above ``hot`` points are split into salted parts on the side of the points, and
the query is sent to each part, so no single task gets a whole crowded cell. All pairs come out.

Points with NULL or NaN in a coordinate, or with both coordinates zero, have no place and give no
rows. Repeated places and ids are ordinary points (a pair needs different ids within one table).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wachbuch.functions.geo import AXIS_BITS, EARTH_M, haversine_m, unit_vector, with_morton3

FINE = 2
#: Points of one cell that one part of it may hold.
HOT = 2000


def placed(df: DataFrame, id_col: str, lat: str, lon: str) -> DataFrame:
    """``(id, lat, lon)`` of the points that have a place."""
    d = df.select(F.col(id_col).cast("long").alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    ok = F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon") & (F.abs("lat") < math.inf) & (F.abs("lon") < math.inf)
    return d.where(ok & ~((F.col("lat") == 0) & (F.col("lon") == 0)) & F.col("id").isNotNull())


def _axes(edge: float) -> list[Column]:
    return [F.floor((v + 1.0) / edge).cast("long") for v in unit_vector(F.col("lat"), F.col("lon"))]


def _edge(metres: float) -> float:
    """Edge of a cell for a distance: its chord, or more where the axis has not enough bits."""
    return max(2 * math.sin(min(metres / EARTH_M, math.pi) / 2), 2.0 / ((1 << AXIS_BITS - FINE - 1) - 3)) * (1 + 1e-9)


def with_code(points: DataFrame, metres: float) -> DataFrame:
    """Adds the fine code of each point."""
    return with_morton3(points, *_axes(_edge(metres) / (1 << FINE)), "code")


def cover(points: DataFrame, metres: float) -> DataFrame:
    """One row per point and cell that its disc meets, with the range of fine codes ``[lo, hi)``.

    Of the 27 cells around a point those are left out that are farther away than the disc reaches
    or don't touch the sphere.
    """
    e = _edge(metres)
    v = unit_vector(F.col("lat"), F.col("lon"))
    d = points.withColumns({f"u{k}": v[k] for k in range(3)} | {f"n{k}": F.floor((v[k] + 1.0) / e).cast("long") for k in range(3)})
    steps = F.array(*[F.struct(*[F.lit(s).alias(f"d{k}") for k, s in enumerate((a, b, c))]) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    d = d.withColumn("step", F.explode(steps))
    cell = [F.col(f"n{k}") + F.col(f"step.d{k}") for k in range(3)]
    lo = [c * e - 1.0 for c in cell]
    hi = [c * e - 1.0 + e for c in cell]
    zero = F.lit(0.0)
    gap = [F.greatest(a - F.col(f"u{k}"), F.col(f"u{k}") - b, zero) for k, (a, b) in enumerate(zip(lo, hi, strict=True))]
    near = [F.greatest(a, -b, zero) for a, b in zip(lo, hi, strict=True)]
    far = [F.greatest(F.abs(a), F.abs(b)) for a, b in zip(lo, hi, strict=True)]
    square = lambda xs: xs[0] * xs[0] + xs[1] * xs[1] + xs[2] * xs[2]
    reach = (2 * math.sin(min(metres / EARTH_M, math.pi) / 2)) ** 2 * (1 + 1e-6) + 1e-18
    kept = (square(gap) <= reach) & (square(near) <= 1 + 1e-9) & (square(far) >= 1 - 1e-9) & (cell[0] >= 0) & (cell[1] >= 0) & (cell[2] >= 0)
    bits = 3 * FINE
    d = with_morton3(d.where(kept), *cell, "code")
    return d.select("id", "lat", "lon", F.shiftleft("code", bits).alias("lo"), F.shiftleft(F.col("code") + 1, bits).alias("hi"))


def near_pairs(queries: DataFrame, points: DataFrame, metres: float, same: bool, hot: int = HOT) -> DataFrame:
    """``(id_a, id_b, metres)``: a query and a point at most ``metres`` apart.

    ``same``: both are one table; then each unordered pair of different ids comes out once.
    """
    bits = 3 * FINE
    pts = with_code(points, metres).withColumn("cell", F.shiftright("code", bits))
    rng = cover(queries, metres).withColumn("cell", F.shiftright("lo", bits))
    crowd = pts.groupBy("cell").agg(F.count("*").alias("m")).select("cell", F.ceil(F.col("m") / hot).cast("int").alias("parts"))
    # only a crowded cell needs a row here: with n points there are at most n / hot of them
    crowd = crowd.where("parts > 1")
    pts = pts.join(crowd, "cell", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int"))
    rng = rng.join(crowd, "cell", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    a = rng.select("cell", "part", "lo", "hi", F.col("id").alias("id_a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"))
    b = pts.select("cell", "part", "code", F.col("id").alias("id_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    j = a.join(b, ["cell", "part"]).where((F.col("code") >= F.col("lo")) & (F.col("code") < F.col("hi")))
    if same:
        j = j.where(F.col("id_a") < F.col("id_b"))
    j = j.withColumn("metres", haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")))
    return j.where(F.col("metres") <= metres).select("id_a", "id_b", "metres")


def found(series: DataFrame, forecast: DataFrame) -> DataFrame:
    """p4_found: near pairs of series (300 m), and of a series and a forecast point (1 500 m)."""
    s = placed(series, "series_id", "centroid_lat", "centroid_lon")
    f = placed(forecast, "forecast_id", "lat", "lon")
    one = near_pairs(s, s, 300.0, True).select(F.lit("series").alias("kind"), "id_a", "id_b")
    # the forecast points are the smaller side, so their discs are the ones that are covered
    two = near_pairs(f, s, 1500.0, False).select(F.lit("forecast").alias("kind"), F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"))
    return one.unionByName(two)
