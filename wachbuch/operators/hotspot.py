"""Scores of districts per day and their walk-forward backtest.

All models are columns of one plan over the long panel: each looks at strictly earlier days only, so a
day's scores don't depend on what happened from that day on. Exponential decay is a running sum of
n * 2^(i/h) scaled back by 2^(-(t-1)/h), linear in the number of days. The day index starts at 0 with the
first day; with a half-life of h days the factors stay finite for about 1 000 h days.

Ties are broken by district name; scores are rounded to nine digits before ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wachbuch.functions.rules import model_note

MODELS = ("naive", "exp_decay", "dow", "long_run", "ensemble")


def scores(panel: DataFrame, horizon: int = 7, half_life: float = 7.0) -> DataFrame:
    """The panel with day index ``i`` and one column per model."""
    per = Window.partitionBy("district").orderBy("day")
    before = per.rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("district", F.weekday("day")).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    n = F.col("n_total")
    p = panel.withColumn("i", F.row_number().over(per) - 1)
    p = p.withColumns({
        "naive": F.coalesce(F.sum(n).over(per.rowsBetween(-horizon, -1)), F.lit(0)).cast("double"),
        "exp_decay": F.coalesce(F.sum(n * F.pow(F.lit(2.0), F.col("i") / half_life)).over(before), F.lit(0.0)) * F.pow(F.lit(2.0), -(F.col("i") - 1) / half_life),
        "dow": F.coalesce(F.avg(n).over(same), F.lit(0.0)) * horizon,
        "long_run": F.coalesce(F.sum(n).over(before), F.lit(0)).cast("double"),
    })
    day = Window.partitionBy("day")

    def norm(c: str) -> Column:
        lo, hi = F.min(c).over(day), F.max(c).over(day)
        return F.when(hi - lo < 1e-9, 0.0).otherwise((F.col(c) - lo) / (hi - lo))

    p = p.withColumns({"n1": norm("exp_decay"), "n2": norm("dow")})
    return p.withColumn("ensemble", (F.col("n1") + F.col("n2")) / 2).drop("n1", "n2")


def with_outcome(panel: DataFrame, observed: DataFrame | None = None, horizon: int = 7, least: int = 21) -> DataFrame:
    """Adds ``hot`` (any event from this day on within the horizon) and ``is_test``: at least ``least``
    observed days before, and every day of the horizon observed."""
    p = panel
    if observed is None:
        p = p.withColumn("observed", F.lit(1))
    else:
        p = p.join(F.broadcast(observed.select("day", F.lit(1).alias("observed"))), "day", "left").fillna(0, ["observed"])
    per = Window.partitionBy("district").orderBy("day")
    ahead = per.rowsBetween(0, horizon - 1)
    p = p.withColumns({
        "hot": (F.sum("n_total").over(ahead) > 0).cast("int"),
        "is_test": (F.count("*").over(ahead) == horizon) & (F.min("observed").over(ahead) == 1) & (F.coalesce(F.sum("observed").over(per.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) >= least),
    })
    return p


def stacked(scored: DataFrame, models: tuple[str, ...] = MODELS) -> DataFrame:
    """One row per day, district and model."""
    keep = [c for c in scored.columns if c not in MODELS]
    return scored.select(*keep, F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.round(m, 9).alias("score")) for m in models])).alias("m")).select(*keep, "m.model", "m.score")


def backtest(panel: DataFrame, observed: DataFrame | None = None, k: int = 5, horizon: int = 7, least: int = 21, models: tuple[str, ...] = MODELS) -> DataFrame:
    """One row per model: test days, hits among the top k, precision, random precision, lift, any-hit rate.

    No test day gives no row.
    """
    s = stacked(with_outcome(scores(panel, horizon), observed, horizon, least).where("is_test"), models)
    rank = F.row_number().over(Window.partitionBy("model", "day").orderBy(F.desc("score"), "district"))
    day = s.withColumn("rank", rank).groupBy("model", "day").agg(F.sum(F.when(F.col("rank") <= k, F.col("hot")).otherwise(0)).alias("hits"), F.sum("hot").alias("hot"), F.count("*").alias("n"))
    return day.groupBy("model").agg(
        F.count("*").alias("test_days"),
        F.sum("hits").alias("hits"),
        F.sum("hot").alias("hot_districts"),
        F.round(F.sum("hits") / (F.count("*") * k), 6).alias("precision_at_k"),
        F.round(F.sum("hot") / F.sum("n"), 6).alias("random_rate"),
        F.round((F.sum("hits") / (F.count("*") * k)) / F.nullif(F.sum("hot") / F.sum("n"), F.lit(0.0)), 6).alias("lift"),
        F.round(F.avg((F.col("hits") > 0).cast("int")), 6).alias("any_hit"),
    )


def ranking(panel: DataFrame, day: str, k: int = 5, model: str = "ensemble") -> DataFrame:
    """All districts ranked for the day ``day`` (the day after the last known one is the usual choice)."""
    ahead = panel.select("district").distinct().select(F.lit(day).cast("date").alias("day"), "district", F.lit(0).cast("long").alias("n_total"))
    p = panel.select("day", "district", F.col("n_total").cast("long").alias("n_total")).where(F.col("day") < F.lit(day).cast("date")).unionByName(ahead)
    s = scores(p).where(F.col("day") == F.lit(day).cast("date")).withColumn("score", F.round(model, 9))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "district"))
    return s.select("district", F.round("score", 6).alias("score"), rank.alias("rank")).withColumn("elevated", F.col("rank") <= k)


def known_by(events: DataFrame, origins: DataFrame, half_life: float = 7.0) -> DataFrame:
    """What was known on each origin day: events *published* before it, weighted by the age of the
    *incident*. ``events``: day, pub, district; ``origins``: day. Two time axes: running sums go over
    publication days, the decay over incident days."""
    first = events.agg(F.min("day").alias("first"))
    e = events.crossJoin(F.broadcast(first)).withColumn("w", F.pow(F.lit(2.0), F.datediff("day", "first") / half_life))
    e = e.groupBy("district", F.col("pub").alias("at")).agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    o = origins.select(F.col("day").alias("at")).distinct().crossJoin(F.broadcast(events.select("district").where("district is not null").distinct()))
    both = e.withColumn("origin", F.lit(0)).unionByName(o.select("district", "at", F.lit(0.0).alias("w"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("origin")))
    # an origin sees what was published on earlier days only: it sorts before its own day's rows
    run = Window.partitionBy("district").orderBy("at", F.desc("origin")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"sw": F.sum("w").over(run), "sn": F.sum("n").over(run)}).where("origin = 1").crossJoin(F.broadcast(first))
    return both.select(F.col("at").alias("day"), "district", F.col("sn").alias("n_known"), (F.col("sw") * F.pow(F.lit(2.0), -(F.datediff("at", "first") - 1) / half_life)).alias("score"))


def marked(events: DataFrame, origins: DataFrame, k: int = 5, half_life: float = 7.0) -> DataFrame:
    """The k districts marked on each origin day, from what was known by then."""
    s = known_by(events, origins, half_life).withColumn("score", F.round("score", 9))
    rank = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("score"), "district"))
    return s.withColumn("rank", rank).where(F.col("rank") <= k).select("day", "district", "rank", "n_known")


def forecast_document(panel: DataFrame, day: str, centroids: DataFrame, current: DataFrame, k: int = 5) -> DataFrame:
    """One row per ranked district with a known centroid: place, score, rank, and what is said of its next reports.

    ``centroids``: district, lat, lon; ``current``: the newest statements of ``timing.windows``. Districts without a
    centroid keep their rank, so that numbers may be missing; those without statements have NULL.
    """
    said = F.struct("category", "seen", "rate_per_30d", "p14", "p30", "t50", "t80")
    w = current.groupBy("district").agg(F.array_sort(F.collect_list(said)).alias("timing"))
    d = ranking(panel, day, k).join(centroids.select("district", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon")), "district").join(w, "district", "left")
    return d.select(F.lit(day).cast("date").alias("generated_for"), "district", "lat", "lon", F.round("score", 3).alias("score"), "rank", "elevated", "timing")


def check(panel: DataFrame, observed: DataFrame | None = None, k: int = 5) -> DataFrame:
    """One row: hit rate of the ensemble, of chance, and of always naming the busiest districts, with a note."""
    b = backtest(panel, observed, k, models=("ensemble", "long_run"))
    pick = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    r = b.agg(F.max("test_days").alias("test_days"), pick("ensemble", "precision_at_k").alias("hit_rate"), pick("ensemble", "random_rate").alias("random_rate"), pick("long_run", "precision_at_k").alias("always_busiest"))
    return r.where("test_days is not null").withColumn("note", model_note(F.col("hit_rate"), F.col("random_rate"), F.col("always_busiest")))
