"""Time to the next report: Gamma posteriors over observed days, and their backtest.

The grid is long: one row per series (district and category, plus the series of all categories of a
district, a grouping set) and day. Days without publications are removed, not counted as quiet. All
weights are running sums over the observed days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANY = "_any"
HALF_LIFE, PRIOR, PRIOR_ANY, LONGEST = 120.0, 90.0, 7.0, 180
QUANTILES = (0.5, 0.8)


def grid(events: DataFrame, covered: DataFrame) -> DataFrame:
    """``district, category, day, t, j, n``: counts on covered days, t the calendar index, j the observed one."""
    days = covered.select("day").distinct()
    w = Window.partitionBy(F.lit(1))
    days = days.withColumns({"t": F.datediff("day", F.min("day").over(w)), "j": F.row_number().over(w.orderBy("day")) - 1})
    e = events.where("district is not null and category is not null").join(F.broadcast(days.select("day")), "day")
    n = e.groupingSets([["district", "category", "day"], ["district", "day"]], "district", "category", "day").agg(F.count("*").alias("n"))
    n = n.withColumn("category", F.coalesce("category", F.lit(ANY)))
    series = events.where("district is not null").select("district").distinct().crossJoin(F.broadcast(events.where("category is not null").select("category").distinct().unionByName(events.sparkSession.createDataFrame([(ANY,)], "category string"))))
    return days.crossJoin(F.broadcast(series)).join(n, ["district", "category", "day"], "left").fillna(0, ["n"])


def posterior(g: DataFrame, half_life: float | Column = HALF_LIFE, prior: float | Column = PRIOR, prior_any: float | Column = PRIOR_ANY, per: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``a, b`` of the Gamma posterior from earlier days only, and ``seen``, the events so far.

    Yesterday has age 1. A series' typical rate is its category's city rate by its district's share. The
    parameters may be columns; ``per`` then names the columns that tell the settings apart.
    """
    half_life, prior, prior_any = (x if isinstance(x, Column) else F.lit(x) for x in (half_life, prior, prior_any))
    run = Window.partitionBy(*per, "district", "category").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    up = F.pow(F.lit(2.0), F.col("t") / half_life)
    down = F.pow(F.lit(2.0), -F.col("t") / half_life)
    p = g.withColumns({"nt": F.coalesce(F.sum(F.col("n") * up).over(run), F.lit(0.0)) * down, "exposure": F.coalesce(F.sum(up).over(run), F.lit(0.0)) * down, "seen": F.coalesce(F.sum("n").over(run), F.lit(0))})
    any_n = F.when(F.col("category") == ANY, F.col("nt")).otherwise(0.0)
    p = p.withColumns({
        "of_district": F.sum(any_n).over(Window.partitionBy(*per, "t", "district")),
        "of_city": F.sum(any_n).over(Window.partitionBy(*per, "t")),
        "of_category": F.sum("nt").over(Window.partitionBy(*per, "t", "category")),
        "n_districts": F.sum(F.when(F.col("category") == ANY, 1).otherwise(0)).over(Window.partitionBy(*per, "t")),
    })
    share = F.when(F.col("of_city") > 0, F.col("of_district") / F.col("of_city")).otherwise(1.0 / F.col("n_districts"))
    exposure = F.greatest("exposure", F.lit(1e-9))
    typical = F.when(F.col("category") == ANY, F.col("of_city") / F.col("n_districts") / exposure).otherwise(F.col("of_category") * share / exposure)
    days = F.when(F.col("category") == ANY, prior_any).otherwise(prior)
    p = p.withColumns({"a": F.greatest(days * typical + F.col("nt"), F.lit(1e-9)), "b": days + F.col("exposure")})
    return p.select(*per, "district", "category", "day", "t", "j", "n", "seen", "a", "b")


def compare(g: DataFrame, half_lives: tuple[float, ...] = (30.0, 60.0, 120.0, 240.0, 480.0), priors: tuple[float, ...] = (15.0, 30.0, 60.0, 90.0, 180.0), days: int = 14, least: int = 120, step: int = 2) -> DataFrame:
    """Log loss and Brier score of every setting over every ``step``-th origin, all settings in one plan."""
    spark = g.sparkSession
    settings = spark.range(1).select(F.explode(F.array(*map(F.lit, half_lives))).alias("half_life")).select("half_life", F.explode(F.array(*map(F.lit, priors))).alias("prior"))
    per = ("half_life", "prior")
    x = posterior(g.crossJoin(F.broadcast(settings)), F.col("half_life"), F.col("prior"), PRIOR_ANY, per)
    ahead = Window.partitionBy(*per, "district", "category").orderBy("j").rowsBetween(0, days - 1)
    x = x.withColumns({"y": (F.sum("n").over(ahead) > 0).cast("int"), "full": F.count("*").over(ahead) == days}).where(F.col("full") & (F.col("j") >= least) & ((F.col("j") - least) % step == 0) & (F.col("category") != ANY))
    p = prob_within(F.col("a"), F.col("b"), float(days))
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return x.groupBy(*per).agg(F.count("*").alias("n"), F.round(F.avg(-(F.col("y") * F.log(q) + (1 - F.col("y")) * F.log(1 - q))), 6).alias("log_loss"), F.round(F.avg(F.pow(p - F.col("y"), 2)), 6).alias("brier"))


def prob_within(a: Column, b: Column, days: float | Column) -> Column:
    """Probability of an event within so many observed days."""
    return 1 - F.pow(b / (b + days), a)


def days_until(a: Column, b: Column, p: float) -> Column:
    """Observed days until an event with probability p; infinite if too long for a double."""
    return b * (F.pow(F.lit(1.0 - p), -1.0 / a) - 1)


def windows(post: DataFrame) -> DataFrame:
    """Rate per 30 days, probability in 14 and 30 days, and the 50 % and 80 % windows (NULL beyond LONGEST)."""
    def window(p: float) -> Column:
        d = F.ceil(F.least(days_until(F.col("a"), F.col("b"), p), F.lit(1e9)))
        return F.when(d <= LONGEST, d.cast("int"))

    return post.select(
        "district", "category", "day", "seen",
        F.round(F.col("a") / F.col("b") * 30, 6).alias("rate_per_30d"),
        F.round(prob_within(F.col("a"), F.col("b"), 14.0), 6).alias("p14"),
        F.round(prob_within(F.col("a"), F.col("b"), 30.0), 6).alias("p30"),
        window(0.5).alias("t50"), window(0.8).alias("t80"),
    )


def top_offenses(post: DataFrame, n: int = 3) -> DataFrame:
    """Per district and day the n categories seen most (then by rate, then by name)."""
    rate = F.round(F.col("a") / F.col("b"), 9)
    rank = F.row_number().over(Window.partitionBy("district", "day").orderBy(F.desc("seen"), F.desc(rate), "category"))
    return post.where(F.col("category") != ANY).withColumn("rank", rank).where(F.col("rank") <= n)


def shown(post: DataFrame, k: int = 5, n: int = 3, least_seen: int = 3, named: str = "Sonstiges", marked: DataFrame | None = None) -> DataFrame:
    """Adds ``shown``: the statements the map would make, for the districts ``marked`` on each day (``district, day``; the k
    busiest if none are given): the series of all categories, and the n offenses seen most, without the
    catch-all, seen at least 3 times."""
    busy = post.where(F.col("category") == ANY).withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy(F.desc(F.round(F.col("a") / F.col("b"), 9)), "district")))
    busy = busy.where(F.col("place") <= k) if marked is None else marked
    busy = busy.select("district", "day", F.lit(1).alias("busy"))
    top = top_offenses(post.where(F.col("category") != named), n).where(F.col("seen") >= least_seen).select("district", "category", "day", F.lit(1).alias("top"))
    p = post.join(busy, ["district", "day"], "left").join(top, ["district", "category", "day"], "left")
    return p.withColumn("shown", F.col("busy").isNotNull() & ((F.col("category") == ANY) | F.col("top").isNotNull())).drop("busy", "top")


def backtest(post: DataFrame, least: int = 120, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """One row per series, origin and quantile whose window fits into the record: ``said, came_true``.

    The events of the next w observed days come from running counts: an equi-join of the series with
    itself at an index that depends on the row (origin + window - 1).
    """
    per = Window.partitionBy("district", "category")
    run = per.orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    x = post.withColumns({"cum": F.sum("n").over(run), "last": F.max("j").over(per)})
    said = x.where(F.col("j") >= least).withColumn("q", F.explode(F.array(*[F.lit(q) for q in quantiles])))
    win = F.ceil(F.least(F.col("b") * (F.pow(1 - F.col("q"), -1.0 / F.col("a")) - 1), F.lit(1e9))).cast("int")
    said = said.withColumn("win", win).where((F.col("win") <= LONGEST) & (F.col("win") >= 1) & (F.col("j") + F.col("win") <= F.col("last") + 1))
    z = x.select("district", "category", F.col("j").alias("at"), F.col("cum").alias("then"))
    said = said.withColumn("at", F.col("j") + F.col("win") - 1).join(z, ["district", "category", "at"])
    keep = ["shown"] if "shown" in post.columns else []
    return said.select("district", "category", "j", "q", "win", *keep, prob_within(F.col("a"), F.col("b"), F.col("win")).alias("said"), (F.col("then") - (F.col("cum") - F.col("n")) > 0).cast("int").alias("came_true"))


def calibration(tested: DataFrame) -> DataFrame:
    """How often windows came true, by quantile and overlapping class of statement."""
    offense, every = F.col("category") != ANY, F.col("category") == ANY
    masks = [("offense", offense), ("any", every)]
    if "shown" in tested.columns:
        masks += [("shown_offense", offense & F.col("shown")), ("shown_any", every & F.col("shown"))]
    d = tested.withColumn("cls", F.explode(F.array_compact(F.array(*[F.when(m, F.lit(c)) for c, m in masks]))))
    return d.groupBy("q", "cls").agg(F.count("*").alias("n"), F.sum("came_true").alias("n_true"), F.round(F.avg("said"), 6).alias("said"), F.round(F.avg("came_true"), 6).alias("came_true"))


def proper_scores(post: DataFrame, days: int = 14, least: int = 120) -> DataFrame:
    """Log loss, Brier score and skill of the probability of an event within ``days`` observed days, by
    class of series; the base forecast is the class's mean outcome. Skill is NULL where that is certain."""
    ahead = Window.partitionBy("district", "category").orderBy("j").rowsBetween(0, days - 1)
    x = post.withColumns({"y": (F.sum("n").over(ahead) > 0).cast("int"), "full": F.count("*").over(ahead) == days}).where(F.col("full") & (F.col("j") >= least))
    x = x.withColumns({"p": prob_within(F.col("a"), F.col("b"), float(days)), "cls": F.when(F.col("category") == ANY, "any").otherwise("offense")})
    q = F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))
    s = x.groupBy("cls").agg(
        F.count("*").alias("n"), F.sum("y").alias("n_true"), F.avg("p").alias("mean_p"),
        F.avg(-(F.col("y") * F.log(q) + (1 - F.col("y")) * F.log(1 - q))).alias("log_loss"),
        F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.avg("y").alias("base"),
    )
    base = F.col("base") * (1 - F.col("base"))
    return s.select("cls", "n", "n_true", *[F.round(c, 6).alias(c) for c in ("mean_p", "log_loss", "brier")], F.when(base > 0, F.round(1 - F.col("brier") / base, 6)).alias("skill"))


def reliability(post: DataFrame, days: int = 14, least: int = 120) -> DataFrame:
    """Forecast against outcome in five uneven bins of probability."""
    ahead = Window.partitionBy("district", "category").orderBy("j").rowsBetween(0, days - 1)
    x = post.withColumns({"y": (F.sum("n").over(ahead) > 0).cast("int"), "full": F.count("*").over(ahead) == days}).where(F.col("full") & (F.col("j") >= least))
    p = F.round(prob_within(F.col("a"), F.col("b"), float(days)), 9)
    b = F.when(p < 0.05, 0).when(p < 0.15, 1).when(p < 0.3, 2).when(p < 0.6, 3).otherwise(4)
    return x.withColumns({"p": p, "bin": b}).groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.sum("y").alias("n_true"))
