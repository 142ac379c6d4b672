"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over the run, w_s(t) for t in [0, 1]: here a straight line through
its target share, ``share * (1 + tilt * (2t - 1))``, tilts set so that the weights sum to one at any
time. Its integral times the total size is the source's cumulative token demand. Copies of documents
of a source are lined up in a seeded random order, copy after copy, and the demand curve is inverted
at the middle of each copy's tokens: that is its position in training. Documents are then range-sorted
by position.

The total is the largest for which every source can meet its share with at most ``max_repeats``
copies of a document, or a smaller one that is asked for; if a larger one is asked for, sources give
what they can and the shares that are reached are reported beside the targets.

A source may hold a third of all rows: its running sum is taken in two steps, sums of hash buckets
first (one row per source and bucket), then within a bucket.

Defined results: documents whose source is NULL or has no target, and documents without tokens, are
never drawn. Repeated document ids are documents of their own. A source with a target but without
documents is reported with a reached share of 0, and is left out when the total is computed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wachbuch.llm import tokens
from wachbuch.session import cut

BUCKETS = 256


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, tokens`` of the documents that may be drawn, materialised: encoding is the dear step."""
    d = tokens.sizes(docs, keep=("source",))
    return cut(d.where("source is not null and tokens > 0"))


def plan(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """One row per source: ``source, target_share, max_repeats, held, demand, tilt``."""
    t = targets.select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
    t = t.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    held = sizes.groupBy("source").agg(F.sum("tokens").alias("held"))
    p = t.join(held, "source", "left").withColumn("held", F.coalesce("held", F.lit(0).cast("long")))
    every = Window.partitionBy(F.lit(1))  # as many rows as there are sources with a target
    room = F.when(F.col("held") > 0, F.col("held") * F.col("max_repeats") / F.col("target_share"))
    p = p.withColumn("whole", F.min(room).over(every) if total is None else F.lit(float(total)))
    p = p.withColumn("demand", F.least(F.col("target_share") * F.col("whole"), (F.col("held") * F.col("max_repeats")).cast("double")))
    # small sources late, large ones early; the tilts' weighted mean is 0, so the weights always sum to 1
    rank = F.percent_rank().over(every.orderBy("target_share", "source"))
    p = p.withColumn("lean", F.lit(0.5) - rank)
    mean = F.sum(F.col("lean") * F.col("target_share")).over(every) / F.sum("target_share").over(every)
    return p.withColumn("tilt", F.col("lean") - mean).select("source", "target_share", "max_repeats", "held", "demand", "tilt")


def positions(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7) -> DataFrame:
    """``doc_id, source, copy_no, tokens, position``: every drawn copy, in the order of training.

    A copy is drawn if the middle of its tokens lies within the source's demand.
    """
    p = plan(sizes, targets, total)
    # the targets are a short list, so is the table of sums: one row per target and bucket
    d = sizes.join(F.broadcast(p), "source").withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "tokens")).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.lit(BUCKETS)).cast("int"))
    sums = d.groupBy("source", "bucket").agg(F.sum("tokens").alias("m"))
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("m").over(w), F.lit(0))).drop("m")
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inner", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    d = d.join(F.broadcast(sums), ["source", "bucket"])
    d = d.withColumn("mid", F.col("ahead") + F.col("inner") + F.col("tokens") / 2)
    copies = F.least(F.col("max_repeats"), F.ceil(F.greatest((F.col("demand") - F.col("mid")) / F.col("held"), F.lit(0.0))).cast("int"))
    d = d.withColumn("copies", copies).where("copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    # demand(t) = D * ((1 - tilt) * t + tilt * t^2), inverted in closed form
    c = (F.col("mid") + (F.col("copy_no") - 1) * F.col("held")) / F.col("demand")
    a = F.col("tilt")
    t = F.when(F.abs(a) < 1e-9, c).otherwise(2 * c / ((1 - a) + F.sqrt(F.greatest((1 - a) * (1 - a) + 4 * a * c, F.lit(0.0)))))
    d = d.withColumn("position", F.least(t, F.lit(1.0)))
    return d.select("doc_id", "source", "copy_no", "tokens", "position").repartitionByRange("position", "doc_id", "copy_no").sortWithinPartitions("position", "doc_id", "copy_no")


def shares(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7) -> DataFrame:
    """One row per source with a target: what was drawn and the share it makes of the whole."""
    drawn = positions(sizes, targets, total, seed).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("copies"), F.countDistinct("doc_id").alias("docs"), F.max("copy_no").alias("repeats"))
    p = plan(sizes, targets, total).join(drawn, "source", "left")
    zero = {c: 0 for c in ("tokens", "copies", "docs", "repeats")}
    p = p.fillna(zero)
    return p.select("source", "target_share", "max_repeats", "held", "docs", "copies", "repeats", "tokens", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy(F.lit(1)))), F.lit(0.0)).alias("actual_share"))
