"""Connected components of an edge list.

Minimum labels spread over edges, with pointer jumping between rounds, so the number of rounds grows
with the logarithm of a component's diameter. Each round is materialised in the shared checkpoint
folder. Only one number per round reaches the driver: how many labels changed.

Defined results: an edge with a NULL end is ignored, loops and repeated edges change nothing, an empty
edge list gives no rows. Nodes without an edge don't appear.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wachbuch.session import cut


def sizeless(df: DataFrame) -> DataFrame:
    """``df`` without the planner's guess of its size: a checkpoint keeps the guess of the plan that it cuts, and
    guesses of joins are products, so their digits would double with every round."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.javaRDD(), df._jdf.schema()), spark)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, root)``: each node with the smallest node of its component."""
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    e = e.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    e = cut(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))))
    labels = cut(e.groupBy("x").agg(F.least(F.min("y"), F.min("x")).alias("root")).withColumnRenamed("x", "node"))
    for _ in range(max_rounds):
        near = e.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("via"))
        # what a node hears, its root hears too: else a root waits until labels have walked to it edge by edge
        heard = labels.join(near, "node").select(F.explode(F.array_distinct(F.array("node", "root"))).alias("node"), "via")
        near = heard.groupBy("node").agg(F.min("via").alias("via"))
        new = labels.join(near, "node", "left").select("node", F.least("root", F.coalesce("via", "root")).alias("next"), "root")
        # pointer jumping: the label of my label
        hop = new.select(F.col("node").alias("next"), F.col("next").alias("far"))
        new = new.join(hop, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("next"), "root")
        new = sizeless(cut(new))
        changed = new.where("next <> root").limit(1).count()
        labels = new.select("node", F.col("next").alias("root"))
        if not changed:
            return labels
    raise RuntimeError(f"labels still changed after {max_rounds} rounds")
