"""Equi-joins whose keys may be very unevenly filled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wachbuch.session import cut

#: Rows of one key that one part of it may hold.
HOT = 5000


#: Rows up to which the list of crowded keys is broadcast.
SMALL = 20_000


def split_join(left: DataFrame, right: DataFrame, keys: list[str], hot: int = HOT) -> DataFrame:
    """Inner join on ``keys`` in which a key with many rows on the right is split into parts.

    Keys are counted first, by a map-side combined aggregation; only counts are shuffled. Rows of the right side of a key with more
    than ``hot`` rows get a salted part number, rows of the left side are sent to each of the
    key's parts. The list of such keys has at most (rows / hot) entries and is written before it is used: an empty one
    leaves a plain join, one of up to ``SMALL`` rows is broadcast, so that no row meets its raw key
    in a shuffle, a longer one is joined like any table. NULL keys match nothing.
    """
    crowd = right.groupBy(*keys).agg(F.count("*").alias("__m")).where(F.col("__m") > hot)
    crowd = cut(crowd.select(*keys, F.ceil(F.col("__m") / hot).cast("int").alias("__parts")))
    n = crowd.count()
    if not n:
        return left.join(right, keys)
    crowd = F.broadcast(crowd) if n <= SMALL else crowd
    many = F.coalesce("__parts", F.lit(1))
    r = right.join(crowd, keys, "left").withColumn("__part", F.pmod(F.xxhash64(*[c for c in right.columns if c not in keys]), many).cast("int")).drop("__parts")
    le = left.join(crowd, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), many - 1))).drop("__parts")
    return le.join(r, [*keys, "__part"]).drop("__part")
