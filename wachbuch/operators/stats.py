"""Correlation and group tests over daily rows.

Moments, ranks and statistics are computed by Spark; only a handful of numbers per test reach the
driver, where p-values are taken from Student's distribution by its continued fraction.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.959964


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """``n, r, low, high``: Pearson's r with its Fisher interval; needs more than 3 rows."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"))
    z, s = F.atanh("r"), 1 / F.sqrt(F.col("n") - 3)
    return d.where("n > 3").select("n", F.round("r", 6).alias("r"), F.round(F.tanh(z - Z * s), 6).alias("low"), F.round(F.tanh(z + Z * s), 6).alias("high"))


def welch(df: DataFrame, flag: str, y: str, least: int = 5) -> DataFrame:
    """``n1, n0, mean1, mean0, t, dof`` of Welch's test; no row if a group has fewer than ``least`` rows."""
    g = lambda f, v: f(F.when(F.col(flag) == v, F.col(y).cast("double")))
    d = df.agg(F.count_if(F.col(flag)).alias("n1"), F.count_if(~F.col(flag)).alias("n0"), g(F.avg, True).alias("m1"), g(F.avg, False).alias("m0"), g(F.var_samp, True).alias("v1"), g(F.var_samp, False).alias("v0"))
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    dof = F.pow(a + b, 2) / (F.pow(a, 2) / (F.col("n1") - 1) + F.pow(b, 2) / (F.col("n0") - 1))
    return d.where((F.col("n1") >= least) & (F.col("n0") >= least)).select("n1", "n0", F.round("m1", 6).alias("mean1"), F.round("m0", 6).alias("mean0"), F.round((F.col("m1") - F.col("m0")) / F.sqrt(a + b), 6).alias("t"), F.round(dof, 4).alias("dof"))


def mann_whitney(df: DataFrame, flag: str, y: str) -> DataFrame:
    """``n1, n0, u, z``: two-sided U test with average ranks, tie and continuity correction.

    Ranks come from counts per value, so equal values cost one row.
    """
    v = df.where(F.col(flag).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(y).alias("y")).agg(F.count("*").alias("t"), F.count_if(F.col(flag)).alias("t1"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy(F.lit(1)).orderBy("y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    v = v.withColumn("rank", before + (F.col("t") + 1) / 2)
    s = v.agg(F.sum("t").alias("n"), F.sum("t1").alias("n1"), F.sum(F.col("rank") * F.col("t1")).alias("r1"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    s = s.withColumns({"n0": F.col("n") - F.col("n1")}).withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    mean = F.col("n1") * F.col("n0") / 2
    sd = F.sqrt(F.col("n1") * F.col("n0") / 12 * ((F.col("n") + 1) - F.col("ties") / (F.col("n") * (F.col("n") - 1))))
    top = F.greatest(F.col("u"), F.col("n1") * F.col("n0") - F.col("u"))
    return s.where("n1 > 0 and n0 > 0").select("n1", "n0", F.round("u", 1).alias("u"), F.round((top - mean - 0.5) / sd, 6).alias("z"))


def benjamini_hochberg(tests: DataFrame, name: str = "name", p: str = "p", q: float = 0.05) -> DataFrame:
    """Adds ``rank`` and ``kept``: p at most that of the largest k with p(k) <= k / n * q."""
    every = Window.partitionBy(F.lit(1))  # one row per test
    d = tests.withColumns({"rank": F.row_number().over(every.orderBy(p, name)), "n": F.count("*").over(every)})
    d = d.withColumn("last", F.max(F.when(F.col(p) <= F.col("rank") / F.col("n") * q, F.col("rank"))).over(every))
    return d.withColumn("kept", F.coalesce(F.col("rank") <= F.col("last"), F.lit(False))).drop("n", "last")


def block_permutation(daily: DataFrame, x: str, y: str, perms: int = 200, block: int = 7, day: str = "day", seed: int = 0) -> DataFrame:
    """``r, n_perm, p``: p-value of the correlation when blocks of consecutive days are shuffled.

    Each permutation orders the blocks by a seeded hash; they run as one plan.
    """
    w = Window.partitionBy(F.lit(1)).orderBy(day)
    d = daily.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(day, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).withColumn("i", F.row_number().over(w) - 1)
    spark = daily.sparkSession
    left = d.select("i", "x", F.floor(F.col("i") / block).alias("block"), (F.col("i") % block).alias("o"))
    many = left.crossJoin(F.broadcast(spark.range(perms).withColumnRenamed("id", "perm")))
    many = many.withColumn("j", F.row_number().over(Window.partitionBy("perm").orderBy(F.xxhash64("perm", "block", F.lit(seed)), "block", "o")) - 1)
    shuffled = many.join(d.select(F.col("i").alias("j"), "y"), "j").groupBy("perm").agg(F.corr("x", "y").alias("r"))
    real = d.agg(F.corr("x", "y").alias("real"))
    return shuffled.crossJoin(F.broadcast(real)).agg(F.round(F.first("real"), 6).alias("r"), F.count("*").alias("n_perm"), ((F.count_if(F.abs("r") >= F.abs("real")) + 1) / (F.count("*") + 1)).alias("p"))


def conditions(df: DataFrame, keys: dict[str, Column], wanted: list[str]) -> DataFrame:
    """Rows that meet all wanted conditions. An unknown name raises, naming the known ones."""
    unknown = [k for k in wanted if k not in keys]
    if unknown:
        raise ValueError(f"unknown conditions {unknown}; known are {sorted(keys)}")
    return df.where(reduce(lambda a, b: a & b, [keys[k] for k in wanted], F.lit(True)))


def p_values(tests: DataFrame) -> DataFrame:
    """``name, statistic, p``: two-sided p-values. ``tests``: name, kind (``r``, ``t`` or ``z``), statistic, dof (rows of an r).

    One row per test, read by an Arrow function, since no built-in expression knows Student's distribution. NULL statistics have no p.
    """
    of = {"r": lambda x, n: pearson_p(x, int(n)), "t": student_p, "z": lambda x, n: normal_p(x)}

    def run(kind: pd.Series, x: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else round(of[k](v, n), 9) for k, v, n in zip(kind, x, dof, strict=True)], dtype="float64")

    return tests.select("name", "statistic", F.pandas_udf(run, "double")("kind", "statistic", "dof").alias("p"))


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function (continued fraction, modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        n = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + n * d if abs(1 + n * d) > tiny else tiny)
        c = 1 + n / c if abs(1 + n / c) > tiny else tiny
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def student_p(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t."""
    return _beta(dof / 2, 0.5, dof / (dof + t * t))


def pearson_p(r: float, n: int) -> float:
    return student_p(r * math.sqrt((n - 2) / max(1e-300, 1 - r * r)), n - 2)


def normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))
