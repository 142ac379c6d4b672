"""Writers: all or nothing, strict JSON, archives that never shrink."""

from __future__ import annotations

import json
import math
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wachbuch.session import cut


def atomic_text(path: str, text: str) -> None:
    """Writes a small local file so that a reader sees the old or the new one, never a part."""
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)


def strict_json(df: DataFrame) -> DataFrame:
    """One JSON object per row in ``value``; NULL fields are left out, NaN and infinity count as NULL."""
    cols = [F.when(F.isnan(c) | (F.abs(c) == math.inf), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cols)).alias("value"))


def publish(outputs: dict[str, DataFrame], folder: str) -> None:
    """Writes every table as JSON lines into a staging folder, and moves them into place only when all
    are complete: a failure leaves the published state untouched."""
    spark = next(iter(outputs.values())).sparkSession
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    stage = folder.rstrip("/") + ".staging"
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(conf)
    fs.delete(path(stage), True)
    for name, df in outputs.items():
        strict_json(df).write.mode("overwrite").text(f"{stage}/{name}")
    old = folder.rstrip("/") + ".old"
    fs.delete(path(old), True)
    if fs.exists(path(folder)):
        fs.rename(path(folder), path(old))
    fs.rename(path(stage), path(folder))
    fs.delete(path(old), True)


def document(row: dict) -> str:
    """A small result as one JSON document; not-a-number raises."""
    return json.dumps(row, ensure_ascii=False, allow_nan=False)


def write_csv(df: DataFrame, path: str, keep_empty: bool = False) -> None:
    """CSV with a header, as ``files.csv`` reads it: quotes doubled, days as yyyy-MM-dd. An empty string comes back as missing, unless
    ``keep_empty`` has it written as ``""``."""
    empty = '""' if keep_empty else ""
    df.write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').option("emptyValue", empty).option("nullValue", "").option("dateFormat", "yyyy-MM-dd").csv(path)


class Shrunk(RuntimeError):
    """A write would lose records."""


def write_archive(df: DataFrame, path: str, copy: str, n_loaded: int, key: str = "key") -> int:
    """Writes the archive and its copy, sorted by key; refuses to store fewer records than were loaded."""
    # the table may be read from the very archive that is written
    ordered = cut(df.repartitionByRange(key).sortWithinPartitions(key))
    n = ordered.count()
    if n < n_loaded:
        raise Shrunk(f"{n} records, {n_loaded} were loaded")
    # the copy is whole before the archive is touched
    for p in (copy, path):
        ordered.write.mode("overwrite").parquet(p)
    return n


def append_new(spark: SparkSession, new: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows whose key isn't stored yet, each once; returns them. ``path`` may be on any file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    rest = [c for c in new.columns if c != key]
    fresh = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*").select(*new.columns)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti").select(*new.columns)
    fresh = cut(fresh)
    fresh.write.mode("append").parquet(path)
    return fresh


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows stay unless a new one has their key."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))
