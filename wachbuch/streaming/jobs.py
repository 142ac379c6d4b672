"""Streaming forms of the batch operators, run with the available-now trigger.

State is bounded by watermarks: a report may come up to ``LATEST`` after its incident. Targets and
checkpoints lie in the shared folder that the cluster names, so that a lost executor or a restarted
driver goes on where the last batch ended.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wachbuch.operators import archive
from wachbuch.session import shared_folder

LATEST = "90 days"


def read(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table as a stream of its files; ``path`` may also name a single file."""
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = path.rstrip("/").rpartition("/")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile():
        return r.option("pathGlobFilter", name).parquet(folder)
    return r.parquet(path)


def first_of_key(stream: DataFrame, key: str, time: str, latest: str = LATEST) -> DataFrame:
    """Each key once: its first row, as long as repeats come within the watermark."""
    return stream.withWatermark(time, latest).dropDuplicatesWithinWatermark([key])


def sessions(stream: DataFrame, time: str, by: list[str], gap: str = "7 days", latest: str = LATEST) -> DataFrame:
    """Spans of activity: a gap of more than ``gap`` between rows starts a new one (touching ones merge)."""
    return stream.withWatermark(time, latest).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))


def trailing(stream: DataFrame, time: str, by: list[str], length: str = "7 days", step: str = "1 day", latest: str = LATEST) -> DataFrame:
    """Counts over sliding windows."""
    return stream.withWatermark(time, latest).groupBy(F.window(time, length, step), *by).agg(F.count("*").alias("n"))


def drain(stream: DataFrame, target: str | None = None) -> DataFrame:
    """Runs a stream over everything that is there, into a table; returns the table."""
    spark = stream.sparkSession
    target = target or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{target}/rows").option("checkpointLocation", f"{target}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    if (e := q.exception()) is not None:
        raise e
    return spark.read.schema(stream.schema).parquet(f"{target}/rows")


def merging(target: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that merges release versions into an archive table.

    The archive only grows, so it is kept as a table instead of operator state. Each batch writes a new
    generation beside the old one and then names it in ``current``: a batch that is run again
    gives the same generation.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        fs = path(target).getFileSystem(conf)
        before = f"{target}/generation={number - 1}"
        versions = batch.select(*archive.FIELDS, "version", "pos")
        if number > 0 and fs.exists(path(before)):
            held = spark.read.parquet(before).select(*archive.FIELDS).withColumns({"version": F.lit(""), "pos": F.lit(0).cast("long")})
            versions = held.unionByName(versions)
        archive.merge(versions).write.mode("overwrite").parquet(f"{target}/generation={number}")

    return run


def hour_gate(last_done: Column, last_tried: Column, now: Column, every_h: int = 24, retry_h: int = 2) -> Column:
    """Whether an update is due: never done, or done a day ago and not tried within two hours."""
    h = lambda a: (F.unix_timestamp(now) - F.unix_timestamp(a)) / 3600
    return last_done.isNull() & (last_tried.isNull() | (h(last_tried) >= retry_h)) | ((h(last_done) >= every_h) & (last_tried.isNull() | (h(last_tried) >= retry_h)))
