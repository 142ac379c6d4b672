"""Readers of the file formats of the pipeline. Schemas are always given, never inferred."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RELEASE = "pm_id string, title string, publish_date string, ort_raw string, zeit_raw string, text string, source_url string"
WEATHER = "time timestamp_ntz, temp_max_c double, temp_min_c double, precip_mm double, wind_max_kmh double, sunset timestamp_ntz"


def _schema(schema: str | StructType) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def jsonl(spark: SparkSession, path: str, schema: str | StructType = RELEASE) -> DataFrame:
    """JSON lines, strictly: a broken line raises. Lines end at ``\\n`` only; texts may hold other breaks."""
    return spark.read.schema(_schema(schema)).option("mode", "FAILFAST").option("lineSep", "\n").json(path)


def jsonl_tolerant(spark: SparkSession, path: str, schema: str | StructType) -> tuple[DataFrame, DataFrame]:
    """(readable rows, broken lines). A cut-off last line lands among the broken ones."""
    # read as lines: Spark can't select the corrupt column alone from a JSON scan
    s = StructType([*_schema(schema).fields]).add("_bad", "string")
    lines = spark.read.option("lineSep", "\n").text(path).where(F.length("value") > 0)
    d = lines.select("value", F.from_json("value", s, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    broken = F.col("r._bad").isNotNull()
    return d.where(~broken).select("r.*").drop("_bad"), d.where(broken).select(F.col("value").alias("line"))


def csv(spark: SparkSession, path: str, schema: str | StructType, date_format: str = "yyyy-MM-dd", keep_empty: bool = False) -> DataFrame:
    """CSV with header and given types; ids stay text, so that ``002825`` doesn't become 2825.0. With ``keep_empty`` a quoted
    empty string is one, and only a field without anything is missing."""
    d = spark.read.schema(_schema(schema)).option("header", True).option("multiLine", True).option("escape", '"').option("dateFormat", date_format)
    if keep_empty:
        # what the parser puts for a missing field: a mark drawn now is in no file
        d = d.option("emptyValue", "").option("nullValue", uuid.uuid4().hex)
    return d.csv(path)


def json_document(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One JSON document per file."""
    return spark.read.schema(_schema(schema)).option("multiLine", True).option("mode", "FAILFAST").json(path)


def lookup(spark: SparkSession, path: str, value: str = "array<double>") -> DataFrame:
    """A JSON object of name -> value as rows ``name, value``."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("name", "value"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """``file_name, text`` of each text file of a folder (cached texts of court releases)."""
    d = spark.read.text(folder, wholetext=True)
    return d.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file_name"), F.col("value").alias("text"))


def panel(spark: SparkSession, path: str) -> DataFrame:
    """A stored panel in its fixed order."""
    return spark.read.parquet(path).orderBy("day", "district")


def weather(payload: DataFrame) -> DataFrame:
    """Daily weather with the hour of sunset as a number."""
    return payload.select(F.to_date("time").alias("day"), "temp_max_c", "temp_min_c", "precip_mm", "wind_max_kmh", (F.hour("sunset") + F.minute("sunset") / 60).alias("sunset_hour"))


def first_source_wins(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of sources in order of trust: of several rows of a key the first source's stays."""
    d = None
    for k, p in enumerate(parts):
        p = p.withColumn("__source", F.lit(k))
        d = p if d is None else d.unionByName(p)
    rest = [c for c in d.columns if c not in keys]
    best = d.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("__source", F.xxhash64(*rest))).alias("b"))
    return best.select(*keys, *[f"b.{c}" for c in rest if c != "__source"])


def stitched_weather(archive: DataFrame, forecast: DataFrame, first: str, last: str) -> DataFrame:
    """Archive and forecast in one: the archive wins, days outside [first, last] are cut off."""
    return first_source_wins([archive, forecast], ["day"]).where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
