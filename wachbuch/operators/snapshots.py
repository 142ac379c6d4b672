"""What changed between consecutive full snapshots.

1. Each row is reduced to its key (number, page) and one 64-bit hash per compared column; of several
   rows of a key in one snapshot the one delivered last counts (ties: the largest row id).
2. Keys get persistent ordinals: a dictionary handed in keeps its numbers, new keys are appended
   after them in sorted order, numbered by range partition (only one count per partition is collected).
   The dictionary is written to a table, which the next run over further snapshots reads and goes on with.
3. Ordinals are cut into chunks. Per chunk and snapshot there is a compressed bitmap of the ordinals
   present (sorted 16-bit positions while sparse, packed words when dense) and per column an
   ordinal-aligned vector of hashes. AND-NOT of the bitmaps of two snapshots gives additions and
   removals; where both have a bit, differing vectors are changes. A chunk whose keys lie in several partitions
   is compared in parts: bitmaps of disjoint keys give disjoint results.

After the shuffle on the key everything is partition-local. A page may hold a third of all rows:
the key includes the release number, so its rows spread over all partitions.

Defined results: spacing is no difference, an empty value is a missing one. Rows without a snapshot
number, release number or page number belong to no release and are left out. Repeated rows count
once. An empty table gives no rows. A snapshot is compared with the one with the next lower number.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wachbuch.functions.text import page_number, release_number, squeeze
from wachbuch.session import cut, shared_folder, width

COMPARED = ("title", "publish_date", "ort_raw", "zeit_raw", "text")
CHUNK = 1 << 13
SPARSE = CHUNK // 16
KINDS = np.array(["added", "removed", "changed"])


def bitmap(positions: np.ndarray, size: int = CHUNK) -> np.ndarray:
    """Compressed bitmap: 16-bit positions while sparse, else packed bits (uint8)."""
    if len(positions) <= SPARSE:
        return np.unique(positions).astype(np.uint16)
    bits = np.zeros(size, bool)
    bits[positions] = True
    return np.packbits(bits)


def positions(b: np.ndarray) -> np.ndarray:
    return b.astype(np.int64) if b.dtype == np.uint16 else np.flatnonzero(np.unpackbits(b))


def and_not(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions set in ``a`` but not in ``b``."""
    if a.dtype == b.dtype == np.uint8:
        return np.flatnonzero(np.unpackbits(a & ~b))
    return np.setdiff1d(positions(a), positions(b), assume_unique=True)


def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.dtype == b.dtype == np.uint8:
        return np.flatnonzero(np.unpackbits(a & b))
    return np.intersect1d(positions(a), positions(b), assume_unique=True)


def reduced(rows: DataFrame, compared: tuple[str, ...] = COMPARED) -> DataFrame:
    """One row per key: ``key_no, key_page, versions`` (array of snapshot number and hashes)."""
    def vector(c: str):
        s = F.nullif(squeeze(F.col(c).cast("string")), F.lit(""))
        return F.when(s.isNotNull(), F.xxhash64(s)).otherwise(F.lit(0).cast("long")).alias(c)

    d = rows.select(
        F.col("snapshot_no").cast("long").alias("snap"),
        release_number(F.col("pm_id")).alias("key_no"),
        page_number(F.col("source_url")).alias("key_page"),
        F.struct(F.col("delivered_at").alias("at"), F.col("snap_row_id").cast("long").alias("row"), *[vector(c) for c in compared]).alias("v"),
    ).where("snap is not null and key_no is not null and key_page is not null")
    # partitioned by key alone, so that both aggregations use one shuffle
    d = d.repartition(width(rows.sparkSession), "key_no", "key_page")
    d = d.groupBy("key_no", "key_page", "snap").agg(F.max("v").alias("v"))
    return d.groupBy("key_no", "key_page").agg(F.collect_list(F.struct("snap", *[F.col(f"v.{c}").alias(f"c{k}") for k, c in enumerate(compared)])).alias("versions"))


def with_ordinals(keys: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Adds ``ordinal``. ``dictionary`` (key_no, key_page, ordinal) of an earlier run keeps its numbers."""
    start = 0
    if dictionary is not None:
        known = keys.join(dictionary.select("key_no", "key_page", "ordinal"), ["key_no", "key_page"])
        highest = dictionary.agg(F.max("ordinal")).first()[0]
        start = 0 if highest is None else highest + 1
        fresh = keys.join(dictionary.select("key_no", "key_page"), ["key_no", "key_page"], "left_anti")
    else:
        known, fresh = None, keys
    n = width(keys.sparkSession)
    # sorted key ranges, materialised, so that numbering can't shift if a partition is computed again
    fresh = cut(fresh.repartitionByRange(n, "key_page", "key_no").sortWithinPartitions("key_page", "key_no").withColumn("pid", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()))
    counts = fresh.groupBy("pid").agg(F.count("*").alias("m"), F.min("pos").alias("low")).orderBy("pid").collect()
    base, offsets = start, []
    for r in counts:
        offsets.append((r["pid"], base - r["low"]))
        base += r["m"]
    off = keys.sparkSession.createDataFrame(offsets or [(0, 0)], "pid int, shift bigint")
    fresh = fresh.join(F.broadcast(off), "pid").withColumn("ordinal", F.col("pos") + F.col("shift")).drop("pid", "pos", "shift")
    return fresh if known is None else known.unionByName(fresh)


def compare(numbered: DataFrame, snaps: list[int], n_cols: int = len(COMPARED)) -> DataFrame:
    """``snapshot_no, pm_no, page_no, change_kind`` for each snapshot against the one before."""
    numbers = np.array(sorted(snaps), dtype=np.int64)
    out = pa.schema([("snapshot_no", pa.int64()), ("pm_no", pa.int64()), ("page_no", pa.int64()), ("change_kind", pa.string())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of their ordinals; a chunk may go on in the next batch, and holds ``CHUNK`` rows at most."""
        held: list[pa.RecordBatch] = []
        number = -1
        for b in batches:
            chunk = b.column("ordinal").to_numpy(zero_copy_only=False) // CHUNK
            edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1), b.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if chunk[lo] != number and held:
                    yield from one(held)
                    held = []
                number = chunk[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from one(held)

    def one(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        place = b.column("ordinal").to_numpy(zero_copy_only=False) % CHUNK
        no, page = np.zeros(CHUNK, np.int64), np.zeros(CHUNK, np.int64)
        no[place], page[place] = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key_no", "key_page"))
        lists = b.column("versions")
        flat = lists.flatten()
        at = np.repeat(place, np.diff(lists.offsets.to_numpy()))
        snap = flat.field("snap").to_numpy(zero_copy_only=False)
        cols = [flat.field(f"c{k}").to_numpy(zero_copy_only=False) for k in range(n_cols)]
        maps, vectors = [], []
        for s in numbers:
            here = snap == s
            maps.append(bitmap(at[here]))
            vec = np.zeros((n_cols, CHUNK), np.int64)
            for k in range(n_cols):
                vec[k, at[here]] = cols[k][here]
            vectors.append(vec)
        for k in range(1, len(numbers)):
            old, new = maps[k - 1], maps[k]
            common = both(old, new)
            found = [and_not(new, old), and_not(old, new), common[(vectors[k - 1][:, common] != vectors[k][:, common]).any(axis=0)]]
            where = np.concatenate(found).astype(np.int64)
            if len(where):
                kind = np.repeat(KINDS, [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(where), numbers[k])), pa.array(no[where]), pa.array(page[where]), pa.array(kind)], schema=out)

    # keys lie in ranges of their ordinals already; sorting them there needs no shuffle
    return numbered.sortWithinPartitions("ordinal").mapInArrow(chunks, "snapshot_no long, pm_no long, page_no long, change_kind string")


def changes(rows: DataFrame, dictionary: str | None = None) -> DataFrame:
    """p6_found. The distinct snapshot numbers are collected: one value per delivery of the archive.

    ``dictionary``: where the table of ordinals lies. What is there keeps its numbers, the state after this run is
    written beside it (``generation=n``). Without it a new table is begun in the shared folder.
    """
    spark = rows.sparkSession
    snaps = [r[0] for r in rows.select(F.col("snapshot_no").cast("long")).where("snapshot_no is not null").distinct().collect()]
    place = dictionary or f"{shared_folder(spark)}/ordinals-{uuid.uuid4().hex}"
    before = generation(spark, place)
    keys = reduced(rows)
    known = spark.read.parquet(f"{place}/generation={before}") if before else None
    numbered = cut(with_ordinals(keys, known))
    fresh = numbered.select("key_no", "key_page", "ordinal")
    # numbers of keys that this delivery lacks are kept
    state = fresh if known is None else fresh.unionByName(known.join(fresh.select("key_no", "key_page"), ["key_no", "key_page"], "left_anti").select("key_no", "key_page", "ordinal"))
    state.write.mode("overwrite").parquet(f"{place}/generation={before + 1}")
    return compare(numbered, snaps)


def generation(spark: SparkSession, place: str) -> int:
    """The newest complete generation of a dictionary; 0 if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(place).getFileSystem(spark._jsc.hadoopConfiguration())
    n = 0
    while fs.exists(path(f"{place}/generation={n + 1}/_SUCCESS")):
        n += 1
    return n
