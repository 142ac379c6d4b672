from datetime import datetime

from wachbuch.operators import snapshots

SCHEMA = "snap_row_id long, snapshot_no int, delivered_at timestamp_ntz, pm_id string, source_url string, title string, publish_date string, ort_raw string, zeit_raw string, text string, versions string, ordinal int"
AT = datetime(2026, 1, 1)


def row(k, snap, pm, title="t", text="x", at=AT, url="https://a.example/p-ab-01012026-7"):
    return (k, snap, at, pm, url, title, None, None, None, text, "v", 1)


def found(spark, rows, **kw):
    return sorted(tuple(r) for r in snapshots.changes(spark.createDataFrame(rows, SCHEMA), **kw).collect())


def test_kinds_spacing_numbers_and_late_rows(spark):
    rows = [row(1, 1, "001"), row(2, 1, "2"), row(3, 1, "3"), row(4, 1, "4"), row(5, 2, "1.0", title=" t "), row(6, 2, "3 ", text="y"), row(7, 2, "5"), row(8, 2, "4", text="old"), row(9, 2, "4", at=datetime(2026, 1, 2)), row(9, 2, "4", at=datetime(2026, 1, 2))]
    assert found(spark, rows) == [(2, 2, 7, "removed"), (2, 3, 7, "changed"), (2, 5, 7, "added")]


def test_nulls_empty_and_unreadable_keys(spark):
    assert found(spark, []) == []
    assert found(spark, [row(1, 1, None), row(2, 2, "x"), row(3, None, "1"), (4, 2, None, "9", None, None, None, None, None, None, None, None)]) == []
    assert found(spark, [row(1, 1, "1", title=""), row(2, 2, "1", title=None), row(3, 3, "1", text="y" * 100_000)]) == [(3, 1, 7, "changed")]


def test_ordinals_persist(spark):
    one = snapshots.with_ordinals(snapshots.reduced(spark.createDataFrame([row(1, 1, "1"), row(2, 1, "5")], SCHEMA)))
    known = {r.key_no: r.ordinal for r in one.collect()}
    two = {r.key_no: r.ordinal for r in snapshots.with_ordinals(snapshots.reduced(spark.createDataFrame([row(1, 2, "1"), row(2, 2, "3"), row(3, 2, "5")], SCHEMA)), one).collect()}
    assert two[1] == known[1] and two[5] == known[5] and two[3] == 2


def test_bitmaps_sparse_and_dense():
    import numpy as np

    rnd = np.random.default_rng(1)
    for n, m in ((10, 4000), (4000, 10), (4000, 5000), (3, 5), (0, 9)):
        a, b = (np.unique(rnd.integers(0, snapshots.CHUNK, k)) for k in (n, m))
        x, y = snapshots.bitmap(a), snapshots.bitmap(b)
        assert set(snapshots.and_not(x, y)) == set(a) - set(b)
        assert set(snapshots.both(x, y)) == set(a) & set(b)


def test_a_dictionary_with_one_key(spark):
    one = snapshots.with_ordinals(snapshots.reduced(spark.createDataFrame([row(1, 1, "9")], SCHEMA)))
    two = snapshots.with_ordinals(snapshots.reduced(spark.createDataFrame([row(1, 2, "9"), row(2, 2, "3")], SCHEMA)), one)
    assert {r.key_no: r.ordinal for r in two.collect()} == {9: 0, 3: 1}


def test_a_later_run_goes_on_with_the_stored_numbers(spark, tmp_path):
    place = str(tmp_path / "ordinals")
    first, second = [row(1, 1, "1"), row(2, 1, "5")], [row(3, 2, "1", text="z"), row(4, 2, "3")]
    assert found(spark, first, dictionary=place) == [] and snapshots.generation(spark, place) == 1
    assert found(spark, first + second, dictionary=place) == [(2, 1, 7, "changed"), (2, 3, 7, "added"), (2, 5, 7, "removed")]
    stored = [{r.key_no: r.ordinal for r in spark.read.parquet(f"{place}/generation={g}").collect()} for g in (1, 2)]
    assert stored[1] == stored[0] | {3: 2}
    # a delivery without some of the keys keeps their numbers
    assert found(spark, second, dictionary=place) == [] and {r.key_no for r in spark.read.parquet(f"{place}/generation=3").collect()} == {1, 3, 5}


def test_chunks_over_batches_and_partitions(spark):
    n = snapshots.CHUNK + 500
    old = spark.range(1, n).selectExpr("id as snap_row_id", "1 as snapshot_no", "id", "case when id % 7 = 0 then 'a' else 'b' end as title")
    new = spark.range(3, n + 2).selectExpr("id as snap_row_id", "2 as snapshot_no", "id", "case when id % 14 = 0 then 'c' when id % 7 = 0 then 'a' else 'b' end as title")
    rows = old.unionByName(new).selectExpr("snap_row_id", "snapshot_no", "timestamp_ntz'2026-01-01' as delivered_at", "cast(id as string) as pm_id", "'https://a.example/p-7' as source_url", "title", "'d' as publish_date", "'o' as ort_raw", "'z' as zeit_raw", "'t' as text")
    got = {r.change_kind: r["count"] for r in snapshots.changes(rows).groupBy("change_kind").count().collect()}
    assert got == {"added": 2, "removed": 2, "changed": sum(1 for k in range(3, n) if k % 14 == 0)}
