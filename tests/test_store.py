import pytest
from pyspark.sql import functions as F

from stratalog.model import ENTRY_SCHEMA, InvalidArgument, StorageFailure, StoreConfig
from stratalog.store import Store


def test_life_of_a_store(spark, tmp_path):
    c = StoreConfig(l0_trigger=2)
    s = Store(spark, f"file://{tmp_path}/s", c)
    assert s.get(b"k") is None and not s.flush() and not s.compact()
    t1 = s.put(b"k", b"v1")
    assert s.put(b"k", b"", "other") > t1
    assert s.get(b"k") == b"v1" and s.get(b"k", "other") == b""
    assert s.flush() and not s.flush()
    s.delete(b"k")
    s.delete(b"ghost")
    assert s.get(b"k") is None and s.get(b"k", "other") == b""
    assert s.batch_put([(b"a", b"1", ""), (b"", b"2", ""), (b"b", b"3", "")]) == (2, 1, ["key must not be empty"])
    assert s.flush() and s.metrics()["level_counts"] == {0: 2}
    before = list(s.rows())
    assert before == [(b"a", b"1"), (b"b", b"3")]
    assert s.compact() and not s.compact() and s.metrics()["level_counts"] == {1: 1}
    assert list(s.rows()) == before and s.get(b"k") is None
    assert s.batch_get([(b"b", ""), (b"no", ""), (b"k", "other"), (b"b", "")]) == [b"3", None, b"", b"3"]
    assert s.vacuum() == 7
    assert [(r.entry_count, r.found, r.intact) for r in s.verify().collect()] == [(5, 5, True)]
    again = Store(spark, f"file://{tmp_path}/s", c)  # reopened
    assert list(again.rows()) == before and again.put(b"z", b"9") > t1
    ns = again.namespace("n")
    ns.batch_put([(b"x", b"1"), (b"y", b"2")])
    assert ns.batch_delete([b"x"]) == (1, 0) and [bytes(r.key) for r in ns.scan().collect()] == [b"y"]
    for bad in (lambda: s.put(b"", b"v"), lambda: s.put(b"k" * 65_536, b"v"), lambda: s.delete(b""), lambda: s.put(b"k", b"v", "n" * 257), lambda: s.batch_put([(b"k", b"v", "")] * 10_001)):
        with pytest.raises(InvalidArgument):
            bad()


def test_bulk_append_and_missing_files(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    df = spark.range(500).select("id", F.lit("").alias("namespace"), F.when(F.col("id") != 7, F.encode(F.format_string("%04d", F.col("id") % 100), "UTF-8")).alias("key"), F.when(F.col("id") < 490, F.encode(F.col("id").cast("string"), "UTF-8")).alias("value"))
    assert [r.id for r in s.append(df, ["id"]).collect()] == [7]
    got = {bytes(r.key): bytes(r.value) for r in s.scan().collect()}
    assert got == {b"%04d" % k: b"%d" % (400 + k) for k in range(90)}
    s.flush()
    assert {bytes(r.key): bytes(r.value) for r in s.scan(b"0010", b"0020").collect()} == {k: v for k, v in got.items() if b"0010" <= k < b"0020"}
    import shutil

    shutil.rmtree(tmp_path / "s" / "segments")
    with pytest.raises(StorageFailure):
        s.get(b"0001")


def test_damage_is_found(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    for n in range(2):
        s.batch_put([(b"k%d" % i, b"v%d" % n, "") for i in range(20)])
        s.flush()
    assert all(r.intact for r in s.verify().collect())
    lost = spark.read.parquet(f"file://{tmp_path}/s/segments/id=1").where("key <> cast('k7' as binary)").collect()
    spark.createDataFrame(lost, ENTRY_SCHEMA).write.mode("overwrite").parquet(f"file://{tmp_path}/s/segments/id=1")
    assert {r.id: (r.found, r.intact) for r in s.verify().collect()} == {0: (20, True), 1: (19, False)}


def test_writes_flush_and_merge_by_themselves(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", StoreConfig(memtable_bytes=200, l0_trigger=2))
    for n in range(4):
        s.batch_put([(b"k%d" % i, b"v%d" % n, "") for i in range(10)])
    m = s.metrics()
    assert m["memtable_entries"] == 0 and m["level_counts"] == {1: 1} and m["sstable_count"] == 1 and m["total_disk_bytes"] > 0
    s.delete(b"k1")
    assert s.get(b"k1") is None and s.get(b"k2") == b"v3"
    m = s.metrics()
    assert (m["writes_total"], m["reads_total"], m["deletes_total"], m["memtable_entries"]) == (40, 2, 1, 1) and m["wal_size_bytes"] == m["memtable_size_bytes"] + 8


def test_two_writers(spark, tmp_path):
    a = Store(spark, f"file://{tmp_path}/s")
    a.put(b"k", b"1")
    a.flush()
    stale = a._version() - 1
    with pytest.raises(StorageFailure):
        a._publish(a.manifest(), stale)
    with pytest.raises(StorageFailure):
        a._write_new(a.entries(), f"file://{tmp_path}/s/log/batch=0")
    (tmp_path / "s" / "log" / "batch=7").mkdir()  # cut off by a failure
    a.put(b"k", b"2")
    assert a.get(b"k") == b"2" and (tmp_path / "s" / "log" / "batch=8").exists()


def test_cold_copies(spark, tmp_path):
    from stratalog.operators import segments

    rows = [("n", b"k%d" % i, None if i % 3 == 0 else b"v", i) for i in range(50)]
    df = spark.createDataFrame(rows, ENTRY_SCHEMA)
    hot, cold, back = (f"file://{tmp_path}/{x}" for x in ("hot", "cold", "back"))
    segments.write_segment(df, hot)
    assert segments.freeze(spark, hot, cold) > 0
    segments.thaw(spark, cold, back)
    assert spark.read.parquet(back).exceptAll(df).count() == 0 == df.exceptAll(spark.read.parquet(back)).count()
    assert segments.drop_cold(spark, cold) and not segments.drop_cold(spark, cold)
