import time

import pandas as pd
from pyspark.sql import functions as F

from stratalog.operators.change_feed import DeleteVectorTable
from stratalog.operators.resolve import latest
from stratalog.scratch import new_path
from stratalog.streaming.state import apply_stream, latest_stream, membership_stream

SCHEMA = "namespace string, key binary, value binary, ts bigint"


def write(spark, path, rows, n):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/part={n}")


def test_streams_equal_batch(spark, tmp_path):
    rows = [("n", b"k%d" % (i % 7), None if i % 5 == 0 else b"v%d" % i, (i * 37) % 101) for i in range(100)]
    for n in range(4):
        write(spark, tmp_path / "in", rows[n::4], n)
    changes = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    want = latest(spark.createDataFrame(rows, SCHEMA))
    q = latest_stream(changes).writeStream.format("memory").queryName("newest").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("newest").exceptAll(want).count() == 0 and spark.table("newest").count() == 7
    t = DeleteVectorTable(spark, new_path(spark, "stream"), ["namespace", "key"], "ts", F.col("value").isNull())
    apply_stream(changes, t, f"{tmp_path}/checkpoint").awaitTermination(120)
    assert t.version == 3
    again = spark.createDataFrame(rows[:5], SCHEMA)
    assert t.apply(again, f"{tmp_path}/checkpoint", 3) == 3 and t.apply(again, "other", 0) == 4  # a replayed batch is passed over
    live = want.where("value is not null")
    assert t.read().select(*live.columns).exceptAll(live).count() == 0 and t.read().count() == live.count()


def test_membership_stream(spark, tmp_path):
    ev = pd.DataFrame({"node_id": ["a", "a", "a", "b", None], "at": pd.to_datetime(["2025-01-01 00:00:01", "2025-01-01 00:00:02", "2025-01-01 00:00:03", "2025-01-01 00:00:00", "2025-01-01 00:00:00"]), "state": ["alive", "suspected", "alive", "alive", "alive"], "incarnation": [1, 1, 0, 3, 1]})
    spark.createDataFrame(ev, "node_id string, at timestamp, state string, incarnation bigint").write.parquet(f"{tmp_path}/ev")
    s = spark.readStream.schema("node_id string, at timestamp, state string, incarnation bigint").parquet(f"{tmp_path}/ev")
    q = membership_stream(s, 200).writeStream.format("memory").queryName("members").outputMode("append").start()
    for _ in range(60):  # the timer runs on processing time, so the query is never out of work
        if spark.table("members").where("state = 'dead'").count():
            break
        time.sleep(0.5)
    q.stop()
    got = {(r.node_id, r.state, r.incarnation) for r in spark.table("members").collect()}
    assert got == {("a", "alive", 1), ("a", "suspected", 1), ("a", "dead", 1), ("b", "alive", 3)}
