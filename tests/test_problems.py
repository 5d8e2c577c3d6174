"""Change feed, history, copy diff, range lookup and balanced work against brute force, with the awkward cases."""

import random
import shutil
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stratalog.model import InvalidArgument, StorageFailure
from stratalog.operators import change_feed
from stratalog.operators.balance import LEAST_BUCKETS, balanced_aggregate, balanced_join, fragment, plan
from stratalog.operators.change_feed import DeleteVectorTable
from stratalog.operators.copy_diff import copy_diff
from stratalog.operators.history import history, snapshot_diff, snapshot_history
from stratalog.operators.range_lookup import range_lookup
from stratalog.plans import problems
from stratalog.scratch import new_path

FEED = "ns string, key binary, value binary, ts bigint, fid string, pos int, e string"


def dv(spark, keys=("ns", "key")):
    return DeleteVectorTable(spark, new_path(spark, "t"), list(keys), "ts", F.col("value").isNull(), buckets=3)


def feed(spark, rows):
    return spark.createDataFrame([(n, k, v, t, "x", 1, "y") for n, k, v, t in rows], FEED)


def state(rows):
    best = {}
    for n, k, v, t in rows:
        if (n, k) not in best or ((t, v is not None) > (best[n, k][1], best[n, k][0] is not None)):
            best[n, k] = (v, t)
    return {(n, k, v, t) for (n, k), (v, t) in best.items() if v is not None}


def got(t, **kw):
    return [(r.ns, r.key and bytes(r.key), bytes(r.value), r.ts) for r in t.read(**kw).collect()]


def test_change_feed_any_order_and_batching(spark):
    r = random.Random(3)
    ts = list(range(600))
    r.shuffle(ts)
    rows = [(r.choice(["a", "b", None]), r.choice([b"\xff", b"k1", b"k2", b"k3", None]), r.choice([None, b"", b"v%d" % i]), ts[i]) for i in range(600)]
    rows += r.sample(rows, 100)  # repeats
    r.shuffle(rows)
    one, many = dv(spark), dv(spark)
    one.apply(feed(spark, rows))
    for i in range(0, len(rows), 250):
        many.apply(feed(spark, rows[i : i + 250]))
        assert Counter(got(many)) == Counter(state(rows[: i + 250]))
    many.apply(feed(spark, rows[:50]))  # a batch again
    many.apply(feed(spark, []))
    assert Counter(got(one)) == Counter(got(many)) == Counter(state(rows))
    assert Counter(got(many, version=0)) == Counter(state(rows[:250]))  # older versions stay readable
    assert one.read().columns == ["ns", "key", "value", "ts", "fid", "pos", "e"]


def test_change_feed_empty_ties_and_deletes(spark):
    t = dv(spark)
    with pytest.raises(ValueError):
        t.read()
    t.apply(feed(spark, []))
    assert got(t) == []
    t.apply(feed(spark, [("a", b"k", None, 5), ("a", b"k", b"", 5), ("a", b"gone", b"1", 1), ("a", b"gone", None, 2), ("a", b"late", None, 9)]))
    t.apply(feed(spark, [("a", b"late", b"old", 3), ("a", b"gone", b"1", 1)]))
    assert got(t) == [("a", b"k", b"", 5)]  # at equal ts the put wins, an empty value is live, late writes lose to a delete


def test_p1_found_supersedes_rows_of_earlier_batches(spark, tmp_path, monkeypatch):
    """Each key is put, put again and, every other one, deleted, in different batches; one entry has no log_seq."""
    rows = [(b * 10 + i, "n", b"k%d" % i, None if b == 2 and i % 2 else b"v%d" % b, b * 10 + i) for b in range(3) for i in range(10)] + [(None, "n", b"late", b"v", 5)]
    spark.createDataFrame(rows, "log_seq bigint, namespace string, key binary, value binary, ts bigint").write.parquet(f"{tmp_path}/entry_log.parquet")
    tables, init = [], DeleteVectorTable.__init__
    monkeypatch.setattr(DeleteVectorTable, "__init__", lambda self, *a, **kw: (tables.append(self), init(self, *a, **kw))[1])
    out = problems.R.queries["p1_found"](spark, str(tmp_path))
    assert {(bytes.fromhex(r.key_hex), r.ts) for r in out.collect()} == {(b"k%d" % i, 20 + i) for i in range(0, 10, 2)} | {(b"late", 5)}
    (t,) = tables
    was = spark.read.parquet(f"{t.root}/index").where("was is not null")
    assert was.count() == 20
    died = spark.read.parquet(f"{t.root}/dv/batch=2").selectExpr("64 - bit_count(mask) as n", "mask").where("bit_count(mask) > 32")
    assert died.agg(F.sum("n")).first()[0] == 10  # the third batch cleared a bit of each key's second row


@pytest.mark.parametrize("small,words", [(0, 0), (0, 1 << 20), (10**6, 0)])
def test_change_feed_paths_agree(spark, monkeypatch, small, words):
    """The index met by an aggregation or a broadcast, bitmaps by a join or a broadcast, with another type of key and columns in another order."""
    monkeypatch.setattr(change_feed, "SMALL_BATCH", small)
    monkeypatch.setattr(change_feed, "BROADCAST_WORDS", words)
    r = random.Random(5)
    rows = [(r.randrange(40), r.choice([None, "v%d" % i]), i) for i in range(500)]
    r.shuffle(rows)
    t = DeleteVectorTable(spark, new_path(spark, "t"), ["k"], "ts", F.col("v").isNull(), buckets=3)
    t.apply(spark.createDataFrame(rows[:200], "k bigint, v string, ts bigint"))
    t.apply(spark.createDataFrame(rows[200:450], "k int, v string, ts bigint").select("v", "ts", "k"))
    t.apply(spark.createDataFrame(rows[450:], "k int, v string, ts int"))
    best = {}
    for k, v, ts in rows:
        best[k] = max(best.get(k, (-1, None)), (ts, v), key=lambda x: x[0])
    want = {(k, v, ts) for k, (ts, v) in best.items() if v is not None}
    assert {tuple(x) for x in t.read("k", "v", "ts").collect()} == want and t.read().count() == len(want)


def test_change_feed_compaction(spark):
    r = random.Random(8)
    rows = [("a", b"%d" % r.randrange(30), r.choice([None, b"%d" % i]), i) for i in range(300)]
    t = dv(spark)
    for i in range(0, 300, 100):
        t.apply(feed(spark, rows[i : i + 100]))
    assert t.compact() == 3 and Counter(got(t)) == Counter(state(rows)) == Counter(got(t, version=2))
    t.apply(feed(spark, rows[:50]))  # late rows lose, also to deletes
    assert Counter(got(t)) == Counter(state(rows))
    t.apply(feed(spark, [("a", b"5", b"new", 999)]))
    assert Counter(got(t)) == Counter(state([*rows, ("a", b"5", b"new", 999)]))
    assert t.vacuum() == 14 and t.vacuum() == 0  # three batches in three folders, five versions
    assert Counter(got(t)) == Counter(state([*rows, ("a", b"5", b"new", 999)]))


def test_change_feed_ties_of_ts_dont_depend_on_batches(spark):
    rows = [("a", b"k%d" % k, v, 1) for k in range(20) for v in (b"x", b"y", b"z", None)]
    one, many = dv(spark), dv(spark)
    one.apply(feed(spark, rows))
    for i in (2, 0, 3, 1):
        many.apply(feed(spark, rows[i::4]))
    assert Counter(got(one)) == Counter(got(many)) and len(got(one)) == 20


@pytest.mark.parametrize("lost", ["dv/batch=0", "index/batch=0", "data/batch=0"])
def test_change_feed_lost_folder_is_an_error(spark, tmp_path, lost):
    """Paths without a scheme are those of the default file system; nothing counts as empty because it can't be found."""
    t = DeleteVectorTable(spark, f"{tmp_path}/t", ["ns", "key"], "ts", F.col("value").isNull())
    t.apply(feed(spark, [("a", b"%d" % i, b"v", i) for i in range(100)]))
    assert len(got(t)) == 100 and t.root.startswith("file:/")
    shutil.rmtree(tmp_path / "t" / lost)
    with pytest.raises(StorageFailure):
        t.apply(feed(spark, [("a", b"1", b"w", 200)])) if lost.startswith("index") else t.read().collect()


def test_many_blocks(spark):
    n = 70_000
    t = dv(spark)
    df = spark.range(n).select(F.lit("a").alias("ns"), F.encode(F.col("id").cast("string"), "UTF-8").alias("key"), F.encode(F.lit("v"), "UTF-8").alias("value"), F.col("id").alias("ts")).coalesce(1)
    t.apply(df)
    t.apply(df.where("ts % 3 = 0").withColumn("value", F.lit(None).cast("binary")).withColumn("ts", F.col("ts") + n))
    ts = sorted(r.ts for r in t.read("ts").collect())
    assert ts == [i for i in range(n) if i % 3]


def test_history_against_a_fold(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", "hot", "hot", "hot", None]), r.choice([None, *range(-5, 60)]), r.choice(["x", "y", None]), r.choice([1, 2, None]), i, "extra") for i in range(400)]
    df = spark.createDataFrame(rows + rows[:30], "k string, n bigint, at string, inc int, seq int, bk string")
    out = history(df, "k", "n", ["at", "inc"], [F.col("seq")])
    best = {}
    for k, t, s, i, q, _ in rows:
        if k is not None and t is not None and (k, t) not in best or (k, t) in best and best[k, t][2] < q:
            best[k, t] = (s, i, q)
    by = defaultdict(list)
    for (k, t), (s, i, _) in sorted(best.items()):
        if not by[k] or by[k][-1][:2] != (s, i):
            by[k].append((s, i, t))
    want = {(k, s, i, t, e[j + 1][2] if j + 1 < len(e) else None) for k, e in by.items() for j, (s, i, t) in enumerate(e)}
    assert {tuple(x) for x in out.collect()} == want and out.count() == len(want)
    assert out.columns == ["k", "at", "inc", "valid_from", "valid_to"]
    assert history(df.limit(0), "k", "n", ["at", "inc"], [F.col("seq")]).count() == 0


def test_snapshot_diff(spark):
    a = spark.createDataFrame([("1", "x", None), ("2", "y", 1), (None, "z", 1), ("4", None, None)], "id string, s string, before int")
    b = spark.createDataFrame([("1", "x", 5), ("2", "y", 1), ("3", "n", 1), ("4", None, None)], "id string, s string, before int")
    out = {(r.id, r.change) for r in snapshot_diff(a, b, ["id"], ["s", "before"]).collect()}
    assert out == {("1", "changed"), (None, "deleted"), ("3", "inserted")}
    assert snapshot_diff(a.limit(0), a.limit(0), ["id"], ["s"]).count() == 0


def test_snapshot_history(spark):
    rows = [(1, "a", "x"), (1, "b", "y"), (3, "a", "x"), (3, "a", "x"), (3, "c", None), (7, "b", "y"), (7, "c", None), (7, "a", "z"), (9, "c", "n"), (None, "a", "q"), (9, None, "q")]
    out = snapshot_history(spark.createDataFrame([(*r, 1) for r in rows], "t int, id string, n string, k int"), "t", "id", ["n"])
    assert {tuple(r) for r in out.collect()} == {("a", "x", 1, 7), ("a", "z", 7, 9), ("b", "y", 1, 3), ("b", "y", 7, 9), ("c", None, 3, 9), ("c", "n", 9, None)}
    assert snapshot_history(spark.createDataFrame([], "t int, id string, n string"), "t", "id", ["n"]).count() == 0


@pytest.mark.parametrize("every", [1, 4, 1000])
def test_copy_diff(spark, every):
    r = random.Random(7)
    base = [(r.choice(["a", "b", None]), bytes([r.randrange(256), r.randrange(256)]), r.choice([None, b"", b"v"]), r.choice([None, 1, 2])) for _ in range(300)]
    base = list({(n, k): (n, k, v, t) for n, k, v, t in base}.values()) + [("a", None, b"x", 1)]
    other = [(n, k, *r.choice([(v, t), (v, t), (v, t), (None, t), (b"", t), (v, 3)])) for n, k, v, t in base if r.random() > 0.1] + [("zz", b"new", None, None)]
    left, right = base + base[:20], other[::-1] + other[:20]
    schema = "ns string, key binary, value binary, ts bigint"
    out = copy_diff(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["ns", "key"], ["value", "ts"], every=every)
    x, y = {t[:2]: t[2:] for t in base}, {t[:2]: t[2:] for t in other}
    want = {(*k, "only_local") for k in x.keys() - y.keys()} | {(*k, "only_remote") for k in y.keys() - x.keys()}
    want |= {(*k, f) for k in x.keys() & y.keys() for i, f in enumerate(["value", "ts"]) if x[k][i] != y[k][i]}
    rows = [(q.ns, q.key and bytes(q.key), q.field) for q in out.collect()]
    assert Counter(rows) == Counter(want)


@pytest.mark.parametrize("every", [1, 2, 64])
def test_copy_diff_of_keys_with_several_rows(spark, every):
    r = random.Random(11)
    base = [("a", b"%03d" % k, v, 1) for k in range(300) for v in r.sample([None, b"", b"v", b"w"], r.choice([1, 1, 1, 2, 4]))]
    other = [x for x in base if r.random() > 0.05] + [("a", b"%03d" % r.randrange(320), b"new", 2) for _ in range(10)]
    schema = "ns string, key binary, value binary, ts bigint"
    out = copy_diff(spark.createDataFrame(base + base[:9], schema), spark.createDataFrame(other[::-1], schema), ["ns", "key"], ["value", "ts"], every=every)
    x, y = defaultdict(set), defaultdict(set)
    for side, rows in ((x, base), (y, other)):
        for n, k, *fields in rows:
            side[n, k].add(tuple(fields))
    want = {(*k, "only_local") for k in x.keys() - y.keys()} | {(*k, "only_remote") for k in y.keys() - x.keys()}
    want |= {(*k, f) for k in x.keys() & y.keys() for i, f in enumerate(["value", "ts"]) if any(a[i] != b[i] for a in x[k] for b in y[k])}
    assert Counter((q.ns, bytes(q.key), q.field) for q in out.collect()) == Counter(want)


def test_copy_diff_of_a_key_over_many_partitions(spark):
    """Half of the rows are of one key, each in both copies; a second key has one row in either."""
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.format_string("%05d", "id")).alias("key"), F.col("id").alias("v"), F.lit(None).cast("int").alias("w"))
    out = copy_diff(rows, rows.where("v <> 100").union(spark.createDataFrame([("00007", 7, 1)], "key string, v bigint, w int")), ["key"], ["v", "w"], every=16)
    assert sorted(tuple(r) for r in out.collect()) == [("00007", "w"), ("hot", "v")]


def test_copy_diff_empty_sides(spark):
    a = spark.createDataFrame([("k", "v")], "key string, f0 string")
    none = a.limit(0)
    assert [(r.key, r.field) for r in copy_diff(a, none, ["key"], ["f0"]).collect()] == [("k", "only_local")]
    assert copy_diff(none, none, ["key"], ["f0"]).count() == 0
    assert copy_diff(a, a, ["key"], ["f0"]).count() == 0


def test_chunks_fall_back_into_step(spark):
    """An insertion near the front leaves most chunks equal, so few rows are compared."""
    a = spark.range(4000).select(F.format_string("%08d", "id").alias("key"), F.lit("v").alias("f"))
    b = a.union(spark.createDataFrame([("00000010x", "v")], "key string, f string"))
    assert [tuple(r) for r in copy_diff(a, b, ["key"], ["f"], every=16).collect()] == [("00000010x", "only_remote")]


def test_range_lookup(spark):
    r = random.Random(9)
    ranges, points = [], []
    for g in ("a", "b", "c"):
        cuts = sorted(r.sample(range(1000), 60))
        ranges += [(len(ranges) + i, g, b"%04d" % x, b"%04d" % y) for i, (x, y) in enumerate(zip(cuts[::2], cuts[1::2], strict=True))]
    ranges += [(900, "d", None, b"9"), (901, "d", b"1", None), (902, "e", b"5", b"1")]
    points = [(r.choice(["a", "b", "c", "d", "e", None]), r.choice([None, *(b"%04d" % r.randrange(1000) for _ in range(9))]), i, "h") for i in range(500)]
    out = range_lookup(spark.createDataFrame(points, "g string, k binary, rid int, high string"), spark.createDataFrame(ranges, "id int, g string, lo binary, hi binary"), "g", "k", "lo", "hi", "id")
    want = {p[2]: next((i for i, g, lo, hi in ranges if lo and hi and p[1] and g == p[0] and lo <= p[1] <= hi), None) for p in points}
    assert {q.rid: q.id for q in out.collect()} == want and out.count() == 500
    assert range_lookup(spark.createDataFrame(points, "g string, k binary, rid int, high string"), spark.createDataFrame([], "id int, g string, lo binary, hi binary"), "g", "k", "lo", "hi", "id").where("id is not null").count() == 0


def skewed(spark):
    rows = [("hot", 1, i, "t") for i in range(4000)] + [(None, i % 3, 4000 + i, "t") for i in range(300)] + [(f"k{i % 700}", None, 4300 + i, "t") for i in range(3000)]
    return rows, spark.createDataFrame(rows, "a string, b int, id int, task string")


def test_balanced_aggregate(spark):
    rows, df = skewed(spark)
    out = balanced_aggregate(df, ["a", "b"], ["id"], 6, [F.count(F.lit(1)).alias("n"), F.max("id").alias("m")], [F.sum("n").alias("n"), F.max("m").alias("m")])
    n, m = Counter(r[:2] for r in rows), {}
    for a, b, i, _ in rows:
        m[a, b] = max(i, m.get((a, b), -1))
    assert {(q.a, q.b): (q.n, q.m) for q in out.collect()} == {k: (n[k], m[k]) for k in n}
    assert balanced_aggregate(df.limit(0), ["a", "b"], ["id"], 6, [F.count(F.lit(1)).alias("n")], [F.sum("n").alias("n")]).count() == 0


def test_placement_is_balanced_and_bounded(spark):
    rows, df = skewed(spark)
    p = plan(df, ["a", "b"], 6)
    assert p.total == len(rows) and len(p.heavy) <= 24 and len(p.buckets) == LEAST_BUCKETS
    sizes = fragment(df, ["a", "b"], p, ["id"], "to").groupBy("to").count().collect()
    assert max(r["count"] for r in sizes) < 1.6 * len(rows) / 6  # one key has more than half of all rows
    parts = fragment(df, ["a", "b"], p, ["id"], "to").select("to", F.spark_partition_id().alias("p")).distinct().collect()
    assert {r.to: r.p for r in parts} == {i: i for i in range(6)}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_balanced_join(spark, how):
    rows, df = skewed(spark)
    side = [("hot", 1, "x"), ("hot", 1, "y"), (None, 1, "never"), ("k5", None, "never"), ("absent", 2, "z")]
    s = spark.createDataFrame(side, "a string, b int, v string")
    got = Counter(tuple(r) for r in balanced_join(df, s, ["a", "b"], ["id"], 6, how).select("a", "b", "id", "v").collect())
    want = Counter(tuple(r) for r in df.join(s, ["a", "b"], how).select("a", "b", "id", "v").collect())
    assert got == want
    with pytest.raises(ValueError):
        balanced_join(df, s, ["a", "b"], ["id"], 6, "full")


def test_balanced_join_of_different_key_types(spark):
    big = spark.range(1000).select(F.col("id").cast("int").alias("k"), F.col("id").alias("n"))
    side = spark.range(0, 1000, 3).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = {tuple(r) for r in balanced_join(big, side, ["k"], ["n"], 5).collect()}
    assert got == {(i, i, 2 * i) for i in range(0, 1000, 3)}
    with pytest.raises(InvalidArgument):
        balanced_join(big.withColumn("k", F.col("k").cast("string")), side, ["k"], ["n"], 5)


def test_placement_balances_any_number_of_tasks(spark):
    p = plan(spark.range(1_000_000), ["id"], 4000)
    assert max(p.loads) < 1.3 * p.total / 4000 and len(p.buckets) == 64_000
    sizes = p.placed(spark.range(1_000_000), ["id"], "at").groupBy(F.col("at")[0]).count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert sizes[0] < 1.3 * 250 and sizes[1] == 4000
