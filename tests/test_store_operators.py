"""Behaviour of the store's operators on inline entries."""

import bisect
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from stratalog.functions import codecs, keys, scalars
from stratalog.model import InvalidArgument, StorageFailure, StoreConfig
from stratalog.operators import catalog, compaction, membership, ordered, placement, reads, repair, segments, wal, writes
from stratalog.operators.resolve import latest, live, merge_runs, versions
from stratalog.plans import store as store_plans

ENTRY = "namespace string, key binary, value binary, ts bigint"


def log(spark, *rows):
    return spark.createDataFrame(list(rows), ENTRY)


def pairs(df):
    return [(bytes(r.key), bytes(r.value)) for r in df.collect()]


def test_overwrite_delete_and_empty_value(spark):
    e = log(spark, ("d", b"k", b"v1", 1), ("d", b"k", b"v3", 3), ("d", b"k", b"v2", 2), ("d", b"ghost", None, 4), ("d", b"e", b"", 5), ("d", b"x", b"1", 6), ("d", b"x", None, 7))
    assert sorted(pairs(live(e))) == [(b"e", b""), (b"k", b"v3")]
    assert latest(e).count() == 4
    assert [r.version for r in versions(e).where(F.col("key") == reads.lit_bytes("k")).orderBy(F.desc("ts")).collect()] == [1, 2, 3]


def test_namespaces_are_isolated_after_merging(spark):
    a, b = log(spark, ("a", b"key", b"1", 1)), log(spark, ("b", b"key", b"2", 9), ("b", b"key", None, 10))
    m = merge_runs(a, b)
    assert pairs(reads.get(m, b"key", "a")) == [(b"key", b"1")]
    assert reads.get(m, b"key", "b").count() == 0 and reads.get(m, b"key").count() == 0


def test_scan_forms(spark):
    e = log(spark, *(("default", bytes([i]), bytes([10 * i]), i) for i in range(10)), ("other", b"\x05", b"x", 50), ("default", b"\xff", b"z", 51))
    keys = lambda **kw: [r.key[0] for r in reads.scan(e, **kw).collect()]
    assert keys(start=b"\x03", end=b"\x07") == [3, 4, 5, 6]
    assert keys(start=b"\x03", end=b"\x07", inclusive=True) == [3, 4, 5, 6, 7]
    assert keys() == [*range(10), 255]  # bytes compare unsigned
    assert keys(limit=5) == [0, 1, 2, 3, 4] and keys(limit=0) == keys()
    assert keys(start=b"\x08") == [8, 9, 255] and keys(end=b"\x02") == [0, 1]
    assert keys(reverse=True, limit=2) == [255, 9]
    assert [r.key[0] for r in reads.scan(e, limit=99, config=StoreConfig(max_scan=3)).collect()] == [0, 1, 2]
    assert [r.key[0] for r in reads.NamespaceView(e, "other").scan().collect()] == [5]
    with pytest.raises(InvalidArgument):
        reads.scan(e, limit=-1)


def test_limit_counts_live_rows(spark):
    e = log(spark, ("default", b"a", b"1", 1), ("default", b"b", b"1", 2), ("default", b"c", b"1", 3), ("default", b"b", None, 4))
    assert [bytes(r.key) for r in reads.scan(e, limit=2).collect()] == [b"a", b"c"]


def test_scan_plan_filters_below_the_resolution(spark, tmp_path):
    log(spark, ("default", b"a", b"1", 1)).write.parquet(str(tmp_path / "e"))
    plan = reads.scan(spark.read.parquet(str(tmp_path / "e")), start=b"a", end=b"b", limit=3)._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan and "EqualTo(namespace" in plan and "TakeOrderedAndProject" in plan


def test_batch_get(spark):
    e = log(spark, ("default", b"a", b"1", 1), ("n", b"a", b"2", 2), ("n", b"b", None, 3))
    r = spark.createDataFrame([(0, "n", b"a"), (1, "", b"a"), (2, None, b"a"), (3, "n", b"b"), (4, "n", b""), (5, "n", None), (6, "n", b"a")], "ordinal int, namespace string, key binary")
    got = [(x.found, x.value and bytes(x.value)) for x in reads.batch_get(e, r).orderBy("ordinal").collect()]
    assert got == [(True, b"2"), (True, b"1"), (True, b"1"), (False, None), (False, None), (False, None), (True, b"2")]
    with pytest.raises(InvalidArgument):
        reads.batch_get(e, r, StoreConfig(max_batch=6))
    with pytest.raises(InvalidArgument):
        reads.batch_get(e, r.withColumn("namespace", F.lit("n" * 257)))
    with pytest.raises(InvalidArgument):
        reads.get(e, b"")


def test_validation(spark):
    r = log(spark, ("n", b"", b"v", 1), ("n", b"k" * 65_536, b"v", 2), ("n" * 257, b"k", b"v", 3), ("", b"k", b"", 4), (None, b"k" * 65_535, None, 5), ("n", None, b"v", 6))
    errors = [x.e for x in r.select(writes.put_error().alias("e"), "ts").orderBy("ts").collect()]
    assert [bool(e) for e in errors] == [True, True, True, False, False, True]
    assert {x.namespace for x in writes.accepted(r, writes.put_error()).collect()} == {"default"}
    report = writes.batch_report(r.withColumn("b", F.lit(1)), "b", writes.delete_error()).first()
    assert (report.ok, report.failed, len(report.errors)) == (2, 4, 3)
    whole = writes.batch_report(r.withColumn("b", F.lit(1)), "b", writes.put_error(), StoreConfig(max_batch=5)).first()
    assert (whole.ok, whole.failed) == (0, 6)


def test_assign_ts_is_the_sequential_clock(spark):
    walls = [5, 5, 5, 100, 99, 98, 101, 300, 1, 1]
    df = spark.createDataFrame(list(enumerate(walls)), "i int, w bigint").repartition(3)
    got = [r.ts for r in writes.assign_ts(df, ["i"], "w", base=7).orderBy("i").collect()]
    prev, want = 7, []
    for w in walls:
        prev = max(prev, w) + 1
        want.append(prev)
    assert got == want


def test_running_sum_and_following(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), (F.col("id") % 5).alias("v"), F.lit(1).alias("part"))
    rows = {r.k: (r.s, r.nxt.k if r.nxt else None) for r in ordered.following(ordered.running_sum(df, ["k"], F.col("v"), "s"), ["k"], "nxt").collect()}
    v, total = {r.k: r.v for r in df.collect()}, 0
    for k in range(1000):
        total += v[k]
        assert rows[k] == (total, k + 1 if k < 999 else None)
    assert ordered.global_row_number(df.limit(0), ["k"], "n").count() == 0


def test_compaction(spark):
    e = log(spark, ("n", b"a", b"1", 1), ("n", b"c", b"old", 1), ("n", b"b", b"2", 2), ("n", b"c", b"new", 2), ("n", b"d", None, 3), ("m", b"c", b"other", 9))
    assert compaction.compact(e).count() == 5 and compaction.compact(e, last_level=True).count() == 4
    s = compaction.compaction_stats(e, last_level=True).first()
    assert (s.entries_read, s.entries_written, s.entries_discarded) == (6, 4, 2)
    assert live(compaction.compact(e)).exceptAll(live(e)).count() == 0
    assert tuple(compaction.compaction_stats(e.limit(0)).first()) == (0, 0, 0)


MANIFEST = "id int, level int, file_size bigint, min_key binary, max_key binary, compacted int"


def test_compaction_plan(spark):
    rows = [(i, 0, 10, b"a", b"z", 0) for i in range(4)] + [(10, 1, 10, b"a", b"c", 0), (11, 1, 10, b"x", b"z", 1), (12, 2, 10, b"a", b"b", 0)]
    plan = {(r.id, r.target_level, r.role) for r in compaction.compaction_plan(spark.createDataFrame(rows, MANIFEST)).collect()}
    assert plan == {(i, 1, "source") for i in range(4)} | {(10, 1, "overlap")}
    rows = [(1, 1, 600, b"m", b"p", 0), (2, 1, 600, b"a", b"c", 0), (3, 2, 5, b"b", b"d", 0), (4, 2, 5, b"d", b"e", 0)]
    plan = {(r.id, r.target_level, r.role) for r in compaction.compaction_plan(spark.createDataFrame(rows, MANIFEST), StoreConfig(level1_bytes=1000)).collect()}
    assert plan == {(2, 2, "source"), (3, 2, "overlap")}
    assert compaction.compaction_plan(spark.createDataFrame([], MANIFEST)).count() == 0


def test_segments(spark, tmp_path):
    e = log(spark, *(("n%d" % (i % 3), b"k%05d" % (i * 37 % 500), None if i % 9 == 0 else b"v" * (i % 90), i) for i in range(1, 800)))
    segments.write_segment(e, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.exceptAll(e).count() == 0 == e.exceptAll(back).count()
    cut = segments.cut_segments(e, StoreConfig(memtable_bytes=5000))
    stats = segments.segment_stats(cut, ["segment"]).orderBy("segment").collect()
    assert sum(r.entry_count for r in stats) == 799 and len(stats) > 5 and all(r.file_size < 5200 for r in stats)
    assert all(a.max_timestamp < b.min_timestamp for a, b in zip(stats, stats[1:], strict=False))
    blocks = segments.block_layout(cut, "segment", StoreConfig(block_bytes=300)).collect()
    assert sum(b.entries for b in blocks) == 799 and all(b.bytes <= 300 or b.entries == 1 for b in blocks)


@pytest.mark.parametrize("limit", [60, 300, 2000, 10**6])
def test_blocks_of_segments_over_many_partitions(spark, limit):
    """As one writer packs them, though a segment spans partitions; some entries are larger than a block."""
    e = log(spark, *(("n", b"k%04d" % i, b"v" * (i * 31 % 70 if i % 50 else 400), i) for i in range(900))).withColumn("s", F.expr("case when ts < 700 then 0 else 1 + ts div 100 end"))
    want = []
    for seg in (0, 8, 9):
        used = limit + 1
        for r in sorted(e.where(F.col("s") == seg).collect(), key=lambda r: r.key):
            size = 19 + len(r.key) + len(r.value) + len(r.namespace) - 2
            if used + size > limit:
                want.append([seg, bytes(r.key), None, 0, 0])
                used = 0
            used += size
            want[-1][2:] = [bytes(r.key), want[-1][3] + 1, want[-1][4] + size]
    got = segments.block_layout(e, "s", StoreConfig(block_bytes=limit)).orderBy("segment", "block").collect()
    assert [[r.segment, bytes(r.first_key), bytes(r.last_key), r.entries, r.bytes] for r in got] == want
    assert [r.block for r in got] == [sum(w[0] == x[0] for x in want[:i]) for i, w in enumerate(want)]
    assert segments.block_layout(e.limit(0), "s").count() == 0


def test_block_lookup_over_namespaces(spark):
    e = log(spark, *((f"n{i % 3}", b"k%02d" % (i * 7 % 23), b"v" * (i % 50), i) for i in range(400)))
    cut = segments.cut_segments(e, StoreConfig(memtable_bytes=6000)).cache()
    layout = segments.block_layout(cut, "segment", StoreConfig(block_bytes=300)).cache()
    blocks = [(r.segment, (r.first_namespace, bytes(r.first_key)), r.block, (r.last_namespace, bytes(r.last_key))) for r in layout.collect()]
    held = {(r.segment, r.namespace, bytes(r.key)) for r in cut.collect()}
    for ns, key in (("n0", b"k22"), ("n1", b"k00"), ("n1", b"k11"), ("n2", b"k05"), ("n2", b"k99"), ("a", b"k05")):
        want = {}
        for s, first, block, last in sorted(blocks):
            if first <= (ns, key):
                want[s] = (block, last)
        want = {s: b[0] for s, b in want.items() if b[1] >= (ns, key)}
        got = {r.segment: r.block for r in segments.block_lookup(layout, F.lit(ns), reads.lit_bytes(key)).collect()}
        assert got == want and {s for s, n, k in held if (n, k) == (ns, key)} <= set(got)


@pytest.mark.parametrize("rows", [0, 5, 8, 61, 800])
def test_even_segments(spark, rows):
    e = log(spark, *(("n", b"k%d" % (i % 7), b"v", i * 3) for i in range(rows)))
    cut = segments.even_segments(e, 8)
    want = e.selectExpr("*", "ntile(8) over (order by ts) - 1 as segment")
    assert cut.columns == want.columns and cut.count() == rows and cut.exceptAll(want).count() == 0


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """20,000 events, each of a user of its own."""
    d = str(tmp_path_factory.mktemp("wide"))
    spark.range(20_000).selectExpr("id as event_id", "id as user_id", "'click' as event_type", "'{}' as props").write.parquet(f"{d}/events.parquet")
    spark.range(100_000, 100_400).selectExpr("id as c_custkey").write.parquet(f"{d}/customer.parquet")
    return d


def test_compact_l0_grows_with_the_table(spark, wide):
    assert sorted(r.ts for r in store_plans.R.queries["compact_l0"](spark, wide).collect()) == list(range(20_000))


def test_l0_best_grows_with_the_table(spark, wide):
    assert sorted(r.ts for r in store_plans.R.queries["l0_best"](spark, wide).collect()) == [i for i in range(10_000, 20_000) if i % 7]


def test_every_filter_is_asked_for_absent_keys(spark, wide):
    got = store_plans.R.queries["bloom_probe"](spark, wide).withColumn("user", F.expr("decode(unhex(key_hex), 'UTF-8')")).cache()
    absent = got.where("user >= 'user_100000'").groupBy("segment").count().collect()
    assert {tuple(r) for r in absent} == {(s, 50) for s in range(8)}
    assert {r.segment for r in got.where("user < 'user_100000'").select("segment").distinct().collect()} == set(range(1, 8))


def test_upsert_retire_and_versions(spark):
    now = spark.createDataFrame([("a", "1", 1), ("b", "1", 1)], "name string, value string, seq int")
    new = spark.createDataFrame([("a", "2", 1), ("c", None, 3), ("b", "0", 0)], "name string, value string, seq int")
    assert {tuple(r) for r in catalog.upsert(now, new, ["name"], "seq").collect()} == {("a", "2", 1), ("b", "1", 1), ("c", None, 3)}
    m = spark.createDataFrame([(1, 0), (2, 0)], "id int, compacted int")
    done = catalog.retire(m, spark.createDataFrame([(2,), (2,)], "id int"))
    assert {tuple(r) for r in done.collect()} == {(1, 0), (2, 1)} and catalog.purge(done).count() == 1
    none = spark.createDataFrame([], "version int")
    assert catalog.schema_version(none).first().version == 0
    known = spark.createDataFrame([(1,), (2,)], "version int")
    assert catalog.pending_migrations(none, known).count() == 2 and catalog.pending_migrations(known, known).count() == 0


def test_prometheus_escapes(spark):
    line = spark.range(1).select(catalog.prometheus_line("x", F.lit("n"), F.lit(3), [("p", F.lit('a"b\\c\nd'))]).alias("l")).first().l
    assert line == 'x_n{p="a\\"b\\\\c\\nd"} 3'


def test_membership(spark):
    u = spark.createDataFrame([("a", "h1", "alive", 1, 1), ("a", None, "suspected", 1, 2), ("a", None, "alive", 0, 3), ("b", None, "alive", 5, 4), ("c", "h3", "dead", 2, 5), ("c", "h4", "alive", 2, 6), (None, "h", "alive", 1, 7), ("c", "h5", None, 9, 8)], "node_id string, address string, state string, incarnation bigint, seq int")
    got = {tuple(r) for r in membership.merge_updates(u).collect()}
    assert got == {("a", "h1", "suspected", 1), ("c", "h4", "alive", 2)}
    t = spark.createDataFrame([("a", 0, "alive"), ("a", 10, "suspected"), ("a", 12, "alive"), ("b", 10, "suspected"), ("b", 40, "alive"), ("c", 95, "suspected")], "node_id string, at_us bigint, state string")
    dead = {(r.node_id, r.at_us): r.dead_at_us for r in membership.timeouts(t, 100, 5 + 1).collect()}
    assert dead == {("a", 0): None, ("a", 10): None, ("a", 12): None, ("b", 10): 16, ("b", 40): None, ("c", 95): None}


def test_status_and_random_members(spark):
    import json

    m = spark.createDataFrame([(f"n{i}", f"h{i}", " Alive" if i % 3 else "dead", i) for i in range(12)], "node_id string, address string, state string, incarnation bigint")
    s = json.loads(catalog.status_json(m).first().status)
    assert s["total_nodes"] == 12 and s["alive_nodes"] == 8 and s["nodes"][0] == {"node_id": "n0", "address": "h0", "state": "DEAD", "incarnation": 0}
    assert json.loads(catalog.status_json(m.limit(0)).first().status)["nodes"] == []
    pick = lambda seed: [r.node_id for r in membership.random_members(m, 3, seed, "n1").collect()]
    assert len(pick(1)) == 3 and pick(1) == pick(1) and len({tuple(pick(i)) for i in range(5)}) > 1
    assert not {x for i in range(5) for x in pick(i)} & {"n0", "n1", "n3"}


def test_freeze(spark, tmp_path):
    e = log(spark, *(("n", b"k%05d" % i, b"value %d" % i, i) for i in range(300)))
    segments.write_segment(e, str(tmp_path / "hot"), 2)
    assert segments.freeze(spark, str(tmp_path / "hot"), str(tmp_path / "cold")) > 0
    assert spark.read.parquet(str(tmp_path / "cold")).exceptAll(e).count() == 0


def test_ring(spark):
    nodes = lambda n: placement.ring(spark.createDataFrame([(f"node-{i}",) for i in range(n)], "node_id string"))
    keys = spark.range(10_000).select(F.format_string("key_%d", "id").alias("k"))
    share = {r.o: r["count"] for r in placement.owner(keys, "k", nodes(3), "o").groupBy("o").count().collect()}
    assert len(share) == 3 and all(2000 <= n <= 5000 for n in share.values())
    m = placement.movement(keys, "k", nodes(2), nodes(3)).first()
    assert 0 < m.moved < 5000
    r = placement.replicas(keys.limit(200), "k", nodes(3), 5).collect()
    assert all(len(x.replicas) == 3 == len(set(x.replicas)) for x in r)
    assert placement.owner(keys.limit(3), "k", nodes(0), "o").where("o is not null").count() == 0


def test_bloom(spark):
    keys = spark.range(10_000).select(F.lit(1).alias("segment"), F.format_string("%06d", "id").alias("k"))
    asked = spark.range(20_000).select(F.lit(1).alias("segment"), F.format_string("%06d", "id").alias("k")).union(spark.createDataFrame([(2, "000001")], "segment int, k string"))
    got = placement.bloom_probe(asked, "segment", "k", placement.bloom_build(keys, "segment", "k", 0.01))
    assert got.count() == 20_000  # segment 2 has no filter
    assert got.where("k < '010000' and not maybe").count() == 0
    assert got.where("k >= '010000' and maybe").count() < 300


def test_merkle(spark):
    rows = spark.range(100).select(F.format_string("key_%03d", "id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    leaves = repair.merkle_leaves(rows, "k", "h")
    other = repair.merkle_leaves(rows.withColumn("h", F.when(F.col("k") == "key_050", "0").otherwise(F.col("h"))), "k", "h")
    assert leaves.count() == 50 and repair.merkle_diff(leaves, leaves).count() == 0
    d = repair.merkle_diff(leaves, other).collect()
    assert len(d) == 1 and d[0].min_key <= "key_050" <= d[0].max_key
    assert repair.merkle_root(leaves).first().root != repair.merkle_root(other).first().root
    none = repair.merkle_leaves(rows.limit(0), "k", "h")
    assert none.count() == 0 and repair.merkle_root(none).first().root == "0" * 64
    plus = rows.union(spark.createDataFrame([("key_0000", "1")], "k string, h string"))
    a, b = (repair.keyed_leaves(x, "k", "h", 16) for x in (rows, plus))
    assert repair.merkle_diff(a, b).count() == 1  # an insertion shifts no other leaf


def test_large_leaves_are_trees(spark):
    """By one definition whatever the fan-out and size."""
    rows = spark.range(1000).select(F.format_string("%04d", "id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    sha = lambda hs: hashlib.sha256("".join(hs).encode()).hexdigest()
    want = []
    for leaf in range(3):
        level = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(334 * leaf, min(1000, 334 * (leaf + 1)))]
        for _ in range(4):  # 5 ** 4 are more than 334
            level = [sha(level[i : i + 5]) for i in range(0, len(level), 5)]
        want.append(level[0])
    tree = repair.merkle_leaves(rows, "k", "h", 3, fan=5)
    assert [r.hash for r in tree.orderBy("leaf").collect()] == want
    assert [tuple(r)[2:] for r in tree.orderBy("leaf").collect()] == [tuple(r)[2:] for r in repair.merkle_leaves(rows, "k", "h", 3).orderBy("leaf").collect()]
    other = repair.merkle_leaves(rows.withColumn("h", F.when(F.col("k") == "0500", "0").otherwise(F.col("h"))), "k", "h", 3, fan=5)
    assert [r.leaf for r in repair.merkle_diff(tree, other).collect()] == [1]


def test_a_ring_of_many_nodes(spark):
    """Two thousand nodes of 256 places, against a walk by bisection."""
    ring = placement.ring(spark.range(2000).select(F.format_string("node-%d", "id").alias("node_id"))).cache()
    keys = spark.range(300).select(F.format_string("k%d", "id").alias("k"), F.lit(1).alias("cell")).union(spark.createDataFrame([(None, 1)], "k string, cell int"))
    held = sorted((r.position, r.node_id) for r in ring.collect())
    assert len(held) > 500_000
    for r in placement.replicas(keys, "k", ring, 3).collect():
        if r.k is None:
            assert r.replicas == []
            continue
        i, seen = bisect.bisect_left(held, (int(hashlib.md5(r.k.encode()).hexdigest()[:15], 16), "")), []
        while len(seen) < 3:
            if (n := held[i % len(held)][1]) not in seen:
                seen.append(n)
            i += 1
        assert r.replicas == seen


def test_cache_replay(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), i, r.randrange(12), r.choice(["get", "get", "insert", "insert", "invalidate", "other"] + ["clear"] * (i % 97 == 0)), r.choice([1, 5, 10, 60, None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "node string, at int, block int, op string, size int")
    want, caches = {}, {}
    for node, at, block, op, size in rows:
        c = caches.setdefault(node, {})  # keeps the order of last use
        hit, gone = None, 0
        if op == "get":
            hit = block in c
            if hit:
                c[block] = c.pop(block)
        elif op == "insert":
            c.pop(block, None)
            while c and sum(c.values()) + (size or 0) > 50:
                del c[next(iter(c))]
                gone += 1
            if (size or 0) <= 50:
                c[block] = size or 0
        elif op == "invalidate":
            c.pop(block, None)
        elif op == "clear":
            c.clear()
        want[at] = (hit, gone, sum(c.values()))
    out = catalog.cache_replay(df.repartition(5), "node", "at", "block", "op", "size", 50)
    assert {x.at: (x.hit, x.evicted, x.used) for x in out.collect()} == want
    stats = {x.node: x for x in catalog.cache_stats(out, "node", "at").collect()}
    assert sum(x.hits for x in stats.values()) == sum(h is True for h, _, _ in want.values()) and sum(x.evictions for x in stats.values()) == sum(g for _, g, _ in want.values())


def test_log_replay_of_damaged_files(spark):
    e = log(spark, *(("n", b"k%d" % i, None if i % 4 == 0 else b"v" * (i % 5), i + 1) for i in range(60)))
    files = wal.log_files(e, "ts", 400).orderBy("file").collect()
    assert len(files) > 3 and [f.file for f in files] == list(range(len(files)))
    back = wal.replay(spark.createDataFrame(files), "file", "content")
    assert back.where("outcome <> 'entry'").count() == 0
    assert back.select("namespace", "key", "value", "ts").exceptAll(e).count() == 0 and back.count() == 60
    whole = bytes(files[0].content)
    first = 8 + int.from_bytes(whole[:4], "little")
    bad = [(0, whole[:10] + b"?" + whole[11:]), (1, whole[:-1]), (2, whole + b"\x05"), (3, whole[:first] + bytes(8) + whole[first:]), (4, b""), (5, None), (6, (5).to_bytes(4, "little") + zlib.crc32(b"abcde").to_bytes(4, "little") + b"abcde" + whole)]
    out = {}
    for r in wal.replay(spark.createDataFrame(bad, "file int, content binary"), "file", "content").orderBy("file", "at").collect():
        out.setdefault(r.file, []).append(r.outcome)
    n = back.where("file = 0").count()
    assert out == {0: ["bad_crc"] + ["entry"] * (n - 1), 1: ["entry"] * (n - 1) + ["truncated"], 2: ["entry"] * n + ["truncated"], 3: ["entry", "truncated"], 6: ["bad_entry"] + ["entry"] * n}


def test_write_rate_over_slices(spark, monkeypatch):
    monkeypatch.setattr(catalog, "SLICE", 10)
    df = spark.range(95).select((F.col("id") * 2_000_000).alias("at"), (F.col("id") * F.col("id") % 70).alias("w"), F.lit(1).alias("slice"))
    rates = [None] + [max(0, i * i % 70 - (i - 1) ** 2 % 70) / 2 for i in range(1, 95)]
    for r in catalog.write_rate(df, "at", "w", 24).collect():
        i = r.at // 2_000_000
        last = [x for x in rates[max(0, i - 23) : i + 1] if x is not None]
        assert r.rate == rates[i] and (r.mean_rate is None if not last else abs(r.mean_rate - sum(last) / len(last)) < 1e-9)


def test_running_sums_and_leads(spark):
    rows = [(i, None if i % 7 == 0 else i % 5 - 2) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, v int").withColumn("part", F.lit("x")).repartition(6)
    total, top = 0, None
    want = []
    for i, v in rows:
        total += v or 0
        top = v if top is None else max(top, v if v is not None else top)
        want.append((i, total, total - (v or 0), top))
    s = ordered.running_sum(df, ["i"], F.col("v"), "s")
    s = ordered.running_max(ordered.running_sum(s, ["i"], F.col("v"), "b", before=True), ["i"], F.col("v"), "m")
    assert sorted((r.i, r.s, r.b, r.m) for r in s.collect()) == want
    led = {r.i: r.nxt and r.nxt.i for r in ordered.following(df, ["i"], "nxt").collect()}
    assert led == {i: i + 1 if i < 499 else None for i in range(500)}
    assert {r.i: r.n for r in ordered.global_row_number(df, ["i"], "n").collect()} == {i: i + 1 for i in range(500)}
    assert ordered.following(df.limit(0), ["i"], "nxt").count() == 0 == ordered.running_sum(df.limit(0), ["i"], F.col("v"), "s").count()


def test_rank_in_group_spans_partitions(spark):
    rows = [("hot", i) for i in range(3000)] + [(None, i) for i in range(50)] + [(f"g{i % 40}", i) for i in range(200)] + [("hot", 5)]
    df = spark.createDataFrame(rows, "g string, v int").withColumn("lo", F.lit(1)).repartition(7)
    got = {}
    for r in ordered.rank_in_group(df, ["g"], [F.desc("v")], "n").collect():
        got.setdefault(r.g, []).append((r.n, r.v))
    assert sum(map(len, got.values())) == len(rows)
    for x in got.values():
        x.sort()
        assert [n for n, _ in x] == list(range(1, len(x) + 1)) and [v for _, v in x] == sorted((v for _, v in x), reverse=True)
    assert ordered.rank_in_group(df.limit(0), ["g"], [F.desc("v")], "n").count() == 0


def test_codecs(spark):
    e = log(spark, ("ns", b"key", b"value", 1_800_000_000_000_000), ("default", b"k", None, 7), ("ä", b"\x00\xff", b"", 0))
    b = e.select("*", codecs.encode_entry(F.col("key"), F.col("value"), F.col("ts"), F.col("namespace")).alias("b"))
    back = b.select(codecs.decode_entry(F.col("b")).alias("e")).select("e.namespace", "e.key", "e.value", "e.ts")
    assert back.exceptAll(e).count() == 0 == e.exceptAll(back).count()
    assert bytes(b.where("namespace = 'default'").first().b) == b"\x01\x00k\x01" + bytes(4) + (7).to_bytes(8, "little") + b"\x07\x00default"
    short = b.select(codecs.decode_entry(F.expr("substring(b, 1, octet_length(b) - 1)")).alias("e"), codecs.decode_entry(F.unhex(F.lit("01"))).alias("f")).collect()
    assert all(r.e is None and r.f is None for r in short)
    sizes = e.select(writes.encoded_size().alias("n"), F.octet_length(codecs.encode_entry(F.col("key"), F.col("value"), F.col("ts"), F.col("namespace"))).alias("m")).collect()
    assert all(r.n == r.m for r in sizes)


def test_encryption_detects_tampering(spark):
    key = codecs.block_key(b"m" * 32, b"info")
    d = spark.range(3).select(F.encode(F.col("id").cast("string"), "UTF-8").alias("p"), key(F.encode(F.lit("block"), "UTF-8")).alias("k"), key(F.encode(F.lit("else"), "UTF-8")).alias("w"))
    d = d.withColumn("c", codecs.encrypt_block(F.col("p"), F.col("k")))
    bad = F.concat(F.expr("substring(c, 1, octet_length(c) - 1)"), F.unhex(F.hex(F.pmod(F.conv(F.hex(F.expr("substring(c, octet_length(c), 1)")), 16, 10).cast("int") + 1, F.lit(256)).cast("bigint"))))
    r = d.select("p", codecs.decrypt_block(F.col("c"), F.col("k")).alias("ok"), codecs.decrypt_block(F.col("c"), F.col("w")).alias("wrong"), codecs.decrypt_block(F.substring("c", 1, 5), F.col("k")).alias("short"), codecs.decrypt_block(bad, F.col("k")).alias("bad")).collect()
    assert all(x.ok == x.p and x.wrong is None and x.short is None and x.bad is None for x in r)


def test_scalars(spark):
    one = spark.range(1)
    size = lambda n: one.select(scalars.fmt_bytes(F.lit(n)).alias("x")).first().x
    assert [size(999), size(1500), size(2_500_000), size(7_000_000_000)] == ["999 B", "1.5 KB", "2.5 MB", "7.0 GB"]
    assert one.select(scalars.align_up(F.lit(0)), scalars.align_up(F.lit(1)), scalars.align_up(F.lit(4096)), scalars.align_up(F.lit(4097))).first()[:] == (0, 4096, 4096, 8192)
    h = scalars.password_hash(F.lit("s"), F.lit("p"), F.lit("c"))
    assert one.select(scalars.verify_password(F.lit("s"), F.lit("p"), F.lit("c"), h), scalars.verify_password(F.lit("s"), F.lit("q"), F.lit("c"), h)).first()[:] == (True, False)


def test_block_codecs(spark):
    import xxhash

    df = spark.createDataFrame([(1, b"abc" * 50), (2, b""), (3, None)], "id int, b binary")
    z = df.withColumn("z", codecs.compress_block(F.col("b"))).withColumn("h", codecs.xxh3_64(F.col("b")))
    out = {r.id: (r.p and bytes(r.p), r.h, r.bad) for r in z.select("id", codecs.decompress_block(F.col("z")).alias("p"), "h", codecs.decompress_block(F.col("b")).alias("bad")).collect()}
    assert out == {1: (b"abc" * 50, xxhash.xxh3_64_hexdigest(b"abc" * 50), None), 2: (b"", xxhash.xxh3_64_hexdigest(b""), None), 3: (None, None, None)}


def test_member_events(spark):
    ev = [("a", 1, "update", "alive", 3, None), ("a", 2, "update", "alive", 3, "h"), ("a", 3, "update", "dead", 2, "x"), ("a", 4, "update", "suspected", 4, "x"), ("a", 5, "ack", None, 6, None), ("a", 6, "ack", None, 9, None), ("a", 7, "leave", None, None, None)]
    ev += [("b", 1, "leave", None, None, None), ("b", 2, "ack", None, 1, None), ("c", 5, "join", None, 7, "c"), ("c", 4, "update", "dead", 8, "d"), (None, 1, "join", None, 1, "z"), ("d", 1, "join", None, None, None), ("d", 2, "other", "dead", 9, "q")]
    got = {tuple(r) for r in membership.replay_events(spark.createDataFrame(ev, "node_id string, seq int, kind string, state string, incarnation int, address string")).collect()}
    assert got == {("a", "h", "left", 6, 4), ("c", "c", "alive", 0, 2), ("d", None, "alive", 0, 1)}


def test_master_key_file(spark, tmp_path):
    path = f"file://{tmp_path}/keys/master"
    key = keys.master_key(spark, path)
    assert len(key) == 32 and keys.master_key(spark, path) == key and (tmp_path / "keys" / "master").stat().st_mode & 0o77 == 0
    assert keys.master_key(spark, f"{path}2") != key
    (tmp_path / "keys" / "short").write_bytes(b"x" * 31)
    with pytest.raises(StorageFailure):
        keys.master_key(spark, f"file://{tmp_path}/keys/short")
    e = spark.createDataFrame([(b"id", b"data")], "id binary, b binary").withColumn("k", codecs.block_key(key, b"info")(F.col("id")))
    assert bytes(e.select(codecs.decrypt_block(codecs.encrypt_block(F.col("b"), F.col("k")), F.col("k")).alias("p")).first().p) == b"data"
