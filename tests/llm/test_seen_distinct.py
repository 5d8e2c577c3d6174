import math
import random

import pytest
from pyspark.sql import functions as F

from stratalog.llm import queries, seen
from stratalog.llm.distinct import cube_estimates, estimates, merge, registers, standard_error
from stratalog.llm.seen import SeenFilter, SeenIndex, answer, error_report
from stratalog.model import InvalidArgument


def test_answers_against_brute_force(spark):
    r = random.Random(8)
    key = lambda: (r.choice(["a", "b", None]), r.choice([None, b"", bytes([r.randrange(40)]), b"k%d" % r.randrange(300)]))
    known = [key() for _ in range(300)] + [("a", b"hot")] * 500
    probes = [(i, *key()) for i in range(800)] + [(1000 + i, "b", b"hot2") for i in range(400)] + [(2000, "a", b"hot")]
    r.shuffle(probes)
    k = spark.createDataFrame([(*x, 1) for x in known], "ns string, key binary, first int")
    p = spark.createDataFrame([(*x, "new", "maybe") for x in probes], "id bigint, ns string, key binary, new string, maybe string").repartition(3)
    out, firsts = answer(p, "id", k, ["ns", "key"])
    have, want = set(known), set()
    for i, n, b in sorted(probes):
        if (n, b) in have:
            want.add(i)
        have.add((n, b))
    rows = out.collect()
    assert {x.id for x in rows} == want and len(rows) == len(want) and out.columns == p.columns
    report = error_report(firsts).first()
    asked = {(n, b) for _, n, b in probes}
    assert report.asked == len(asked) and report.new == len(asked - set(known)) and report.missed == 0
    assert report.error_rate == pytest.approx(report.disproved / report.new)


def test_empty_tables(spark):
    p = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id bigint, k string")
    out, firsts = answer(p, "id", p.select("k").limit(0), ["k"])
    assert [r.id for r in out.collect()] == [2]
    r = error_report(firsts).first()
    assert (r.asked, r.new, r.disproved, r.missed, r.without_filter, r.error_rate) == (2, 2, 0, 0, 0, 0.0)
    out, firsts = answer(p.limit(0), "id", p.select("k"), ["k"])
    assert out.count() == 0 and error_report(firsts).first().error_rate == 0.0


def test_filter_error_and_merge(spark):
    n = 20_000
    ids = spark.range(4 * n).select(F.col("id").alias("k"))
    f = SeenFilter.build(ids.where(f"k < {n}"), ["k"], expected=n)
    a, b = (SeenFilter.build(ids.where(w), ["k"], expected=n) for w in (f"k < {n // 3}", f"k >= {n // 3} and k < {n}"))
    got = f.test(ids).groupBy((F.col("k") < n).alias("member")).agg(F.avg(F.col("maybe").cast("int")).alias("share")).collect()
    share = {r.member: r.share for r in got}
    assert share[True] == 1.0 and share[False] < 0.02
    m = a.merge(b).test(ids)
    assert m.exceptAll(f.test(ids)).count() == 0
    with pytest.raises(ValueError):
        f.merge(SeenFilter.build(ids.where("k < 10"), ["k"], expected=10))


@pytest.mark.parametrize("blocks", [0, 1 << 20])
def test_index_of_parts(spark, tmp_path, monkeypatch, blocks):
    """Keys added in parts, some twice, an index opened again, and filters met by a join or a broadcast."""
    monkeypatch.setattr(seen, "BROADCAST_BLOCKS", blocks)
    monkeypatch.setattr(seen, "BROADCAST_KEYS", blocks)
    i = SeenIndex(spark, f"file://{tmp_path}/i", ["a", "b"])
    rows = spark.range(3000).select((F.col("id") % 1500).cast("int").alias("a"), F.when(F.col("id") % 5 != 0, F.col("id").cast("string")).alias("b"), (F.col("id") % 2 == 0).alias("f"))
    i.add(rows.where("a < 700"), F.col("f"), expected=3000)
    i.add(rows.where("a >= 500"), F.col("f"))
    j = SeenIndex(spark, f"file://{tmp_path}/i", ["a", "b"])
    assert (j.parts, j.blocks) == (2, i.blocks)
    probes = spark.range(0, 6000).select(F.col("id").alias("n"), (F.col("id") % 1500).alias("a"), F.when(F.col("id") % 5 != 0, F.col("id").cast("string")).alias("b"))
    got, firsts = answer(probes, "n", j, ["a", "b"])
    # keys without b repeat every 1,500 ids
    assert {r.n for r in got.collect()} == {n for n in range(6000) if n < 3000 or n % 5 == 0}
    r = error_report(firsts).first()
    assert r.missed == 0 and r.error_rate < 0.05 and 10 < r.rejected_checked < 150
    assert r.without_filter == 1350  # those of odd ids: half of the 2,400 keys with b and of the 300 without


def test_key_types_are_compared_alike(spark):
    known = spark.range(50).select("id")
    seen_, _ = answer(spark.range(100).select(F.col("id").cast("int").alias("id"), F.col("id").alias("n")), "n", known, ["id"])
    assert sorted(r.n for r in seen_.collect()) == list(range(50))
    with pytest.raises(InvalidArgument):
        answer(spark.range(5).select(F.col("id").cast("string").alias("id"), F.col("id").alias("n")), "n", known, ["id"])


@pytest.mark.parametrize("n", [0, 1, 2, 100, 5000, 40_000, 120_000])
def test_estimate_within_error(spark, n):
    df = spark.range(n).select(F.lit("g").alias("g"), F.explode(F.array_repeat("id", 2)).alias("x"))
    got = estimates(registers(df, ["g"], ["x"]), ["g"]).collect()
    if not n:
        assert got == []
    else:
        assert got[0].rows == 2 * n and abs(got[0].estimate - n) <= 5 * standard_error() * n + 0.5


def test_partial_results_merge(spark):
    df = spark.range(30_000).select((F.col("id") % 3).alias("day"), F.pmod(F.hash("id"), F.lit(2)).alias("ns"), (F.col("id") % 9000).alias("x"))
    whole = registers(df, ["day", "ns"], ["x"])
    parts = merge(registers(df.where("x < 4000"), ["day", "ns"], ["x"]).unionByName(registers(df.where("x >= 4000"), ["day", "ns"], ["x"])), ["day", "ns"])
    assert whole.exceptAll(parts.select(*whole.columns)).count() == 0 == parts.select(*whole.columns).exceptAll(whole).count()
    est = {(r.day, r.ns, r.level): r for r in cube_estimates(whole, ["day", "ns"]).collect()}
    assert len(est) == 12 and est[None, None, 3].rows == 30_000
    true = {tuple(r)[:2]: r.n for r in df.groupBy("day", "ns").agg(F.count_distinct("x").alias("n")).collect()}
    for k, n in true.items():
        assert abs(est[*k, 0].estimate - n) <= 5 * standard_error() * n
    assert abs(est[None, None, 3].estimate - 9000) <= 5 * standard_error() * 9000
    assert est[None, None, 3].std_error == pytest.approx(1.04 / math.sqrt(1 << 14))


def test_nulls(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "x", 1), (None, "x", 1), (None, None, 1), (None, None, 1)], "g string, x string, reg int")
    got = {r.g: (r.rows, round(r.estimate)) for r in estimates(registers(df, ["g"], ["x"]), ["g"]).collect()}
    assert got == {"a": (2, 1), None: (3, 1)}


def test_small_group_with_collisions_is_counted_exactly(spark, tmp_path):
    """30 distinct keys in 42 rows are a case (0.714), though pairs of keys share a register and a rank."""
    keys = spark.range(400_000).select(F.encode(F.format_string("k%06d", "id"), "UTF-8").alias("key"), F.lit("n").alias("namespace"))
    h = F.xxhash64("namespace", "key")
    regs = keys.withColumn("reg", h.bitwiseAND((1 << 14) - 1)).groupBy("reg").agg(F.sort_array(F.collect_list("key")).alias("ks")).orderBy("reg").limit(24).collect()
    chosen = [bytes(k) for i, r in enumerate(regs) for k in r.ks[: 4 if i < 2 else 1]]
    assert len(chosen) == 30
    rows = [(i, "n", k, b"v", 1_700_000_000_000_000) for i, k in enumerate(chosen + chosen[:12])]
    spark.createDataFrame(rows, "log_seq bigint, namespace string, key binary, value binary, ts bigint").write.parquet(f"{tmp_path}/entry_log.parquet")
    assert [r.namespace for r in queries.R.queries["p5_found"](spark, str(tmp_path)).collect()] == ["n"]
