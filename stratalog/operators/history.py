"""History of changing attributes from observations or periodic snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.operators.ordered import global_row_number, parts_of
from stratalog.scratch import staged


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], attrs: list[str], carry: list[str] = []) -> DataFrame:
    """Keys that were inserted, changed or deleted between two snapshots, with their attributes before and after, and ``carried``, a struct of the
    later snapshot's columns carry, if any.

    One null-safe full outer join: null keys match null keys, null attributes equal null ones. keys must be unique in either
    snapshot. Result: keys, change, and a struct ``before`` and ``after`` of attrs. Rows without a difference don't come out; an
    empty snapshot makes all rows of the other inserted or deleted."""
    b = before.select(*(F.col(k).alias(f"bk{i}") for i, k in enumerate(keys)), F.struct(*(F.col(a) for a in attrs)).alias("before"))
    a = after.select(*(F.col(k).alias(f"ak{i}") for i, k in enumerate(keys)), F.struct(*(F.col(a) for a in attrs)).alias("after"), *([F.struct(*carry).alias("carried")] if carry else []))
    on = [F.col(f"bk{i}").eqNullSafe(F.col(f"ak{i}")) for i in range(len(keys))]
    change = F.when(F.col("before").isNull(), "inserted").when(F.col("after").isNull(), "deleted").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    out = b.join(a, on, "full").withColumn("change", change).where(F.col("change").isNotNull())
    side = F.col("after").isNotNull()
    return out.select(*(F.when(side, F.col(f"ak{i}")).otherwise(F.col(f"bk{i}")).alias(k) for i, k in enumerate(keys)), "change", "before", "after", *(["carried"] if carry else []))


def history(observed: DataFrame, key: str, at: str, attrs: list[str], prefer: list[Column]) -> DataFrame:
    """Periods of unchanged attributes of each key: key, attrs, valid_from, valid_to (null while valid).

    observed: any number of rows a key in any order. at: a bigint column of the time an observation holds from. prefer: of rows with
    one (key, at) the greatest by these columns counts; equal ones are copies. Rows with a null key or time are dropped; null
    attributes are values of their own. An empty input gives no rows. Other columns are left out.

    Observations are numbered in order of (key, time), and each is a snapshot of its key. ``snapshot_diff`` sets all snapshots against the ones
    before them at once, by a null-safe full outer join on (key, number): inserted where a key's first one stands, changed, or deleted where no
    other one follows. ``lead`` over the union of these events gives the end of each period; a deletion ends none, its period is still valid.

    Numbering is by range partitions of (key, time), the join by single numbers and the lead inside slices of consecutive numbers, of
    which each takes the next event from the slices after it: so the rows of a key that has a third of the table are spread over tasks like any others."""
    spark = observed.sparkSession
    rows = observed.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    # the hash is the first to sort by, as numbers sort faster than texts
    best = rows.groupBy(F.xxhash64(key, at).alias("h"), F.col(key).alias("k"), F.col(at).alias("at")).agg(F.max(F.struct(*(c.alias(f"p{i}") for i, c in enumerate(prefer)), F.struct(*attrs).alias("a"))).alias("best")).select("k", "at", F.col("best.a").alias("a"))
    snaps = global_row_number(best, ["k", "at"], "n")
    before = snaps.select("k", (F.col("n") + 1).alias("n"), "a")
    events = snapshot_diff(before, snaps, ["n", "k"], ["a"], ["at"]).select("k", "n", "change", F.col("after.a").alias("a"), F.col("carried.at").alias("at"))

    # a deletion and the insertion of the next key share a number; slices hold at most as many numbers as a range partition has rows on average
    total = snaps.count()
    slices = 4 * parts_of(spark)
    events = staged(events.withColumn("slice", F.expr(f"cast(n div {total // slices + 1} as int)")), "events")
    event = F.struct("n", F.when(F.col("change") == "deleted", 0).otherwise(1).alias("kind"), "at")
    firsts = events.groupBy("slice").agg(F.min(event).alias("first"))
    after = firsts.select("slice", F.lead("first").over(Window.orderBy("slice")).alias("after"))  # at most 4 rows a shuffle partition
    led = events.withColumn("next", F.lead(event).over(Window.partitionBy("slice").orderBy(event))).where("change <> 'deleted'").join(F.broadcast(after), "slice")
    return led.select(F.col("k").alias(key), *(F.col("a")[a].alias(a) for a in attrs), F.col("at").alias("valid_from"), F.coalesce("next", "after")["at"].alias("valid_to"))


def snapshot_history(snapshots: DataFrame, taken: str, key: str, attrs: list[str]) -> DataFrame:
    """Periods of unchanged attributes from periodic snapshots, each a full list of the keys that exist then: key, attrs, valid_from, valid_to.

    taken: when a row's snapshot was taken; all rows of one snapshot share it. A key that is missing from the next snapshot is deleted then, which ends its period, and inserted
    if it comes again; a period that lasts is null at its end. Of rows of one snapshot and key the greatest attrs count. Rows with a null key or time are dropped.

    Consecutive snapshots, all at once, go through snapshot_diff on (number of the snapshot, key); the changes, united, end each other by lead. A
    key stands once in a snapshot, so a window over a key has as many rows at most as there are snapshots. Their times are numbered over range partitions and
    met in a join."""
    rows = snapshots.where(F.col(key).isNotNull() & F.col(taken).isNotNull()).groupBy(F.col(taken).alias("at"), F.col(key).alias("k")).agg(F.max(F.struct(*attrs)).alias("a"))
    rows = staged(rows, "snapshots")
    times = staged(global_row_number(rows.select("at").distinct(), ["at"], "n"), "times")
    snaps = rows.join(times, "at").select("n", "k", "a")
    # the next snapshot's time is known also where a key is missing from it; nothing follows the last one
    diff = snapshot_diff(snaps.select((F.col("n") + 1).alias("n"), "k", "a"), snaps, ["n", "k"], ["a"])
    events = diff.select("n", "k", "change", F.col("after.a").alias("a")).join(times, "n")
    led = events.withColumn("until", F.lead("at").over(Window.partitionBy("k").orderBy("n"))).where("change <> 'deleted'")
    return led.select(F.col("k").alias(key), *(F.col("a")[a].alias(a) for a in attrs), F.col("at").alias("valid_from"), F.col("until").alias("valid_to"))
