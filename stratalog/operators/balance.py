"""Per-key work in balanced tasks where a few keys hold most rows: fragment and replicate by estimated load."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.model import common_types, fresh

#: Keys that aren't heavy are placed by hash bucket; so many buckets for each task, and so many at least.
BUCKETS_A_TASK, LEAST_BUCKETS = 16, 1024
#: Items of which a sketch gives the counts.
SKETCHED = 100_000


@dataclass(frozen=True)
class Placement:
    """Where the rows of each key go. total: rows counted, exact. heavy: key hash -> the tasks of its shards; buckets: the task of each bucket of other keys."""

    tasks: int
    total: int
    heavy: dict[int, list[int]]
    buckets: list[int]
    loads: list[int]

    def placed(self, df: DataFrame, keys: list[str], name: str) -> DataFrame:
        """df with the tasks of a key's shards, one task for a key that isn't heavy. Two lookups by broadcast: at most 4 * tasks heavy keys with as many
        shards again, and BUCKETS_A_TASK * tasks buckets (or LEAST_BUCKETS)."""
        h, key, shards, bucket, task = fresh(df.withColumn(name, F.lit(0)), "key_hash", "heavy_hash", "shards", "bucket", "bucket_task")
        spark = df.sparkSession
        heavy = spark.createDataFrame(list(self.heavy.items()), f"{key} bigint, {shards} array<int>")
        light = spark.createDataFrame([(b, [t]) for b, t in enumerate(self.buckets)], f"{bucket} bigint, {task} array<int>")
        hashed = df.withColumn(h, key_hash(keys))
        got = hashed.join(F.broadcast(heavy), F.col(h) == F.col(key), "left").join(F.broadcast(light), F.pmod(h, F.lit(len(self.buckets))) == F.col(bucket), "left")
        return got.withColumn(name, F.coalesce(shards, task)).drop(h, key, shards, bucket, task)


def key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*keys, F.concat_ws("", *(F.col(k).isNull().cast("int") for k in keys)))


def plan(df: DataFrame, keys: list[str], tasks: int) -> Placement:
    """Estimates loads over all rows of df, in one pass, and bin-packs them into tasks.

    A frequent-items sketch, whose partial results merge, gives the heavy keys: those with more than a quarter of a task's
    fair share, so 4 * tasks of them at most. Each is split into as many shards as quarter shares fit its load. Other keys go by
    hash bucket; a second sketch in the same pass, with room for all buckets, has their exact sizes (beyond SKETCHED buckets a count of its own). Shards
    and buckets, largest first, each go to the least loaded task. The driver gets 4 * tasks heavy keys and max(BUCKETS_A_TASK * tasks,
    LEAST_BUCKETS) buckets at most. Estimates decide only where rows go, never whether they count."""
    top, n = 4 * tasks, max(BUCKETS_A_TASK * tasks, LEAST_BUCKETS)
    h = df.select(key_hash(keys).alias("h")).withColumn("b", F.pmod("h", F.lit(n)).cast("int"))
    sketch = lambda c, k, room: F.expr(f"approx_top_k({c}, {k}, {min(1_000_000, room)})").alias(c)
    # a sketch of more than 4 / 3 times as many items as there are counts each exactly
    got = h.agg(F.count(F.lit(1)).alias("n"), sketch("h", min(top, SKETCHED), 64 * top), *([sketch("b", n, 4 * n)] if n <= SKETCHED else [])).first()
    buckets, total = [0] * n, got["n"]
    for r in (got["b"] if n <= SKETCHED else h.groupBy(F.col("b").alias("item")).count().collect()) if total else []:
        buckets[r["item"]] = r["count"]
    unit = max(1, total // top)
    found = {r["item"]: r["count"] for r in got["h"] if r["count"] > unit} if total else {}
    items: list[tuple[int, int, int | None]] = []
    for key, c in found.items():
        parts = -(-c // unit)
        items += [(-(-c // parts), 0, key)] * parts
        buckets[key % n] = max(0, buckets[key % n] - c)
    items += [(c, b, None) for b, c in enumerate(buckets)]
    heap, heavy, place = [(0, t) for t in range(tasks)], {k: [] for k in found}, [0] * n
    for c, b, key in sorted(items, key=lambda x: (-x[0], x[1], x[2] or 0)):
        load, t = heapq.heappop(heap)
        if key is None:
            place[b] = t
        else:
            heavy[key].append(t)
        heapq.heappush(heap, (load + c, t))
    return Placement(tasks, total, heavy, place, [c for c, _ in sorted(heap, key=lambda x: x[1])])


def fragment(df: DataFrame, keys: list[str], p: Placement, spread: list[str], task: str) -> DataFrame:
    """Each row of df once, moved to a task of its key; rows of a heavy key are spread over its shards by a hash of the columns spread,
    which should tell rows of a key apart. Adds the column task."""
    (shards,) = fresh(df, "shards")
    at = F.element_at(shards, (F.pmod(F.xxhash64(F.lit(11), *spread), F.size(shards)) + 1).cast("int"))
    return p.placed(df, keys, shards).withColumn(task, at).drop(shards).repartitionById(p.tasks, F.col(task))


def replicate(df: DataFrame, keys: list[str], p: Placement, task: str) -> DataFrame:
    """The rows of df at every task that holds a shard of their key, at one task for keys that aren't heavy."""
    (shards,) = fresh(df, "shards")
    return p.placed(df, keys, shards).withColumn(task, F.explode(F.array_distinct(shards))).drop(shards).repartitionById(p.tasks, F.col(task))


def balanced_join(big: DataFrame, side: DataFrame, keys: list[str], spread: list[str], tasks: int, how: str = "inner") -> DataFrame:
    """big joined with side on keys (null keys meet nothing) by fragment-replicate; how is inner or left. Both sides keep their columns, so
    those besides keys must not share names. Rows of side may repeat; every pair comes out, as from an ordinary join. Keys of different numeric types
    are compared in the wider one; text and numbers are refused."""
    big, side = common_types(big, side, keys)
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    p = plan(big, keys, tasks)
    (t,) = fresh(big.select(*(F.col(f"`{c}`") for c in big.columns), *(F.lit(0).alias(c) for c in side.columns if c not in big.columns)), "task")
    return fragment(big, keys, p, spread, t).join(replicate(side, keys, p, t), [t, *keys], how).drop(t)


def balanced_aggregate(df: DataFrame, keys: list[str], spread: list[str], tasks: int, partial: list[Column], merge: list[Column], placement: Placement | None = None) -> DataFrame:
    """Per-key results in balanced tasks. partial: aliased aggregates of a key's rows within a task; merge: aliased aggregates of the partial
    results by their aliases. Null keys form a group of their own. An empty df gives no rows. placement: a plan of df made before."""
    p = placement or plan(df, keys, tasks)
    (t,) = fresh(df, "task")
    parts = fragment(df, keys, p, spread, t).groupBy(t, *keys).agg(*partial)
    return parts.groupBy(*keys).agg(*merge)
