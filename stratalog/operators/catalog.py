"""The catalog: small relations with upserts, counts and status reports."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.model import fresh
from stratalog.operators.ordered import global_row_number, parts_of, running_sum

#: Consecutive samples in one window partition.
SLICE = 65_536


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The relation after changes: of each key the row with the greatest order; on a tie the change wins. Columns are those of current."""
    rows = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in current.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("__o"), "__new", F.struct(*rest).alias("r"))).alias("b"))
    return best.select(*keys, *(F.col("b.r")[c].alias(c) for c in rest)).select(*current.columns)


def retire(manifest: DataFrame, ids: DataFrame) -> DataFrame:
    """The manifest with the segments of ids (column id) marked as compacted."""
    hit = ids.select(F.col("id").alias("__id")).distinct()
    return manifest.join(hit, manifest["id"] == F.col("__id"), "left").withColumn("compacted", F.when(F.col("__id").isNotNull(), 1).otherwise(F.col("compacted"))).drop("__id")


def purge(manifest: DataFrame) -> DataFrame:
    """The manifest without compacted segments."""
    return manifest.where(F.coalesce(F.col("compacted"), F.lit(0)) == 0)


def schema_version(migrations: DataFrame) -> DataFrame:
    """One row: the highest applied version, 0 if there is none."""
    return migrations.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))


def pending_migrations(applied: DataFrame, known: DataFrame) -> DataFrame:
    """Known migrations above the applied version; running them twice finds none."""
    return known.join(F.broadcast(schema_version(applied).withColumnRenamed("version", "__v")), F.col("version") > F.col("__v")).drop("__v")


def member_state(state: Column) -> Column:
    """A member's state as the status report names it."""
    s = F.lower(F.trim(state))
    return F.when(s == "alive", "ACTIVE").when(s == "suspected", "SUSPECTED").when(s == "dead", "DEAD").when(s == "left", "LEFT").otherwise("UNKNOWN")


def cluster_status(members: DataFrame) -> DataFrame:
    """One row: members, members alive, and whether any is not."""
    alive = F.lower(F.trim("state")) == "alive"
    return members.agg(F.count(F.lit(1)).alias("total_nodes"), F.count_if(alive).alias("alive_nodes")).withColumn("degraded", F.col("alive_nodes") < F.col("total_nodes"))


def status_json(members: DataFrame) -> DataFrame:
    """One row ``status``: the cluster status with the member list, as JSON. The list is of a cluster's nodes, some thousands at most."""
    node = F.struct("node_id", "address", member_state(F.col("state")).alias("state"), "incarnation")
    alive = F.lower(F.trim("state")) == "alive"
    body = F.struct(F.count(F.lit(1)).alias("total_nodes"), F.count_if(alive).alias("alive_nodes"), F.sort_array(F.collect_list(node)).alias("nodes"))
    return members.agg(F.to_json(body).alias("status"))


def prometheus_line(prefix: str, name: Column, value: Column, labels: list[tuple[str, Column]] = []) -> Column:
    """``prefix_name{label="value",...} value``; quotes, backslashes and line ends in labels are escaped."""
    esc = lambda c: F.replace(F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    inner = F.concat_ws(",", *(F.concat(F.lit(f'{k}="'), esc(v), F.lit('"')) for k, v in labels))
    return F.concat(F.lit(f"{prefix}_"), name, F.concat(F.lit("{"), inner, F.lit("}")) if labels else F.lit(""), F.lit(" "), value.cast("string"))


#: The metrics of a node: name, kind, help (fixed values); the level counts have no header of their own.
METRICS = [
    ("uptime_seconds", "gauge", "Node uptime in seconds"),
    ("writes_total", "counter", "Total write operations"),
    ("reads_total", "counter", "Total read operations"),
    ("deletes_total", "counter", "Total delete operations"),
    ("memtable_size_bytes", "gauge", "Active MemTable size in bytes"),
    ("memtable_entries", "gauge", "Active MemTable entry count"),
    ("wal_size_bytes", "gauge", "Current WAL file size in bytes"),
    ("sstable_count", "gauge", "Total number of active SSTables"),
    ("disk_bytes_total", "gauge", "Total bytes used on disk"),
    ("cache_hits_total", "counter", "Block cache hit count"),
    ("cache_misses_total", "counter", "Block cache miss count"),
    ("cache_hit_rate", "gauge", "Block cache hit rate (0.0-1.0)"),
    ("cache_used_bytes", "gauge", "Block cache bytes currently used"),
]


def metrics_text(metrics: DataFrame, levels: DataFrame, prefix: str, node: str) -> DataFrame:
    """Rows ``line`` with ``n``, their place, of the text format: of each metric a help line, a type line and the value with the node as label, then a line for each level.

    metrics: one row with a column for each name of METRICS that is to come out; levels: (level, segments), some ten rows."""
    label = [("node", F.lit(node))]
    rows = []
    for i, (name, kind, text) in enumerate(METRICS):
        if name in metrics.columns:
            value = F.format_string("%.4f", F.col(name)) if name == "cache_hit_rate" else F.col(name)
            lines = F.array(F.lit(f"# HELP {prefix}_{name} {text}"), F.lit(f"# TYPE {prefix}_{name} {kind}"), prometheus_line(prefix, F.lit(name), value, label))
            rows.append(F.struct(F.lit(3 * i).alias("n"), lines.alias("lines")))
    got = metrics.select(F.explode(F.array(*rows)).alias("r")).select(F.col("r.n").alias("at"), F.posexplode("r.lines").alias("i", "line")).select((F.col("at") + F.col("i")).alias("n"), "line")
    level = F.concat(F.lit("L"), F.col("level").cast("string"))
    per = levels.select((F.lit(3 * len(METRICS)) + F.col("level")).alias("n"), prometheus_line(prefix, F.lit("sstable_level_count"), F.col("segments"), [*label, ("level", level)]).alias("line"))
    return got.unionByName(per)


def cache_replay(accesses: DataFrame, node: str, at: str, block: str, op: str, size: str, capacity: int) -> DataFrame:
    """accesses with what each node's block cache did: ``hit`` (of a get, else null), ``evicted`` (blocks pushed out by it) and ``used`` (bytes held after it).

    op: get, insert, invalidate or clear, in the order of at (unique within a node); others change nothing. An insert replaces the block and pushes out the least
    recently used ones until it fits; a block larger than capacity isn't kept. A get that misses doesn't insert. A cache is one process's state machine, so
    a node's log streams through one task in order; the task holds no more than the blocks in the cache."""
    n = parts_of(accesses.sparkSession)
    rows = accesses.repartition(n, node).sortWithinPartitions(node, at)
    names = fresh(accesses, "hit", "evicted", "used")
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, t) for c, t in zip(names, (T.BooleanType(), T.IntegerType(), T.LongType()), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, used = None, OrderedDict(), 0
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for who, what, o, bytes_ in zip(*(b.column(c).to_pylist() for c in (node, block, op, size)), strict=True):
                if who != of:
                    of, used = who, 0
                    held.clear()
                hit, gone = None, 0
                if o == "get":
                    hit = what in held
                    if hit:
                        held.move_to_end(what)
                elif o in ("insert", "invalidate"):
                    used -= held.pop(what, 0)
                    if o == "insert":
                        need = bytes_ or 0
                        while held and used + need > capacity:
                            used -= held.popitem(last=False)[1]
                            gone += 1
                        if need <= capacity:
                            held[what] = need
                            used += need
                elif o == "clear":
                    held.clear()
                    used = 0
                for column, v in zip(out, (hit, gone, used), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out[0], pa.bool_()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64())], names=[*b.schema.names, *names])

    return rows.mapInArrow(run, schema)


def cache_stats(replayed: DataFrame, node: str, at: str) -> DataFrame:
    """For each node of a replayed log: hits, misses, hit_rate, evictions and the bytes in the cache at the end."""
    hits, misses = F.count_if(F.col("hit")), F.count_if(~F.col("hit"))
    return replayed.groupBy(node).agg(hits.alias("hits"), misses.alias("misses"), hit_rate(hits, misses).alias("hit_rate"), F.sum("evicted").alias("evictions"), F.max_by("used", at).alias("used"))


def hit_rate(hits: Column, misses: Column) -> Column:
    """hits / (hits + misses), 0 without any."""
    return F.coalesce(F.try_divide(hits.cast("double"), (hits + misses).cast("double")), F.lit(0.0))


def write_rate(samples: DataFrame, at: str, writes: str, points: int = 24) -> DataFrame:
    """For each sample of a counter: the rate since the one before, max(0, change) / seconds, and ``mean_rate`` over the last ``points`` samples.

    Samples are one series of any length, numbered over range partitions. A window runs over slices of SLICE numbers (of points, if those are more), to which the last samples of the slice before
    are given as well, so no task holds more of the series."""
    n, s, own = fresh(samples, "n", "slice", "own")
    rows = global_row_number(samples, [at], n)
    # a mean reaches back over points - 1 rates, the first of which needs the sample before it
    size = max(SLICE, points)
    slices = F.array_distinct(F.array(F.expr(f"{n} div {size}"), F.expr(f"({n} + {points}) div {size}")))
    cut = rows.withColumn(s, F.explode(slices)).withColumn(own, F.expr(f"{n} div {size}") == F.col(s))
    w = Window.partitionBy(s).orderBy(n)
    dt = (F.col(at) - F.lag(at).over(w)) / F.lit(1e6)
    rate = F.greatest(F.lit(0), F.col(writes) - F.lag(writes).over(w)) / dt
    rated = cut.withColumn("rate", F.when(dt > 0, rate)).withColumn("mean_rate", F.avg("rate").over(w.rowsBetween(-(points - 1), 0)))
    return rated.where(own).drop(n, s, own)


def lru_victims(blocks: DataFrame, needed: int) -> DataFrame:
    """The blocks (block_id, bytes, last_access) to evict, least recently used first, until ``needed`` bytes are free."""
    return running_sum(blocks, ["last_access", "block_id"], F.col("bytes"), "freed_before", before=True).where(F.col("freed_before") < needed)
