"""Immutable sorted segments: writing, statistics, pruning and block layout."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.model import ENTRY_SCHEMA, StoreConfig
from stratalog.operators.ordered import global_row_number, parts_of, running_sum
from stratalog.operators.writes import encoded_size
from stratalog.scratch import filesystem, staged


def cut_segments(entries: DataFrame, config: StoreConfig = StoreConfig()) -> DataFrame:
    """entries with ``segment``, from 0 in order of ts: the flush that an entry falls into when memtables of memtable_bytes fill up one after
    the other. An entry belongs to the segment in which it begins; ts must be unique."""
    size = encoded_size().cast("bigint")
    return running_sum(entries, ["ts"], size, "__bytes", before=True).withColumn("segment", F.expr(f"__bytes div {config.memtable_bytes}")).drop("__bytes")


def even_segments(entries: DataFrame, n: int) -> DataFrame:
    """entries with ``segment``, from 0 in order of ts: n segments of as many rows each, the first ones of one more where the rows don't divide, as
    ntile has them, but without gathering the table in one task. ts must be unique."""
    q, r = divmod(entries.count(), n)
    at = f"(__row - 1 - {r * (q + 1)})"
    segment = F.expr(f"case when {at} < 0 then (__row - 1) div {q + 1} else {r} + {at} div {max(q, 1)} end")
    return global_row_number(entries, ["ts"], "__row").withColumn("segment", segment).drop("__row")


def write_segment(entries: DataFrame, path: str, partitions: int | None = None) -> None:
    """Writes all versions of entries as one sorted segment: range partitioned and sorted by (namespace, key, newest first), so that row groups
    and pages have narrow key bounds. zstd, with a bloom filter on the key column."""
    n = partitions or int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = entries.repartitionByRange(n, "namespace", "key").sortWithinPartitions("namespace", "key", F.desc("ts"))
    ordered.write.mode("overwrite").option("compression", "zstd").option("parquet.bloom.filter.enabled#key", "true").parquet(path)


def segment_stats(entries: DataFrame, by: list[str]) -> DataFrame:
    """For each segment: entries, tombstones, bytes, and the true bounds of keys and ts."""
    return entries.groupBy(*by).agg(F.count(F.lit(1)).alias("entry_count"), F.count_if(F.col("value").isNull()).alias("tombstones"), F.sum(encoded_size().cast("bigint")).alias("file_size"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("ts").alias("min_timestamp"), F.max("ts").alias("max_timestamp"))


def overlaps(low: Column, high: Column) -> Column:
    """Whether the closed key range low..high meets a segment's closed range."""
    return (F.col("min_key") <= high) & (F.col("max_key") >= low)


def may_hold(key: Column) -> Column:
    """Whether a get of the key must look into a segment."""
    return (F.col("min_key") <= key) & (F.col("max_key") >= key)


def in_scan(start: Column | None, end: Column | None) -> Column:
    """Whether a scan of start <= key < end must look into a segment."""
    c = F.lit(True)
    if start is not None:
        c &= F.col("max_key") >= start
    if end is not None:
        c &= F.col("min_key") < end
    return c


class _Packing:
    """Greedy packing of consecutive sizes into blocks: a block ends before the entry with which it would pass the limit; a larger entry stands alone."""

    def __init__(self, sizes: np.ndarray, limit: int):
        self.upto = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=self.upto[1:])
        # where the block after one that begins at each place begins
        self.next = np.maximum(np.searchsorted(self.upto, self.upto[:-1] + limit, "right") - 1, np.arange(1, len(sizes) + 1))

    def starts(self, at: int) -> list[int]:
        """The beginnings of blocks from the one at ``at``."""
        out = []
        while at < len(self.next):
            out.append(at)
            at = int(self.next[at])
        return out


def _first_start(upto: np.ndarray, limit: int, used: int) -> int:
    """The first place that doesn't fit into a block of which ``used`` bytes are taken; 0 where no block is open."""
    return max(0, int(np.searchsorted(upto, limit - used, "right")) - 1) if used else 0


def block_layout(entries: DataFrame, segment: str, config: StoreConfig = StoreConfig()) -> DataFrame:
    """Blocks of each segment: segment, block (from 0), first_namespace, first_key, last_namespace, last_key, entries, bytes.

    Entries in the order (namespace, key, newest first) fill a block until the next one would pass block_bytes; a larger entry has a
    block of its own. Packing is sequential, yet a segment may span any number of range partitions and comes out as one writer would have it: what a
    partition inherits is no more than the bytes of an open block, and these decide only which of its first entries begins its first block. So each
    partition tells what comes of each such entry (as many as fit a block), the driver goes once over two small rows for each partition, and a second
    pass numbers the blocks. A task holds a segment's rows of one range partition."""
    spark, limit = entries.sparkSession, config.block_bytes
    sized = entries.select(F.col(segment).alias("segment"), "namespace", "key", (-F.col("ts")).alias("neg"), encoded_size().cast("bigint").alias("size"))
    order = ["segment", "namespace", "key", "neg"]
    # written once, so that both passes see the same partitions; the upper bits of an id are the partition
    rows = staged(sized.repartitionByRange(parts_of(spark), *order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()), "layout")
    rows = rows.withColumn("part", F.shiftright("id", 33).cast("int"))
    edge = rows.groupBy("part").agg(F.min(F.struct("id", "segment")).alias("lo"), F.max(F.struct("id", "segment")).alias("hi")).select("part", F.explode(F.array("lo.segment", "hi.segment")).alias("segment")).distinct()

    def outcome(key: tuple, run: pd.DataFrame) -> pd.DataFrame:
        p = _Packing(run.sort_values("id")["size"].to_numpy(), limit)
        s = [p.starts(c) for c in range(_first_start(p.upto, limit, 1) + 1)]
        left = [int(p.upto[-1] - p.upto[x[-1]]) if x else 0 for x in s]
        return pd.DataFrame({"part": [key[0]], "segment": [key[1]], "id": [run["id"].min()], "upto": [p.upto[: len(s) + 1].tolist()], "blocks": [[len(x) for x in s]], "left": [left], "total": [int(p.upto[-1])]})

    kind = sized.schema["segment"].dataType.simpleString()
    told = rows.join(F.broadcast(edge), ["part", "segment"], "left_semi").groupBy("part", "segment").applyInPandas(outcome, f"part int, segment {kind}, id bigint, upto array<bigint>, blocks array<bigint>, left array<bigint>, total bigint")
    inherited, open_segment, used, count = {}, None, 0, 0
    for r in sorted(told.collect(), key=lambda r: r["id"]):  # two rows at most for each partition
        if r["segment"] != open_segment:
            open_segment, used, count = r["segment"], 0, 0
        inherited[r["part"], r["segment"]] = used, count
        c = _first_start(np.array(r["upto"]), limit, used)
        if c < len(r["blocks"]) and r["blocks"][c]:
            used, count = r["left"][c], count + r["blocks"][c]
        else:
            used += r["total"]

    def fill(key: tuple, run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values("id")
        used, count = inherited.get(key, (0, 0))
        p = _Packing(run["size"].to_numpy(), limit)
        begin = np.zeros(len(run), np.int64)
        begin[p.starts(_first_start(p.upto, limit, used))] = 1
        g = run.assign(block=count - 1 + np.cumsum(begin)).groupby("block", sort=True)
        first, last = g.first(), g.last()
        return pd.DataFrame({"segment": run["segment"].iloc[0], "block": list(g.groups), "first_id": first["id"].values, "first_namespace": first["namespace"].values, "first_key": first["key"].values, "last_id": last["id"].values, "last_namespace": last["namespace"].values, "last_key": last["key"].values, "entries": g.size().values, "bytes": g["size"].sum().values})

    ends = [f"{e}_id bigint, {e}_namespace string, {e}_key binary" for e in ("first", "last")]
    parts = rows.groupBy("part", "segment").applyInPandas(fill, f"segment {kind}, block bigint, {', '.join(ends)}, entries bigint, bytes bigint")
    whole = parts.groupBy("segment", "block").agg(F.min(F.struct("first_id", "first_namespace", "first_key")).alias("f"), F.max(F.struct("last_id", "last_namespace", "last_key")).alias("l"), F.sum("entries").alias("entries"), F.sum("bytes").alias("bytes"))
    return whole.select("segment", "block", "f.first_namespace", "f.first_key", "l.last_namespace", "l.last_key", "entries", "bytes")


def block_lookup(blocks: DataFrame, namespace: Column, key: Column) -> DataFrame:
    """For each segment the block that a get of (namespace, key) reads: the last one whose first (namespace, key) is not above it, if its last one isn't
    below. blocks has the columns of block_layout."""
    at = F.struct(namespace.alias("namespace"), key.alias("key"))
    first, last = (F.struct(F.col(f"{end}_namespace").alias("namespace"), F.col(f"{end}_key").alias("key")) for end in ("first", "last"))
    best = blocks.where(first <= at).groupBy("segment").agg(F.max(F.struct(first.alias("first"), "block", last.alias("last"))).alias("b"))
    return best.where(F.col("b.last") >= at).select("segment", "b.block", F.col("b.first.namespace").alias("first_namespace"), F.col("b.first.key").alias("first_key"), F.col("b.last.namespace").alias("last_namespace"), F.col("b.last.key").alias("last_key"))


def entry_digest() -> Column:
    """The first 15 hexadecimal digits of the md5 of an entry's parts, as a bigint."""
    parts = F.concat_ws("/", "namespace", F.lower(F.hex("key")), F.coalesce(F.lower(F.hex("value")), F.lit("-")), F.col("ts").cast("string"))
    return F.conv(F.substring(F.md5(parts), 1, 15), 16, 10).cast("decimal(38,0)")


def checksums(entries: DataFrame, by: list[str]) -> DataFrame:
    """For each segment ``entry_count`` and ``checksum``, the sum of its entries' digests: in any order, combined on the map side."""
    return entries.groupBy(*by).agg(F.count(F.lit(1)).alias("entry_count"), F.sum(entry_digest()).cast("string").alias("checksum"))


def verify(manifest: DataFrame, entries: DataFrame, by: str) -> DataFrame:
    """Each segment of the manifest (by, entry_count, checksum) with ``found``, the entries that are there, and ``intact``: whether they are those that were written. A
    segment without entries has none found."""
    got = checksums(entries, [by]).select(F.col(by).alias("__by"), F.col("entry_count").alias("found"), F.col("checksum").alias("__sum"))
    j = manifest.select(by, "entry_count", "checksum").join(got, F.col(by) == F.col("__by"), "left")
    same = (F.col("entry_count") == F.col("found")) & (F.col("checksum") == F.col("__sum"))
    return j.select(by, "entry_count", F.coalesce("found", F.lit(0)).cast("bigint").alias("found"), F.coalesce(same, F.lit(False)).alias("intact"))


def paths_for(manifest: DataFrame, condition: Column) -> Iterator[str]:
    """The files of the active segments that meet the condition, to read only these; one row a segment."""
    for r in manifest.where((F.col("compacted") == 0) & condition).select("file_name").toLocalIterator():
        yield r["file_name"]


def freeze(spark: SparkSession, path: str, cold_path: str) -> int:
    """Copies a segment to a cold place, such as an object store, at a higher compression; returns the bytes there. Files are sorted like a segment's."""
    df = spark.read.parquet(path).sortWithinPartitions("namespace", "key", F.desc("ts"))
    df.write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", "6").parquet(cold_path)
    fs, p = filesystem(spark, cold_path)
    return fs.getContentSummary(p).getLength()


def thaw(spark: SparkSession, cold_path: str, path: str) -> None:
    """Brings a segment back from its cold place; its entries are those that were frozen."""
    write_segment(spark.read.schema(ENTRY_SCHEMA).parquet(cold_path), path)


def drop_cold(spark: SparkSession, cold_path: str) -> bool:
    """Deletes a cold copy; False if there was none."""
    fs, p = filesystem(spark, cold_path)
    return bool(fs.delete(p, True))
