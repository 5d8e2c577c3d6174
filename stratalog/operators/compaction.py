"""Levelled compaction: which segments to merge, the merge, and its accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.model import StoreConfig
from stratalog.operators.resolve import latest


def level_limit(level: Column, config: StoreConfig = StoreConfig()) -> Column:
    """Bytes allowed on a level: level1_bytes * ratio ** (level - 1), saturating at the largest bigint, which is also level 0's."""
    top = (1 << 63) - 1
    v = F.lit(float(config.level1_bytes)) * F.pow(F.lit(float(config.level_ratio)), level - 1)
    return F.when((level < 1) | (v >= float(top)), F.lit(top)).otherwise(v.cast("bigint"))


def compact(entries: DataFrame, last_level: bool = False) -> DataFrame:
    """The merge of the input segments' entries: newest of each key. Tombstones go only on the last level, where nothing older can lie below."""
    merged = latest(entries)
    return merged.where(F.col("value").isNotNull()) if last_level else merged


def compaction_stats(entries: DataFrame, last_level: bool = False) -> DataFrame:
    """One row: entries read, written, and discarded, which is their difference."""
    per = entries.groupBy("namespace", "key").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("ts", F.col("value").isNotNull().alias("put"))).alias("e"))
    kept = F.col("e.put") if last_level else F.lit(True)
    got = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entries_read"), F.count_if(kept).alias("entries_written"))
    return got.withColumn("entries_discarded", F.col("entries_read") - F.col("entries_written"))


def active(manifest: DataFrame) -> DataFrame:
    return manifest.where(F.col("compacted") == 0)


def level_sizes(manifest: DataFrame) -> DataFrame:
    """For each level with active segments: segments and bytes."""
    return active(manifest).groupBy("level").agg(F.count(F.lit(1)).alias("segments"), F.sum("file_size").alias("bytes"))


def compaction_plan(manifest: DataFrame, config: StoreConfig = StoreConfig()) -> DataFrame:
    """The next merge, as rows (id, level, target_level, role) of its inputs; none if nothing is due.

    With l0_trigger segments on level 0 all of level 0 and all of level 1 merge into level 1. Otherwise the lowest level past its limit gives its
    first segment by min_key, with the segments of the next level that overlap it. The catalog is small: one row a segment; its
    range join has one row on the driving side."""
    a = active(manifest).select("id", "level", "file_size", "min_key", "max_key")
    n0 = F.count_if(F.col("level") == 0)
    due0 = a.agg((n0 >= config.l0_trigger).alias("due"))
    l0 = a.join(F.broadcast(due0), F.col("due")).where("level <= 1").select("id", "level", F.lit(1).alias("target_level"), F.when(F.col("level") == 0, "source").otherwise("overlap").alias("role"))
    over = level_sizes(manifest).where((F.col("level") >= 1) & (F.col("level") < config.last_level) & (F.col("bytes") > level_limit(F.col("level"), config))).agg(F.min("level").alias("over_level"))
    first = a.join(F.broadcast(over), F.col("level") == F.col("over_level")).select("*", F.row_number().over(Window.partitionBy("level").orderBy("min_key", "id")).alias("rn")).where("rn = 1").join(F.broadcast(due0), ~F.col("due"))
    source = first.select("id", "level", (F.col("level") + 1).alias("target_level"), F.lit("source").alias("role"))
    s = first.select(F.col("level").alias("sl"), F.col("min_key").alias("lo"), F.col("max_key").alias("hi"))
    below = a.join(F.broadcast(s), (F.col("level") == F.col("sl") + 1) & (F.col("min_key") <= F.col("hi")) & (F.col("max_key") >= F.col("lo")))
    return l0.unionByName(source).unionByName(below.select("id", "level", F.col("level").alias("target_level"), F.lit("overlap").alias("role")))
