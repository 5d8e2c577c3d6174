"""Version resolution: of each (namespace, key) the entry with the greatest ts counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators.ordered import rank_in_group

KEY = ["namespace", "key"]


def latest(entries: DataFrame) -> DataFrame:
    """The newest entry of each (namespace, key): namespace, key, value (null for a tombstone), ts.

    At equal ts a put beats a tombstone, then the greater value wins. One aggregation with a partial step on the map side, so copies and
    versions of a hot key are combined before the shuffle; filters on namespace and key pass below it to the scan."""
    return entries.groupBy(*KEY).agg(F.max(F.struct("ts", "value")).alias("e")).select(*KEY, "e.value", "e.ts")


def live(entries: DataFrame) -> DataFrame:
    """latest without tombstones. An empty value is live."""
    return latest(entries).where(F.col("value").isNotNull())


def merge_runs(*runs: DataFrame) -> DataFrame:
    """The merge of sorted runs: all keys of all runs, newest entry each, tombstones kept."""
    return latest(reduce(DataFrame.unionByName, runs))


def versions(entries: DataFrame) -> DataFrame:
    """All versions with ``version``, 1 for the newest of its key. The versions of one key may lie in many tasks."""
    return rank_in_group(entries, KEY, [F.desc("ts"), F.desc_nulls_last("value")], "version")
