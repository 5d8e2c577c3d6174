"""Point get, multi-get and range scan over a changelog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.model import DEFAULT_NAMESPACE, InvalidArgument, StoreConfig, normal_namespace
from stratalog.operators.resolve import live


def lit_bytes(b: bytes | str) -> Column:
    return F.lit(bytearray(b.encode() if isinstance(b, str) else b))


def get(entries: DataFrame, key: bytes | str, namespace: str = "") -> DataFrame:
    """At most one row (namespace, key, value, ts): the live value of a key. Both equalities reach the scan. An empty key is refused."""
    if not key:
        raise InvalidArgument("key must not be empty")
    return live(entries.where((F.col("namespace") == (namespace or DEFAULT_NAMESPACE)) & (F.col("key") == lit_bytes(key))))


def batch_get(entries: DataFrame, requests: DataFrame, config: StoreConfig = StoreConfig()) -> DataFrame:
    """For each request (ordinal, namespace, key), duplicates included: ordinal, namespace, key, found, value. Missing and empty keys are not found.

    At most max_batch requests are allowed, which is checked and bounds the broadcast. Entries are reduced to the asked keys before
    they are resolved."""
    n = requests.limit(config.max_batch + 1).count()
    if n > config.max_batch:
        raise InvalidArgument(f"more than {config.max_batch} keys in a batch")
    asked = requests.select("ordinal", normal_namespace("namespace").alias("namespace"), "key")
    if asked.where(F.octet_length("namespace") > config.max_namespace_bytes).limit(1).count():
        raise InvalidArgument("namespace too long")
    hits = live(entries.join(F.broadcast(asked.select("namespace", "key").distinct()), ["namespace", "key"], "left_semi"))
    got = asked.join(hits, ["namespace", "key"], "left")
    return got.select("ordinal", "namespace", "key", F.col("value").isNotNull().alias("found"), "value")


def key_range(start: bytes | str = b"", end: bytes | str | None = None, inclusive: bool = False) -> Column:
    """start <= key < end, or <= end. An empty start and an empty or missing end are open."""
    c = F.lit(True) if not start else F.col("key") >= lit_bytes(start)
    if end:
        c &= F.col("key") <= lit_bytes(end) if inclusive else F.col("key") < lit_bytes(end)
    return c


def scan(entries: DataFrame, namespace: str = "", start: bytes | str = b"", end: bytes | str | None = None, limit: int = 0, inclusive: bool = False, reverse: bool = False, config: StoreConfig = StoreConfig()) -> DataFrame:
    """Live (key, value, ts) of one namespace in key order. limit counts live rows; 0 means all, a positive one is capped by max_scan.

    The range and the namespace are filtered at the scan, below the resolution; tombstones above it. With a limit Spark keeps the first
    rows of each partition (TakeOrderedAndProject), else it sorts by range."""
    if limit < 0:
        raise InvalidArgument("limit must not be negative")
    rows = live(entries.where((F.col("namespace") == (namespace or DEFAULT_NAMESPACE)) & key_range(start, end, inclusive))).select("key", "value", "ts")
    rows = rows.orderBy(F.desc("key") if reverse else "key")
    return rows.limit(min(limit, config.max_scan)) if limit else rows


class NamespaceView:
    """A changelog bound to one namespace."""

    def __init__(self, entries: DataFrame, namespace: str):
        self.entries, self.namespace = entries, namespace

    def get(self, key: bytes | str) -> DataFrame:
        return get(self.entries, key, self.namespace)

    def batch_get(self, requests: DataFrame) -> DataFrame:
        return batch_get(self.entries, requests.withColumn("namespace", F.lit(self.namespace)))

    def scan(self, start: bytes | str = b"", end: bytes | str | None = None, limit: int = 0, inclusive: bool = False, reverse: bool = False) -> DataFrame:
        return scan(self.entries, self.namespace, start, end, limit, inclusive, reverse)
