"""A store on a path: the write and read calls of a namespaced key-value store over Spark tables.

    s = Store(spark, "file:///data/store")
    s.batch_put([(b"k", b"v", "users")]); s.get(b"k", "users"); s.scan(b"a", b"z", namespace="users")
    s.namespace("users").get(b"k"); s.flush(); s.compact(); s.metrics()

Layout: ``log/batch=N`` are appended writes, ``segments/id=N`` immutable sorted segments, ``manifest/version=N`` snapshots of the catalog. A
manifest is written last and names the log batches that its segments hold, so a reader sees either the log rows or their segment.
Any number of readers. Of two writers at once the slower one gets StorageFailure, as no folder is ever written over; its call can be made again. Writes
flush the tail when it has memtable_bytes, and then merge what is due; ``auto=False`` leaves both to the caller. For bulk data use ``append`` with a
DataFrame: a call is a Spark job."""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.model import DEFAULT_NAMESPACE, ENTRY_SCHEMA, InvalidArgument, StorageFailure, StoreConfig
from stratalog.operators import compaction, reads, segments, wal, writes
from stratalog.operators.change_feed import numbers
from stratalog.scratch import filesystem

MANIFEST = "id int, level int, file_name string, entry_count bigint, file_size bigint, min_key binary, max_key binary, min_timestamp bigint, max_timestamp bigint, compacted int, log_to int, checksum string"


class Store:
    def __init__(self, spark: SparkSession, path: str, config: StoreConfig = StoreConfig(), auto: bool = True):
        self.spark, self.path, self.config, self.auto = spark, path.rstrip("/"), config, auto
        self._clock = self._newest_ts()
        self._tail = self._tail_size()[1]
        self.writes = self.reads = self.deletes = 0

    # catalog

    def manifest(self) -> DataFrame:
        """The newest snapshot of the catalog."""
        v = self._version()
        return self.spark.createDataFrame([], MANIFEST) if v < 0 else self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/version={v}")

    def _version(self) -> int:
        return max(numbers(self.spark, f"{self.path}/manifest", "version"), default=-1)

    def _next(self, kind: str, name: str) -> int:
        """A number above those of all folders, also of ones that were cut off by a failure."""
        fs, p = filesystem(self.spark, f"{self.path}/{kind}")
        taken = [s.getPath().getName().partition("=")[2] for s in fs.listStatus(p)] if fs.exists(p) else []
        return max([int(n) for n in taken if n.isdigit()], default=-1) + 1

    def _write_new(self, df: DataFrame, path: str) -> None:
        try:
            df.write.mode("errorifexists").parquet(path)
        except AnalysisException as e:
            raise StorageFailure(f"another writer has written {path}") from e

    def _publish(self, manifest: DataFrame, version: int) -> None:
        """version: the one that manifest was made from."""
        if self._version() != version:
            raise StorageFailure("another writer has changed the catalog")
        self._write_new(manifest.coalesce(1), f"{self.path}/manifest/version={max(version + 1, self._next('manifest', 'version'))}")

    def _flushed_to(self) -> int:
        return self.manifest().agg(F.coalesce(F.max("log_to"), F.lit(-1))).first()[0]

    def _log(self) -> tuple[list[int], DataFrame]:
        """The batches that no segment holds yet."""
        done = self._flushed_to()
        n = [b for b in numbers(self.spark, f"{self.path}/log", "batch") if b > done]
        return n, self._read([f"{self.path}/log/batch={b}" for b in n])

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], ENTRY_SCHEMA)
        try:
            return self.spark.read.schema(ENTRY_SCHEMA).parquet(*paths)
        except AnalysisException as e:
            raise StorageFailure(f"files of the store are missing: {e.getMessageParameters() or e}") from e

    def _newest_ts(self) -> int:
        both = self._log()[1].agg(F.max("ts")).first()[0] or 0, self.manifest().agg(F.max("max_timestamp")).first()[0] or 0
        return max(both)

    def _tail_size(self) -> tuple[int, int]:
        """Entries and bytes that no segment holds yet."""
        r = self._log()[1].agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(writes.encoded_size().cast("bigint")), F.lit(0)).alias("b")).first()
        return r["n"], r["b"]

    def entries(self, *conditions) -> DataFrame:
        """All versions: the log's tail and the active segments that meet the conditions on the catalog. Files that the catalog rules out aren't
        opened."""
        met = reduce(lambda a, b: a & b, conditions, F.lit(True))
        return self._log()[1].unionByName(self._read(list(segments.paths_for(self.manifest(), met))))

    # writes

    def _append(self, df: DataFrame) -> None:
        n = max(self._flushed_to() + 1, self._next("log", "batch"))
        self._write_new(df.select(*ENTRY_SCHEMA.names), f"{self.path}/log/batch={n}")

    def _written(self, size: int) -> None:
        self._tail += size
        if self.auto and self._tail >= self.config.memtable_bytes and self.flush():
            while self.compact():
                pass

    def _stamp(self) -> int:
        self._clock = max(self._clock, time.time_ns() // 1000) + 1
        return self._clock

    def _write(self, rows: list[tuple[str, bytes, bytes | None]]) -> list[int]:
        stamps = [self._stamp() for _ in rows]
        self._append(self.spark.createDataFrame([(ns or DEFAULT_NAMESPACE, bytearray(k), None if v is None else bytearray(v), t) for (ns, k, v), t in zip(rows, stamps, strict=True)], ENTRY_SCHEMA))
        dead = sum(v is None for _, _, v in rows)
        self.writes, self.deletes = self.writes + len(rows) - dead, self.deletes + dead
        self._written(sum(17 + len(k) + len(v or b"") + len((ns or DEFAULT_NAMESPACE).encode()) for ns, k, v in rows))
        return stamps

    def _refused(self, key: bytes, value: bytes | None, namespace: str) -> str | None:
        c = self.config
        if not key:
            return "key must not be empty"
        if len(key) > c.max_key_bytes:
            return f"key exceeds {c.max_key_bytes} bytes"
        if value is not None and len(value) > c.max_value_bytes:
            return f"value exceeds {c.max_value_bytes} bytes"
        if len((namespace or DEFAULT_NAMESPACE).encode()) > c.max_namespace_bytes:
            return f"namespace exceeds {c.max_namespace_bytes} bytes"
        return None

    def put(self, key: bytes, value: bytes, namespace: str = "") -> int:
        """Stores a value; returns its ts."""
        if e := self._refused(key, value, namespace):
            raise InvalidArgument(e)
        return self._write([(namespace, key, value)])[0]

    def delete(self, key: bytes, namespace: str = "") -> int:
        """Appends a tombstone, whether the key exists or not; returns its ts."""
        if e := self._refused(key, None, namespace):
            raise InvalidArgument(e)
        return self._write([(namespace, key, None)])[0]

    def _batch(self, rows: list[tuple[str, bytes, bytes | None]]) -> tuple[int, int, list[str]]:
        if len(rows) > self.config.max_batch:
            raise InvalidArgument(f"batch exceeds {self.config.max_batch} entries")
        errors = [self._refused(k, v, ns) for ns, k, v in rows]
        if ok := [r for r, e in zip(rows, errors, strict=True) if e is None]:
            self._write(ok)
        bad = [e for e in errors if e]
        return len(ok), len(bad), bad

    def batch_put(self, entries: Iterable[tuple[bytes, bytes, str]]) -> tuple[int, int, list[str]]:
        """Stores what is valid: (stored, failed, errors). Not atomic in the sense that valid entries are stored beside refused ones."""
        return self._batch([(ns, k, v) for k, v, ns in entries])

    def batch_delete(self, keys: Iterable[tuple[bytes, str]]) -> tuple[int, int]:
        return self._batch([(ns, k, None) for k, ns in keys])[:2]

    def append(self, df: DataFrame, order: list[str]) -> DataFrame:
        """Bulk write of (namespace, key, value; null deletes) in the order of the columns order. Returns the refused rows with ``error``."""
        error = writes.put_error(self.config)
        base = self._stamp()
        good = writes.accepted(df, error).withColumn("__wall", F.lit(base))
        before = self._tail_size() if self._tail else (0, 0)
        self._append(writes.assign_ts(good, order, "__wall", base))
        self._clock = self._newest_ts()
        n, size = self._tail_size()
        self.writes += n - before[0]
        self._tail = before[1]
        self._written(size - before[1])
        return df.withColumn("error", error).where(F.col("error").isNotNull())

    # reads

    def get(self, key: bytes, namespace: str = "") -> bytes | None:
        self.reads += 1
        row = reads.get(self.entries(segments.may_hold(reads.lit_bytes(key))), key, namespace).first()
        return bytes(row["value"]) if row else None

    def batch_get(self, keys: list[tuple[bytes, str]]) -> list[bytes | None]:
        """Values in the order of the request, None where there is none."""
        self.reads += len(keys)
        if not keys:
            return []
        asked = self.spark.createDataFrame([(i, ns, bytearray(k)) for i, (k, ns) in enumerate(keys)], "ordinal int, namespace string, key binary")
        low, high = (reads.lit_bytes(f(k for k, _ in keys)) for f in (min, max))
        got = {r["ordinal"]: r["value"] for r in reads.batch_get(self.entries(segments.overlaps(low, high)), asked, self.config).select("ordinal", "value").collect()}  # max_batch rows at most
        return [None if got.get(i) is None else bytes(got[i]) for i in range(len(keys))]

    def scan(self, start: bytes = b"", end: bytes | None = None, limit: int = 0, namespace: str = "", inclusive: bool = False, reverse: bool = False) -> DataFrame:
        """Live (key, value, ts) in key order; 0 means no limit."""
        self.reads += 1
        low, high = (reads.lit_bytes(start) if start else None), (reads.lit_bytes(end + b"\x00" * inclusive) if end else None)
        return reads.scan(self.entries(segments.in_scan(low, high)), namespace, start, end, limit, inclusive, reverse, self.config)

    def rows(self, *args, **kw) -> Iterator[tuple[bytes, bytes]]:
        """scan, streamed to the caller a partition at a time."""
        return ((bytes(r["key"]), bytes(r["value"])) for r in self.scan(*args, **kw).toLocalIterator())

    def namespace(self, name: str) -> Namespace:
        return Namespace(self, name)

    # upkeep

    def flush(self) -> bool:
        """Turns the log's tail into one sorted segment on level 0; False if there was nothing."""
        batches, log = self._log()
        if not batches:
            return False
        self._add(log, 0, batches[-1], [])
        return True

    def _add(self, df: DataFrame, level: int, log_to: int | None, retired: list[int]) -> None:
        version, m = self._version(), self.manifest()
        n = max(m.agg(F.coalesce(F.max("id"), F.lit(-1)) + 1).first()[0], self._next("segments", "id"))
        path = f"{self.path}/segments/id={n}"
        segments.write_segment(df, path)
        held = self._read([path]).withColumn("id", F.lit(n))
        own = segments.segment_stats(held, ["id"]).join(segments.checksums(held, ["id"]).drop("entry_count"), "id")
        own = own.withColumns({"level": F.lit(level), "file_name": F.lit(path), "compacted": F.lit(0), "log_to": F.lit(log_to).cast("int")})
        rows = m.withColumn("compacted", F.when(F.col("id").isin(retired), 1).otherwise(F.col("compacted"))) if retired else m
        # a compaction that leaves no entry has no statistics, and so no segment
        self._publish(rows.unionByName(own.select(*m.columns)), version)
        if log_to is not None:
            self._tail = 0

    def verify(self) -> DataFrame:
        """Each active segment (id, entry_count, found, intact): whether its entries are those that were written."""
        m = self.manifest().where("compacted = 0 and checksum is not null")
        held = [self._read([r["file_name"]]).withColumn("id", F.lit(r["id"])) for r in m.select("id", "file_name").toLocalIterator()]  # a read for each segment
        return segments.verify(m, reduce(DataFrame.unionByName, held) if held else self._read([]).withColumn("id", F.lit(0)), "id")

    def compact(self) -> bool:
        """One merge, if one is due. The inputs stay on disk until vacuum, for readers of older snapshots."""
        plan = compaction.compaction_plan(self.manifest(), self.config).collect()  # one row a segment
        if not plan:
            return False
        ids, target = [r["id"] for r in plan], plan[0]["target_level"]
        paths = [r["file_name"] for r in self.manifest().where(F.col("id").isin(ids)).select("file_name").collect()]
        self._add(compaction.compact(self._read(paths), target >= self.config.last_level), target, None, ids)
        return True

    def vacuum(self) -> int:
        """Deletes compacted segments and log batches that segments hold; returns how many. Only without readers of older snapshots."""
        fs, _ = filesystem(self.spark, self.path)
        old = [r["file_name"] for r in self.manifest().where("compacted = 1").select("file_name").collect()]
        done = self._flushed_to()
        old += [f"{self.path}/log/batch={b}" for b in numbers(self.spark, f"{self.path}/log", "batch") if b <= done]
        return sum(bool(fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(p), True)) for p in old)

    def metrics(self) -> dict:
        """Calls of this handle, the log's tail, and the active segments in all and by level."""
        n, size = self._tail_size()
        levels = {r["level"]: r for r in compaction.level_sizes(self.manifest()).collect()}  # one row a level
        return {
            "writes_total": self.writes, "reads_total": self.reads, "deletes_total": self.deletes,
            "memtable_entries": n, "memtable_size_bytes": size, "wal_size_bytes": size + wal.HEADER_BYTES * n,
            "sstable_count": sum(r["segments"] for r in levels.values()), "total_disk_bytes": sum(r["bytes"] for r in levels.values()),
            "level_counts": {level: r["segments"] for level, r in levels.items()},
        }


class Namespace:
    """A store bound to one namespace."""

    def __init__(self, store: Store, name: str):
        self.store, self.name = store, name

    def put(self, key: bytes, value: bytes) -> int:
        return self.store.put(key, value, self.name)

    def get(self, key: bytes) -> bytes | None:
        return self.store.get(key, self.name)

    def delete(self, key: bytes) -> int:
        return self.store.delete(key, self.name)

    def batch_put(self, entries: Iterable[tuple[bytes, bytes]]) -> tuple[int, int, list[str]]:
        return self.store.batch_put((k, v, self.name) for k, v in entries)

    def batch_get(self, keys: Iterable[bytes]) -> list[bytes | None]:
        return self.store.batch_get([(k, self.name) for k in keys])

    def batch_delete(self, keys: Iterable[bytes]) -> tuple[int, int]:
        return self.store.batch_delete((k, self.name) for k in keys)

    def scan(self, start: bytes = b"", end: bytes | None = None, limit: int = 0, **kw) -> DataFrame:
        return self.store.scan(start, end, limit, self.name, **kw)
