"""Applying a feed of inserts, updates and deletes by delete vectors.

A DeleteVectorTable is a folder of immutable Parquet files, bitmaps of the positions that count, and an index:

* ``data/batch=N``   the images of batch N, appended and never rewritten
* ``index/batch=N``  bucket=B: key -> (file, position, ts, live) for the keys that batch N changed
* ``dv/batch=N``     (file, word, mask): one bit for each of the 64 positions of a word, cleared where the row is dead
* ``log/version=N``  written last: a version exists only once its log row does. It names the batches that make it up

A batch writes bitmaps of the files that it touches, and nothing else of the others: a word's masks of all batches together are its state
(``bit_and``), in whatever order they come. So a batch costs what it changes, plus a look into the index buckets of its keys. ``compact`` turns all
batches of a version into one, so that files, index deltas and bitmaps don't pile up.

``apply`` finds superseded rows through the index, clears their bits and appends the new images. ``read`` scans the data files and drops dead
positions. Everything is read and written through Spark, on whatever file system the path names; a missing folder is an error. Bitmaps are
broadcast up to BROADCAST_WORDS words; beyond, rows and bitmaps meet in an equi-join of (file, word), 64 rows a key.

Order is by ts, not by arrival: late, repeated and out-of-order changes leave the same state. At equal ts an insert beats a delete, then the
row with the greatest hash of its columns wins, so the state doesn't depend on how the feed was cut into batches. One writer at a time, any number of readers. Null keys are keys; a null ts
loses to every other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.model import StorageFailure, fresh
from stratalog.scratch import filesystem, staged

#: Words of 64 positions up to which a version's bitmaps are broadcast: about 100 bytes each as a hash table, so 26 MB for 16 million rows.
BROADCAST_WORDS = 1 << 18
#: Rows up to which a batch counts as small, and the hashes of its keys are broadcast: about 60 bytes each as a hash table, so 30 MB.
SMALL_BATCH = 500_000


def numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """N of each finished folder ``name=N`` in path."""
    fs, p = filesystem(spark, path)
    if not fs.exists(p):
        return []
    out = []
    for s in fs.listStatus(p):
        head, _, n = s.getPath().getName().partition("=")
        if head == name and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            out.append(int(n))
    return sorted(out)


def _word(pos: str) -> Column:
    return F.shiftright(pos, 6).alias("word")


def _bit(pos: str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(pos).bitwiseAND(63).cast("int"))


class DeleteVectorTable:
    """The current state of a keyed table under a change feed.

    keys: key columns (null keys are compared as equal). ts: the bigint that orders changes. deleted: a boolean Column over the
    feed that is true for a delete. buckets: folders of each index delta, by key hash; by default the session's shuffle partitions. A word of a file
    without a mask is dead as a whole; that is how files whose rows were all superseded on arrival cost nothing.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], ts: str, deleted: Column, buckets: int | None = None):
        self.spark, self.keys, self.ts, self.deleted = spark, keys, ts, deleted
        fs, p = filesystem(spark, root.rstrip("/"))
        self.root = str(fs.makeQualified(p))
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._schema: T.StructType | None = None  # of the data files
        self._logs: dict[int, tuple[list[int], int, dict[str, int]]] = {}  # versions never change

    @property
    def version(self) -> int:
        """The newest finished version, -1 for a table without any."""
        return max(numbers(self.spark, f"{self.root}/log", "version"), default=-1)

    def _log(self, version: int) -> tuple[list[int], int, dict[str, int]]:
        """The batches of a version, in order, how many mask rows they have, and the last batch applied of each stream. One small row."""
        if version < 0:
            return [], 0, {}
        if version in self._logs:
            return self._logs[version]
        r = self.spark.read.schema("batches array<int>, words bigint, streams map<string, bigint>").json(f"{self.root}/log/version={version}").first()
        self._logs = {version: (list(r["batches"]), r["words"], dict(r["streams"] or {}))}
        return self._logs[version]

    def _folders(self, kind: str, batches: list[int]) -> list[str]:
        paths = [f"{self.root}/{kind}/batch={b}" for b in batches]
        for path in paths:
            fs, p = filesystem(self.spark, path)
            if not fs.exists(p):
                raise StorageFailure(f"{path} is missing")
        return paths

    def _data(self, batches: list[int]) -> tuple[DataFrame, str, str, str]:
        """The images of batches with their order mark, file id and position, and the names of these three columns. File names hold a job's unique
        id, so they stay valid if the table is moved."""
        folders = self._folders("data", batches)
        self._schema = self._schema or self.spark.read.parquet(folders[0]).schema
        df = self.spark.read.schema(self._schema).parquet(*folders)
        meta, (fid, pos) = df.metadataColumn("_metadata"), fresh(df, "fid", "pos")
        return df.select(df["*"], F.xxhash64(meta["file_name"]).alias(fid), meta["row_index"].alias(pos)), df.columns[-1], fid, pos

    def _entries(self, data: DataFrame, order: str, fid: str, pos: str) -> DataFrame:
        """key hash, key and (ts, mark, fid, pos) of each image. The hash sorts and places keys; the struct tells them apart, nulls being equal."""
        key = F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(self.keys)))
        entry = F.struct(F.col(self.ts).alias("ts"), F.col(order).alias("mark"), F.col(fid).alias("fid"), F.col(pos).alias("pos"))
        return data.select(F.xxhash64(key).alias("h"), key.alias("k"), entry.alias("e"))

    def _index(self, batches: list[int], like: DataFrame, buckets: list[int] | None = None) -> DataFrame:
        """Index rows h, k, e and was, the entry that e superseded; like: a DataFrame of h, k and e."""
        e = like.schema["e"].dataType
        schema = T.StructType([*(T.StructField(c, like.schema[c].dataType) for c in ("h", "k", "e")), T.StructField("was", e), T.StructField("bucket", T.IntegerType())])
        df = self.spark.read.schema(schema).option("basePath", f"{self.root}/index").parquet(*self._folders("index", batches))
        return df if buckets is None else df.where(F.col("bucket").isin(buckets))

    def apply(self, changes: DataFrame, stream: str | None = None, number: int = 0) -> int:
        """Appends one batch of changes; returns the version that holds it. The columns of the first batch are those of the table, whatever
        their names, and later batches are cast to their types; an empty batch makes a version without changes. stream, number: a batch of a stream
        whose numbers ascend; one that was applied before is passed over."""
        done = self.version
        n, (old, words, streams) = done + 1, self._log(done)
        if stream is not None:
            if streams.get(stream, -1) >= number:
                return done
            streams = streams | {stream: number}
        rest = [c for c in changes.columns if c not in self.keys and c != self.ts]
        nulls = F.concat_ws("", *(F.col(f"`{c}`").isNull().cast("int") for c in rest))
        # the order mark, the last column, spares the index pass from reading other columns: -1 for a delete, else a hash of them
        h = F.shiftrightunsigned(F.xxhash64(*(F.col(f"`{c}`") for c in rest), nulls), 1)
        mark = F.when(F.coalesce(self.deleted, F.lit(False)), F.lit(-1).cast("bigint")).otherwise(h).alias(*fresh(changes, "order_mark"))
        kinds = {f.name: f.dataType for f in self._data(old[:1])[0].schema} if old else {}
        cols = [F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in changes.columns]
        # a batch that was cut off by a failure is written again; nothing refers to its leftovers
        images = changes.select(*cols, mark)
        images.write.mode("overwrite").parquet(f"{self.root}/data/batch={n}")
        self._schema = self._schema or images.schema

        data = self._data([n])
        new = self._entries(*data)
        newest = [F.max(c).alias(c) for c in ("e", "was")]
        if not old:
            both = new.groupBy("h", "k").agg(newest[0]).withColumn("was", F.lit(None).cast(new.schema["e"].dataType))
        elif data[0].count() <= SMALL_BATCH:
            # of the index only rows of this batch's keys go on: those of its buckets, by a broadcast of at most SMALL_BATCH hashes
            new = staged(new.groupBy("h", "k").agg(newest[0]), "batch")
            bucket = [r[0] for r in new.select(self._bucket().alias("b")).distinct().collect()]  # at most self.buckets rows
            mine = self._index(old, new, bucket).join(F.broadcast(new.select("h")), "h", "left_semi").groupBy("h", "k").agg(F.max("e").alias("was"))
            both = new.join(mine, ["h", "k"], "left")
        else:
            # a batch that touches most buckets meets the index in one aggregation, combined on the map side
            was = self._index(old, new).select("h", "k", F.lit(None).cast(new.schema["e"].dataType).alias("e"), F.col("e").alias("was"))
            both = new.withColumn("was", F.lit(None).cast(new.schema["e"].dataType)).unionByName(was).groupBy("h", "k").agg(*newest).where("e is not null")
        wins = F.col("was").isNull() | (F.col("e") > F.col("was"))
        both.where(wins).select("h", "k", "e", "was", self._bucket().alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/index/batch={n}")

        changed = self._index([n], new)
        masks = self._born(changed)
        if old:
            died = changed.where("was.mark >= 0").select("was.fid", "was.pos").groupBy("fid", _word("pos")).agg(F.bit_or(_bit("pos")).alias("m"))
            masks = masks.unionByName(died.select("fid", "word", F.bitwise_not("m").alias("mask")))
        self._masks(masks, n)
        self._publish(n, [*old, n], words, streams)
        return n

    def _bucket(self) -> Column:
        """The index bucket of a key: the hash by which Spark places it in a shuffle, so a task writes few buckets, without a further shuffle."""
        return F.pmod(F.hash("h", "k"), F.lit(self.buckets)).cast("int")

    def _born(self, rows: DataFrame) -> DataFrame:
        return rows.where("e.mark >= 0").select("e.fid", "e.pos").groupBy("fid", _word("pos")).agg(F.bit_or(_bit("pos")).alias("mask"))

    def _masks(self, masks: DataFrame, n: int) -> None:
        masks.write.mode("overwrite").parquet(f"{self.root}/dv/batch={n}")

    def _publish(self, n: int, batches: list[int], words: int, streams: dict[str, int]) -> None:
        """words: mask rows of the batches before the last."""
        words += self._bitmaps(batches[-1:]).count()
        held = F.create_map(*(F.lit(x) for kv in streams.items() for x in kv)) if streams else F.lit(None).cast("map<string, bigint>")
        self.spark.range(1).select(F.array(*map(F.lit, batches)).alias("batches"), F.lit(words).alias("words"), held.alias("streams")).coalesce(1).write.mode("overwrite").json(f"{self.root}/log/version={n}")
        self._logs = {n: (batches, words, streams)}

    def _bitmaps(self, batches: list[int]) -> DataFrame:
        masks = self.spark.read.schema("fid bigint, word bigint, mask bigint").parquet(*self._folders("dv", batches))
        return masks.groupBy("fid", "word").agg(F.bit_and("mask").alias("mask")) if len(batches) > 1 else masks

    def _live(self, version: int) -> tuple[DataFrame, str, str, str]:
        """The rows that count as of a version, with the names as in _data."""
        batches, words, _ = self._log(version)
        df, order, fid, pos = self._data(batches)
        mask, of, word, j = fresh(df, "mask", "of", "word", "j")
        bits = self._bitmaps(batches).select(F.col("fid").alias(of), F.col("word").alias(word), F.col("mask").alias(mask))
        if words <= BROADCAST_WORDS:
            # one bigint as the key makes the hash table small; what it stands for is compared as well
            bits = F.broadcast(bits.withColumn(j, F.xxhash64(of, word)))
            same = F.col(fid).bitwiseXOR(F.col(of)).bitwiseOR(F.shiftright(pos, 6).bitwiseXOR(F.col(word))) == 0
            on = (F.xxhash64(F.col(fid), F.shiftright(pos, 6)) == F.col(j)) & same
        else:
            on = (F.col(fid) == F.col(of)) & (F.shiftright(pos, 6) == F.col(word))
        hit = df.join(bits, on).where(F.col(mask).bitwiseAND(_bit(pos)) != 0)
        return hit.drop(of, word, mask, j), order, fid, pos

    def read(self, *columns: str, version: int | None = None) -> DataFrame:
        """The live rows as of a version, the newest by default: columns, or all columns of the table."""
        v = self.version if version is None else version
        if v < 0:
            raise ValueError("the table has no version yet")
        df, *own = self._live(v)
        return df.select(*(F.col(f"`{c}`") for c in (columns or [c for c in df.columns if c not in own])))

    def compact(self) -> int:
        """Rewrites the newest version as one batch of live rows and of one index entry a key (deletes keep theirs, so that later, older writes still
        lose); returns the new version. The files of older versions stay, for their readers, until ``vacuum``."""
        done = self.version
        batches, _, streams = self._log(done)
        if not batches:
            raise ValueError("the table has no version yet")
        n = done + 1
        live, *own = self._live(done)
        order = own[0]
        live.select(*(F.col(f"`{c}`") for c in live.columns if c not in own), order).write.mode("overwrite").parquet(f"{self.root}/data/batch={n}")
        put = self._entries(*self._data([n]))
        gone = self._index(batches, put).groupBy("h", "k").agg(F.max("e").alias("e")).where("e.mark < 0")
        rows = put.unionByName(gone).repartition(self.buckets, "h", "k").select("*", F.lit(None).cast(put.schema["e"].dataType).alias("was"), self._bucket().alias("bucket"))
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/index/batch={n}")
        self._masks(self._born(self._index([n], put)), n)
        self._publish(n, [n], 0, streams)
        return n

    def vacuum(self) -> int:
        """Deletes what only versions before the newest use; returns how many folders. Only without readers of these versions."""
        done = self.version
        used, gone = self._log(done)[0], 0
        for kind, name, kept in (("log", "version", [done]), ("data", "batch", used), ("index", "batch", used), ("dv", "batch", used)):
            for n in numbers(self.spark, f"{self.root}/{kind}", name):
                if n not in kept:
                    fs, p = filesystem(self.spark, f"{self.root}/{kind}/{name}={n}")
                    gone += bool(fs.delete(p, True))
        return gone
