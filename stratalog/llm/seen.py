"""Has this key been seen before? Approximate membership first, exact lookup of the positives on disk."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.model import common_types, fresh
from stratalog.scratch import filesystem, new_path, staged

WORDS = 4
#: Bits that a key sets in its block: two in each of the block's words.
BITS = 2 * WORDS
BITS_PER_KEY = 12
#: Blocks up to which a filter is broadcast: 60 bytes each as a hash table, so 64 MB, enough for 22 million keys. A larger filter is met by an equi-join.
BROADCAST_BLOCKS = 1 << 20
#: Keys up to which the hashes of those that are looked up are broadcast to the keys on disk, about 12 MB as a hash table; more are met by an equi-join.
BROADCAST_KEYS = 200_000
#: Of the keys that the filter rejects one in so many, by hash, is looked up all the same, to measure false negatives.
CHECKED_ONE_IN = 64


def key_hash(keys: list[Column]) -> Column:
    """Null keys are ordinary values: which are null goes in."""
    return F.xxhash64(*keys, F.concat_ws("", *(k.isNull().cast("int") for k in keys)))


def _marks(h: Column, blocks: int) -> list[Column]:
    """The block of a key of hash h and the bits that it sets in each word of the block."""
    g = F.xxhash64(F.lit(1), h)
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(g, 6 * n).bitwiseAND(63).cast("int"))
    return [F.pmod(h, F.lit(blocks)).alias("block"), *(bit(2 * i).bitwiseOR(bit(2 * i + 1)).alias(f"m{i}") for i in range(WORDS))]


class SeenFilter:
    """A blocked Bloom filter over key hashes, kept as a table of blocks of 256 bits; only blocks with a key exist.

    Blocks are built by a mergeable ``bit_or`` and met by a broadcast up to BROADCAST_BLOCKS blocks, beyond by an equi-join, so neither a task nor the
    driver ever holds a filter of unbounded size, and a hot key is one key. Filters of equal size merge by ``bit_or``. Null key columns are
    ordinary values."""

    def __init__(self, blocks_df: DataFrame, keys: list[str], blocks: int):
        self.table, self.keys, self.blocks = blocks_df, keys, blocks

    @staticmethod
    def size(keys: int, bits_per_key: int = BITS_PER_KEY) -> int:
        return max(1, math.ceil(keys * bits_per_key / (64 * WORDS)))

    @staticmethod
    def blocks_of(hashes: DataFrame, h: str, blocks: int) -> DataFrame:
        return hashes.select(*_marks(F.col(h), blocks)).groupBy("block").agg(*(F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)))

    @classmethod
    def build(cls, df: DataFrame, keys: list[str], expected: int | None = None, bits_per_key: int = BITS_PER_KEY) -> SeenFilter:
        """expected: how many distinct keys to size for; by default an estimate over all rows (to about 2 %). More keys only cost precision."""
        hashes = df.select(key_hash([F.col(k) for k in keys]).alias("h"))
        n = hashes.agg(F.approx_count_distinct("h", 0.02)).first()[0] if expected is None else expected
        return cls(staged(cls.blocks_of(hashes, "h", cls.size(n, bits_per_key)), "filter"), keys, cls.size(n, bits_per_key))

    def merge(self, other: SeenFilter) -> SeenFilter:
        if (self.blocks, self.keys) != (other.blocks, other.keys):
            raise ValueError("only filters of one size over the same keys merge")
        both = self.table.unionByName(other.table).groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))
        return SeenFilter(both, self.keys, self.blocks)

    def test(self, df: DataFrame, flag: str = "maybe", h: str | None = None) -> DataFrame:
        """df with flag: false where the key was certainly never added, true where it may have been. h: a column of df that holds the key's hash."""
        marked = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *_marks(F.col(h) if h else key_hash([F.col(k) for k in self.keys]), self.blocks))
        hit = F.col("w0").isNotNull()
        for i in range(WORDS):
            hit &= F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}")
        table = F.broadcast(self.table) if self.blocks <= BROADCAST_BLOCKS else self.table
        return marked.join(table, "block", "left").select("row.*", F.coalesce(hit, F.lit(False)).alias(flag))


class SeenIndex:
    """Distinct keys on disk and a filter over them, kept in a folder and extended part by part.

    * ``keys/part=N``    bucket=B: hash, key and ``filtered``, the distinct keys of part N
    * ``filter/part=N``  the blocks of these keys; all parts have one number of blocks, so they merge by ``bit_or``
    * ``about``          the number of blocks and of buckets, and the parts, written last

    ``filtered`` tells whether the store keeps a filter of its own for a segment that holds the key. Here every key is in the filter, also those of
    segments that were written without one and those not flushed yet: what the store's filters can't answer, this one does."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.blocks, self.buckets, self.parts, self.schema = 0, int(spark.conf.get("spark.sql.shuffle.partitions")), 0, None
        fs, p = filesystem(spark, f"{self.path}/about")
        if fs.exists(p):
            r = spark.read.schema("parts int, blocks bigint, buckets int").json(f"{self.path}/about").orderBy(F.desc("parts")).first()  # a row for each part
            self.parts, self.blocks, self.buckets = r["parts"], r["blocks"], r["buckets"]
            self.schema = spark.read.option("basePath", f"{self.path}/keys").parquet(f"{self.path}/keys/part=0").drop("part", "bucket").schema

    def add(self, known: DataFrame, filtered: Column | None = None, expected: int | None = None, bits_per_key: int = BITS_PER_KEY) -> None:
        """Adds the keys of known, in one pass over it, combined on the map side. filtered: over known, by default true. expected, of the first part: how many
        keys the filter is to hold in the end, by default those of this part; more only cost precision."""
        own = [F.col(f"`{k}`") for k in self.keys]
        rows = known.select(key_hash(own).alias("h"), F.struct(*(c.alias(f"k{i}") for i, c in enumerate(own))).alias("k"), (F.lit(True) if filtered is None else F.coalesce(filtered, F.lit(False))).alias("filtered"))
        if self.schema is not None:
            rows = rows.withColumn("k", F.col("k").cast(self.schema["k"].dataType))
        n = self.parts
        found = rows.groupBy("h", "k").agg(F.bool_or("filtered").alias("filtered"))
        # the bucket is the hash by which Spark places a key in a shuffle, so a task writes few buckets, without a further shuffle
        found.withColumn("bucket", F.pmod(F.hash("h", "k"), F.lit(self.buckets)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/keys/part={n}")
        self.schema = self.schema or found.schema
        hashes = self._keys([n])
        if not n:
            self.blocks = SeenFilter.size(hashes.count() if expected is None else expected, bits_per_key)
        SeenFilter.blocks_of(hashes, "h", self.blocks).write.mode("overwrite").parquet(f"{self.path}/filter/part={n}")
        self.spark.range(1).select(F.lit(n + 1).alias("parts"), F.lit(self.blocks).alias("blocks"), F.lit(self.buckets).alias("buckets")).coalesce(1).write.mode("append").json(f"{self.path}/about")
        self.parts = n + 1

    def _keys(self, parts: list[int], buckets: list[int] | None = None) -> DataFrame:
        df = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).option("basePath", f"{self.path}/keys").parquet(*(f"{self.path}/keys/part={i}" for i in parts))
        return df if buckets is None else df.where(F.col("bucket").isin(buckets))

    def filter(self) -> SeenFilter:
        schema = "block bigint, " + ", ".join(f"w{i} bigint" for i in range(WORDS))
        table = self.spark.read.schema(schema).parquet(*(f"{self.path}/filter/part={i}" for i in range(self.parts)))
        if self.parts > 1:
            table = table.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))
        return SeenFilter(table, self.keys, self.blocks)

    def lookup(self, asked: DataFrame) -> DataFrame:
        """asked (h, k and more) with ``known`` and ``filtered``, exactly, from the buckets that the asked keys are in."""
        buckets = [r[0] for r in asked.select(F.pmod(F.hash("h", "k"), F.lit(self.buckets)).cast("int")).distinct().collect()]  # at most self.buckets rows
        full = self._keys(list(range(self.parts)), buckets).select("h", "k", "filtered")
        if self.parts > 1:
            full = full.groupBy("h", "k").agg(F.bool_or("filtered").alias("filtered"))
        if asked.count() <= BROADCAST_KEYS:  # then the keys on disk aren't moved
            full = full.join(F.broadcast(asked.select("h")), "h", "left_semi")
        return asked.join(full, ["h", "k"], "left").withColumn("known", F.col("filtered").isNotNull())


def answer(probes: DataFrame, probe_id: str, known: DataFrame | SeenIndex, keys: list[str], filtered: Column | None = None, bits_per_key: int = BITS_PER_KEY) -> tuple[DataFrame, DataFrame]:
    """(seen, firsts) of a stream of probes against the known keys and against earlier probes.

    known: rows with the keys, of which an index is made (filtered: see SeenIndex), or an index. Keys of different numeric types are compared in the wider
    one; text and numbers are refused. seen: the rows of probes, with all their columns, whose key is known or in a probe of smaller probe_id (unique and
    not null). firsts: for each distinct key asked for, ``key`` (a struct of keys), ``first`` (smallest probe_id), ``maybe`` (the filter's answer),
    ``checked`` (whether the key was looked up), ``known`` (what the lookup said; false if it wasn't asked) and ``filtered``. A row with maybe and not
    known is a wrong answer of the filter that the lookup disproved; one with known and not maybe would be a false negative. Null keys equal null keys.
    Probes and known may repeat rows; without known keys the filter rejects all.

    Only a key's first probe can be new, so the distinct keys go to the filter: those it rejects are new at once, the others are looked
    up among the full keys on disk, and so is one in CHECKED_ONE_IN of the rejected. The probes themselves meet only the ids of new firsts, a unique id
    each: a key that holds a third of the probes moves like any other rows."""
    if isinstance(known, SeenIndex):
        index = known
        held = index.spark.createDataFrame([], index.schema).select(*(F.col("k")[f"k{i}"].alias(k) for i, k in enumerate(keys)))
        alike = common_types(probes, held, keys)[0]
    else:
        alike, stored = common_types(probes, known, keys)
        index = SeenIndex(probes.sparkSession, new_path(probes.sparkSession, "seen"), keys)
        index.add(stored, filtered, bits_per_key=bits_per_key)
    own = [F.col(f"`{k}`") for k in keys]
    key = F.struct(*(c.cast(index.schema["k"].dataType[f"k{i}"].dataType).alias(f"k{i}") for i, c in enumerate(own)))
    asked = alike.select(key.alias("k"), F.col(probe_id).alias("first")).withColumn("h", key_hash([F.col("k")[f"k{i}"] for i in range(len(keys))])).groupBy("h", "k").agg(F.min("first").alias("first"))
    # the hash of the sample must not be that of the buckets or blocks
    checked = F.col("maybe") | (F.pmod(F.xxhash64(F.lit(3), "h"), F.lit(CHECKED_ONE_IN)) == 0)
    tested = staged(index.filter().test(asked, h="h").withColumn("checked", checked), "tested")
    rejected = tested.where("not checked").select("*", F.lit(None).cast("boolean").alias("filtered"), F.lit(False).alias("known"))
    both = rejected.unionByName(index.lookup(tested.where("checked")))
    firsts = staged(both.select(F.struct(*(F.col("k")[f"k{i}"].alias(c) for i, c in enumerate(keys))).alias("key"), "first", "maybe", "checked", "known", "filtered"), "answers")
    new = firsts.where("not known").select(F.col("first").alias(*fresh(probes, "new")))
    return probes.join(new, probes[probe_id] == new[new.columns[0]], "left_anti"), firsts


def error_report(firsts: DataFrame) -> DataFrame:
    """One row: keys asked for, keys that are new, how many of them the filter let through (each disproved by the lookup), how many keys that it rejected
    were looked up and how many of these are known (false negatives), how many known keys none of the store's own filters has, and the filter's
    measured rate of wrong answers on new keys (0 without any)."""
    c, maybe, known = F.count_if, F.col("maybe"), F.col("known")
    n = firsts.agg(F.count(F.lit(1)).alias("asked"), c(~known).alias("new"), c(maybe & ~known).alias("disproved"), c(F.col("checked") & ~maybe).alias("rejected_checked"), c(~maybe & known).alias("missed"), c(known & ~F.coalesce("filtered", F.lit(False))).alias("without_filter"))
    return n.select("*", F.coalesce(F.try_divide("disproved", "new"), F.lit(0.0)).alias("error_rate"))
