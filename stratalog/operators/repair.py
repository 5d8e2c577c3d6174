"""Hash leaves over key-ordered rows, and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators.ordered import global_row_number

LEAVES = 64
#: Fan-out of a leaf's tree: hashes that are put together at once.
FAN = 4096


def merkle_leaves(rows: DataFrame, key_hex: str, row_hash: str, leaves: int = LEAVES, fan: int = FAN) -> DataFrame:
    """Positional leaves: rows in key order are cut into chunks of ceil(n / min(leaves, n)); leaf, hash, min_key, max_key, cnt. No rows, no leaves.

    hash is the root of a tree of that fan-out over the chunk's row hashes (hexadecimal) in key order: ``fan`` neighbours put together and hashed by sha-256 become one,
    level by level, until one is left; a chunk has one level at least. So it is the flat hash of a chunk of up to fan rows, by one definition at every size, and no
    task gathers more than fan hashes at once. Equal keys are in any order."""
    n = rows.count()
    size = -(-n // min(leaves, n)) if n else 1
    placed = global_row_number(rows.select(F.col(key_hex).alias("k"), F.col(row_hash).alias("h")), ["k"], "at")
    level = placed.select(F.expr(f"cast((at - 1) div {size} as int)").alias("leaf"), F.expr(f"(at - 1) % {size}").alias("i"), "h", F.col("k").alias("lo"), F.col("k").alias("hi"), F.lit(1).cast("bigint").alias("n"))
    while True:
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]), "")
        up = level.groupBy("leaf", F.expr(f"i div {fan}").alias("j")).agg(F.sha2(joined.cast("binary"), 256).alias("h"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
        level = up.withColumnRenamed("j", "i")
        size = -(-size // fan)
        if size <= 1:
            return level.select("leaf", F.col("h").alias("hash"), F.col("lo").alias("min_key"), F.col("hi").alias("max_key"), F.col("n").alias("cnt"))


def keyed_leaves(rows: DataFrame, key_hex: str, row_hash: str, leaves: int) -> DataFrame:
    """Leaves by hash of the key, so that one insertion touches one leaf: leaf, hash, min_key, max_key, cnt.

    A row's leaf is the first 15 hexadecimal digits of its key's md5, modulo leaves. hash is the sha-256 of two sums over the leaf's rows, of the same digits of the
    md5 of ``1/key/hash`` and of ``2/key/hash``: in any order, so a leaf of any size takes constant memory and is combined on the map side."""
    k, h = F.col(key_hex), F.col(row_hash)
    digits = lambda c: F.conv(F.substring(F.md5(c), 1, 15), 16, 10)
    b = F.pmod(digits(k).cast("bigint"), F.lit(leaves)).cast("int").alias("leaf")
    sums = [F.sum(digits(F.concat_ws("/", F.lit(s), "k", "h")).cast("decimal(38,0)")).cast("string") for s in ("1", "2")]
    hashed = F.sha2(F.concat_ws("/", *sums).cast("binary"), 256).alias("hash")
    return rows.select(b, k.alias("k"), h.alias("h")).groupBy("leaf").agg(hashed, F.min("k").alias("min_key"), F.max("k").alias("max_key"), F.count(F.lit(1)).alias("cnt"))


def merkle_root(leaves: DataFrame) -> DataFrame:
    """One row: the sha-256 over the leaves' hashes in order; 64 zeros without leaves."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("leaf", "hash"))), lambda x: x["hash"]), "")
    return leaves.agg(F.when(F.count(F.lit(1)) == 0, "0" * 64).otherwise(F.sha2(joined.cast("binary"), 256)).alias("root"))


def merkle_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Leaves that differ: leaf, min_key, max_key (over both sides), local_count, remote_count."""
    j = local.alias("l").join(remote.alias("r"), F.col("l.leaf") == F.col("r.leaf"), "full").where(~F.col("l.hash").eqNullSafe(F.col("r.hash")))
    return j.select(F.coalesce("l.leaf", "r.leaf").alias("leaf"), F.least("l.min_key", "r.min_key").alias("min_key"), F.greatest("l.max_key", "r.max_key").alias("max_key"), F.coalesce("l.cnt", F.lit(0)).alias("local_count"), F.coalesce("r.cnt", F.lit(0)).alias("remote_count"))
