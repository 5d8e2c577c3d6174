"""Puts, deletes and batches as appends to the changelog: validation, reports, timestamps, sizes, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.model import StoreConfig, fresh, normal_namespace
from stratalog.operators.ordered import global_row_number, running_max


def put_error(config: StoreConfig = StoreConfig()) -> Column:
    """Why a put of (namespace, key, value) is refused; null if it is accepted."""
    ns = normal_namespace("namespace")
    return (
        F.when(F.col("key").isNull() | (F.octet_length("key") == 0), "key must not be empty")
        .when(F.octet_length("key") > config.max_key_bytes, f"key exceeds {config.max_key_bytes} bytes")
        .when(F.octet_length("value") > config.max_value_bytes, f"value exceeds {config.max_value_bytes} bytes")
        .when(F.octet_length(ns) > config.max_namespace_bytes, f"namespace exceeds {config.max_namespace_bytes} bytes")
    )


def delete_error(config: StoreConfig = StoreConfig()) -> Column:
    """Why a delete of (namespace, key) is refused; null if it is accepted. A key need not exist."""
    return F.when(F.col("key").isNull() | (F.octet_length("key") == 0), "key must not be empty").when(F.octet_length("key") > config.max_key_bytes, f"key exceeds {config.max_key_bytes} bytes").when(F.octet_length(normal_namespace("namespace")) > config.max_namespace_bytes, f"namespace exceeds {config.max_namespace_bytes} bytes")


def accepted(requests: DataFrame, error: Column) -> DataFrame:
    """The requests that pass, with the namespace that counts; what a batch appends."""
    return requests.where(error.isNull()).withColumn("namespace", normal_namespace("namespace"))


def batch_report(requests: DataFrame, batch: str, error: Column, config: StoreConfig = StoreConfig()) -> DataFrame:
    """For each batch: requests, ok, failed and ``errors``, the distinct error texts in order. Batches aren't atomic: ok ones are stored.
    A batch of more than max_batch requests fails whole, with one error text. The texts come from a fixed set, so no list grows."""
    e = requests.withColumn("__e", error).groupBy(batch).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("__e").isNull()).alias("ok"), F.sort_array(F.collect_set("__e")).alias("errors"))
    over = F.col("requests") > config.max_batch
    return e.select(batch, "requests", F.when(over, F.lit(0).cast("bigint")).otherwise(F.col("ok")).alias("ok"), F.when(over, F.col("requests")).otherwise(F.col("requests") - F.col("ok")).alias("failed"), F.when(over, F.array(F.lit(f"batch exceeds {config.max_batch} entries"))).otherwise(F.col("errors")).alias("errors"))


def assign_ts(requests: DataFrame, order: list[str], wall_us: str, base: int = 0) -> DataFrame:
    """requests with ``ts``: strictly increasing in arrival order and never behind the wall clock, as if each took max(previous, wall) + 1.

    Closed form: with n the place of a row, ts = n + max(base, the greatest wall_us - place + 1 so far). Places are numbered without a
    single task; the running maximum is taken the same way, so a retry gives the same ts."""
    n, m = fresh(requests, "n", "m")
    placed = global_row_number(requests, order, n)
    return running_max(placed, order, F.col(wall_us) - F.col(n) + 1, m).withColumn("ts", F.col(n) + F.greatest(F.col(m), F.lit(base))).drop(n, m)


def encoded_size() -> Column:
    """Bytes of an encoded entry: u16 key length, key, u8 tombstone flag, u32 value length, value, u64 ts, u16 namespace length, namespace."""
    return F.lit(2) + F.octet_length("key") + 1 + 4 + F.coalesce(F.octet_length("value"), F.lit(0)) + 8 + 2 + F.octet_length("namespace")


def op_counters(ops: DataFrame) -> DataFrame:
    """One row of counters over an operation log (op, ok): a failed write doesn't count, a read counts on entry."""
    done = F.coalesce(F.col("ok"), F.lit(False))
    return ops.agg(F.count_if((F.col("op") == "put") & done).alias("writes"), F.count_if(F.col("op").isin("get", "scan")).alias("reads"), F.count_if((F.col("op") == "delete") & done).alias("deletes"))
