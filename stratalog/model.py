"""Data model: schemas, limits and the small helpers every operator shares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("namespace", T.StringType(), False),
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("ts", T.LongType(), False),
    ]
)

DEFAULT_NAMESPACE = "default"


@dataclass(frozen=True)
class StoreConfig:
    """Limits and thresholds of the store. The defaults are part of the data contract."""

    max_key_bytes: int = 65_535
    max_value_bytes: int = 4_294_967_295
    max_namespace_bytes: int = 256
    max_batch: int = 10_000
    max_scan: int = 100_000
    memtable_bytes: int = 32 << 20
    block_bytes: int = 4096
    bloom_fpp: float = 0.01
    level_ratio: int = 10
    max_levels: int = 7
    l0_trigger: int = 4
    level1_bytes: int = 10 << 20

    @property
    def last_level(self) -> int:
        return self.max_levels - 1


class StoreError(Exception):
    """Base of the errors raised on the driver."""


class InvalidArgument(StoreError):
    """A request breaks a limit of StoreConfig."""


class StorageFailure(StoreError):
    """Stored files are missing or damaged."""


def normal_namespace(c: Column | str) -> Column:
    """The namespace, with null and empty taken as ``default``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull() | (c == ""), F.lit(DEFAULT_NAMESPACE)).otherwise(c)


def has_key(c: Column | str) -> Column:
    """True where the key is neither null nor empty; never null."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (F.octet_length(c) > 0)


def key_hex(c: Column | str = "key") -> Column:
    return F.lower(F.hex(c))


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names not used by df (compared without case), one for each base."""
    taken, out = {c.lower() for c in df.columns}, []
    for b in bases:
        while b.lower() in taken:
            b = f"_{b}"
        taken.add(b.lower())
        out.append(b)
    return out


def common_types(a: DataFrame, b: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """a and b with each of columns in one type, so that equal values have equal hashes: the wider of two numeric types, as a union has it. Types that
    have no common one without reading text as numbers are refused."""
    out = [a, b]
    for c in columns:
        x, y = (d.schema[c].dataType for d in (a, b))
        if x == y:
            continue
        texts = [isinstance(t, (T.StringType, T.BinaryType)) for t in (x, y)]
        if any(texts):
            raise InvalidArgument(f"{c} is {x.simpleString()} here and {y.simpleString()} there")
        wide = a.select(c).limit(0).union(b.select(c).limit(0)).schema[c].dataType
        out = [d.withColumn(c, F.col(f"`{c}`").cast(wide)) for d in out]
    return out[0], out[1]
