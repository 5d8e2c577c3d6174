"""Running sums and ranks over a whole table, without gathering it in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.model import fresh
from stratalog.scratch import staged


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def run_starts(b: pa.RecordBatch, columns: list[str], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Where a row of b differs from the one before it in columns, nulls being equal; last: those of the row before b. And those of its last row."""
    cols = [b.column(c) for c in columns]
    new = np.zeros(b.num_rows, bool)
    new[0] = last is None or tuple(c[0].as_py() for c in cols) != last
    if b.num_rows > 1:
        for c in cols:
            x, y = c[1:], c[:-1]
            new[1:] |= pa.compute.not_equal(x, y).fill_null(False).to_numpy(zero_copy_only=False) | (x.is_null().to_numpy(zero_copy_only=False) != y.is_null().to_numpy(zero_copy_only=False))
    return new, tuple(c[-1].as_py() for c in cols)


def _carry(df: DataFrame, order: list[str], value: Column, out: str, combine: str, before: bool) -> DataFrame:
    """The running sum or maximum of value: each range partition goes over its own sorted rows once, in a stage with the write; what lies before it, one
    number a partition, is added from a broadcast of that many rows."""
    v, part, ahead, own = fresh(df, "v", "part", "ahead", "own")
    kind = df.select(value.alias("v")).schema["v"].dataType
    kind = T.LongType() if isinstance(kind, T.IntegralType) else kind
    rows = df.withColumn(v, value.cast(kind)).repartitionByRange(parts_of(df.sparkSession), *order).sortWithinPartitions(*order)
    schema = T.StructType([*rows.schema.fields, T.StructField(own, kind), T.StructField(part, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        p, held = TaskContext.get().partitionId(), None
        for b in batches:
            c = b.column(v)
            if combine == "sum":
                x = pa.compute.cumulative_sum(c.fill_null(0), start=pa.scalar(held or 0, c.type))
            else:
                x = c if held is None else pa.concat_arrays([pa.array([held], c.type), c])
                x = pa.compute.fill_null_forward(pa.compute.cumulative_max(x, skip_nulls=True))
                x = x if held is None else x[1:]
            if len(x):
                held = x[-1].as_py()
            yield pa.RecordBatch.from_arrays([*b.columns, x, pa.array(np.full(b.num_rows, p, np.int32))], names=[*b.schema.names, own, part])

    cut = staged(rows.mapInArrow(run, schema), "ordered")
    whole = (F.sum if combine == "sum" else F.max)(v).alias(ahead)
    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    each = cut.groupBy(part).agg(whole).select(part, (F.sum if combine == "sum" else F.max)(ahead).over(w).alias(ahead))  # a row for each partition
    got = cut.join(F.broadcast(each), part)
    if combine == "max":
        return got.withColumn(out, F.greatest(own, ahead)).drop(v, part, ahead, own)
    total = F.col(own) + F.coalesce(ahead, F.lit(0))
    return got.withColumn(out, total - F.coalesce(v, F.lit(0)) if before else total).drop(v, part, ahead, own)


def running_sum(df: DataFrame, order: list[str], value: Column, out: str, before: bool = False) -> DataFrame:
    """df with ``out``: the sum of value over the rows up to this one in the order of the columns order, without this row if before.

    Rows are range partitioned, once; each partition sums its own rows and adds what the partitions before it hold. That is one row for each
    partition, the bound of the broadcast. order should be unique, or sums within ties are arbitrary. Null values add nothing."""
    return _carry(df, order, value, out, "sum", before)


def following(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with ``out``: the columns order of the next row in their order, as a struct; null in the last row. A lead over the whole table: each
    range partition goes over its sorted rows once, in a stage with the write; its last row takes the first of the next partition that has any."""
    part, first, after, led = fresh(df, "part", "first", "after", "led")
    rows = df.repartitionByRange(parts_of(df.sparkSession), *order).sortWithinPartitions(*order)
    kind = T.StructType([T.StructField(c, df.schema[c].dataType) for c in order])
    schema = T.StructType([*rows.schema.fields, T.StructField(led, kind), T.StructField(part, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        p, held = TaskContext.get().partitionId(), None

        def with_next(b: pa.RecordBatch, upcoming: list[pa.Array], known: int) -> pa.RecordBatch:
            s = pa.StructArray.from_arrays(upcoming, names=order, mask=pa.array(np.arange(b.num_rows) >= known))
            return pa.RecordBatch.from_arrays([*b.columns, s, pa.array(np.full(b.num_rows, p, np.int32))], names=[*b.schema.names, led, part])

        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            held = b.slice(b.num_rows - 1)
            if b.num_rows > 1:
                yield with_next(b.slice(0, b.num_rows - 1), [b.column(c)[1:] for c in order], b.num_rows)
        if held is not None:
            yield with_next(held, [held.column(c) for c in order], 0)

    cut = staged(rows.mapInArrow(run, schema), "ordered")
    firsts = cut.groupBy(part).agg(F.min(F.struct(*order)).alias(first))
    n = firsts.select(part, F.lead(first).over(Window.orderBy(part)).alias(after))  # a row for each partition
    return cut.join(F.broadcast(n), part).withColumn(out, F.coalesce(led, after)).drop(part, led, after)


def global_row_number(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with ``out``: the place of each row in the order, from 1. The place inside a range partition is given as rows are written, so numbering
    needs neither a window over rows nor a second shuffle."""
    part, at, ahead = fresh(df, "part", "place", "ahead")
    # the id's upper bits are the partition, its lower 33 the row's place
    cut = staged(df.repartitionByRange(parts_of(df.sparkSession), *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "numbered")
    cut = cut.withColumn(part, F.shiftright(at, 33).cast("int")).withColumn(at, F.col(at).bitwiseAND((1 << 33) - 1))
    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    n = cut.groupBy(part).count().select(part, F.coalesce(F.sum("count").over(w), F.lit(0)).alias(ahead))  # a row for each partition
    return cut.join(F.broadcast(n), part).withColumn(out, F.col(at) + F.col(ahead) + 1).drop(part, at, ahead)


def running_max(df: DataFrame, order: list[str], value: Column, out: str) -> DataFrame:
    """df with ``out``: the maximum of value so far in the order; one carried row for each range partition."""
    return _carry(df, order, value, out, "max", False)


def rank_in_group(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """df with ``out``: the place of each row, from 1, among the rows of its group in the given order. Null group columns are values.

    Like row_number over a window of the group, but a group may span any number of range partitions: a row's place in its partition is
    raised by what earlier partitions hold of its group. Only the first group of a partition can have begun earlier, so the driver
    sums over two group values and two counts for each partition."""
    spark = df.sparkSession
    part, lo, hi, place, ahead = fresh(df, "part", "lo", "hi", "place", "ahead")
    rows = df.repartitionByRange(parts_of(spark), *group, *order).sortWithinPartitions(*group, *order)
    schema = T.StructType([*rows.schema.fields, T.StructField(place, T.LongType()), T.StructField(part, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        p, last, held = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            new, last = run_starts(b, group, last)
            at = np.arange(b.num_rows)
            began = np.maximum.accumulate(np.where(new, at, -1))
            own = np.where(began < 0, held + at + 1, at - began + 1)
            held = int(own[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own), pa.array(np.full(b.num_rows, p, np.int32))], names=[*b.schema.names, place, part])

    cut = staged(rows.mapInArrow(run, schema), "ranked")
    g = F.struct(*group)
    ends = staged(cut.groupBy(part).agg(F.min(g).alias(lo), F.max(F.struct(g.alias("g"), F.col(place).alias("n"))).alias(hi)), "ends")
    carried: list[tuple[int, int]] = []
    last, held = None, 0
    for r in sorted(ends.collect(), key=lambda r: r[part]):  # a row for each partition
        before = held if r[lo] == last else 0
        carried.append((r[part], before))
        last, held = r[hi]["g"], r[hi]["n"] + (before if r[lo] == r[hi]["g"] else 0)
    extra = spark.createDataFrame(carried, f"{part} int, {ahead} bigint")
    got = cut.join(F.broadcast(ends.select(part, lo)), part).join(F.broadcast(extra), part)
    return got.withColumn(out, F.col(place) + F.when(g.eqNullSafe(F.col(lo)), F.col(ahead)).otherwise(0)).drop(part, lo, ahead, place)
