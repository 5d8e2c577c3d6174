"""For each point the range that holds it, at any number of points and ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.scratch import staged


def range_lookup(points: DataFrame, ranges: DataFrame, group: str, key: str, low: str, high: str, range_id: str) -> DataFrame:
    """points with ``range_id``: of the range of the same group with low <= key <= high, null where there is none.

    Ranges of one group don't overlap; a range with a null bound or low > high holds nothing. Bounds and keys are binary. The columns
    of points are kept; one called like range_id is replaced.

    Points and range starts are sorted together by (group, key) over range partitions; inside a partition the range that started last
    is carried forward. Points ahead of a partition's first start take the last start of the partitions before: one row for
    each partition, whose number bounds that broadcast. Neither side is broadcast and no group is gathered."""
    spark = points.sparkSession
    points = points.drop(range_id)
    marks = ranges.where(F.col(low).isNotNull() & F.col(high).isNotNull()).select(F.col(group).alias("g"), F.col(low).alias("k"), F.lit(0).alias("kind"), F.col(high).alias("high"), F.col(range_id).cast("long").alias("rid"))
    rows = points.select(F.col(group).alias("g"), F.col(key).alias("k"), F.lit(1).alias("kind"), F.struct(*points.columns).alias("row"))
    both = marks.unionByName(rows, allowMissingColumns=True)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = both.repartitionByRange(n, "g", "k").sortWithinPartitions("g", "k", "kind")
    schema = T.StructType([*ordered.schema.fields, T.StructField("mg", T.StringType()), T.StructField("part", T.IntegerType())])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), dict.fromkeys(("g", "high", "rid"))
        for b in batches:
            if not b.num_rows:
                continue
            # of each row the last range start so far: place 0 is the one carried from earlier batches
            at = np.maximum.accumulate(np.where(b.column("kind").to_numpy() == 0, np.arange(1, b.num_rows + 1), 0))
            got = {c: pa.concat_arrays([pa.array([last[c]], b.column(c).type), b.column(c)]).take(pa.array(at)) for c in last}
            last = {c: x[-1].as_py() for c, x in got.items()}
            arrays = {c: b.column(c) for c in b.schema.names} | {"high": got["high"], "rid": got["rid"], "mg": got["g"], "part": pa.array(np.full(b.num_rows, part, np.int32))}
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    led = staged(ordered.mapInArrow(carry, schema), "ranges")
    lasts = led.where("kind = 0").groupBy("part").agg(F.max(F.struct("g", "k", "high", "rid")).alias("m"))
    # the last start seen before each partition: partitions come in order of (g, k), so it is a running maximum
    parts = spark.range(n).select(F.col("id").cast("int").alias("part")).join(lasts, "part", "left")
    before = parts.select("part", F.max("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("m"))
    got = led.where("kind = 1").join(F.broadcast(before), "part", "left")
    own = F.col("rid").isNotNull()
    inside = F.when(own, F.col("mg").eqNullSafe(F.col("g")) & (F.col("k") <= F.col("high"))).otherwise(F.col("m.g").eqNullSafe(F.col("g")) & (F.col("k") <= F.col("m.high")))
    return got.select("row.*", F.when(inside, F.coalesce("rid", "m.rid")).alias(range_id))
