"""Differences between two copies of a keyed table, found by content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.operators.ordered import run_starts
from stratalog.scratch import staged

#: Odd multipliers of the rolling hash over the last rows' key hashes; one for each row of the window.
ROLL = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def _chunker(every: int):
    """Numbers the chunks of sorted rows and marks rows that aren't the first of their key in the partition. A chunk ends after the last row of a key at which the
    rolling hash over the hashes of that side's last three keys is divisible by ``every``; each partition starts a new chunk on either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tail = {0: np.zeros(2, np.uint64), 1: np.zeros(2, np.uint64)}
        # the chunk of the last key, and that of the next one
        chunk, follows, begun = {0: 0, 1: 0}, {0: 0, 1: 0}, {0: False, 1: False}
        for b in batches:
            side = b.column("side").to_numpy()
            h = b.column("kh").to_numpy().view(np.uint64)
            out, again = np.empty(b.num_rows, np.int64), np.zeros(b.num_rows, bool)
            for s in (0, 1):
                at = np.flatnonzero(side == s)
                if not len(at):
                    continue
                own = h[at]
                first = np.r_[not begun[s] or own[0] != tail[s][-1], own[1:] != own[:-1]]
                x = np.concatenate([tail[s], own[first]])
                rolled = x[2:] * ROLL[0] + x[1:-1] * ROLL[1] + x[:-2] * ROLL[2]
                ends = ((rolled >> np.uint64(20)) % np.uint64(every)) == 0
                of_key = np.r_[chunk[s], follows[s] + np.cumsum(ends) - ends]
                out[at], again[at] = of_key[np.cumsum(first)], ~first
                if len(ends):
                    chunk[s], follows[s] = int(of_key[-1]), int(of_key[-1] + ends[-1])
                tail[s], begun[s] = x[-2:], True
            ids = pa.array((np.int64(part) << np.int64(40)) + out)
            yield pa.RecordBatch.from_arrays([*b.columns, ids, pa.array(again)], names=[*b.schema.names, "chunk", "again"])

    return run


def copy_diff(local: DataFrame, remote: DataFrame, keys: list[str], fields: list[str], every: int = 64) -> DataFrame:
    """One row for each difference: keys and ``field``, which is ``only_local``, ``only_remote`` or the name of a field that differs.

    Rows are matched on keys, null keys with null keys. Null equals null only. A copy may hold a row several times; identical rows
    count once. If one key has different rows in a copy, each pair of them is compared and a difference comes out once: so a field differs if the
    rows of both copies together have more than one value of it. Empty copies make all rows of the other one-sided. Columns besides keys and
    fields are left out. The result is distinct.

    Both copies go through one range partitioning of (keys, hash of the fields), so their partitions begin at the same rows and a key with very many
    different rows is spread. Either side is cut into chunks of about ``every`` keys where the content says so: after an insertion or deletion the cuts
    fall back into step. A chunk's fingerprint is its row count with two independent 64-bit sums of row hashes. Chunks whose fingerprint the other side
    has too are dropped by an anti-join, unless they hold a key with several rows, or may share one with the next partition. Rows of the rest are
    compared field by field in one aggregation by key, combined on the map side, without forming pairs."""
    k, f = [f"k{i}" for i in range(len(keys))], [f"f{i}" for i in range(len(fields))]

    def side(df: DataFrame, n: int) -> DataFrame:
        return df.select(*(F.col(c).alias(a) for c, a in zip(keys, k, strict=True)), *(F.col(c).alias(a) for c, a in zip(fields, f, strict=True)), F.lit(n).alias("side"))

    spark = local.sparkSession
    both = side(local, 0).unionByName(side(remote, 1))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # nulls don't change Spark's hashes, so which columns are null goes in as well
    nulls = F.concat_ws("", *(F.col(c).isNull().cast("int") for c in [*k, *f]))
    rows = both.select("*", F.xxhash64(*k, F.concat_ws("", *(F.col(c).isNull().cast("int") for c in k))).alias("kh"), F.xxhash64(*f, nulls).alias("fh"))
    ordered = rows.repartitionByRange(n, *k, "fh").sortWithinPartitions(*k, "fh", "side", *f)
    # identical rows are neighbours here and must not count as several
    schema = T.StructType([*ordered.schema.fields, T.StructField("chunk", T.LongType()), T.StructField("again", T.BooleanType())])
    distinct, chunked = _distinct_runs([*k, "side", *f]), _chunker(every)
    cut = staged(ordered.mapInArrow(lambda batches: chunked(distinct(batches)), schema), "chunks")

    dec = "decimal(38,0)"
    # the two hashes of a row, of its keys and of its fields, stand for it
    prints = cut.groupBy("side", "chunk").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64("kh", "fh").cast(dec)).alias("s1"), F.sum(F.xxhash64(F.lit(7), "fh", "kh").cast(dec)).alias("s2"), F.max("again").alias("several"))
    prints = staged(prints, "prints")
    # a key at either end of a partition may have more rows in the next one: two chunks a partition and side
    ends = prints.groupBy("side", F.shiftright("chunk", 40).alias("p")).agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi")).select("side", F.explode(F.array("lo", "hi")).alias("chunk"))
    prints = staged(prints.join(F.broadcast(ends.distinct().withColumn("end", F.lit(True))), ["side", "chunk"], "left").withColumn("kept", F.col("several") | F.col("end").isNotNull()), "kept")
    a, b = prints.where("side = 0"), prints.where("side = 1")
    same = ["rows", "s1", "s2"]
    # what one side keeps the other one must keep too
    odd = [x.where("kept").unionByName(x.where("not kept").join(y.where("not kept").select(*same), same, "left_anti").select(*x.columns)) for x, y in ((a, b), (b, a))]
    # written first, so that Spark knows its size: few chunks are broadcast, and the rows not moved
    odd = staged(odd[0].unionByName(odd[1]).select("side", "chunk"), "odd")
    left = cut.select("side", "chunk", *k, *f).join(odd, ["side", "chunk"], "left_semi")

    seen = [x for i, c in enumerate(f) for x in (F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"), F.bool_or(F.col(c).isNull()).alias(f"null{i}"))]
    per = left.groupBy(*k).agg(F.bool_or(F.col("side") == 0).alias("l"), F.bool_or(F.col("side") == 1).alias("r"), *seen)
    differs = [F.when((F.col(f"lo{i}") != F.col(f"hi{i}")) | (F.col(f"null{i}") & F.col(f"lo{i}").isNotNull()), F.lit(name)) for i, name in enumerate(fields)]
    found = F.when(~F.col("r"), F.array(F.lit("only_local"))).when(~F.col("l"), F.array(F.lit("only_remote"))).otherwise(F.array_compact(F.array(*differs)))
    return per.select(*(F.col(c).alias(name) for c, name in zip(k, keys, strict=True)), F.explode(found).alias("field"))


def _distinct_runs(columns: list[str]):
    """Drops a row that equals the one before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            if b.num_rows:
                new, last = run_starts(b, columns, last)
                yield b.filter(pa.array(new))

    return run
