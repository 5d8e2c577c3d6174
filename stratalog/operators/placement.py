"""Consistent-hash placement and Bloom filter sizing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.model import fresh
from stratalog.scratch import staged

VNODES = 256
#: Bits of a place on the ring, and the last place.
POSITION_BITS = 60
LAST = (1 << POSITION_BITS) - 1


def position(label: Column) -> Column:
    """A place on the ring: the first 15 hexadecimal digits of the label's md5, as a bigint."""
    return F.conv(F.substring(F.md5(label), 1, 15), 16, 10).cast("bigint")


def ring(nodes: DataFrame, vnodes: int = VNODES) -> DataFrame:
    """(position, node_id) of every virtual node ``node:i``. Where two share a position the smaller node_id has it."""
    v = nodes.select("node_id").distinct().select("node_id", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("i"))
    return v.groupBy(position(F.concat_ws(":", "node_id", F.col("i").cast("string"))).alias("position")).agg(F.min("node_id").alias("node_id"))


def _walks(r: DataFrame, n: int) -> DataFrame:
    """(low, high, walk): the stretches between neighbouring positions of the ring, both ends included, and the next n distinct nodes clockwise from each, fewer if
    there are fewer nodes. The stretch past the last position has the walk of the first.

    Going backwards, a position's walk is its own node and the walk of the position after it without that node. A ring is metadata of a cluster; its
    rows stream through one task in order, which holds one walk, twice around so that the first lap knows what lies past the end."""
    laps = r.select("position", "node_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("lap"))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk: list[str] = []
        above: tuple[int, list[str]] | None = None  # the position before, whose stretch ends above this one
        top = 0

        def made(rows: list[tuple[int, int, list[str]]]) -> pa.RecordBatch:
            low, high, walks = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(walks, pa.list_(pa.string()))], names=["low", "high", "walk"])

        for b in batches:
            out = []
            for p, node, lap in zip(*(b.column(c).to_pylist() for c in ("position", "node_id", "lap")), strict=True):
                walk = [node, *(x for x in walk if x != node)][:n]
                if lap:
                    if above is None:
                        top = p
                    else:
                        out.append((p + 1, *above))
                    above = p, walk
            yield made(out)
        if above is not None:
            yield made([(0, *above), (top + 1, LAST, above[1])])

    return laps.repartition(1).sortWithinPartitions("lap", F.desc("position")).mapInArrow(back, "low bigint, high bigint, walk array<string>")


def owner(keys: DataFrame, key: str, r: DataFrame, out: str = "owner") -> DataFrame:
    """keys with the node at the first position not below the key's, or at the smallest position past the end; null on an empty ring and for a null key."""
    (walk,) = fresh(keys, "walk")
    return replicas(keys, key, r, 1, walk).withColumn(out, F.element_at(walk, F.when(F.size(walk) > 0, 1))).drop(walk)


def replicas(keys: DataFrame, key: str, r: DataFrame, n: int, out: str = "replicas") -> DataFrame:
    """keys with the next n distinct nodes clockwise from the key's position, fewer if there are fewer nodes; none for a null key.

    The circle is cut into as many equal cells as the ring has positions, rounded up to a power of two, and each cell has the few stretches of the ring that
    meet it. A key meets its cell in an equi-join. Positions are hashes, so cells are even, and a ring of any size is joined like any table; Spark broadcasts it
    while it is small, and keys don't move."""
    walks = staged(_walks(r, n), "ring")
    bits = min(40, walks.count().bit_length())
    cell, held = fresh(keys, "cell", "held")
    of = lambda c: F.shiftright(c, POSITION_BITS - bits)
    met = walks.select(F.explode(F.sequence(of("low"), of("high"))).alias(cell), F.struct("high", "walk").alias("s"))
    cells = staged(met.groupBy(cell).agg(F.sort_array(F.collect_list("s")).alias(held)), "cells")
    at = position(F.col(key))
    placed = keys.withColumn(cell, of(at)).join(cells, cell, "left")
    found = F.filter(held, lambda s: s["high"] >= at)
    return placed.withColumn(out, F.coalesce(F.get(found, F.lit(0))["walk"], F.array().cast("array<string>"))).drop(cell, held)


def ring_stats(r: DataFrame) -> DataFrame:
    """One row: positions and distinct nodes."""
    return r.agg(F.count(F.lit(1)).alias("positions"), F.count_distinct("node_id").alias("nodes"))


def movement(keys: DataFrame, key: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: keys, and how many of them have another owner on the second ring."""
    o = owner(owner(keys, key, before, "was"), key, after, "now")
    return o.agg(F.count(F.lit(1)).alias("keys"), F.count_if(~F.col("was").eqNullSafe(F.col("now"))).alias("moved"))


def bloom_bits(n: Column, fpp: Column) -> Column:
    """Bits of a filter for n keys: ceil(-n ln p / (ln 2)^2), 64 at least, with p between 0.0001 and 0.5."""
    p = F.least(F.greatest(fpp, F.lit(0.0001)), F.lit(0.5))
    ln2 = F.ln(F.lit(2.0))
    return F.greatest(F.ceil(-n * F.ln(p) / (ln2 * ln2)), F.lit(64)).cast("bigint")


def bloom_hashes(bits: Column, n: Column) -> Column:
    """Hash functions: ceil(m / n * ln 2), between 1 and 30."""
    return F.least(F.greatest(F.ceil(bits / n * F.ln(F.lit(2.0))), F.lit(1)), F.lit(30)).cast("int")


def _digests(key_hex: Column) -> list[Column]:
    """Two 32-bit halves of a key's md5, from which all its positions follow."""
    d = F.md5(key_hex)
    return [F.conv(F.substring(d, a, 8), 16, 10).cast("bigint").alias(n) for a, n in ((1, "h1"), (9, "h2"))]


def _at(bits: Column, hashes: Column) -> Column:
    """The bit positions of a key by double hashing: (h1 + i * h2) mod bits."""
    return F.transform(F.sequence(F.lit(0), hashes - 1), lambda i: F.pmod(F.col("h1") + i * F.col("h2"), bits))


def _bit() -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))


def bloom_build(keys: DataFrame, segment: str, key_hex: str, fpp: float) -> DataFrame:
    """For each segment its filter as rows (segment, word, mask) of 64 bits, with bits and hashes in every row. Masks merge by ``bit_or``."""
    k = keys.select(F.col(segment).alias("segment"), F.col(key_hex).alias("k")).distinct()
    sizes = k.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).select("segment", bloom_bits(F.col("n"), F.lit(fpp)).alias("bits"), "n").select("segment", "bits", bloom_hashes(F.col("bits"), F.col("n")).alias("hashes"))
    at = k.select("segment", *_digests(F.col("k"))).join(sizes, "segment").select("segment", "bits", "hashes", F.explode(_at(F.col("bits"), F.col("hashes"))).alias("p"))
    return at.groupBy("segment", "bits", "hashes", F.expr("p div 64").alias("word")).agg(F.bit_or(_bit()).alias("mask"))


def bloom_probe(asked: DataFrame, segment: str, key_hex: str, bloom: DataFrame) -> DataFrame:
    """For each distinct (segment, key) asked for whether the segment may hold the key: segment, k, maybe. Pairs of a segment without a filter
    don't come out. A key's digests are taken once a pair; filters are met word by word in an equi-join, so none is held whole."""
    bloom = staged(bloom, "bloom")
    sizes = bloom.select("segment", "bits", "hashes").distinct()
    n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # each pair becomes many rows, so few small pairs must not share a task
    pairs = asked.select(F.col(segment).alias("segment"), F.col(key_hex).alias("k")).repartition(n, "segment", "k").distinct().select("segment", "k", *_digests(F.col("k")))
    at = pairs.join(sizes, "segment").select("segment", "k", F.explode(_at(F.col("bits"), F.col("hashes"))).alias("p"))
    hit = at.select("segment", "k", F.expr("p div 64").alias("word"), _bit().alias("bit")).join(bloom.select("segment", "word", "mask"), ["segment", "word"], "left")
    return hit.groupBy("segment", "k").agg(F.min(F.coalesce((F.col("mask").bitwiseAND(F.col("bit")) != 0), F.lit(False))).alias("maybe"))
