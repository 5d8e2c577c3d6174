"""Distinct counts from log-log registers that merge by maximum."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.model import fresh

#: Registers are 2 ** PRECISION; the relative standard error is 1.04 / sqrt(registers), 0.81 % here.
PRECISION = 14


def standard_error(precision: int = PRECISION) -> float:
    return 1.04 / math.sqrt(1 << precision)


def _rank(w: Column, bits: int) -> Column:
    """1 + leading zeros of the bits-wide number w; bits + 1 for zero. The leading one is smeared down and the ones are counted."""
    for s in (1, 2, 4, 8, 16, 32):
        w = w.bitwiseOR(F.shiftrightunsigned(w, s))
    return (F.lit(bits + 1) - F.bit_count(w)).cast("tinyint")


def registers(df: DataFrame, groups: list[str], items: list[str], precision: int = PRECISION) -> DataFrame:
    """Partial results: groups, ``reg``, ``rank`` (the largest over the register's items) and ``n`` (rows counted). Only registers that were hit exist.

    Rows whose items are all null count as rows of ``n`` with no item, in register -1. Null groups are groups. Map-side aggregation leaves at most
    2 ** precision + 1 rows a group and task, however many rows one item or group has."""
    h = F.xxhash64(*items)
    some = F.coalesce(*(F.when(F.col(c).isNotNull(), True) for c in items), F.lit(False))
    reg = F.when(some, h.bitwiseAND((1 << precision) - 1)).otherwise(-1).cast("int")
    rank = F.when(some, _rank(F.shiftrightunsigned(h, precision), 64 - precision)).otherwise(0).cast("tinyint")
    return df.select(*groups, reg.alias("reg"), rank.alias("rank")).groupBy(*groups, "reg").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"))


def merge(parts: DataFrame, groups: list[str]) -> DataFrame:
    """Partial results of several runs, or of finer groups, as those of groups: register by register the largest rank."""
    return parts.groupBy(*groups, "reg").agg(F.max("rank").alias("rank"), F.sum("n").alias("n"))


def estimates(parts: DataFrame, groups: list[str], precision: int = PRECISION) -> DataFrame:
    """groups, ``rows``, ``estimate`` (double), ``std_error`` (relative). Uses the estimator m^2 / (2 ln 2 (m sigma(c0 / m) + sum 2^-rank)) with
    sigma(x) = x + sum of x^(2^k) 2^(k-1), which has no bias at small or large counts and needs no table."""
    m = float(1 << precision)
    got = parts.groupBy(*groups).agg(F.sum("n").alias("rows"), F.count_if(F.col("reg") >= 0).alias("hit"), F.sum(F.when(F.col("reg") >= 0, F.pow(F.lit(2.0), -F.col("rank")))).alias("s"))
    start = F.struct((F.lit(1.0) - F.col("hit") / m).alias("x"), F.lit(1.0).alias("y"), (F.lit(1.0) - F.col("hit") / m).alias("z"))
    step = lambda a, _: F.struct((a["x"] * a["x"]).alias("x"), (a["y"] * 2).alias("y"), (a["z"] + a["x"] * a["x"] * a["y"]).alias("z"))
    sigma = F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, step)["z"]
    value = F.when(F.col("hit") == 0, 0.0).otherwise(m * m / (2 * math.log(2)) / (m * sigma + F.col("s")))
    return got.select(*groups, "rows", value.alias("estimate"), F.lit(standard_error(precision)).alias("std_error"))


def cube_estimates(parts: DataFrame, groups: list[str], precision: int = PRECISION) -> DataFrame:
    """Estimates of every combination of groups from the same partial results: ``level`` counts in binary, first group highest, which
    groups are summed over (0: none); summed groups are null. Registers stay apart in every grouping set, and are merged on the map side."""
    reg, n, last = fresh(parts, "reg_of", "rank_n", "set_id")
    rows = parts.withColumnRenamed("reg", reg)
    sets = [[*(F.col(g) for i, g in enumerate(groups) if not s >> (len(groups) - 1 - i) & 1), F.col(reg)] for s in range(1 << len(groups))]
    per = rows.groupingSets(sets, *groups, reg).agg(F.max("rank").alias(n), F.sum("n").alias("n"), F.grouping_id().alias(last))
    per = per.select(*groups, F.shiftright(last, 1).cast("int").alias("level"), F.col(reg).alias("reg"), F.col(n).alias("rank"), "n")
    return estimates(per, [*groups, "level"], precision)
