"""Scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.model import fresh


def align_up(n: Column, block: int = 4096) -> Column:
    """n rounded up to a multiple of block."""
    return F.expr("0").cast("bigint") + (n + (block - 1)) - F.pmod(n + (block - 1), F.lit(block))


def fmt_bytes(n: Column) -> Column:
    """n in GB, MB or KB (powers of 1,000) with one decimal, or in B."""
    one = lambda d: F.format_string("%.1f", F.round(n / F.lit(d), 1))
    return F.when(n >= 1e9, F.concat(one(1e9), F.lit(" GB"))).when(n >= 1e6, F.concat(one(1e6), F.lit(" MB"))).when(n >= 1e3, F.concat(one(1e3), F.lit(" KB"))).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def password_hash(salt: Column, password: Column, context: Column) -> Column:
    """Hexadecimal sha-256 of salt, password and a fixed context put together."""
    return F.sha2(F.concat(salt.cast("binary"), password.cast("binary"), context.cast("binary")), 256)


def verify_password(salt: Column, password: Column, context: Column, stored: Column) -> Column:
    return password_hash(salt, password, context) == F.lower(stored)


def parse_dsn(dsn: Column, scheme: str, default_port: int = 9090) -> Column:
    """A struct (user, password, host, port, error) of ``scheme://[user[:password]@]host[:port]``. The last ``@`` ends the credentials, their
    first ``:`` the user; the last ``:`` begins the port. On an error only error is set."""
    known = dsn.startswith(f"{scheme}://")
    rest = F.substring(dsn, len(scheme) + 4, 1 << 30)
    cred = F.regexp_extract(rest, "^(.*)@", 1)
    has_cred = rest.contains("@")
    place = F.regexp_extract(rest, "([^@]*)$", 1)
    host = F.regexp_replace(place, ":[^:]*$", "")
    port_text = F.when(place.contains(":"), F.regexp_extract(place, ":([^:]*)$", 1))
    port = F.when(port_text.isNull(), F.lit(default_port)).when(port_text.rlike("^[0-9]{1,5}$") & (port_text.cast("int") < 65536), port_text.cast("int"))
    error = F.when(dsn.isNull() | ~known, "unknown scheme").when(port.isNull(), "bad port").when(host == "", "no host")
    user = F.when(has_cred, F.substring_index(cred, ":", 1))
    password = F.when(has_cred & cred.contains(":"), F.regexp_replace(cred, "^[^:]*:", ""))
    ok = error.isNull()
    return F.struct(F.when(ok, user).alias("user"), F.when(ok, password).alias("password"), F.when(ok, host).alias("host"), F.when(ok, port).alias("port"), error.alias("error"))


def storage_mode(devices: DataFrame, by: str) -> DataFrame:
    """For each host (column by) the mode of its devices (kind: nvme, ssd or hdd): one kind alone, or tiered for several; unknown for none."""
    has = lambda k: F.coalesce(F.bool_or(F.lower("kind") == k), F.lit(False))
    d = devices.groupBy(by).agg(has("nvme").alias("n"), has("ssd").alias("s"), has("hdd").alias("h"))
    kinds = sum(F.col(c).cast("int") for c in ("n", "s", "h"))
    return d.select(by, F.when(kinds > 1, "tiered").when(F.col("n"), "nvme_only").when(F.col("s"), "ssd_only").when(F.col("h"), "hdd_only").otherwise("unknown").alias("mode"))


def tier_route(level: Column, mode: Column, usage: Column, threshold: float = 0.8) -> Column:
    """A struct (tier, cold): levels 0 and 1 are hot, up to 3 warm, others cold, on a tiered host; all hot on any other. cold tells whether frozen
    segments leave the host, at a usage of threshold or more."""
    tier = F.when(mode != "tiered", "hot").when(level <= 1, "hot").when(level <= 3, "warm").otherwise("cold")
    return F.struct(tier.alias("tier"), (usage >= threshold).alias("cold"))


def tier_settings(mode: Column) -> Column:
    """A struct (parallelism, compaction_threads) of a host's storage mode: moderate on a tiered one, sequential on hard disks alone, high on all others."""
    parallelism = F.when(mode == "tiered", 4).when(mode == "hdd_only", 1).otherwise(8)
    threads = F.when(mode == "tiered", 2).when(mode == "hdd_only", 1).otherwise(4)
    return F.struct(parallelism.alias("parallelism"), threads.alias("compaction_threads"))


def mount_match(paths: DataFrame, path: str, mounts: DataFrame, mount: str, device: str) -> DataFrame:
    """paths with the device of the longest mount that prefixes the path, case ignored; null without one. Where a mount comes twice the greater device counts.

    Each path goes in the lengths of the mounts that there are (a host has few) and meets equal mounts in a join on the text: no pairs are formed. Rows of
    paths are told apart by their path, so repeated ones come out as often as they went in."""
    m = mounts.where(F.col(mount).isNotNull()).groupBy(F.lower(F.col(mount)).alias("m")).agg(F.max(device).alias("d"))
    lengths = [r[0] for r in m.select(F.char_length("m").alias("n")).distinct().limit(4097).collect()]
    if len(lengths) > 4096:
        raise ValueError("mounts of more than 4,096 different lengths")
    p, d = fresh(paths, "p", "d")
    asked = paths.select(F.col(path).alias("p")).where("p is not null").distinct()
    heads = asked.select("p", F.explode(F.array(*(F.when(F.char_length("p") >= n, F.substring(F.lower("p"), 1, n)) for n in sorted(lengths)))).alias("m")) if lengths else asked.select("p", F.lit("").alias("m")).limit(0)
    best = heads.join(m, "m").groupBy("p").agg(F.max_by("d", F.char_length("m")).alias(d)).withColumnRenamed("p", p)
    return paths.join(best, F.col(path) == F.col(p), "left").withColumn(device, F.col(d)).drop(p, d)
