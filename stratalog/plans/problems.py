"""Queries of the general data problems: change feed, history, differences of copies, skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.model import has_key, key_hex, normal_namespace
from stratalog.operators.balance import balanced_aggregate, balanced_join, plan
from stratalog.operators.change_feed import DeleteVectorTable
from stratalog.operators.copy_diff import copy_diff
from stratalog.operators.history import history, snapshot_history
from stratalog.operators.range_lookup import range_lookup
from stratalog.plans.registry import Registry
from stratalog.scratch import new_path
from stratalog.sources.tables import table

R = Registry()

KEYED = "select log_seq, case when coalesce(namespace, '') = '' then 'default' else namespace end as namespace, key, value, ts from entry_log where key is not null and octet_length(key) > 0"


def entries(spark: SparkSession, d: str) -> DataFrame:
    """entry_log without rejected rows, with the namespace that counts."""
    return table(spark, d, "entry_log").where(has_key("key")).withColumn("namespace", normal_namespace("namespace"))


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


CURRENT = f"""select namespace, lower(hex(key)) as key_hex, max(ts) as ts from ({KEYED}) e
group by namespace, key having arg_max(value is not null, ts)"""


def _fed(spark: SparkSession, d: str) -> DeleteVectorTable:
    """The feed in three batches in order of arrival, so that later batches supersede rows of earlier files."""
    log = entries(spark, d)
    last = log.agg(F.max("log_seq")).first()[0] or 0
    t = DeleteVectorTable(spark, new_path(spark, "state"), ["namespace", "key"], "ts", F.col("value").isNull())
    seq, cuts = F.coalesce("log_seq", F.lit(0)), (last // 3, 2 * last // 3)
    for part in (seq <= cuts[0], (seq > cuts[0]) & (seq <= cuts[1]), seq > cuts[1]):
        t.apply(log.where(part).select("namespace", "key", "value", "ts"))
    return t


@R.query("p1_found", CURRENT)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _fed(spark, d).read("namespace", "key", "ts").select("namespace", key_hex().alias("key_hex"), "ts")


@R.query("p1_batches", CURRENT.replace("max(ts) as ts", "lower(hex(arg_max(value, ts))) as value_hex, max(ts) as ts"))
def p1_batches(spark: SparkSession, d: str) -> DataFrame:
    """p1_found with the values."""
    return _fed(spark, d).read().select("namespace", key_hex().alias("key_hex"), key_hex("value").alias("value_hex"), "ts")


@R.query(
    "p2_found",
    """with o as (
  select node_id, lower(trim(state, ' \t\r\n')) as state, incarnation, epoch_us(last_heartbeat) as hb, snapshot_at, snapshot_id from node_snapshots
  where state is not null and trim(state, ' \t\r\n') <> '' and last_heartbeat is not null and node_id is not null),
b as (select * from o qualify row_number() over (partition by node_id, hb order by incarnation desc nulls last, snapshot_at desc nulls last, snapshot_id desc) = 1),
c as (select *, lag(hb) over w is null or state is distinct from lag(state) over w or incarnation is distinct from lag(incarnation) over w as starts
  from b window w as (partition by node_id order by hb))
select node_id, state, incarnation, hb as valid_from_us, coalesce(lead(hb) over (partition by node_id order by hb), -1) as valid_to_us from c where starts""",
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "node_snapshots").withColumn("state", F.lower(F.trim(F.col("state"), F.lit(" \t\r\n")))).where("state <> ''")
    s = s.withColumn("hb", F.unix_micros(F.col("last_heartbeat").cast("timestamp")))
    h = history(s, "node_id", "hb", ["state", "incarnation"], [F.col("incarnation"), F.col("snapshot_at"), F.col("snapshot_id")])
    return h.select("node_id", "state", "incarnation", F.col("valid_from").alias("valid_from_us"), F.coalesce("valid_to", F.lit(-1)).alias("valid_to_us"))


@R.query(
    "p2_snapshots",
    """with o as (select snapshot_at::date as day, node_id, max({'state': lower(trim(state, ' \t\r\n')), 'incarnation': incarnation}) as a from node_snapshots where snapshot_at is not null and node_id is not null
  and trim(state, ' \t\r\n') <> '' and incarnation is not null group by 1, 2),
t as (select day, row_number() over (order by day) as n from (select distinct day from o)), s as (select n, node_id, a from o join t using (day)),
j as (select coalesce(c.n, p.n + 1) as n, coalesce(c.node_id, p.node_id) as node_id, c.a as now, p.a as was from s c full join s p on c.node_id = p.node_id and c.n = p.n + 1 where c.a is distinct from p.a),
e as (select j.*, day, lead(day) over (partition by node_id order by j.n) as until from j join t using (n))
select node_id, now.state as state, now.incarnation as incarnation, day::varchar as valid_from, until::varchar as valid_to from e where now is not null""",
)
def p2_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The history as daily snapshots tell it: a node that nobody saw on a day is deleted then."""
    s = table(spark, d, "node_snapshots").withColumn("state", F.lower(F.trim(F.col("state"), F.lit(" \t\r\n")))).where("state <> '' and incarnation is not null")
    h = snapshot_history(s.withColumn("day", F.to_date("snapshot_at")), "day", "node_id", ["state", "incarnation"])
    return h.withColumns({c: F.col(c).cast("string") for c in ("valid_from", "valid_to")})


@R.query(
    "p3_found",
    """with n as (select 0 as side, * from replica_local union all select 1, * from replica_remote),
x as (select distinct side, case when coalesce(namespace, '') = '' then 'default' else namespace end as namespace, key, value, ts, lower(checksum) as checksum from n),
j as (select coalesce(l.namespace, r.namespace) as namespace, coalesce(l.key, r.key) as key, l.key is null as no_l, r.key is null as no_r,
  l.value is distinct from r.value as dv, l.ts is distinct from r.ts as dt, l.checksum is distinct from r.checksum as dc
  from (select * from x where side = 0) l full join (select * from x where side = 1) r on l.namespace = r.namespace and l.key = r.key),
f as (select namespace, key, 'only_local' as field from j where no_r union select namespace, key, 'only_remote' from j where no_l
  union select namespace, key, 'value' from j where not no_l and not no_r and dv union select namespace, key, 'ts' from j where not no_l and not no_r and dt
  union select namespace, key, 'checksum' from j where not no_l and not no_r and dc)
select g.range_id, f.namespace, lower(hex(f.key)) as key_hex, f.field from f
left join diff_ranges g on f.namespace = (case when coalesce(g.namespace, '') = '' then 'default' else g.namespace end) and f.key between g.min_key and g.max_key""",
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    def copy(name: str) -> DataFrame:
        return table(spark, d, name).select(normal_namespace("namespace").alias("namespace"), "key", "value", "ts", F.lower("checksum").alias("checksum"))

    # keys tell more rows apart than namespaces, so they sort first
    found = copy_diff(copy("replica_local"), copy("replica_remote"), ["key", "namespace"], ["value", "ts", "checksum"])
    ranges = table(spark, d, "diff_ranges").withColumn("namespace", normal_namespace("namespace"))
    return range_lookup(found, ranges, "namespace", "key", "min_key", "max_key", "range_id").select("range_id", "namespace", key_hex().alias("key_hex"), "field")


def _per_key(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """Entries and newest ts of each key, and the number of all entries."""
    log, tasks = entries(spark, d).select("namespace", "key", "ts", "log_seq"), shuffle_tasks(spark)
    p = plan(log, ["namespace", "key"], tasks)
    partial, merge = [F.count(F.lit(1)).alias("n"), F.max("ts").alias("newest")], [F.sum("n").alias("n"), F.max("newest").alias("newest")]
    return balanced_aggregate(log, ["namespace", "key"], ["log_seq"], tasks, partial, merge, p), p.total


@R.query("p6_found", f"with e as ({KEYED}) select namespace, lower(hex(key)) as key_hex from e group by namespace, key having count(*) >= 0.01 * (select count(*) from e)")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    per_key, total = _per_key(spark, d)
    return per_key.where(F.col("n") * 100 >= total).select("namespace", key_hex().alias("key_hex"))


@R.query("p6_per_key", f"select namespace, lower(hex(key)) as key_hex, count(*) as n, max(ts) as newest from ({KEYED}) e group by namespace, key")
def p6_per_key(spark: SparkSession, d: str) -> DataFrame:
    return _per_key(spark, d)[0].select("namespace", key_hex().alias("key_hex"), "n", "newest")


@R.query(
    "p6_join",
    f"""with e as ({KEYED}), p as (select case when coalesce(namespace, '') = '' then 'default' else namespace end as namespace, key, count(*) as probes
  from key_probes where key is not null and octet_length(key) > 0 group by 1, 2)
select log_seq, namespace, lower(hex(key)) as key_hex, probes from e join p using (namespace, key)""",
)
def p6_join(spark: SparkSession, d: str) -> DataFrame:
    """Every entry whose key was asked for, with the number of probes of its key."""
    probes = table(spark, d, "key_probes").where(has_key("key")).groupBy(normal_namespace("namespace").alias("namespace"), "key").agg(F.count(F.lit(1)).alias("probes"))
    log = entries(spark, d).select("log_seq", "namespace", "key")
    return balanced_join(log, probes, ["namespace", "key"], ["log_seq"], shuffle_tasks(spark)).select("log_seq", "namespace", key_hex().alias("key_hex"), "probes")
