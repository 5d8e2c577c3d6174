"""Queries of the store's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import codecs, scalars
from stratalog.model import StoreConfig, has_key, key_hex, normal_namespace
from stratalog.operators import catalog, compaction, membership, placement, reads, repair, segments, wal, writes
from stratalog.operators.ordered import global_row_number, running_sum
from stratalog.operators.resolve import latest, live, merge_runs, versions
from stratalog.plans import fixtures as fx
from stratalog.plans.problems import KEYED, entries
from stratalog.plans.registry import Registry
from stratalog.scratch import new_path
from stratalog.sources.tables import table

R = Registry()
query = R.query

HEX = "lower(hex(key)) as key_hex, lower(hex(value)) as value_hex"


def hexed(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*[c for c in ("namespace",) if c in df.columns], key_hex().alias("key_hex"), key_hex("value").alias("value_hex"), *more)


# resolution


@query("latest_per_key", f"select namespace, {HEX}, ts, value is null as deleted from {fx.newest(fx.EVENTS)}")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return hexed(latest(fx.events_log(spark, d)).withColumn("deleted", F.col("value").isNull()), "ts", "deleted")


@query("latest_entry_log", f"select namespace, lower(hex(key)) as key_hex, max(ts) as ts, arg_max(value is null, ts) as deleted, lower(hex(arg_max(coalesce(value, ''::blob), ts))) as value_hex from ({KEYED}) e group by namespace, key")
def latest_entry_log(spark: SparkSession, d: str) -> DataFrame:
    """The same over the write log with late and repeated entries."""
    e = latest(entries(spark, d))
    return e.select("namespace", key_hex().alias("key_hex"), "ts", F.col("value").isNull().alias("deleted"), F.coalesce(key_hex("value"), F.lit("")).alias("value_hex"))


@query("version_history", f"select namespace, {HEX}, ts, row_number() over (partition by namespace, key order by ts desc) as version from {fx.EVENTS}")
def version_history(spark: SparkSession, d: str) -> DataFrame:
    return hexed(versions(fx.events_log(spark, d)), "ts", "version")


@query("merge_runs", f"select namespace, {HEX}, ts from {fx.newest(f'(select * from {fx.EVENTS} union all select * from {fx.ORDERS})')}")
def merge_runs_(spark: SparkSession, d: str) -> DataFrame:
    log = fx.events_log(spark, d)
    return hexed(merge_runs(log.where("ts % 2 = 0"), log.where("ts % 2 = 1"), fx.orders_log(spark, d)), "ts")


@query("l0_best", f"select namespace, {HEX}, ts from {fx.newest(f'(select * from {fx.EIGHTHS} where segment >= 4)')} where value is not null")
def l0_best(spark: SparkSession, d: str) -> DataFrame:
    """The best of four overlapping runs, the newer half of the table at every size."""
    return hexed(live(fx.eighths(spark, d).where("segment >= 4")), "ts")


# reads


@query("point_get", f"select namespace, {HEX}, ts from {fx.newest(fx.EVENTS)} where namespace = 'click' and key = 'user_000011'::blob and value is not null")
def point_get(spark: SparkSession, d: str) -> DataFrame:
    return hexed(reads.get(fx.events_log(spark, d), "user_000011", "click"), "ts")


REQUESTS = [(0, "click", "user_000011"), (1, "view", "user_000012"), (2, "click", "user_000011"), (3, "click", "nobody"), (4, "click", ""), (5, "", "user_000011"), (6, "error", "user_000003"), (7, "purchase", "user_000005")]


@query(
    "batch_get",
    f"""with r as (select ordinal, case when ns = '' then 'default' else ns end as namespace, k::blob as key from (values {", ".join(map(str, REQUESTS))}) v(ordinal, ns, k))
select ordinal, namespace, lower(hex(r.key)) as key_hex, e.value is not null as found, lower(hex(e.value)) as value_hex from r left join (select * from {fx.newest(fx.EVENTS)} where value is not null) e using (namespace, key)""",
)
def batch_get(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame(REQUESTS, "ordinal int, namespace string, key string").withColumn("key", F.encode("key", "UTF-8"))
    return reads.batch_get(fx.events_log(spark, d), asked).select("ordinal", "namespace", key_hex().alias("key_hex"), "found", key_hex("value").alias("value_hex"))


def _scan(name: str, sql_log: str, where: str, log, limit: int = 0, order: str = "key", **kw) -> None:
    tail = f" order by {order} limit {limit}" if limit else ""
    sql = f"select {HEX}, ts from (select * from {fx.newest(sql_log)} where value is not null and {where}{tail})"
    query(name, sql)(lambda spark, d: hexed(reads.scan(log(spark, d), limit=limit, **kw), "ts"))


_scan("scan_full", fx.EVENTS, "namespace = 'click'", fx.events_log, namespace="click")
_scan("scan_from", fx.ORDERS, "namespace = 'F' and key >= '000000000500'::blob", fx.orders_log, namespace="F", start="000000000500")
_scan("scan_until", fx.ORDERS, "namespace = 'F' and key < '000000000500'::blob", fx.orders_log, namespace="F", end="000000000500")
_scan("scan_bounded", fx.ORDERS, "namespace = 'O' and key >= '000000000100'::blob and key < '000000001200'::blob", fx.orders_log, namespace="O", start="000000000100", end="000000001200")
_scan("scan_inclusive", fx.ORDERS, "namespace = 'O' and key >= '000000000100'::blob and key <= '000000001200'::blob", fx.orders_log, namespace="O", start="000000000100", end="000000001200", inclusive=True)
_scan("scan_limit", fx.EVENTS, "namespace = 'view'", fx.events_log, 25, namespace="view")
_scan("scan_limit_large", fx.ORDERS, "namespace = 'O'", fx.orders_log, 5000, namespace="O")
_scan("scan_reverse", fx.EVENTS, "namespace = 'view'", fx.events_log, 25, "key desc", namespace="view", reverse=True)
_scan("scan_excludes_tombstones", fx.EVENTS, "namespace = 'signup' and key >= 'user_000001'::blob and key < 'user_000100'::blob", fx.events_log, namespace="signup", start="user_000001", end="user_000100")


@query("namespace_isolation", f"select namespace, count(*) as live_keys from {fx.newest(fx.EVENTS)} where value is not null group by namespace")
def namespace_isolation(spark: SparkSession, d: str) -> DataFrame:
    """Live keys of each namespace; the same keys stand in all five."""
    return live(fx.events_log(spark, d)).groupBy("namespace").agg(F.count(F.lit(1)).alias("live_keys"))


@query("namespace_view", f"select {HEX}, ts from (select * from {fx.newest(fx.EVENTS)} where value is not null and namespace = 'purchase' order by key limit 40)")
def namespace_view(spark: SparkSession, d: str) -> DataFrame:
    return hexed(reads.NamespaceView(fx.events_log(spark, d), "purchase").scan(limit=40), "ts")


# writes

_REQ = "select log_seq // 1000 as batch, namespace, key, value from entry_log"
_ERR = "case when key is null or octet_length(key) = 0 then 'key must not be empty' when octet_length(key) > 14 then 'key exceeds 14 bytes' when octet_length(value) > 22 then 'value exceeds 22 bytes' when strlen(case when coalesce(namespace, '') = '' then 'default' else namespace end) > 7 then 'namespace exceeds 7 bytes' end"
#: Limits small enough that entries of the log break each of them.
SMALL = StoreConfig(max_key_bytes=14, max_value_bytes=22, max_namespace_bytes=7)


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entry_log").select(F.expr("log_seq div 1000").alias("batch"), "namespace", "key", "value", "log_seq")


@query("put_validate", f"select coalesce(error, 'ok') as result, count(*) as n from (select {_ERR} as error from ({_REQ})) group by 1")
def put_validate(spark: SparkSession, d: str) -> DataFrame:
    return _requests(spark, d).groupBy(F.coalesce(writes.put_error(SMALL), F.lit("ok")).alias("result")).agg(F.count(F.lit(1)).alias("n"))


def _report_sql(err: str) -> str:
    return f"select batch, count(*) as requests, count(*) filter (error is null) as ok, count(*) filter (error is not null) as failed, coalesce(list_sort(list(distinct error) filter (error is not null)), []) as errors from (select batch, {err} as error from ({_REQ})) group by batch"


@query("batch_put_report", _report_sql(_ERR))
def batch_put_report(spark: SparkSession, d: str) -> DataFrame:
    return writes.batch_report(_requests(spark, d), "batch", writes.put_error(SMALL), SMALL)


@query("batch_delete_report", _report_sql(_ERR.replace("when octet_length(value) > 22 then 'value exceeds 22 bytes' ", "")))
def batch_delete_report(spark: SparkSession, d: str) -> DataFrame:
    return writes.batch_report(_requests(spark, d), "batch", writes.delete_error(SMALL), SMALL)


@query("delete_resolve", f"select namespace, {HEX}, ts from {fx.newest(f'(select * from {fx.ORDERS} union all select namespace, key, null, ts + 1000000 from {fx.ORDERS} where ts % 3 = 0)')} where value is not null")
def delete_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Blind deletes of a third of the keys, appended as tombstones."""
    log = fx.orders_log(spark, d)
    gone = log.where("ts % 3 = 0").select("namespace", "key", F.lit(None).cast("binary").alias("value"), (F.col("ts") + 1000000).alias("ts"))
    return hexed(live(log.unionByName(gone)), "ts")


@query(
    "assign_ts",
    """with p as (select event_id, (epoch_us(ts) // 1000000000) as wall, row_number() over (order by event_id) as n from events)
select event_id, n + greatest(max(wall - n + 1) over (order by event_id), 0) as ts from p""",
)
def assign_ts(spark: SparkSession, d: str) -> DataFrame:
    """A clock of 1,000 s resolution, so that the counter runs ahead of it."""
    e = table(spark, d, "events").select("event_id", F.expr("unix_micros(cast(ts as timestamp)) div 1000000000").alias("wall"))
    return writes.assign_ts(e, ["event_id"], "wall").select("event_id", "ts")


@query("replay_idempotent", f"select namespace, {HEX}, ts from {fx.newest(fx.EVENTS)} where value is not null")
def replay_idempotent(spark: SparkSession, d: str) -> DataFrame:
    """The log replayed twice over resolves as once."""
    log = fx.events_log(spark, d)
    return hexed(live(log.unionByName(log).unionByName(log.where("ts % 5 = 0"))), "ts")


#: 8 bytes of header a record.
_FRAMED = f"(select *, cast(sum({{size}} + 8) over (order by ts rows unbounded preceding) - {{size}} - 8 as bigint) // 65536 as file from {fx.EVENTS})"


@query(
    "log_replay",
    f"""with f as {_FRAMED.replace("{size}", "(19 + octet_length(key) + coalesce(octet_length(value), 0) + strlen(namespace) - 2)")}, l as (select *, row_number() over (partition by file order by ts desc) = 1 and file % 3 = 0 as cut from f)
select file, case when cut then 'truncated' when ts % 101 = 0 then 'bad_crc' else 'entry' end as outcome, case when not cut and ts % 101 <> 0 then namespace end as namespace, case when not cut and ts % 101 <> 0 then lower(hex(key)) end as key_hex,
  case when not cut and ts % 101 <> 0 then lower(hex(value)) end as value_hex, case when not cut and ts % 101 <> 0 then ts end as ts from l""",
)
def log_replay(spark: SparkSession, d: str) -> DataFrame:
    """Log files of 64 KiB after a crash: a byte is wrong in every 101st record, and every third file lacks its last bytes."""
    e = fx.events_log(spark, d)
    whole = wal.log_files(e, "ts", 1 << 16)
    placed = wal.replay(whole, "file", "content").where("ts % 101 = 0").select(F.col("file").alias("f"), "at")
    # the last byte of a record's header is changed
    wrong = placed.groupBy("f").agg(F.sort_array(F.collect_list(F.col("at") + 8)).alias("at"))
    other = lambda c, i: F.concat(c.substr(F.lit(1), (i - 1).cast("int")), F.when(c.substr(i.cast("int"), F.lit(1)) == reads.lit_bytes(b"\x55"), reads.lit_bytes(b"\xaa")).otherwise(reads.lit_bytes(b"\x55")), c.substr((i + 1).cast("int"), F.lit(1 << 30)))
    damaged = whole.join(wrong, F.col("file") == F.col("f"), "left").withColumn("content", F.aggregate(F.coalesce("at", F.array().cast("array<bigint>")), F.col("content"), other))
    cut = damaged.withColumn("content", F.when(F.col("file") % 3 == 0, F.col("content").substr(F.lit(1), (F.octet_length("content") - 3).cast("int"))).otherwise(F.col("content")))
    r = wal.replay(cut, "file", "content")
    return r.select("file", "outcome", "namespace", key_hex().alias("key_hex"), key_hex("value").alias("value_hex"), "ts")


@query("op_metrics", f"select count(*) filter (op = 'put' and ok) as writes, count(*) filter (op = 'get') as reads, count(*) filter (op = 'delete' and ok) as deletes from {fx.OPS}")
def op_metrics(spark: SparkSession, d: str) -> DataFrame:
    return writes.op_counters(fx.op_log(spark, d))


_SIZE = "(19 + octet_length(key) + coalesce(octet_length(value), 0) + strlen(namespace) - 2)"


@query("encoded_size", f"select namespace, count(*) as entries, sum{_SIZE}::bigint as bytes from {fx.EVENTS} group by namespace")
def encoded_size(spark: SparkSession, d: str) -> DataFrame:
    return fx.events_log(spark, d).groupBy("namespace").agg(F.count(F.lit(1)).alias("entries"), F.sum(writes.encoded_size()).cast("bigint").alias("bytes"))


# segments

TINY = StoreConfig(memtable_bytes=1 << 16)


@query("flush_segments", f"select segment, count(*) as entries, min(ts) as first_ts, max(ts) as last_ts from (select ts, cast(sum{_SIZE} over (order by ts rows unbounded preceding) - {_SIZE} as bigint) // 65536 as segment from {fx.EVENTS}) group by segment")
def flush_segments(spark: SparkSession, d: str) -> DataFrame:
    return segments.cut_segments(fx.events_log(spark, d), TINY).groupBy("segment").agg(F.count(F.lit(1)).alias("entries"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


_STATS = f"select segment, count(*) as entry_count, count(*) filter (value is null) as tombstones, sum{_SIZE}::bigint as file_size, min(key) as min_key, max(key) as max_key, min(ts) as min_timestamp, max(ts) as max_timestamp from {fx.SEGMENTED} group by segment"


@query("segment_stats", f"select segment, entry_count, tombstones, file_size, lower(hex(min_key)) as min_hex, lower(hex(max_key)) as max_hex, min_timestamp, max_timestamp from ({_STATS})")
def segment_stats(spark: SparkSession, d: str) -> DataFrame:
    s = segments.segment_stats(fx.segmented(spark, d), ["segment"])
    return s.select("segment", "entry_count", "tombstones", "file_size", key_hex("min_key").alias("min_hex"), key_hex("max_key").alias("max_hex"), "min_timestamp", "max_timestamp")


@query(
    "manifest_check",
    f"""with s as (select sstable_id as id, count(*) as n, min(key) as lo, max(key) as hi from entry_log where sstable_id is not null and key is not null and octet_length(key) > 0 group by 1)
select id, entry_count is not distinct from n as count_ok, min_key is not distinct from lo and max_key is not distinct from hi as bounds_ok from sstable_manifest m left join s using (id)""",
)
def manifest_check(spark: SparkSession, d: str) -> DataFrame:
    """Each segment of the manifest against the entries that it holds."""
    s = table(spark, d, "entry_log").where(F.col("sstable_id").isNotNull() & has_key("key")).groupBy(F.col("sstable_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    m = table(spark, d, "sstable_manifest").join(s, "id", "left")
    return m.select("id", F.col("entry_count").eqNullSafe(F.col("n")).alias("count_ok"), (F.col("min_key").eqNullSafe(F.col("lo")) & F.col("max_key").eqNullSafe(F.col("hi"))).alias("bounds_ok"))


_LO, _HI = bytes.fromhex("2f"), bytes.fromhex("6d")


@query("segment_overlap", "select id, level from sstable_manifest where compacted = 0 and min_key <= '\\x6D'::blob and max_key >= '\\x2F'::blob")
def segment_overlap(spark: SparkSession, d: str) -> DataFrame:
    return compaction.active(table(spark, d, "sstable_manifest")).where(segments.overlaps(reads.lit_bytes(_LO), reads.lit_bytes(_HI))).select("id", "level")


@query(
    "segment_pruning",
    "select id, min_key <= 'user:'::blob and max_key >= 'user:'::blob as for_get, max_key >= '\\x2F'::blob and min_key < '\\x6D'::blob as for_scan from sstable_manifest where compacted = 0",
)
def segment_pruning(spark: SparkSession, d: str) -> DataFrame:
    a = compaction.active(table(spark, d, "sstable_manifest"))
    return a.select("id", segments.may_hold(reads.lit_bytes("user:")).alias("for_get"), segments.in_scan(reads.lit_bytes(_LO), reads.lit_bytes(_HI)).alias("for_scan"))


_BLOCKS = f"""(with recursive s as (select segment, namespace, key, sz, row_number() over w as n, sum(sz) over (w rows unbounded preceding) as upto from (select *, {_SIZE} as sz from {fx.SEGMENTED}) window w as (partition by segment order by namespace, key, ts desc)),
x as (select segment, n, min(n) over (partition by segment order by upto range between greatest(4097 - sz, 1) following and unbounded following) as nxt from s),
k as (select segment, 1::bigint as n, 0::bigint as block from s where n = 1 union all select k.segment, x.nxt, block + 1 from k join x using (segment, n) where x.nxt is not null),
r as (select s.*, last_value(k.block ignore nulls) over (partition by s.segment order by s.n) as block from s left join k using (segment, n))
select segment, block, arg_min(namespace, n) as first_namespace, arg_min(key, n) as first_key, arg_max(namespace, n) as last_namespace, arg_max(key, n) as last_key, count(*) as entries, sum(sz)::bigint as bytes from r group by 1, 2)"""


@query("block_layout", f"select segment, block, first_namespace, lower(hex(first_key)) as first_hex, last_namespace, lower(hex(last_key)) as last_hex, entries, bytes from {_BLOCKS}")
def block_layout(spark: SparkSession, d: str) -> DataFrame:
    b = segments.block_layout(fx.segmented(spark, d), "segment")
    return b.select("segment", "block", "first_namespace", key_hex("first_key").alias("first_hex"), "last_namespace", key_hex("last_key").alias("last_hex"), "entries", "bytes")


@query(
    "block_lookup",
    f"""select segment, block, first_namespace, lower(hex(first_key)) as first_hex, last_namespace, lower(hex(last_key)) as last_hex from (select *, row_number() over (partition by segment order by first_namespace desc, first_key desc, block desc) as r
  from {_BLOCKS} where first_namespace < 'view' or first_namespace = 'view' and first_key <= 'user_000011'::blob) where r = 1 and (last_namespace > 'view' or last_namespace = 'view' and last_key >= 'user_000011'::blob)""",
)
def block_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of block_layout, over all namespaces, sought for one key of the last namespace."""
    b = segments.block_lookup(segments.block_layout(fx.segmented(spark, d), "segment"), F.lit("view"), reads.lit_bytes("user_000011"))
    return b.select("segment", "block", "first_namespace", key_hex("first_key").alias("first_hex"), "last_namespace", key_hex("last_key").alias("last_hex"))


_DIGEST = "('0x' || substr(md5(namespace || '/' || lower(hex(key)) || '/' || coalesce(lower(hex(value)), '-') || '/' || ts), 1, 15))::bigint"
_SUMS = "(select segment, count(*) as n, sum({0}::hugeint) as s from {1} group by 1)"
_DAMAGED = f"(select namespace, key, case when ts % 1009 = 0 then '!'::blob else value end as value, ts, segment from {fx.SEGMENTED} where ts % 2003 <> 5 and segment <> 2)"


@query(
    "segment_verify",
    f"select segment, m.n as entry_count, coalesce(a.n, 0) as found, m.n is not distinct from a.n and m.s is not distinct from a.s as intact from {_SUMS.format(_DIGEST, fx.SEGMENTED)} m left join {_SUMS.format(_DIGEST, _DAMAGED)} a using (segment)",
)
def segment_verify(spark: SparkSession, d: str) -> DataFrame:
    """Segments whose values were changed, that lack entries, or that are gone."""
    e = fx.segmented(spark, d)
    value = F.when(F.col("ts") % 1009 == 0, reads.lit_bytes("!")).otherwise(F.col("value"))
    return segments.verify(segments.checksums(e, ["segment"]), e.withColumn("value", value).where("ts % 2003 <> 5 and segment <> 2"), "segment")


@query("segment_blocks", f"select segment, count(*) as blocks, sum(entries)::bigint as entry_count, max(bytes) as largest from {_BLOCKS} group by 1")
def segment_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Block counts of the segments."""
    b = segments.block_layout(fx.segmented(spark, d), "segment")
    return b.groupBy("segment").agg(F.count(F.lit(1)).alias("blocks"), F.sum("entries").alias("entry_count"), F.max("bytes").alias("largest"))


@query("cold_roundtrip", f"select namespace, {HEX}, ts from {fx.EVENTS}")
def cold_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A segment frozen, deleted and brought back from its cold copy."""
    hot, cold, back = (new_path(spark, x) for x in ("hot", "cold", "back"))
    segments.write_segment(fx.events_log(spark, d), hot)
    segments.freeze(spark, hot, cold)
    segments.drop_cold(spark, hot)
    segments.thaw(spark, cold, back)
    return hexed(spark.read.parquet(back), "ts")


@query("active_segments", "select row_number() over (order by level, min_key, id) as n, id, level, file_name from sstable_manifest where compacted = 0")
def active_segments(spark: SparkSession, d: str) -> DataFrame:
    """The catalog in order of level and key."""
    return global_row_number(compaction.active(table(spark, d, "sstable_manifest")).select("id", "level", "min_key", "file_name"), ["level", "min_key", "id"], "n").select("n", "id", "level", "file_name")


@query("segment_retire", "select id, level, file_name from sstable_manifest where compacted = 0 and level <> 0")
def segment_retire(spark: SparkSession, d: str) -> DataFrame:
    """All of level 0 marked as compacted, and compacted segments purged."""
    m = table(spark, d, "sstable_manifest")
    return catalog.purge(catalog.retire(m, m.where("level = 0").select("id"))).select("id", "level", "file_name")


@query("level_totals", "select count(*) as segments, sum(file_size)::bigint as bytes, sum(entry_count)::bigint as entries from sstable_manifest where compacted = 0")
def level_totals(spark: SparkSession, d: str) -> DataFrame:
    return compaction.active(table(spark, d, "sstable_manifest")).agg(F.count(F.lit(1)).alias("segments"), F.sum("file_size").alias("bytes"), F.sum("entry_count").alias("entries"))


@query("level_counts", "select level, count(*) as segments from sstable_manifest where compacted = 0 group by level")
def level_counts(spark: SparkSession, d: str) -> DataFrame:
    return compaction.level_sizes(table(spark, d, "sstable_manifest")).select("level", "segments")


@query("level_sizes", "select level, count(*) as segments, sum(file_size)::bigint as bytes, sum(file_size)::bigint > least(10000.0 * pow(10, level - 1), 9.2e18) and level >= 1 as over from sstable_manifest where compacted = 0 group by level")
def level_sizes(spark: SparkSession, d: str) -> DataFrame:
    """With a first level of 10,000 bytes."""
    c = StoreConfig(level1_bytes=10_000)
    return compaction.level_sizes(table(spark, d, "sstable_manifest")).withColumn("over", F.col("bytes") > compaction.level_limit(F.col("level"), c))


@query("level_limits", "select range::int as level, case when range < 1 or 10485760 * pow(10.0, range - 1) >= 9223372036854775807 then 9223372036854775807 else (10485760 * pow(10.0, range - 1))::bigint end as bytes from range(15)")
def level_limits(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(15).select(F.col("id").cast("int").alias("level"), compaction.level_limit(F.col("id")).alias("bytes"))


# compaction


@query("compact_l0", f"select namespace, {HEX}, ts from {fx.newest(fx.EIGHTHS)}")
def compact_l0(spark: SparkSession, d: str) -> DataFrame:
    """Level 0 is the newer half of the table in four runs, level 1 the older half, merged before; both go into a new level 1."""
    e = fx.eighths(spark, d)
    return hexed(compaction.compact(e.where("segment >= 4").drop("segment").unionByName(compaction.compact(e.where("segment < 4")))), "ts")


@query("compact_keep", f"select namespace, {HEX}, ts from {fx.newest(fx.EVENTS)}")
def compact_keep(spark: SparkSession, d: str) -> DataFrame:
    return hexed(compaction.compact(fx.events_log(spark, d)), "ts")


@query("compact_last_level", f"select namespace, {HEX}, ts from {fx.newest(fx.EVENTS)} where value is not null")
def compact_last_level(spark: SparkSession, d: str) -> DataFrame:
    return hexed(compaction.compact(fx.events_log(spark, d), last_level=True), "ts")


@query("compaction_stats", f"select count(*) as entries_read, (select count(*) from {fx.newest(fx.EVENTS)} where value is not null) as entries_written, count(*) - (select count(*) from {fx.newest(fx.EVENTS)} where value is not null) as entries_discarded from {fx.EVENTS}")
def compaction_stats(spark: SparkSession, d: str) -> DataFrame:
    return compaction.compaction_stats(fx.events_log(spark, d), last_level=True)


_PLAN = """with a as (select id, level, file_size, min_key, max_key from sstable_manifest where compacted = 0), due as (select count(*) filter (level = 0) >= {trigger} as due from a),
o as (select min(level) as ol from (select level, sum(file_size) as b from a where level between 1 and 5 group by level) where b > {first} * pow(10.0, level - 1)),
f as (select a.* from a, o, due where level = ol and not due order by min_key, id limit 1)
select id, level, 1 as target_level, case when level = 0 then 'source' else 'overlap' end as role from a, due where due and level <= 1
union all select id, level, level + 1, 'source' from f
union all select a.id, a.level, a.level, 'overlap' from a, f where a.level = f.level + 1 and a.min_key <= f.max_key and a.max_key >= f.min_key"""


@query("compaction_plan", _PLAN.format(trigger=4, first=10485760))
def compaction_plan(spark: SparkSession, d: str) -> DataFrame:
    return compaction.compaction_plan(table(spark, d, "sstable_manifest"))


@query("compaction_plan_level", _PLAN.format(trigger=1000000, first=1000))
def compaction_plan_level(spark: SparkSession, d: str) -> DataFrame:
    """Level 0 never due, a first level of 1,000 bytes."""
    return compaction.compaction_plan(table(spark, d, "sstable_manifest"), StoreConfig(l0_trigger=1_000_000, level1_bytes=1000))


# catalog and metrics


@query("config_upsert", "select p_type as name, arg_max(p_name, p_partkey) as value, max(p_partkey) as seq from part group by p_type")
def config_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Settings by kind of part, of which later numbers overwrite earlier ones; some are there, others change or come new."""
    p = table(spark, d, "part").select(F.col("p_type").alias("name"), F.col("p_name").alias("value"), F.col("p_partkey").alias("seq"))
    now = catalog.upsert(p.limit(0), p.where("seq % 3 = 0"), ["name"], "seq")
    return catalog.upsert(now, p.where("seq % 3 <> 0"), ["name"], "seq")


@query("config_get", "select p_type as name, arg_max(p_name, p_partkey) as value from part where p_type in (select p_type from part where p_partkey % 100 = 1) group by p_type")
def config_get(spark: SparkSession, d: str) -> DataFrame:
    """The settings that are asked for, after all changes."""
    asked = table(spark, d, "part").where("p_partkey % 100 = 1").select(F.col("p_type").alias("name")).distinct()
    return config_upsert(spark, d).join(asked, "name", "left_semi").select("name", "value")


_MEMBER = "(select node_id, address, lower(trim(state)) as state, incarnation, snapshot_id as seq from node_snapshots where state is not null)"


def _updates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "node_snapshots").select("node_id", "address", F.lower(F.trim("state")).alias("state"), "incarnation", F.col("snapshot_id").alias("seq"))


@query("node_upsert", f"select node_id, arg_max(address, seq) as address, arg_max(state, seq) as state, max(seq) as seq from {_MEMBER} group by node_id")
def node_upsert(spark: SparkSession, d: str) -> DataFrame:
    u = _updates(spark, d).where("state is not null").select("node_id", "address", "state", "seq")
    return catalog.upsert(u.where("seq % 2 = 0"), u.where("seq % 2 = 1"), ["node_id"], "seq")


_MERGED = f"(select node_id, arg_max(address, seq) as address, arg_max(state, incarnation * 1000000000 + seq) as state, max(incarnation) as incarnation from {_MEMBER} group by node_id)"


@query("membership_merge", f"select * from {_MERGED}")
def membership_merge(spark: SparkSession, d: str) -> DataFrame:
    return membership.merge_updates(_updates(spark, d))


@query("alive_members", f"select node_id, address from {_MERGED} where state = 'alive'")
def alive_members(spark: SparkSession, d: str) -> DataFrame:
    return membership.alive(membership.merge_updates(_updates(spark, d))).select("node_id", "address")


@query(
    "membership_timeout",
    """with e as (select distinct node_id, epoch_us(last_heartbeat) as at_us, lower(trim(state)) as state from node_snapshots where state is not null and last_heartbeat is not null and lower(trim(state)) in ('alive', 'suspected')),
u as (select node_id, at_us, min(state) as state from e group by 1, 2), n as (select *, lead(at_us) over (partition by node_id order by at_us) as next_us from u)
select node_id, at_us, state, case when state = 'suspected' and at_us + 600000000 < coalesce(next_us, 1900000000000000) then at_us + 600000000 end as dead_at_us from n""",
)
def membership_timeout(spark: SparkSession, d: str) -> DataFrame:
    """Ten minutes of suspicion, timers run to 2030."""
    s = table(spark, d, "node_snapshots").select("node_id", F.unix_micros(F.col("last_heartbeat").cast("timestamp")).alias("at_us"), F.lower(F.trim("state")).alias("state"))
    e = s.where("at_us is not null and state in ('alive', 'suspected')").groupBy("node_id", "at_us").agg(F.min("state").alias("state"))
    return membership.timeouts(e, 1_900_000_000_000_000, 600_000_000)


_KINDS = "case snapshot_id % 10 when 0 then 'join' when 1 then 'leave' when 2 then 'ack' when 3 then 'ack' else 'update' end"


@query(
    "member_events",
    f"""with recursive e as (select node_id, row_number() over (partition by node_id order by snapshot_id) as n, {_KINDS} as kind, lower(trim(state)) as state, incarnation as inc, address from node_snapshots where node_id is not null),
f as (select distinct node_id, 0::bigint as n, null::varchar as address, null::varchar as state, null::bigint as inc, 0::bigint as changes from e
  union all select f.node_id, e.n, case when j then e.address when u0 then e.address else f.address end, case when j then 'alive' when l then 'left' when a then 'alive' when u0 or u1 then e.state else f.state end,
    case when j then 0 when a or u0 or u1 then e.inc else f.inc end, f.changes + (j or l or a or u0 or u1)::bigint
  from f join e on f.node_id = e.node_id and e.n = f.n + 1, lateral (select kind = 'join' as j, kind = 'leave' and f.state is not null as l, coalesce(kind = 'ack' and f.state = 'suspected', false) as a,
    kind = 'update' and e.inc is not null and e.state is not null and f.state is null and e.address is not null as u0, coalesce(kind = 'update' and e.state is not null and f.state is not null and e.inc >= coalesce(f.inc, 0), false) as u1))
select node_id, address, state, inc as incarnation, changes from f where state is not null qualify row_number() over (partition by node_id order by n desc) = 1""",
)
def member_events(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots read as events of all four kinds."""
    s = table(spark, d, "node_snapshots")
    return membership.replay_events(s.select("node_id", F.col("snapshot_id").alias("seq"), F.expr(_KINDS).alias("kind"), F.lower(F.trim("state")).alias("state"), "incarnation", "address"))


def _migrations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("version"), F.col("n_name").alias("description"))


@query("schema_version", "select max(n_nationkey) + 1 as version from nation where n_regionkey <= 2")
def schema_version(spark: SparkSession, d: str) -> DataFrame:
    """Nations as migrations, of which some are applied."""
    return catalog.schema_version(_migrations(spark, d).join(table(spark, d, "nation").where("n_regionkey <= 2").select((F.col("n_nationkey") + 1).alias("version")), "version", "left_semi"))


@query("pending_migrations", "select n_nationkey + 1 as version, n_name as description from nation where n_nationkey >= 17")
def pending_migrations(spark: SparkSession, d: str) -> DataFrame:
    m = _migrations(spark, d)
    return catalog.pending_migrations(m.where("version <= 17"), m)


@query("cluster_status", f"select count(*) as total_nodes, count(*) filter (state = 'alive') as alive_nodes, count(*) filter (state = 'alive') < count(*) as degraded from {_MERGED}")
def cluster_status(spark: SparkSession, d: str) -> DataFrame:
    return catalog.cluster_status(membership.merge_updates(_updates(spark, d)))


@query("node_info", f"select node_id, address, case state when 'alive' then 'ACTIVE' when 'suspected' then 'SUSPECTED' when 'dead' then 'DEAD' when 'left' then 'LEFT' else 'UNKNOWN' end as node_state, incarnation from {_MERGED}")
def node_info(spark: SparkSession, d: str) -> DataFrame:
    m = membership.merge_updates(_updates(spark, d))
    return m.select("node_id", "address", catalog.member_state(F.col("state")).alias("node_state"), "incarnation")


_STATE = "case state when 'alive' then 'ACTIVE' when 'suspected' then 'SUSPECTED' when 'dead' then 'DEAD' when 'left' then 'LEFT' else 'UNKNOWN' end"


@query(
    "status_json",
    f"""select to_json({{'total_nodes': count(*), 'alive_nodes': count(*) filter (state = 'alive'), 'nodes': list({{'node_id': node_id, 'address': address, 'state': {_STATE}, 'incarnation': incarnation}} order by node_id)}})::varchar as status from {_MERGED}""",
)
def status_json(spark: SparkSession, d: str) -> DataFrame:
    return catalog.status_json(membership.merge_updates(_updates(spark, d)))


@query("random_members", f"select node_id, address from {_MERGED} where state = 'alive' and node_id <> 'node-00000' order by md5('42/' || node_id), node_id limit 3")
def random_members(spark: SparkSession, d: str) -> DataFrame:
    """Three relays for a probe by the first node; the limit is the feature."""
    return membership.random_members(membership.merge_updates(_updates(spark, d)), 3, 42, "node-00000").select("node_id", "address")


@query("prometheus_lines", "select 'store_level_segments{level=\"' || level || '\"} ' || count(*) as line from sstable_manifest where compacted = 0 group by level")
def prometheus_lines(spark: SparkSession, d: str) -> DataFrame:
    s = compaction.level_sizes(table(spark, d, "sstable_manifest"))
    return s.select(catalog.prometheus_line("store", F.lit("level_segments"), F.col("segments"), [("level", F.col("level"))]).alias("line"))


_COUNTS = f"(select count(*) filter (op = 'put' and ok) as writes_total, count(*) filter (op = 'get') as reads_total, count(*) filter (op = 'delete' and ok) as deletes_total, count(*) filter (op = 'get' and ok) as cache_hits_total, count(*) filter (op = 'get' and not ok) as cache_misses_total from {fx.OPS})"
_TAIL = "(select count(*) as memtable_entries, coalesce(sum(19 + octet_length(key) + coalesce(octet_length(value), 0) + strlen(namespace) - 2), 0)::bigint as memtable_size_bytes from entries where sstable_id is null)"
_ENGINE = f"""(with entries as (select sstable_id, key, value, case when coalesce(namespace, '') = '' then 'default' else namespace end as namespace from entry_log where key is not null and octet_length(key) > 0)
select *, memtable_size_bytes + 8 * memtable_entries as wal_size_bytes, (select count(*) from sstable_manifest where compacted = 0) as sstable_count, (select sum(file_size)::bigint from sstable_manifest where compacted = 0) as disk_bytes_total,
  coalesce(cache_hits_total / nullif(cache_hits_total + cache_misses_total, 0), 0)::double as cache_hit_rate from {_COUNTS}, {_TAIL})"""


@query("engine_metrics", f"select * from {_ENGINE}")
def engine_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Counters of the operation log, what isn't flushed yet, and the catalog's totals: one row each, set side by side."""
    ops = fx.op_log(spark, d)
    gets = ops.where("op = 'get'").agg(F.count_if("ok").alias("cache_hits_total"), F.count_if(~F.col("ok")).alias("cache_misses_total"))
    counts = writes.op_counters(ops).toDF("writes_total", "reads_total", "deletes_total")
    tail = entries(spark, d).where("sstable_id is null").agg(F.count(F.lit(1)).alias("memtable_entries"), F.coalesce(F.sum(writes.encoded_size().cast("bigint")), F.lit(0)).alias("memtable_size_bytes"))
    files = level_totals(spark, d).select(F.col("segments").alias("sstable_count"), F.col("bytes").alias("disk_bytes_total"))
    one = counts.withColumn("one", F.lit(1))
    for x in (gets, tail, files):
        one = one.join(x.withColumn("one", F.lit(1)), "one")
    wal_bytes = F.col("memtable_size_bytes") + wal.HEADER_BYTES * F.col("memtable_entries")
    return one.drop("one").withColumns({"wal_size_bytes": wal_bytes, "cache_hit_rate": catalog.hit_rate(F.col("cache_hits_total"), F.col("cache_misses_total"))})


def _metric_sql(i: int, name: str, kind: str, text: str) -> str:
    value = f"printf('%.4f', {name})" if name == "cache_hit_rate" else f"{name}"
    return f"""select {3 * i} as n, '# HELP store_{name} {text}' as line union all select {3 * i + 1}, '# TYPE store_{name} {kind}' union all select {3 * i + 2}, 'store_{name}{{node="node-1"}} ' || {value} from e"""


@query(
    "metrics_text",
    f"with e as materialized (select * from {_ENGINE}) "
    + " union all ".join(_metric_sql(i, *m) for i, m in enumerate(catalog.METRICS) if m[0] not in ("uptime_seconds", "cache_used_bytes"))
    + f""" union all select {3 * len(catalog.METRICS)} + level, 'store_sstable_level_count{{node="node-1",level="L' || level || '"}} ' || count(*) from sstable_manifest where compacted = 0 group by level""",
)
def metrics_text(spark: SparkSession, d: str) -> DataFrame:
    """The metrics page, but for the clock and the cache's bytes, which no table has."""
    return catalog.metrics_text(engine_metrics(spark, d), compaction.level_sizes(table(spark, d, "sstable_manifest")), "store", "node-1")


def _accesses(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("op") == "put", "insert").when(F.col("op") == "delete", "invalidate").otherwise("get")
    return fx.op_log(spark, d).select((F.col("event_id") % 7).alias("node"), F.col("event_id").alias("access"), F.col("user_id").alias("block"), op.alias("op"), F.lit(4096).alias("size"))


@query(
    "cache_replay",
    f"""with a as (select event_id % 7 as node, event_id as access, user_id as block, op from {fx.OPS}), w as (select *, last_value(case when op = 'get' then null else op end ignore nulls) over (partition by node, block order by access rows between unbounded preceding and 1 preceding) as was,
  4096 * case when op = 'put' then 1 when op = 'delete' then -1 else 0 end as change from a)
select node, access, block, op = 'get' and was is not distinct from 'put' as hit, sum(case when op = 'put' and was is distinct from 'put' then 4096 when op = 'delete' and was is not distinct from 'put' then -4096 else 0 end) over (partition by node order by access)::bigint as used from w""",
)
def cache_replay(spark: SparkSession, d: str) -> DataFrame:
    """Seven nodes' caches, so large that nothing is pushed out."""
    r = catalog.cache_replay(_accesses(spark, d), "node", "access", "block", "op", "size", 1 << 40)
    return r.select("node", "access", "block", F.coalesce("hit", F.lit(False)).alias("hit"), "used")


@query("cache_evictions")
def cache_evictions(spark: SparkSession, d: str) -> DataFrame:
    """The same with room for twenty blocks each. What is pushed out depends on all accesses before, so there is no SQL."""
    return catalog.cache_stats(catalog.cache_replay(_accesses(spark, d), "node", "access", "block", "op", "size", 20 * 4096), "node", "access")


@query(
    "write_rate",
    f"""with h as (select event_id // 100 as sample, count(*) filter (op = 'put' and ok) as w from {fx.OPS} group by 1), c as (select sample * 2000000 as at_us, sum(w) over (order by sample)::bigint as writes from h),
r as (select *, greatest(0, writes - lag(writes) over (order by at_us)) / ((at_us - lag(at_us) over (order by at_us)) / 1e6) as rate from c)
select at_us, writes, round(rate, 6) as rate, round(avg(rate) over (order by at_us rows 23 preceding), 6) as mean_rate from r""",
)
def write_rate(spark: SparkSession, d: str) -> DataFrame:
    """A poll every two seconds, 100 operations apart."""
    h = fx.op_log(spark, d).groupBy(F.expr("event_id div 100").alias("sample")).agg(F.count_if((F.col("op") == "put") & F.col("ok")).alias("w"))
    polls = running_sum(h, ["sample"], F.col("w"), "writes").select((F.col("sample") * 2_000_000).alias("at_us"), "writes")
    r = catalog.write_rate(polls, "at_us", "writes")
    return r.select("at_us", "writes", F.round("rate", 6).alias("rate"), F.round("mean_rate", 6).alias("mean_rate"))


@query("cache_hit_rate", f"select user_id, round(coalesce(count(*) filter (ok) / nullif(count(*), 0), 0), 9)::double as rate from {fx.OPS} where op = 'get' group by user_id")
def cache_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    g = fx.op_log(spark, d).where("op = 'get'").groupBy("user_id").agg(F.count_if("ok").alias("h"), F.count_if(~F.col("ok")).alias("m"))
    return g.select("user_id", F.round(catalog.hit_rate(F.col("h"), F.col("m")), 9).alias("rate"))


@query(
    "lru_victims",
    "select user_id as block_id, bytes, last_access from (select *, sum(bytes) over (order by last_access, user_id rows unbounded preceding) - bytes as before from (select user_id, count(*) * 100 as bytes, max(event_id) as last_access from events group by user_id)) where before < 20000",
)
def lru_victims(spark: SparkSession, d: str) -> DataFrame:
    """Users as cached blocks of 100 bytes an event; 20,000 bytes are needed."""
    b = table(spark, d, "events").groupBy(F.col("user_id").alias("block_id")).agg((F.count(F.lit(1)) * 100).alias("bytes"), F.max("event_id").alias("last_access"))
    return catalog.lru_victims(b, 20_000).select("block_id", "bytes", "last_access")


@query("fmt_bytes", "select id, case when file_size * 100 >= 1e9 then printf('%.1f GB', round(file_size * 100 / 1e9, 1)) when file_size * 100 >= 1e6 then printf('%.1f MB', round(file_size * 100 / 1e6, 1)) when file_size * 100 >= 1e3 then printf('%.1f KB', round(file_size * 100 / 1e3, 1)) else file_size * 100 || ' B' end as text from sstable_manifest")
def fmt_bytes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sstable_manifest").select("id", scalars.fmt_bytes(F.col("file_size") * 100).alias("text"))


# placement

NODES = ["node-a", "node-b", "node-c"]
_POS = "('0x' || substr(md5({}), 1, 15))::bigint"
_RING = "(select {} as position, min(node_id) as node_id from (values {}) v(node_id), range(256) group by 1)".format(_POS.format("node_id || ':' || range"), "{}")
RING3 = _RING.format(", ".join(f"('{n}')" for n in NODES))
RING2 = _RING.format(", ".join(f"('{n}')" for n in NODES[:2]))


def _ring(spark: SparkSession, n: int = 3) -> DataFrame:
    return placement.ring(spark.createDataFrame([(x,) for x in NODES[:n]], "node_id string"))


def _users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_name")


@query("ring_build", f"select * from {RING3}")
def ring_build(spark: SparkSession, d: str) -> DataFrame:
    return _ring(spark)


@query("ring_owner", f"select c_name, coalesce(a.node_id, (select arg_min(node_id, position) from {RING3})) as owner from (select c_name, {_POS.format('c_name')} as p from customer) c asof left join {RING3} a on c.p <= a.position")
def ring_owner(spark: SparkSession, d: str) -> DataFrame:
    return placement.owner(_users(spark, d), "c_name", _ring(spark))


@query(
    "ring_replicas",
    f"""with k as (select c_name, {_POS.format("c_name")} as p from customer), r as (select * from {RING3}),
n as (select node_id, position, position - 1152921504606846976 as low from r union all select node_id, position + 1152921504606846976, position from r),
f as (select c_name, node_id, min(case when position >= p then position end) as pl from k, n where position >= p and position - p < 1152921504606846976 group by 1, 2),
o as (select *, row_number() over (partition by c_name order by pl) as rn from f)
select c_name, list(node_id order by rn) as replicas from o where rn <= 2 group by c_name""",
)
def ring_replicas(spark: SparkSession, d: str) -> DataFrame:
    return placement.replicas(_users(spark, d), "c_name", _ring(spark), 2)


@query("ring_stats", f"select count(*) as positions, count(distinct node_id) as nodes from {RING3}")
def ring_stats(spark: SparkSession, d: str) -> DataFrame:
    return placement.ring_stats(_ring(spark))


@query(
    "ring_movement",
    f"""with k as (select c_name, {_POS.format("c_name")} as p from customer), a as (select c_name, coalesce(r.node_id, (select arg_min(node_id, position) from {RING2})) as o from k asof left join {RING2} r on k.p <= r.position),
b as (select c_name, coalesce(r.node_id, (select arg_min(node_id, position) from {RING3})) as o from k asof left join {RING3} r on k.p <= r.position)
select count(*) as keys, count(*) filter (a.o <> b.o) as moved from a join b using (c_name)""",
)
def ring_movement(spark: SparkSession, d: str) -> DataFrame:
    return placement.movement(_users(spark, d), "c_name", _ring(spark, 2), _ring(spark))


_BITS = "greatest(ceil(-n * ln(least(greatest({}, 0.0001), 0.5)) / (ln(2.0) * ln(2.0))), 64)::bigint"


@query("bloom_sizing", f"select n, bits, least(greatest(ceil(bits / n * ln(2.0)), 1), 30)::int as hashes from (select n, {_BITS.format('0.01')} as bits from (values (1), (100), (10000), (1000000)) v(n))")
def bloom_sizing(spark: SparkSession, d: str) -> DataFrame:
    n = spark.createDataFrame([(1,), (100,), (10_000,), (1_000_000,)], "n int").withColumn("bits", placement.bloom_bits(F.col("n"), F.lit(0.01)))
    return n.withColumn("hashes", placement.bloom_hashes(F.col("bits"), F.col("n")))


_BP = "list_transform(range(hashes), lambda i: (('0x' || substr(md5(k), 1, 8))::bigint + i * ('0x' || substr(md5(k), 9, 8))::bigint) % bits)"


@query(
    "bloom_probe",
    f"""with k as (select distinct segment, lower(hex(key)) as k from {fx.EIGHTHS}), s as (select segment, n, bits, least(greatest(ceil(bits / n * ln(2.0)), 1), 30)::int as hashes from (select segment, n, {_BITS.format('0.01')} as bits from (select segment, count(*) as n from k group by 1))),
b as (select distinct segment, unnest({_BP}) as p from k join s using (segment)), q as (select segment + 1 as segment, k from k union select c_custkey % 8, lower(hex(encode(printf('user_%06d', c_custkey)))) from customer),
a as (select k, segment, unnest({_BP}) as p from q join s using (segment))
select k as key_hex, segment, bool_and(b.p is not null) as maybe from a left join b using (segment, p) group by 1, 2""",
)
def bloom_probe(spark: SparkSession, d: str) -> DataFrame:
    """Filters of eight segments, asked for the keys of the segment before and for customer numbers as users, who are dealt to all of them."""
    log = fx.eighths(spark, d).select("segment", key_hex().alias("k"))
    users = table(spark, d, "customer").select((F.col("c_custkey") % 8).alias("segment"), F.lower(F.hex(F.encode(F.format_string("user_%06d", "c_custkey"), "UTF-8"))).alias("k"))
    asked = log.select((F.col("segment") + 1).alias("segment"), "k").unionByName(users)
    return placement.bloom_probe(asked, "segment", "k", placement.bloom_build(log, "segment", "k", 0.01)).withColumnRenamed("k", "key_hex")


# repair


def _hashed(log: str) -> str:
    return f"(select lower(hex(key)) || '/' || namespace as k, sha256(lower(hex(key)) || coalesce(lower(hex(value)), '-') || ts) as h from {fx.newest(log)})"


def _hash_rows(df: DataFrame) -> DataFrame:
    e = latest(df)
    return e.select(F.concat_ws("/", key_hex(), "namespace").alias("k"), F.sha2(F.concat(key_hex(), F.coalesce(key_hex("value"), F.lit("-")), F.col("ts").cast("string")).cast("binary"), 256).alias("h"))


def _leaves(log: str) -> str:
    """A tree of two levels, which holds leaves of up to 4096 ** 2 rows."""
    placed = f"(select k, h, row_number() over (order by k) - 1 as n0, (select ceil(count(*) / least(64, count(*)))::bigint from {_hashed(log)}) as size from {_hashed(log)})"
    groups = f"(select leaf, j, sha256(string_agg(h, '' order by k)) as h, min(k) as lo, max(k) as hi, count(*) as n from (select *, (n0 // size)::int as leaf, n0 % size // 4096 as j from {placed}) group by 1, 2)"
    return f"(select leaf, case when count(*) = 1 then any_value(h) else sha256(string_agg(h, '' order by j)) end as hash, min(lo) as min_key, max(hi) as max_key, sum(n)::bigint as cnt from {groups} group by leaf)"


_CHANGED = f"(select namespace, key, case when ts % 37 = 0 then 'x'::blob else value end as value, ts from {fx.EVENTS})"


@query("merkle_build", f"select * from {_leaves(fx.EVENTS)}")
def merkle_build(spark: SparkSession, d: str) -> DataFrame:
    return repair.merkle_leaves(_hash_rows(fx.events_log(spark, d)), "k", "h")


@query("merkle_root", f"select sha256(string_agg(hash, '' order by leaf)) as root from {_leaves(fx.EVENTS)}")
def merkle_root(spark: SparkSession, d: str) -> DataFrame:
    return repair.merkle_root(repair.merkle_leaves(_hash_rows(fx.events_log(spark, d)), "k", "h"))


@query(
    "merkle_diff",
    f"select coalesce(l.leaf, r.leaf) as leaf, least(l.min_key, r.min_key) as min_key, greatest(l.max_key, r.max_key) as max_key, coalesce(l.cnt, 0) as local_count, coalesce(r.cnt, 0) as remote_count from {_leaves(fx.EVENTS)} l full join {_leaves(_CHANGED)} r on l.leaf = r.leaf where l.hash is distinct from r.hash",
)
def merkle_diff(spark: SparkSession, d: str) -> DataFrame:
    log = fx.events_log(spark, d)
    other = log.withColumn("value", F.when(F.col("ts") % 37 == 0, reads.lit_bytes("x")).otherwise(F.col("value")))
    return repair.merkle_diff(*(repair.merkle_leaves(_hash_rows(x), "k", "h") for x in (log, other)))


@query(
    "keyed_leaves",
    f"""with r as (select k, h, (('0x' || substr(md5(k), 1, 15))::bigint % 1024)::int as leaf from {_hashed(fx.EVENTS)})
select leaf, sha256(sum(('0x' || substr(md5('1/' || k || '/' || h), 1, 15))::hugeint) || '/' || sum(('0x' || substr(md5('2/' || k || '/' || h), 1, 15))::hugeint)) as hash, min(k) as min_key, max(k) as max_key, count(*) as cnt from r group by leaf""",
)
def keyed_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Leaves by hash of the key, which grow with the table but are combined on the map side."""
    return repair.keyed_leaves(_hash_rows(fx.events_log(spark, d)), "k", "h", 1024)


# scalar functions and codecs


@query("password_hash", "select c_custkey, sha256('salt' || c_custkey || c_name || 'context') as hash from customer")
def password_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", scalars.password_hash(F.concat(F.lit("salt"), F.col("c_custkey").cast("string")), F.col("c_name"), F.lit("context")).alias("hash"))


_DSN = """case c_custkey % 8 when 0 then 'kv://' || c_name || ':7001' when 1 then 'kv://' || c_mktsegment || ':pa:' || c_custkey || '@' || c_name || ':' || (1000 + c_custkey % 60000) when 2 then 'kv://' || c_mktsegment || '@' || c_name
  when 3 then 'kv://a@b:' || c_custkey || '@' || c_name when 4 then 'http://' || c_name when 5 then 'kv://' || c_name || ':port' when 6 then 'kv://' || c_name || ':' || (65536 + c_custkey) else 'kv://' || c_mktsegment || ':@' end"""


@query(
    "parse_dsn",
    f"""select c_custkey, {_DSN} as dsn, case c_custkey % 8 when 1 then c_mktsegment when 2 then c_mktsegment when 3 then 'a@b' end as "user", case c_custkey % 8 when 1 then 'pa:' || c_custkey when 3 then c_custkey::varchar end as "password",
case when c_custkey % 8 < 4 then c_name end as host, case c_custkey % 8 when 0 then 7001 when 1 then 1000 + c_custkey % 60000 when 2 then 9090 when 3 then 9090 end::int as port,
case c_custkey % 8 when 4 then 'unknown scheme' when 5 then 'bad port' when 6 then 'bad port' when 7 then 'no host' end as error from customer""",
)
def parse_dsn(spark: SparkSession, d: str) -> DataFrame:
    """Addresses put together from customers, in eight forms."""
    c = table(spark, d, "customer").select("c_custkey", F.expr(_DSN).alias("dsn"))
    return c.select("*", scalars.parse_dsn(F.col("dsn"), "kv").alias("p")).select("c_custkey", "dsn", "p.*")


@query("align_up", "select id, (file_size + 4095) // 4096 * 4096 as aligned from sstable_manifest")
def align_up(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sstable_manifest").select("id", scalars.align_up(F.col("file_size")).alias("aligned"))


_KIND = "case when s_nationkey % 5 = 0 then 'SSD' when s_nationkey % 5 = 1 then 'hdd' when s_nationkey % 5 = 2 then 'nvme' when s_nationkey % 5 = 3 then null when s_suppkey % 2 = 0 then 'NVMe' else 'HDD' end"


@query(
    "storage_mode",
    f"""with k as (select s_nationkey as host, count(distinct lower({_KIND})) as n, max(lower({_KIND})) as k from supplier group by 1), m as (select host, case when n > 1 then 'tiered' when n = 0 then 'unknown' else k || '_only' end as mode from k)
select *, case mode when 'tiered' then 4 when 'hdd_only' then 1 else 8 end as parallelism, case mode when 'tiered' then 2 when 'hdd_only' then 1 else 4 end as compaction_threads from m""",
)
def storage_mode(spark: SparkSession, d: str) -> DataFrame:
    """Nations as hosts whose suppliers are their devices."""
    m = scalars.storage_mode(table(spark, d, "supplier").select(F.col("s_nationkey").alias("host"), F.expr(_KIND).alias("kind")), "host")
    return m.select("*", scalars.tier_settings(F.col("mode")).alias("t")).select("host", "mode", "t.*")


@query("tier_route", "select id, case when level <= 1 then 'hot' when level <= 3 then 'warm' else 'cold' end as tier, id % 10 >= 8 as cold from sstable_manifest")
def tier_route(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sstable_manifest").select("id", scalars.tier_route(F.col("level"), F.lit("tiered"), F.col("id") % 10 / 10).alias("t")).select("id", "t.*")


_PATH = "'/' || replace(p_type, ' ', '/') || '/' || p_partkey"
_MOUNTS = "(select '/' || split_part(p_type, ' ', 1) as mount, min(p_brand) as device from part where p_size > 10 group by 1 union all select lower('/' || replace(p_type, ' ', '/')), min(p_brand) from part where p_size < 4 group by 1)"


@query("mount_match", f"select p_partkey, device from (select p_partkey, device, row_number() over (partition by p_partkey order by length(mount) desc, device desc) as r from (select p_partkey, {_PATH} as path from part) p left join {_MOUNTS} m on starts_with(lower(path), lower(mount))) where r = 1")
def mount_match(spark: SparkSession, d: str) -> DataFrame:
    """Parts as files in folders by type, and some of the folders as mounts."""
    p = table(spark, d, "part")
    one = p.where("p_size > 10").groupBy(F.concat(F.lit("/"), F.split_part("p_type", F.lit(" "), F.lit(1))).alias("mount")).agg(F.min("p_brand").alias("device"))
    two = p.where("p_size < 4").groupBy(F.lower(F.concat(F.lit("/"), F.replace("p_type", F.lit(" "), F.lit("/")))).alias("mount")).agg(F.min("p_brand").alias("device"))
    return scalars.mount_match(p.select("p_partkey", F.expr(_PATH).alias("path")), "path", one.unionByName(two), "mount", "device").select("p_partkey", "device")


@query("entry_roundtrip", f"select namespace, ts, {HEX}, octet_length(key) + coalesce(octet_length(value), 0) + strlen(namespace) + 17 as bytes from {fx.EVENTS}")
def entry_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every entry encoded and decoded again, with the bytes that it took."""
    e = fx.events_log(spark, d).select(codecs.encode_entry(F.col("key"), F.col("value"), F.col("ts"), F.col("namespace")).alias("b"))
    x = e.select(codecs.decode_entry(F.col("b")).alias("e"), F.octet_length("b").alias("bytes")).select("e.*", "bytes")
    return hexed(x, "ts", "bytes")


_LE = lambda n, size: "printf('{}', {})".format("%02x" * size, ", ".join(f"({n}) // {256**i} % 256" for i in range(size)))


@query(
    "wal_crc",
    f"""with recursive z as (select range as i, range as c, 0 as n from range(256) union all select i, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, n + 1 from z where n < 8),
t as (select list(c order by i) as tbl from z where n = 8),
e as (select ts, {_LE("octet_length(key)", 2)} || lower(hex(key)) || case when value is null then '01' else '00' end || {_LE("coalesce(octet_length(value), 0)", 4)} || coalesce(lower(hex(value)), '') || {_LE("ts", 8)} || {_LE("strlen(namespace)", 2)} || lower(hex(encode(namespace))) as x from {fx.EVENTS}),
b as (select ts, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint) as bytes from e)
select ts, xor(list_reduce(bytes, lambda c, y: xor(c // 256, tbl[(xor(c % 256, y) + 1)::int]), 4294967295::bigint), 4294967295) as crc from b, t""",
)
def wal_crc(spark: SparkSession, d: str) -> DataFrame:
    e = fx.events_log(spark, d)
    return e.select("ts", codecs.log_record_crc(codecs.encode_entry(F.col("key"), F.col("value"), F.col("ts"), F.col("namespace"))).alias("crc"))


@query("aes_roundtrip", f"select ts, {HEX}, octet_length(value) + 28 as bytes, true as wrong_key_fails from {fx.EVENTS} where value is not null")
def aes_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    derive = codecs.block_key(b"0" * 32, b"block-key")
    log = fx.events_log(spark, d).where("value is not null").withColumn("k", derive(F.encode(F.col("ts").cast("string"), "UTF-8"))).withColumn("x", derive(F.encode(F.lit("other"), "UTF-8")))
    e = log.withColumn("c", codecs.encrypt_block(F.col("value"), F.col("k")))
    return e.select("ts", key_hex().alias("key_hex"), F.lower(F.hex(codecs.decrypt_block(F.col("c"), F.col("k")))).alias("value_hex"), F.octet_length("c").alias("bytes"), codecs.decrypt_block(F.col("c"), F.col("x")).isNull().alias("wrong_key_fails"))


@query("zstd_roundtrip", f"select ts, {HEX}, true as smaller, true as damage_found from {fx.EVENTS} where value is not null")
def zstd_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Values, forty times over, compressed as blocks and read again, also without the last byte."""
    e = fx.events_log(spark, d).where("value is not null").withColumn("block", F.repeat(F.decode("value", "UTF-8"), F.lit(40)).cast("binary"))
    c = e.withColumn("z", codecs.compress_block(F.col("block"))).withColumn("cut", F.col("z").substr(F.lit(1), F.octet_length("z") - 1))
    back = c.withColumn("p", codecs.decompress_block(F.col("z"))).withColumn("broken", codecs.decompress_block(F.col("cut")))
    value = F.lower(F.hex(F.col("p").substr(F.lit(1), F.octet_length("value"))))
    return back.select("ts", key_hex().alias("key_hex"), F.when(F.col("p") == F.col("block"), value).alias("value_hex"), (F.octet_length("z") < F.octet_length("block")).alias("smaller"), F.col("broken").isNull().alias("damage_found"))


@query("xxh3_keys")
def xxh3_keys(spark: SparkSession, d: str) -> DataFrame:
    """The hash that filters and rings of the original are built on; the SQL engine doesn't have it."""
    return table(spark, d, "customer").select("c_name", codecs.xxh3_64(F.col("c_name").cast("binary")).alias("hash"))


@query("bench_load", "select 'bench' as namespace, printf('bench_key_%010d', range) as key_text, repeat('ab', 256) as value_hex, range + 1 as ts from range(100000)")
def bench_load(spark: SparkSession, d: str) -> DataFrame:
    """100,000 keys with constant values of 256 bytes."""
    return spark.range(100_000).select(F.lit("bench").alias("namespace"), F.format_string("bench_key_%010d", "id").alias("key_text"), F.repeat(F.lit("ab"), F.lit(256)).alias("value_hex"), (F.col("id") + 1).alias("ts"))


@query("large_values", "select lang as namespace, count(*) as documents, sum(strlen(coalesce(text, '')))::bigint as bytes, max(strlen(coalesce(text, '')))::int as largest from documents group by lang")
def large_values(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as values: bytes by namespace."""
    return fx.document_log(spark, d).groupBy("namespace").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.coalesce(F.octet_length("value"), F.lit(0))).alias("bytes"), F.max(F.coalesce(F.octet_length("value"), F.lit(0))).alias("largest"))
