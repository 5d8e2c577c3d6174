"""Queries of the problems of language-model data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.distinct import cube_estimates, estimates, registers
from stratalog.llm.leak import leaked_spans, leaks, remove_spans
from stratalog.llm.seen import answer, error_report
from stratalog.llm.split import split_oversized
from stratalog.llm.tokenize import decode, encode
from stratalog.model import has_key, key_hex, normal_namespace
from stratalog.plans.registry import Registry
from stratalog.scratch import staged
from stratalog.sources.tables import table

R = Registry()

_NS = "case when coalesce(namespace, '') = '' then 'default' else namespace end"


def _keyed(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name).where(has_key("key")).withColumn("namespace", normal_namespace("namespace"))


def _answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """filtered: whether the entry's segment was written with a filter; a null or zero bloom_offset says that it wasn't, and entries that aren't flushed have
    none either."""
    probes = _keyed(spark, d, "key_probes").select("probe_id", "namespace", "key")
    segments = table(spark, d, "sstable_manifest").select(F.col("id").alias("sstable_id"), (F.coalesce("bloom_offset", F.lit(0)) != 0).alias("has_filter"))
    log = _keyed(spark, d, "entry_log").select("namespace", "key", "sstable_id").join(segments, "sstable_id", "left")
    return answer(probes, "probe_id", log, ["namespace", "key"], F.col("has_filter"))


@R.query(
    "p4_found",
    f"""with p as (select probe_id, {_NS} as namespace, key from key_probes where key is not null and octet_length(key) > 0),
k as (select distinct {_NS} as namespace, key from entry_log where key is not null and octet_length(key) > 0)
select probe_id from (select probe_id, k.key is not null as known, row_number() over (partition by p.namespace, p.key order by probe_id) > 1 as again
  from p left join k on p.namespace = k.namespace and p.key = k.key) where known or again""",
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d)[0].select("probe_id")


_ASKED = f"""(select {_NS} as namespace, key, min(probe_id) as first from key_probes where key is not null and octet_length(key) > 0 group by 1, 2)"""
_STORED = f"""(select {_NS} as namespace, key, bool_or(coalesce(bloom_offset, 0) <> 0) as filtered from entry_log left join sstable_manifest on sstable_id = id
  where key is not null and octet_length(key) > 0 group by 1, 2)"""


@R.query(
    "p4_error",
    f"""select count(*) as asked, count(*) filter (filtered is null) as new, 0::bigint as missed, count(*) filter (filtered = false) as without_filter, true as rate_holds, true as negatives_checked
from {_ASKED} a left join {_STORED} s using (namespace, key)""",
)
def p4_error(spark: SparkSession, d: str) -> DataFrame:
    """The filter's measured errors: of the keys asked for, how many are new, false negatives among the rejected keys that were looked up, known
    keys that no filter of the store holds, whether at most one new key in fifty passed the filter, and whether at least one in 128 of many rejected keys was looked up."""
    r = error_report(_answers(spark, d)[1])
    many = F.col("new") - F.col("disproved") >= 5000
    return r.select("asked", "new", "missed", "without_filter", (F.col("error_rate") <= 0.02).alias("rate_holds"), (~many | (F.col("rejected_checked") * 128 >= F.col("new") - F.col("disproved"))).alias("negatives_checked"))


@R.query("p4_report")
def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """The figures of error_report as they are: which keys pass the filter wrongly depends on its hash, so there is no SQL."""
    return error_report(_answers(spark, d)[1])


@R.query("p4_disproved")
def p4_disproved(spark: SparkSession, d: str) -> DataFrame:
    """The log of the filter's wrong answers: new keys that it let through and the lookup turned away. Which they are depends on its hash."""
    return _answers(spark, d)[1].where("maybe and not known").select("key.namespace", key_hex("key.key").alias("key_hex"), "first")


@R.query("p4_routes", f"select lower(hex(key)) as key_hex, namespace, first, filtered is not null as known, true as routed from {_ASKED} a left join {_STORED} s using (namespace, key)")
def p4_routes(spark: SparkSession, d: str) -> DataFrame:
    """Each key asked for with the answer, and whether its way was right: a known key passed the filter and was looked up, and a wrong pass was disproved."""
    f = _answers(spark, d)[1]
    routed = F.when(F.col("known"), F.col("maybe") & F.col("checked")).otherwise(~F.col("maybe") | F.col("checked"))
    return f.select(key_hex("key.key").alias("key_hex"), "key.namespace", "first", "known", routed.alias("routed"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format(F.timestamp_micros("ts"), "yyyy-MM-dd")
    return registers(_days(spark, d).withColumn("day_utc", day), ["day_utc", "namespace"], ["namespace", "key"])


def _days(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(spark, d, "entry_log").select("namespace", "key", "ts")


SHARE = 0.7
#: Groups whose share lies within so many standard errors of the threshold are counted exactly.
SIGMAS = 6
#: So are groups within so many keys of it: the estimate of a small group errs by whole collisions of registers, more than its standard error says.
MARGIN_KEYS = 10.0


def near_threshold(gap: Column, estimate: Column, std_error: Column) -> Column:
    """Whether the estimate is too close to the threshold to decide by."""
    return F.abs(gap) <= F.greatest(SIGMAS * std_error * estimate, F.lit(MARGIN_KEYS))


@R.query(
    "p5_found",
    f"""select strftime(make_timestamp(ts), '%Y-%m-%d') as day_utc, {_NS} as namespace from entry_log where key is not null and octet_length(key) > 0
group by 1, 2 having count(distinct key) >= 0.7 * count(*)""",
)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """By the registers' estimate; groups too close to the threshold for it are counted exactly, and only their rows."""
    groups = ["day_utc", "namespace"]
    got = staged(estimates(_parts(spark, d), groups), "estimates")
    gap = F.col("estimate") - SHARE * F.col("rows")
    near = near_threshold(gap, F.col("estimate"), F.col("std_error"))
    sure = got.where(~near & (gap > 0)).select(*groups)
    rows = _days(spark, d).withColumn("day_utc", F.date_format(F.timestamp_micros("ts"), "yyyy-MM-dd")).drop("ts")
    close = rows.join(got.where(near).select(*groups), groups, "left_semi").groupBy(*groups, "key").agg(F.count(F.lit(1)).alias("n"))
    exact = close.groupBy(*groups).agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n")).where(F.col("keys") * 10 >= F.col("n") * 7)
    return sure.unionByName(exact.select(*groups))


@R.query("p5_distinct")
def p5_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Estimated distinct keys of each day, namespace, combination and in all, from the same registers. The figures depend on the hash, so there is no SQL."""
    return cube_estimates(_parts(spark, d), ["day_utc", "namespace"])


@R.query(
    "p5_within",
    f"""with e as (select strftime(make_timestamp(ts), '%Y-%m-%d') as day_utc, {_NS} as namespace, key from entry_log where key is not null and octet_length(key) > 0)
select day_utc, namespace, grouping(day_utc, namespace)::int as level, count(*) as rows, count(distinct (namespace, key)) as keys, true as within
from (select *, namespace as ns from e) group by cube (day_utc, namespace)""".replace("count(distinct (namespace, key))", "count(distinct (ns, key))"),
)
def p5_within(spark: SparkSession, d: str) -> DataFrame:
    """The estimates of p5_distinct set against exact counts, which take one row a key and group: within five standard errors, or three keys?"""
    groups, keys = ["day_utc", "namespace"], ["ns", "key"]
    e = p5_distinct(spark, d)
    rows = _days(spark, d).select(F.date_format(F.timestamp_micros("ts"), "yyyy-MM-dd").alias("day_utc"), "namespace", F.col("namespace").alias("ns"), "key")
    sets = [[*(F.col(g) for i, g in enumerate(groups) if not s >> (1 - i) & 1), *map(F.col, keys)] for s in range(4)]
    per = rows.groupBy(*groups, *keys).count().groupingSets(sets, *groups, *keys).agg(F.sum("count").alias("n"), F.shiftright(F.grouping_id(), 2).cast("int").alias("level"))
    exact = per.groupBy(*groups, "level").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("keys"))
    same = [exact[c].eqNullSafe(e[c]) for c in (*groups, "level")]
    near = F.abs(e["estimate"] - exact["keys"]) <= F.greatest(5 * e["std_error"] * exact["keys"], F.lit(3.0))
    return exact.join(e, same).select(*(exact[c] for c in (*groups, "level")), exact["rows"], "keys", near.alias("within"))


@R.query("p7_ids")
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "ids")


@R.query("p7_roundtrip", "select doc_id, md5(coalesce(text, '')) as digest from documents")
def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The texts that the ids of p7_ids stand for."""
    return decode(p7_ids(spark, d), "ids").select("doc_id", F.md5("text").alias("digest"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", "passage")


@R.query("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), "doc_id", "text", _items(spark, d), "item_id", "passage").select("doc_id", "item_id")


@R.query("p8_spans")
def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """The matched spans of each text part, to be removed."""
    return leaked_spans(table(spark, d, "documents"), "doc_id", "text", _items(spark, d), "item_id", "passage")


@R.query("p8_cleaned")
def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """The text parts with leaks, without them."""
    return remove_spans(table(spark, d, "documents"), "doc_id", "text", _items(spark, d), "item_id", "passage")


@R.query("p8_verbatim", "select doc_id, item_id from documents, eval_items where contains(text, passage)")
def p8_verbatim(spark: SparkSession, d: str) -> DataFrame:
    """Of the pairs found those where the whole passage stands in the raw message as it is; SQL finds them by comparing all texts."""
    docs, items = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items").select("item_id", "passage")
    return p8_found(spark, d).join(docs, "doc_id").join(items, "item_id").where(F.contains("text", "passage")).select("doc_id", "item_id")


@R.query("p8_check", "select true as same_documents, true as coverage_right, true as nothing_left")
def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether spans and cleaned parts have the documents of p8_found, coverage is what the spans say and decides what is kept, and no passage stands in what is kept."""
    found, spans, cleaned = (staged(f(spark, d), "check") for f in (p8_found, p8_spans, p8_cleaned))
    ids = [x.select("doc_id", F.lit(1 << i).alias("b")).distinct() for i, x in enumerate((found, spans, cleaned))]
    same = ids[0].unionByName(ids[1]).unionByName(ids[2]).groupBy("doc_id").agg(F.sum("b").alias("b")).agg(F.count_if(F.col("b") != 7).alias("odd"))
    per = spans.groupBy("doc_id", "part").agg(F.sum("words").alias("w"))
    joined = cleaned.join(per, ["doc_id", "part"], "left")
    right = F.col("leaked_words").eqNullSafe(F.col("w")) & (F.col("coverage") == F.col("leaked_words") / F.col("words")) & ((F.col("coverage") > 0.5) == F.col("kept_text").isNull())
    wrong = joined.agg(F.count_if(~F.coalesce(right, F.lit(False))).alias("wrong"))
    # a line end in front makes it text without a header
    left = leaks(cleaned.select("doc_id", F.concat(F.lit("\n"), "kept_text").alias("t")), "doc_id", "t", _items(spark, d), "item_id", "passage").agg(F.count(F.lit(1)).alias("left"))
    one = [x.withColumn("one", F.lit(1)) for x in (same, wrong, left)]
    return one[0].join(one[1], "one").join(one[2], "one").select((F.col("odd") == 0).alias("same_documents"), (F.col("wrong") == 0).alias("coverage_right"), (F.col("left") == 0).alias("nothing_left"))


@R.query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_pieces(spark, d).where("piece = 0").select("doc_id")


@R.query("p9_pieces")
def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "documents"), "doc_id", "text")


@R.query("p9_check", "select true as within, true as covering, true as overlapping, true as counted")
def p9_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether each piece has at most 2,048 tokens, pieces begin and end with their text, each shares 128 tokens with the one before, and they are of the texts that have more
    tokens by p7_ids."""
    p = staged(p9_pieces(spark, d), "check")
    after = p.select("doc_id", (F.col("piece") + 1).alias("piece"), (F.col("first_token") + F.col("n_tokens") - 128).alias("begin"))
    # texts with one doc_id are told apart by nothing, and there are none here
    j = p.join(after, ["doc_id", "piece"], "left")
    ends = p.groupBy("doc_id").agg(F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.max("doc_tokens").alias("size"))
    n = p7_ids(spark, d).select("doc_id", F.size("ids").alias("n")).where("n > 2048")
    counted = n.join(ends, "doc_id", "full").agg(F.count_if(~F.col("n").eqNullSafe(F.col("size"))).alias("odd"), F.count_if(~F.col("end").eqNullSafe(F.col("n"))).alias("short"))
    begins = F.when(F.col("piece") == 0, F.col("first_token") == 0).otherwise(F.col("begin").eqNullSafe(F.col("first_token")))
    own = j.agg(F.count_if(F.col("n_tokens") > 2048).alias("large"), F.count_if(~begins).alias("apart"))
    both = own.withColumn("one", F.lit(1)).join(counted.withColumn("one", F.lit(1)), "one")
    return both.select((F.col("large") == 0).alias("within"), (F.col("short") == 0).alias("covering"), (F.col("apart") == 0).alias("overlapping"), (F.col("odd") == 0).alias("counted"))
