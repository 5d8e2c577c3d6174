"""Membership: merging of state updates, and the suspicion timer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators.ordered import following, parts_of


def merge_updates(updates: DataFrame) -> DataFrame:
    """The member list after updates (node_id, address, state, incarnation, seq): an update counts if its incarnation isn't below the member's,
    so the highest incarnation wins and, within it, the latest seq. Nodes that never came with an address are ignored; the address is the
    latest one given. Rows without node_id, state or incarnation say nothing."""
    u = updates.where(F.col("node_id").isNotNull() & F.col("state").isNotNull() & F.col("incarnation").isNotNull())
    got = u.groupBy("node_id").agg(F.max(F.struct("incarnation", "seq", "state")).alias("s"), F.max(F.when(F.col("address").isNotNull(), F.struct("seq", "address"))).alias("a"))
    return got.where(F.col("a").isNotNull()).select("node_id", F.col("a.address").alias("address"), F.col("s.state").alias("state"), F.col("s.incarnation").alias("incarnation"))


def alive(members: DataFrame) -> DataFrame:
    return members.where(F.lower(F.trim("state")) == "alive")


def timeouts(events: DataFrame, now_us: int, dead_after_us: int = 5_000_000) -> DataFrame:
    """States of the events (node_id, at_us, state: alive or suspected) as they stand when timers run: node_id, at_us, state, dead_at_us.

    A suspected node that isn't heard of as alive within dead_after_us is dead from then on; dead_at_us is null where that didn't happen by now_us.
    Events of a node at one time are each followed by the other. The next event is found over range partitions, so a node may have any
    number of events."""
    nxt = F.when(F.col("next.node_id").eqNullSafe(F.col("node_id")), F.col("next.at_us"))
    due = F.col("at_us") + dead_after_us
    dead = (F.col("state") == "suspected") & (due < F.coalesce(F.col("next_us"), F.lit(now_us)))
    return following(events.select("node_id", "at_us", "state"), ["node_id", "at_us"], "next").withColumn("next_us", nxt).select("node_id", "at_us", "state", F.when(dead, due).alias("dead_at_us"))


def random_members(members: DataFrame, n: int, seed: int, exclude: str | None = None) -> DataFrame:
    """n live members in random order (a probe's target, or its relays), the same for the same seed and members. exclude: the asking node."""
    rows = alive(members)
    if exclude is not None:
        rows = rows.where(F.col("node_id") != exclude)
    return rows.orderBy(F.md5(F.concat_ws("/", F.lit(seed).cast("string"), "node_id")), "node_id").limit(n)


def replay_events(events: DataFrame) -> DataFrame:
    """The members after events (node_id, seq, kind, state, incarnation, address): node_id, address, state, incarnation, changes.

    In the order of seq, unique within a node: ``join`` makes the node alive at incarnation 0 with the event's address, ``leave`` turns it to left, ``ack`` brings a
    suspected one back as alive with the event's incarnation, and ``update`` counts if its incarnation isn't below the member's, or if the node isn't known
    and the event has an address. Others, and events without a node, say nothing; nodes that never became members don't come out. changes counts the
    events that counted. A node's events stream through one task in order, which holds one member."""
    n = parts_of(events.sparkSession)
    rows = events.where(F.col("node_id").isNotNull()).select("node_id", "seq", "kind", "state", F.col("incarnation").cast("bigint").alias("incarnation"), "address").repartition(n, "node_id").sortWithinPartitions("node_id", "seq")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, member, changes = None, None, 0  # member: address, state, incarnation

        def made(out: list[tuple]) -> pa.RecordBatch:
            types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["node_id", "address", "state", "incarnation", "changes"])

        for b in batches:
            out = []
            for who, kind, state, inc, address in zip(*(b.column(c).to_pylist() for c in ("node_id", "kind", "state", "incarnation", "address")), strict=True):
                if who != node:
                    if member:
                        out.append((node, *member, changes))
                    node, member, changes = who, None, 0
                was = member
                if kind == "join":
                    member = address, "alive", 0
                elif kind == "leave" and member:
                    member = member[0], "left", member[2]
                elif kind == "ack" and member and member[1] == "suspected":
                    member = member[0], "alive", inc
                elif kind == "update" and inc is not None and state is not None:
                    if member and inc >= (member[2] or 0):
                        member = member[0], state, inc
                    elif not member and address is not None:
                        member = address, state, inc
                changes += member is not was
            yield made(out)
        if member:
            yield made([(node, *member, changes)])

    return rows.mapInArrow(fold, "node_id string, address string, state string, incarnation bigint, changes bigint")
