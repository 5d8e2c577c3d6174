"""The store as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratalog.operators.change_feed import DeleteVectorTable
from stratalog.operators.resolve import latest


def latest_stream(changes: DataFrame) -> DataFrame:
    """The newest entry of each key of a changelog stream, for complete or update mode."""
    return latest(changes)


def apply_stream(changes: DataFrame, table: DeleteVectorTable, checkpoint: str) -> StreamingQuery:
    """Applies a stream of changes to a table with delete vectors, a batch at a time, until what is there now has been read. The table's log holds
    the number of the last batch of each checkpoint, so a batch that is replayed after a failure isn't appended again."""

    def batch(df: DataFrame, n: int) -> None:
        table.apply(df, checkpoint, n)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def membership_stream(events: DataFrame, dead_after_ms: int = 5000) -> DataFrame:
    """Members of a stream of events (node_id, at timestamp, state, incarnation): node_id, state, incarnation, at_us, one row at each change.

    An event counts if its incarnation isn't below the member's; events are taken as they arrive, in order of time within an Arrow batch. A suspected node not heard of within dead_after_ms of processing
    time is dead. The state of a node is one row."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], s: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if s.hasTimedOut:
            _, inc, at = s.get
            s.update(("dead", inc, at))
            out.append(("dead", inc, at))
        else:
            held = s.get if s.exists else (None, -1, 0)
            for rows in batches:  # one after the other, so a node with many rows is never held whole
                for r in rows.sort_values(["at_us", "incarnation"], kind="stable").itertuples():
                    if r.incarnation >= held[1]:
                        if (r.state, r.incarnation) != held[:2]:
                            out.append((r.state, int(r.incarnation), int(r.at_us)))
                        held = (r.state, int(r.incarnation), int(r.at_us))
            s.update(held)
            if held[0] == "suspected":
                s.setTimeoutDuration(dead_after_ms)
        yield pd.DataFrame([(key[0], *o) for o in out], columns=["node_id", "state", "incarnation", "at_us"])

    e = events.where("node_id is not null and state is not null and incarnation is not null").select("node_id", F.unix_micros("at").alias("at_us"), "state", "incarnation")
    return e.groupBy("node_id").applyInPandasWithState(fold, "node_id string, state string, incarnation bigint, at_us bigint", "state string, incarnation bigint, at_us bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)
