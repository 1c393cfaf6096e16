"""The balance of a collection as a stream: counts and reservations in state, reservations that expire by a timer.

Events have a time (ts), a dimension and a value, a kind and a number n. A sample counts n for good. A reservation counts one
until it is committed, which makes it count for good, is rolled back, or expires when the watermark has passed ttl after it. A
change of a value is written to a versioned table; counts are read from there, and scores and lists derived from them.

A value that most samples have is dealt to SLOTS states by a hash of the event's id, and summed when it is read, so that no
task holds it alone; the events of a reservation meet in one state by its id. A state has a number and the open reservations.

Cases: events without a dimension or value are dropped; a commitment or rollback of a reservation that isn't open does nothing;
a reservation that is made twice is open once, from its last time on; events from before the watermark, which is late behind the
newest event of earlier batches, are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.versioned import VersionedTable

#: States of one value.
SLOTS = 16
CHANGES = "slot string, dimension string, value string, n long, reserved long, change long"
_STATE = "n long, change long, ids array<string>, until array<long>"


def _updates(ttl_ms: int):
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, change, ids, until = state.get if state.exists else (0, 0, [], [])
        held = dict(zip(ids, until, strict=True))
        if state.hasTimedOut:
            now = state.getCurrentWatermarkMs()
            held = {i: u for i, u in held.items() if u > now}
        else:
            rest = []
            for rows in batches:
                is_sample = rows["kind"] == "sample"
                n += int(rows.loc[is_sample, "n"].sum())
                rest.append(rows.loc[~is_sample, ["ts", "step", "kind", "reservation_id"]])
            # the few events of reservations, in their order
            for ts, _, kind, i in pd.concat(rest).sort_values(["ts", "step"]).itertuples(index=False):
                at = int(ts.timestamp() * 1000)
                if kind == "reserve":
                    held[i] = at + ttl_ms
                elif i in held and at <= held.pop(i) and kind == "commit":
                    n += 1
        change += 1
        state.update((n, change, list(held), list(held.values())))
        if held:
            state.setTimeoutTimestamp(max(min(held.values()), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"slot": ["/".join(map(str, key))], "dimension": [key[0]], "value": [key[1]], "n": [n], "reserved": [len(held)], "change": [change]})

    return update


def balance_changes(events: DataFrame, ttl: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """slot, dimension, value, n, reserved and change (how often the slot has changed), from a stream of events: id, ts,
    dimension, value, kind (sample, reserve, commit or rollback), reservation_id and n."""
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)
    step = F.when(F.col("kind") == "reserve", 0).otherwise(1)
    owner = F.when(F.col("kind") == "sample", F.col("id").cast("string")).otherwise(F.col("reservation_id"))
    rows = events.where("dimension is not null and value is not null and kind in ('sample', 'reserve', 'commit', 'rollback')").withWatermark("ts", late)
    rows = rows.select("ts", "dimension", "value", "kind", "reservation_id", F.coalesce("n", F.lit(1)).cast("long").alias("n"), step.alias("step"), F.pmod(F.xxhash64(owner), F.lit(SLOTS)).cast("int").alias("part"))
    return rows.groupBy("dimension", "value", "part").applyInPandasWithState(_updates(ttl_ms), CHANGES, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def balance_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, "slot", buckets=8)


def run_balance(events: DataFrame, path: str, ttl: str = "1 hour", late: str = "10 minutes") -> None:
    """Takes in all events that are there; a run that begins again goes on from its state."""

    def write(batch: DataFrame, number: int) -> None:
        table = balance_table(batch.sparkSession, f"{path}/table")
        if table.merge(batch, f"batch {number}", "change"):
            table.vacuum(3)

    out = balance_changes(events, ttl, late).writeStream.outputMode("update").option("checkpointLocation", f"{path}/state")
    out.foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def read_balance(spark: SparkSession, path: str, with_reserved: bool = True) -> DataFrame:
    """dimension, value and n (long) as the operators on counts take them, open reservations counted unless told otherwise."""
    schema = spark.createDataFrame([], CHANGES).schema
    rows = balance_table(spark, f"{path}/table").read(schema)
    n = F.sum(F.col("n") + F.col("reserved")) if with_reserved else F.sum("n")
    return rows.groupBy("dimension", "value").agg(n.alias("n")).where("n > 0")
