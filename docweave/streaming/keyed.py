"""Keyed state in a stream: decisions per region, attempts counted, retries by timers.

State lives in the stream's state store, one value and one list a key, and not in a table that every batch rewrites: a batch
costs what is new, whatever has gone before. A restart goes on from the checkpoint, each event counts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "attempts long, latest long, decision string, accepted long, batch long"
OUTPUT = "region_id {key}, kind string, version long, attempts long, event_no long, decision string, pending long"


class Decisions(StatefulProcessor):
    """For each region its number of events, the latest one, and the rejected ones after the last that was accepted.

    Events may come in any order: the latest is the one with the largest number. With ``backoff`` (milliseconds), a region
    with something pending is due again after backoff * 2^(attempts - 1), on the stream's clock; an accepted event ends that.
    """

    def __init__(self, backoff: int = 0, longest: int = 3_600_000):
        self.backoff, self.longest = backoff, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)
        self.rejected = handle.getListState("rejected", "event_no long")

    def _told(self, key: Any, kind: str, state: tuple, pending: int) -> pd.DataFrame:
        attempts, latest, decision, _, version = state
        return pd.DataFrame({"region_id": [key[0]], "kind": [kind], "version": [version], "attempts": [attempts], "event_no": [latest], "decision": [decision], "pending": [pending]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        attempts, latest, decision, accepted, version = self.state.get() if self.state.exists() else (0, -(2**62), "", -(2**62), 0)
        pending = [r[0] for r in self.rejected.get()] if self.rejected.exists() else []
        for part in rows:
            attempts += len(part)
            last = part.loc[part["event_no"].idxmax()]
            if last["event_no"] > latest:
                latest, decision = int(last["event_no"]), last["decision"]
            fine = part["decision"] == "accepted"
            accepted = max([accepted, *(int(x) for x in part.loc[fine, "event_no"])])
            pending += [int(x) for x in part.loc[~fine, "event_no"]]
        pending = sorted(x for x in pending if x > accepted)
        state = (attempts, latest, decision, accepted, version + 1)
        self.state.update(state)
        self.rejected.put([(x,) for x in pending]) if pending else self.rejected.clear()
        if self.backoff:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if pending:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + min(self.longest, self.backoff << min(attempts - 1, 40)))
        yield self._told(key, "state", state, len(pending))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        pending = len(list(self.rejected.get())) if self.rejected.exists() else 0
        if pending:
            yield self._told(key, "retry", self.state.get(), pending)

    def close(self) -> None:
        pass


def decisions(events: DataFrame, backoff: int = 0, longest: int = 3_600_000) -> DataFrame:
    """A row of each region that a batch has touched, and with ``backoff`` one of each that is due again.

    ``events`` is a stream of (region_id, event_no, decision), without nulls. ``version`` counts a region's rows: the one
    with the largest is its state.
    """
    rows = events.select("region_id", "event_no", "decision").where("region_id is not null and event_no is not null and decision is not null")
    key = events.schema["region_id"].dataType.simpleString()
    return rows.groupBy("region_id").transformWithStateInPandas(Decisions(backoff, longest), OUTPUT.format(key=key), "Append", "ProcessingTime" if backoff else "None")


def run_decisions(spark: SparkSession, events: DataFrame, out: str, checkpoint: str, backoff: int = 0, **trigger: Any) -> StreamingQuery:
    """Write the rows of ``decisions`` below ``out``; by default everything that is new, then stop."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STORE)
    try:
        return decisions(events, backoff).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
