"""The job ledger over a stream of events (an extension: batch is the main form).

Each micro-batch brings events; a job's state and its events live in typed state variables of the state store, and a
job that runs too long without news becomes pending again by a processing-time timer. The transitions and the order,
by batch and place in it, are those of the batch ledger, however micro-batches cut or shuffle the events. A stream may
start from the states of a batch ledger.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from korpuslab.operators.ledger import KEY, STALE_AFTER, TRANSITIONS
from korpuslab.schemas import _layout

OUTPUT = T.StructType([*(T.StructField(k, T.StringType()) for k in (*KEY, "status")), T.StructField("retry_count", T.IntegerType()), T.StructField("events", T.LongType())])
#: What a job is now, how many of its events were seen, and what it was before them, as of a batch of the ledger.
JOB = _layout("status string, retry_count int, events bigint, base_status string, base_retries int, base_batch bigint")
#: An event of a job; one made by a timer comes after the event it followed.
EVENT = _layout("batch bigint, seq bigint, made int, event string")
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def advance(status: str, retries: int, event: str) -> tuple[str, int]:
    """The state after one event; an event the state does not allow changes nothing."""
    needs, makes = TRANSITIONS.get(event, ("", ""))
    return (makes, retries + (event in ("retry", "failed"))) if (needs or "none") == status else (status, retries)


class Jobs(StatefulProcessor):
    """One job: its events in order on top of what it was."""

    def __init__(self, stale_after: float):
        self.stale_after = stale_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", JOB)
        self.events = handle.getListState("events", EVENT)

    def close(self) -> None:
        pass

    def _take(self, key: tuple, new: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        old = self.job.get() if self.job.exists() else ("none", 0, 0, "none", 0, -1)
        status, retries, _, base, base_retries, upto = old
        held = sorted(tuple(e) for e in self.events.get()) if self.events.exists() else []
        known = {e[:3] for e in held}
        new = sorted({e[:3]: e for e in new if e[0] > upto and e[:3] not in known}.values())
        if not new:
            return
        if held and new[0] < held[-1]:  # late: all events again, in order
            held, status, retries = sorted(held + new), base, base_retries
            for e in held:
                status, retries = advance(status, retries, e[3])
        else:
            held += new
            for e in new:
                status, retries = advance(status, retries, e[3])
        self.events.put(held)
        self.job.update((status, retries, len(held), base, base_retries, upto))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        if status == "running":
            self.handle.registerTimer(now + int(self.stale_after * 1000))
        if (status, retries) != tuple(old[:2]):
            yield pd.DataFrame([(*key, status, retries, len(held))], columns=OUTPUT.names)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(int(b), int(s), 0, e) for part in rows for b, s, e in zip(part["batch"], part["seq"], part["event"], strict=True)]
        yield from self._take(key, new, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = max((tuple(e) for e in self.events.get()), default=(self.job.get()[5] + 1, 0, 0, "")) if self.events.exists() else (self.job.get()[5] + 1, 0, 0, "")
        yield from self._take(key, [(last[0], last[1], last[2] + 1, "recovered")], timerValues.getCurrentProcessingTimeInMs())

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        row = initialState.iloc[0]
        status, retries = str(row["status"]), int(row["retry_count"])
        self.job.update((status, retries, 0, status, retries, int(row["batch"])))
        if status == "running":
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.stale_after * 1000))


def stream_states(events: DataFrame, stale_after: float = STALE_AFTER, initial: DataFrame | None = None, upto: int = 0) -> DataFrame:
    """A row for a job whenever its state has changed; its events count in the order of ``batch``, then ``seq``.

    Events with equal batch and seq are one event. ``initial`` holds states as of the ledger's batch ``upto``; events
    up to it are taken as counted. Without a column ``batch`` all events are of one. The session's state store must be
    RocksDB, which is set if it is not.
    """
    spark = events.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != _ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    rows = events if "batch" in events.columns else events.withColumn("batch", F.lit(upto + 1).cast("bigint"))
    start = None if initial is None else initial.select(*KEY, "status", "retry_count", F.lit(upto).cast("bigint").alias("batch")).groupBy(*KEY)
    return rows.select(*KEY, "batch", "seq", "event").groupBy(*KEY).transformWithStateInPandas(Jobs(stale_after), OUTPUT, "Update", "ProcessingTime", initialState=start)


def windowed_counts(events: DataFrame, at: str, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Events by kind in windows of event time; what comes later than the watermark allows is left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), "event").agg(F.count(F.lit(1)).alias("n"))
