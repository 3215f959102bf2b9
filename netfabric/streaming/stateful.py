"""Keyed state on streams: devices that fall silent, and principals above their rate.

The state functions are local, so that they travel with the plan.  State is bounded by
time: one value per device, and two windows of milliseconds per principal and bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.streaming.state import GroupStateTimeout

from netfabric.functions.ids import DEFAULT_TENANT, text
from netfabric.functions.net import short_host
from netfabric.operators.audit import RATE_WINDOW_SECONDS
from netfabric.operators.liveness import STALENESS_HOURS
from netfabric.operators.upsert import upsert_table
from netfabric.streaming.streams import _start

SILENCE_LATENESS = "1 minute"
CALL_LATENESS = "10 minutes"
STATUS_KEYS = ["name"]
CALL_KEYS = ["principal", "ts"]


def _newest_per_batch(seen: DataFrame) -> DataFrame:
    """At most one row per device and Arrow batch, so that a hot device sends few rows."""
    def reduce_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.sort_values(["timestamp", "provider"]).drop_duplicates("name", keep="last")

    return seen.mapInPandas(reduce_batches, "name string, provider string, timestamp timestamp")


def _silence_processor(budget_ms: int) -> StatefulProcessor:
    class Silence(StatefulProcessor):
        """One value per device: its provider, its newest event and whether it is silent."""

        def init(self, handle) -> None:
            self.handle = handle
            self.seen = handle.getValueState("seen", "provider string, last_ms long, stale boolean")

        def _row(self, key, provider, last_ms, stale, changed) -> pd.DataFrame:
            return pd.DataFrame({
                "name": [key[0]], "provider": pd.Series([provider], dtype=object), "last_ms": pd.Series([last_ms], dtype="Int64"),
                "stale": [stale], "changed": [changed],
            })

        def handleInitialState(self, key, initialState, timerValues) -> None:
            self.seen.update((initialState["provider"].iloc[0], None, False))
            # Expected and never heard: told as soon as the stream has a time.
            self.handle.registerTimer(1)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            known, old, stale = self.seen.get() if self.seen.exists() else (None, None, True)
            best = (old if old is not None else -1, known or "")
            for pdf in rows:
                best = max(best, *zip(pdf["ms"].astype("int64").tolist(), pdf["provider"].fillna("").tolist(), strict=True))
            last, provider = best
            if old is not None and (last, provider) == (old, known or ""):
                return
            if old != last:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(last + budget_ms)
            self.seen.update((provider, last, False))
            yield self._row(key, provider, last, False, bool(stale or old is None))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            if self.seen.exists():
                provider, last, stale = self.seen.get()
                if not stale:
                    self.seen.update((provider, last, True))
                    yield self._row(key, provider, last, True, True)

        def close(self) -> None:
            pass

    return Silence()


def silence_stream(
    events: DataFrame, expected: DataFrame, *, staleness_hours: float = STALENESS_HOURS, tenant: str | None = DEFAULT_TENANT,
    lateness: str = SILENCE_LATENESS,
) -> DataFrame:
    """``(name, provider, last_event, stale, changed)``: a row when a device speaks, and one when its budget passes.

    ``expected`` is ``(name, provider)``, one row per device that should log; those that
    never spoke are told as silent as soon as the stream has a time.  The newest row of
    each device is its status as of the watermark.  ``changed`` marks where the status
    turns.  Events without a host name or a time are left out.  A timer per device lies in
    the state store, so the stream needs the RocksDB state store provider; for update mode.
    """
    mine = events if tenant is None else events.filter(F.col("tenant_id") == tenant)
    seen = mine.filter((text("observer_hostname") != "") & F.col("timestamp").isNotNull()).select(
        short_host("observer_hostname").alias("name"), F.col("event_provider").alias("provider"), F.col("timestamp").cast("timestamp").alias("timestamp"))
    newest = _newest_per_batch(seen).withWatermark("timestamp", lateness).withColumn("ms", F.unix_millis("timestamp"))
    known = expected.select("name", F.col("provider").cast("string").alias("provider")).dropDuplicates(["name"])
    told = newest.groupBy("name").transformWithStateInPandas(
        statefulProcessor=_silence_processor(int(staleness_hours * 3_600_000)), outputStructType="name string, provider string, last_ms long, stale boolean, changed boolean",
        outputMode="Update", timeMode="EventTime", initialState=known.groupBy("name"),
    )
    return told.select("name", "provider", F.timestamp_millis("last_ms").alias("last_event"), "stale", "changed")


def start_silence(events: DataFrame, expected: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """Keeps the newest status per device in the table at ``path``."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        # A device that speaks and falls silent in one batch is silent.
        turn = F.struct(F.coalesce(F.unix_millis("last_event"), F.lit(-1)), "stale")
        rows = batch.groupBy("name").agg(F.max_by(F.struct("provider", "last_event", "stale", "changed"), turn).alias("s")).select("name", "s.*")
        upsert_table(rows.withColumns({"batch": F.lit(batch_id).cast("long"), "part": F.lit(0)}), path, STATUS_KEYS, ["batch"], ["part"])

    return _start(silence_stream(events, expected, **options), checkpoint, handle, "update", trigger)


def trailing_calls_stream(
    audit: DataFrame, window_seconds: int = RATE_WINDOW_SECONDS, max_calls: int = 0, lateness: str = CALL_LATENESS,
) -> DataFrame:
    """``(principal, ts, calls, calls_in_window, breach)`` of :func:`calls_in_trailing_window` on a stream, for update mode.

    Exact to the millisecond.  A call that comes late, but not behind the watermark, gives
    new rows for all call times whose window holds it; the newest row of a principal and
    time has the largest counts.  As in the batch form a call goes to its bucket of one
    window and to the next one as context, so a busy principal is spread over tasks, and
    the state of a bucket, two windows of counts at most, goes when the watermark passes it.
    Calls without a time are left out.
    """
    width = int(window_seconds * 1000)

    def count(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new, fresh = np.unique(np.concatenate([pdf["ms"].to_numpy(np.int64) for pdf in batches]), return_counts=True)
        old, held = (np.frombuffer(b, np.int64) for b in state.get) if state.exists else (new[:0], fresh[:0])
        times, place = np.unique(np.concatenate([old, new]), return_inverse=True)
        calls = np.zeros(len(times), np.int64)
        np.add.at(calls, place, np.concatenate([held, fresh]))
        upto = np.concatenate([[0], np.cumsum(calls)])
        inside = upto[1:] - upto[np.searchsorted(times, times - width, "right")]
        touched = np.searchsorted(new, times, "right") > np.searchsorted(new, times - width, "right")
        bucket = int(key[1])
        state.update((times.tobytes(), calls.tobytes()))
        state.setTimeoutTimestamp(max((bucket + 1) * width, state.getCurrentWatermarkMs() + 1))
        own = touched & (times >= bucket * width)
        yield pd.DataFrame({"principal": pd.Series([key[0]] * int(own.sum()), dtype=object), "ms": times[own], "calls": calls[own], "calls_in_window": inside[own]})

    shift = F.explode(F.array(F.lit(0), F.lit(1)))
    dealt = audit.filter(F.col("ts").isNotNull()).withWatermark("ts", lateness).select(
        "principal", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), shift.alias("shift")
    ).withColumn("bucket", F.floor(F.col("ms") / width) + F.col("shift"))
    counted = dealt.groupBy("principal", "bucket").applyInPandasWithState(
        count, "principal string, ms long, calls long, calls_in_window long", "times binary, calls binary", "update", GroupStateTimeout.EventTimeTimeout)
    return counted.select(
        "principal", F.timestamp_millis("ms").alias("ts"), "calls", "calls_in_window",
        (F.lit(max_calls > 0) & (F.col("calls_in_window") > max_calls)).alias("breach"),
    )


def start_trailing_calls(audit: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """Merges the counts into the table at ``path``, by day of the call."""
    def handle(batch: DataFrame, _batch_id: int) -> None:
        upsert_table(batch.withColumn("call_date", F.to_date("ts")), path, CALL_KEYS, ["calls_in_window", "calls"], ["call_date"])

    return _start(trailing_calls_stream(audit, **options), checkpoint, handle, "update", trigger)
