"""Alerts that fire on silence, and counters that a running query reports.

An alert about missing data cannot be a query over rows. Each instrument keeps
a timer of the processing clock that every row sets anew; when it expires, the
alert is a row of the stream although none came in.
"""

from __future__ import annotations

import threading
import time

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

from tickloom.schema import TRADE
from tickloom.streaming.metrics import CHECKS

ALERTS = "instrument_id int, alert string, at_ms long, silent_ms long"
#: What Spark has to be told for timers: its default store of state has none.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Silence(StatefulProcessor):
    """``no_data`` after ``quiet_ms`` without a row within the session, ``endpoint_down`` after ``down_ms``, each once; ``resolved`` with the next row."""

    def __init__(self, quiet_ms: int, down_ms: int):
        self.quiet_ms, self.down_ms = quiet_ms, down_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("silence", "seen_ms long, raised string")

    def _row(self, key, alert: str, now: int, seen: int) -> pd.DataFrame:
        return pd.DataFrame({"instrument_id": pd.array([key[0]], dtype="int32"), "alert": [alert], "at_ms": [now], "silent_ms": [now - seen]})

    def handleInputRows(self, key, rows, timerValues):
        now, last = timerValues.getCurrentProcessingTimeInMs(), None
        for frame in rows:
            top = frame.sort_values("ts_event").iloc[-1]
            last = top if last is None or top.ts_event >= last.ts_event else last
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        before = self.state.get() if self.state.exists() else None
        self.state.update((now, ""))
        if last is not None and last.in_session:
            self.handle.registerTimer(now + self.quiet_ms)
        if before is not None and before[1]:
            yield self._row(key, "resolved", now, before[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentProcessingTimeInMs()
        seen, raised = self.state.get()
        if not raised:
            self.state.update((seen, "no_data"))
            self.handle.registerTimer(max(now, seen + self.down_ms))
            yield self._row(key, "no_data", now, seen)
        elif raised == "no_data":
            self.state.update((seen, "endpoint_down"))
            yield self._row(key, "endpoint_down", now, seen)

    def close(self) -> None:
        pass


def silence(stream: DataFrame, quiet_s: float = 5.0, down_s: float = 10.0) -> DataFrame:
    """Alerts (``ALERTS``) of a stream with ``instrument_id``, ``ts_event`` and ``in_session``; its session needs ``STATE_STORE``."""
    if not 0 < quiet_s < down_s:
        raise ValueError("an endpoint is down after it has been quiet")
    rows = stream.select("instrument_id", "ts_event", "in_session")
    return rows.groupBy("instrument_id").transformWithStateInPandas(Silence(int(quiet_s * 1000), int(down_s * 1000)), ALERTS, "Append", "ProcessingTime")


# ----------------------------------------------------------------- counters


def counters() -> dict[str, Column]:
    """What a trigger counts; the names are those of the batch metrics."""
    return {
        "events_total": F.count(F.lit(1)),
        "trades_total": F.count_if(F.col("action") == TRADE),
        **{f"data_quality_errors_total.{n}": F.count_if(F.col("book_flags").bitwiseAND(bit) > 0) for n, bit in CHECKS.items()},
        "market_timestamp_ns": F.max("ts_event"),
    }


def observed(stream: DataFrame, name: str) -> DataFrame:
    """``stream`` with :func:`counters` observed under ``name``; they cost no pass of their own."""
    return stream.observe(name, *(x.alias(k) for k, x in counters().items()))


class LiveCounters(StreamingQueryListener):
    """Counters of running queries, trigger by trigger: totals, the last market time, lag and the time a trigger took."""

    def __init__(self, name: str):
        self.name, self.totals, self.triggers = name, {}, []
        self._lock, self.ended = threading.Lock(), threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is None:
            return
        took = event.progress.durationMs.get("triggerExecution", 0) / 1000
        with self._lock:
            for key, value in found.asDict().items():
                if key == "market_timestamp_ns":
                    self.totals[key] = max(self.totals.get(key, value or 0), value or 0)
                else:
                    self.totals[key] = self.totals.get(key, 0) + value
            if found["events_total"]:
                self.triggers.append({"batch": event.progress.batchId, "events": found["events_total"], "seconds": took, "events_per_second": found["events_total"] / took if took else 0.0, "wall_timestamp_seconds": time.time()})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def metrics(self, spark: SparkSession) -> DataFrame:
        """The totals, and what the last trigger says, as ``metric`` and ``value``."""
        with self._lock:
            rows = [(k, float(v)) for k, v in self.totals.items()]
            rows += [(k, float(self.triggers[-1][k])) for k in ("events_per_second", "seconds", "wall_timestamp_seconds")] if self.triggers else []
        return spark.createDataFrame(rows, "metric string, value double")
