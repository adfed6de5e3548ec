"""Replay of order-book events as a stream, with features that equal the batch ones.

Each book-day is a key with its own state: the previous touch, the last order
flows and the trades of the window. A trigger takes one slice of time, and the
slices follow each other at once or at a pace.
"""

from __future__ import annotations

import logging
import re
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.operators import positions
from tickloom.schema import BID, DAY, MS, TRADE
from tickloom.sources.scratch import scratch_root
from tickloom.streaming import source

LOG = logging.getLogger(__name__)
FEATURES = "instrument_id int, date date, sequence long, ts_event long, imbalance double, microprice double, ofi double, tfi double, latency_us double"
_STATE = "bid long, ask long, qb long, qa long, flows array<long>, trades array<struct<ts:long,signed:long>>, imbalance double, microprice double"


def _previous(x: np.ndarray, first) -> np.ndarray:
    return np.r_[np.nan if first is None else first, x[:-1]]


def _held(x: np.ndarray, valid: np.ndarray, before) -> np.ndarray:
    """``x`` where ``valid``, else the last valid one, at first the one held before."""
    last = np.maximum.accumulate(np.where(valid, np.arange(len(x)), -1))
    return np.where(last >= 0, x[np.maximum(last, 0)], np.nan if before is None else before)


def advance(rows: pd.DataFrame, state: tuple, events: int, window_ns: int) -> tuple[dict[str, np.ndarray], tuple]:
    """Features of a batch of one key's rows, in order, and the state behind them.

    Everything is array operations over the batch and what the state carries:
    the last touch, the last order flows and the trades of the window.
    """
    bid0, ask0, qb0, qa0, flows0, trades0, imbalance0, microprice0 = state
    bid, ask, qb, qa = (rows[c].to_numpy(dtype=float, na_value=np.nan) for c in ("bid_px", "ask_px", "qb", "qa"))
    ts, size = rows["ts_event"].to_numpy(dtype=np.int64), rows["size"].to_numpy(dtype=np.int64)
    both = ~np.isnan(bid) & ~np.isnan(ask)
    pb, pa, pqb, pqa = _previous(bid, bid0), _previous(ask, ask0), _previous(qb, qb0), _previous(qa, qa0)
    flow = np.where(bid >= pb, qb, 0) - np.where(bid <= pb, pqb, 0) - np.where(ask <= pa, qa, 0) + np.where(ask >= pa, pqa, 0)
    flow = np.where(both & ~np.isnan(pb) & ~np.isnan(pa), flow, 0).astype(np.int64)
    sums = np.r_[0, np.cumsum(np.r_[np.array(flows0 or [], dtype=np.int64), flow])]
    stop = np.arange(len(rows)) + len(flows0 or []) + 1
    ofi = sums[stop] - sums[np.maximum(0, stop - events)]
    trade = np.flatnonzero(rows["action"].to_numpy() == TRADE)
    signed = np.where(rows["side"].to_numpy()[trade] == BID, size[trade], -size[trade])
    old = np.array([(t["ts"], t["signed"]) if isinstance(t, dict) else tuple(t) for t in trades0 or []], dtype=np.int64).reshape(-1, 2)
    times, amounts = np.r_[old[:, 0], ts[trade]], np.r_[old[:, 1], signed]
    clock = np.maximum.accumulate(ts)
    until = len(old) + np.searchsorted(trade, np.arange(len(rows)), side="right")
    since = np.minimum(np.searchsorted(np.maximum.accumulate(times), clock - window_ns, side="right"), until)
    net, gross = np.r_[0, np.cumsum(amounts)], np.r_[0, np.cumsum(np.abs(amounts))]
    traded = gross[until] - gross[since]
    total = np.where(qb + qa > 0, qb + qa, 1)
    out = {
        "imbalance": _held(np.where(qb + qa > 0, (qb - qa) / total, 0), both, imbalance0),
        "microprice": _held(np.where(qb + qa > 0, (bid * qa + ask * qb) / total - 0.5 * (bid + ask), 0), both, microprice0),
        "ofi": ofi.astype(float),
        "tfi": np.where(traded > 0, (net[until] - net[since]) / np.maximum(traded, 1), 0.0),
    }
    whole = lambda x: None if np.isnan(x) else int(x)
    number = lambda x: None if np.isnan(x) else float(x)
    left = list(zip(times[since[-1] :].tolist(), amounts[since[-1] :].tolist(), strict=True))
    flows = [*(flows0 or []), *flow.tolist()][-events:]
    return out, (*map(whole, (bid[-1], ask[-1], qb[-1], qa[-1])), flows, left, number(out["imbalance"][-1]), number(out["microprice"][-1]))


def stream_features(book: DataFrame, events: int = 50, window_ms: int = 1000) -> DataFrame:
    """Imbalance and microprice (the last valid ones are held), order flow and trade imbalance of a streaming book.

    A key's rows of one trigger are worked on together; ``latency_us`` is the
    time that took, shared out evenly over them.
    """

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState):
        began = time.perf_counter()
        rows = pd.concat(list(frames)).sort_values("sequence")
        held = state.get if state.exists else (None, None, None, None, [], [], None, None)
        found, after = advance(rows, held, events, window_ms * MS)
        state.update(after)
        out = pd.DataFrame({c: rows[c].to_numpy() for c in ("sequence", "ts_event")} | found)
        for name, value in zip(DAY, key, strict=True):
            out.insert(0, name, value)
        out["latency_us"] = (time.perf_counter() - began) * 1e6 / len(rows)
        yield out[[c.split()[0] for c in FEATURES.split(", ")]]

    return book.groupBy(*DAY).applyInPandasWithState(update, FEATURES, _STATE, "append", GroupStateTimeout.NoTimeout)


def replayed(table: DataFrame, plan, name: str, slices: int = 4, speed: float | None = None) -> DataFrame:
    """Stream ``table`` through ``plan`` in the order of time and return what the sink has.

    The table is numbered and written once; a trigger takes one of ``slices``
    equal stretches of it, or with a ``speed`` what is due by then. The sink is
    Parquet with a checkpoint, so a replay that is interrupted goes on where it
    stopped. What a trigger of a paced replay takes goes to the log.
    """
    if speed is not None:
        pace(0, speed)
    spark = table.sparkSession
    root = f"{scratch_root(spark).rstrip('/')}/replay-{name}-{uuid.uuid4().hex}"
    rows = positions.Slices(table, "ts_event", *DAY, "sequence")
    first = rows.table().agg(F.min("ts_event")).first()[0] or 0 if speed is not None else 0
    stream = source.read_slices(spark, rows, f"{root}/progress", max(1, -(-rows.count // slices)), speed, first)
    out = plan(stream.drop("position"))
    query = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/log").start()
    try:
        drained(query, rows.count)
    finally:
        query.stop()
    return spark.read.schema(out.schema).parquet(f"{root}/out") if rows.count else spark.createDataFrame([], out.schema)


def drained(query, total: int) -> None:
    """Wait until a query on a numbered source has taken all its rows; what ends the query before is raised."""
    at, batch = 0, -1
    while at < total:
        query.processAllAvailable()
        said = query.lastProgress
        if said and said["batchId"] != batch and said["sources"][0]["endOffset"]:
            end, batch = said["sources"][0]["endOffset"], said["batchId"]
            at = max(at, int(re.search(r"\d+", str(end)).group()))  # the offset is one number
            LOG.info("%d of %d rows", at, total)
        elif at < total:
            time.sleep(0.05)


def pace(offset_ns: int, speed: float) -> float:
    """Seconds of wall time at which an event is due; a speed of zero or less is an error."""
    if speed <= 0:
        raise ValueError("speed must be positive")
    return offset_ns / 1e9 / speed


def bounded(rows: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Rows from ``start`` on and before ``end``."""
    if start is not None:
        rows = rows.filter(F.col("ts_event") >= start)
    return rows if end is None else rows.filter(F.col("ts_event") < end)
