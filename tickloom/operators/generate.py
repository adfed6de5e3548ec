"""Synthetic order-book days: competing exponential clocks, one day a group.

A day is sequential by nature, so each (instrument, day) is one grouped task
and days run in parallel. The random stream is seeded by a hash of the day.
"""

from __future__ import annotations

import datetime
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.schema import ADD, ASK, BID, CANCEL, EVENT_COLUMNS, EVENTS, SECOND, TRADE

#: Events a second of each kind at one level: add, cancel, trade.
RATES, LEVELS, START = (6.0, 4.5, 1.5), 4, 30


def seed_of(*parts) -> int:
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def one_day(instrument: int, date: datetime.date, minutes: float, seed: int, mid: int = 1000) -> list[tuple]:
    """Events of a day: opening adds, then clocks whose rates follow the queues; an emptied touch moves the price."""
    draw = np.random.default_rng(seed_of(seed, instrument, date))
    bids, asks = {mid - i: START for i in range(LEVELS)}, {mid + 1 + i: START for i in range(LEVELS)}
    t, rows = 0, []

    def emit(action, side, price, size, pos=-1):
        rows.append((instrument, date, t, len(rows) + 1, action, side, price, size, pos))

    for side, levels in ((BID, bids), (ASK, asks)):
        for price, size in levels.items():
            emit(ADD, side, price, size)
    end = int(minutes * 60 * SECOND)
    while True:
        choices = [(side, price) for side, levels in ((BID, bids), (ASK, asks)) for price in sorted(levels)]
        rates = np.array([[RATES[0], RATES[1] * (bids if s == BID else asks)[p] / START, RATES[2] * (p == (max(bids) if s == BID else min(asks)))] for s, p in choices])
        t += int(draw.exponential(1 / rates.sum()) * SECOND) + 1
        if t >= end:
            return rows
        pick = int(np.searchsorted(np.cumsum(rates.ravel()), draw.random() * rates.sum(), side="right"))
        (side, price), kind = choices[min(pick, rates.size - 1) // 3], min(pick, rates.size - 1) % 3
        levels = bids if side == BID else asks
        size = int(draw.geometric(0.25))
        if kind == 0:
            levels[price] += size
            emit(ADD, side, price, size)
            continue
        size = min(size, levels[price])
        levels[price] -= size
        emit(TRADE if kind == 2 else CANCEL, -side if kind == 2 else side, price, size, 0 if kind == 2 else int(draw.integers(0, levels[price] + 1)))
        if not levels[price]:
            del levels[price]
            far = (min(bids) - 1) if side == BID else (max(asks) + 1)
            levels[far] = START
            emit(ADD, side, far, START)


def synthetic_days(spark: SparkSession, days: int, minutes: float, seed: int, instruments=(1, 2), first: str = "2026-08-17") -> DataFrame:
    """Events of ``days`` calendar days of each instrument, with the columns of ``schema.EVENTS``."""

    def make(group: pd.DataFrame) -> pd.DataFrame:
        rows = [r for i, d in zip(group["instrument_id"], group["date"], strict=True) for r in one_day(int(i), d, minutes, seed)]
        return pd.DataFrame(rows, columns=list(EVENT_COLUMNS))

    keys = spark.range(days).select(F.date_add(F.lit(first).cast("date"), F.col("id").cast("int")).alias("date"), F.explode(F.array(*map(F.lit, instruments))).alias("instrument_id"))
    return keys.groupBy("instrument_id", "date").applyInPandas(make, EVENTS)
