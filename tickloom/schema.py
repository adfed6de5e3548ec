"""Codes, column lists and settings of the order-book tables."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import types as T

# Codes in the event tables.
ADD, CANCEL, MODIFY, TRADE, CLEAR = 0, 1, 2, 3, 4
BID, ASK, NO_SIDE = 1, -1, 0
OUT_OF_RANGE, NEGATIVE_SIZE, CROSSED, LOCKED, BAD_SIZE = 1, 2, 4, 8, 16
QUEUE_MODELS = ("pessimistic", "proportional", "optimistic", "exact")
STRATEGIES = ("always_cross", "always_post", "model_direction", "model_cost", "new_level", "oracle")

DAY = ("instrument_id", "date")
EVENTS = T.StructType(
    [T.StructField("instrument_id", T.IntegerType()), T.StructField("date", T.DateType())]
    + [T.StructField(c, T.LongType()) for c in ("ts_event", "sequence")]
    + [T.StructField(c, T.IntegerType()) for c in ("action", "side")]
    + [T.StructField(c, T.LongType()) for c in ("price", "size", "queue_pos")]
)
EVENT_COLUMNS = tuple(EVENTS.fieldNames())
MS, SECOND, MINUTE = 1_000_000, 1_000_000_000, 60_000_000_000


@dataclass(frozen=True)
class Settings:
    """All tunable numbers; ``override`` rejects unknown names."""

    levels: int = 10
    price_window: int = 16_384
    slice_rows: int = 0  # 0: a day is folded in one piece
    windows_ms: tuple[int, ...] = (100, 1000, 5000)
    windows_events: tuple[int, ...] = (10, 50, 200)
    depth_levels: tuple[int, ...] = (3, 5, 10)
    vol_windows_s: tuple[int, ...] = (30, 300)
    horizons_s: tuple[int, ...] = (1, 5, 30)
    timezone: str = "America/New_York"
    session: tuple[str, str] = ("08:30", "15:00")
    release_minutes: int = 5
    max_gap_s: float = 2.0
    min_front_share: float = 0.85
    roll_buffer_days: int = 1
    imbalance_bins: int = 10
    laplace_alpha: float = 1.0
    sample_rows_per_day: int = 150_000
    reliability_bins: int = 15
    hac_lags: int = 50
    bootstrap_reps: int = 2000
    decisions_per_day: int = 2000
    deadlines_s: tuple[int, ...] = (5, 15, 30)
    latencies_ms: tuple[int, ...] = (0, 1, 10, 100)
    checkpoint_ms: int = 250
    headline: tuple[str, int, int] = ("proportional", 10, 15)
    new_level_share: float = 0.25
    thresholds: tuple[float, ...] = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80)
    cost_margin_ticks: float = 0.0
    tick_value_usd: float = 15.625
    fee_usd: float = 2.5
    fees_usd: tuple[float, ...] = (1.0, 2.5, 4.0)
    boost_rounds: int = 300
    boost_leaves: int = 31
    boost_rate: float = 0.05
    boost_l2: float = 1.0
    boost_least_rows: int = 200
    cost_rounds: int = 200
    min_train_days: int = 5
    test_block_days: int = 3

    def override(self, **values) -> Settings:
        unknown = set(values) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **values)


DEFAULT = Settings()
