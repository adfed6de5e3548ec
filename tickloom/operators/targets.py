"""Forward-looking targets, one row an event."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.schema import DAY, DEFAULT, SECOND, Settings


def _rows():
    return Window.partitionBy(*DAY).orderBy("sequence")

#: Backwards in time, so that "the next start" is the last one seen.

def _back():
    return Window.partitionBy(*DAY).orderBy(F.desc("sequence")).rowsBetween(Window.unboundedPreceding, -1)


def _time():
    return Window.partitionBy(*DAY).orderBy("ts_event")


def with_targets(rows: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """``next_dir``, ``next_change_ms`` and ``ret_hs`` of rows that have ``mid``.

    The next change is the start of the next run of equal mids; a run after a
    one-sided gap counts even with the same mid, and then gives no direction.
    A return is null if its horizon ends after the day's last row.
    """
    start = F.col("mid").isNotNull() & ~F.col("mid").eqNullSafe(F.lag("mid").over(_rows()))
    rows = rows.withColumn("run_start", F.when(start, F.struct("ts_event", "mid")))
    rows = rows.withColumn("next_run", F.last("run_start", ignorenulls=True).over(_back()))
    moved = F.col("mid").isNotNull() & (F.col("next_run.mid") != F.col("mid"))
    columns = {
        "next_dir": F.when(moved, F.when(F.col("next_run.mid") > F.col("mid"), 1.0).otherwise(0.0)),
        "next_change_ms": F.when(moved, (F.col("next_run.ts_event") - F.col("ts_event")) / 1e6),
    }
    last = F.max("ts_event").over(Window.partitionBy(*DAY))
    for h in cfg.horizons_s:
        then = F.max(F.struct("ts_event", "sequence", "mid")).over(_time().rangeBetween(Window.unboundedPreceding, h * SECOND))
        columns[f"ret_{h}s"] = F.when(F.col("ts_event") + h * SECOND <= last, then["mid"] - F.col("mid"))
    return rows.withColumns(columns).drop("run_start", "next_run")
