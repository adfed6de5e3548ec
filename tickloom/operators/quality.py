"""Data-quality counters, session windows, contract rolls and calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.schema import BAD_SIZE, CLEAR, CROSSED, DAY, DEFAULT, LOCKED, NEGATIVE_SIZE, OUT_OF_RANGE, SECOND, Settings


def local_ns(date: Column, clock: str, zone: str = DEFAULT.timezone) -> Column:
    """UTC microseconds of a local wall-clock time, which the fixtures read as nanoseconds."""
    return F.unix_micros(F.to_utc_timestamp(F.concat(date.cast("string"), F.lit(f" {clock}:00")), zone))


def with_session(rows: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """``open_ns``, ``close_ns`` and ``in_session`` (open <= time < close)."""
    rows = rows.withColumns({"open_ns": local_ns(F.col("date"), cfg.session[0]), "close_ns": local_ns(F.col("date"), cfg.session[1])})
    return rows.withColumn("in_session", (F.col("ts_event") >= F.col("open_ns")) & (F.col("ts_event") < F.col("close_ns")))


def with_release_flag(rows: DataFrame, releases: DataFrame, width_ns: int) -> DataFrame:
    """``in_release_window``: the time lies in [release - width, release + width) of any release.

    Times meet by stretches of twice the width, of which a release lies in two
    at most, so a row sees the releases near it only and rows are not multiplied.
    """
    stretch = lambda t: F.round((t - F.pmod(t, F.lit(2 * width_ns))) / (2 * width_ns)).cast("long")
    near = releases.filter("ts_ns IS NOT NULL").select("ts_ns", F.explode(F.sequence(stretch(F.col("ts_ns") - width_ns), stretch(F.col("ts_ns") + width_ns))).alias("__stretch"))
    near = near.groupBy("__stretch").agg(F.collect_set("ts_ns").alias("__releases"))
    hit = F.exists("__releases", lambda r: (F.col("ts_event") >= r - width_ns) & (F.col("ts_event") < r + width_ns))
    rows = rows.withColumn("__stretch", stretch(F.col("ts_event"))).join(near, "__stretch", "left")
    return rows.withColumn("in_release_window", F.coalesce(hit, F.lit(False))).drop("__releases", "__stretch")


def deduplicated(events: DataFrame) -> DataFrame:
    """Exact duplicates (all columns) removed."""
    return events.dropDuplicates()


def day_counters(raw: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Counters of one raw table by day; ``arrival`` is the order in the file.

    Times are compared after duplicates are gone and before sorting; sequence
    numbers are compared in order. A size of zero is bad but for clears, also
    where a modification may set it.
    """
    keys = [c for c in raw.columns if c != "arrival"]
    total = raw.groupBy(*DAY).agg(F.count(F.lit(1)).alias("raw_rows"))
    rows = raw.groupBy(*keys).agg(F.min("arrival").alias("arrival"))
    day = Window.partitionBy(*DAY)
    rows = rows.withColumns({"dt": F.col("ts_event") - F.lag("ts_event").over(day.orderBy("arrival")), "ds": F.col("sequence") - F.lag("sequence").over(day.orderBy("sequence", "arrival"))})
    gap = F.col("ds") > 1
    found = rows.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("dt") < 0).alias("out_of_order"), F.count_if(gap).alias("sequence_gaps"),
        F.coalesce(F.sum(F.when(gap, F.col("ds") - 1)), F.lit(0)).alias("missing_sequences"), F.count_if((F.col("size") <= 0) & (F.col("action") != CLEAR)).alias("bad_sizes"),
    )
    return total.join(found, [*DAY]).withColumn("duplicates", F.col("raw_rows") - F.col("rows"))


def flag_counts(book: DataFrame) -> DataFrame:
    """Rows of each day by book flag."""
    has = lambda bit: F.count_if(F.col("book_flags").bitwiseAND(bit) > 0)
    return book.groupBy(*DAY).agg(*(has(b).alias(n) for b, n in ((OUT_OF_RANGE, "out_of_range"), (NEGATIVE_SIZE, "negative_sizes"), (CROSSED, "crossed"), (LOCKED, "locked"), (BAD_SIZE, "flagged_bad_sizes"))), F.count(F.lit(1)).alias("rows"))


def session_gaps(rows: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Gaps longer than ``max_gap_s`` between session rows, and the longest in seconds."""
    rows = rows.filter("in_session").withColumn("gap", F.col("ts_event") - F.lag("ts_event").over(Window.partitionBy(*DAY).orderBy("ts_event", "sequence")))
    return rows.groupBy(*DAY).agg(F.count_if(F.col("gap") > int(cfg.max_gap_s * SECOND)).alias("gaps"), F.round(F.coalesce(F.max("gap"), F.lit(0)) / float(SECOND), 3).alias("longest_gap_s"))


def verdicts(counts: DataFrame, crossed_share: float = 0.001) -> DataFrame:
    """``verdict`` of each day: why it is refused, or ``ok``."""
    bad = F.when(F.col("rows") == 0, "empty").when(F.col("crossed") > F.col("rows") * crossed_share, "crossed").when(F.col("out_of_range") > 0, "out of range")
    return counts.withColumn("verdict", bad.otherwise("ok"))


def front_contracts(volume: DataFrame) -> DataFrame:
    """Contract with the largest volume of each date (the smaller id among equals) and its share."""
    best = F.max(F.struct("volume", (-F.col("instrument_id")).alias("minus")))
    return volume.groupBy("date").agg(best.alias("b"), F.sum("volume").alias("total")).select("date", (-F.col("b.minus")).alias("front"), (F.col("b.volume") / F.col("total")).alias("share"))


def roll_days(volume: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Dates with ``is_roll``: a small front share, or a change of front within the buffer of trading days.

    The window runs over dates, a few hundred rows a year.
    """
    days = Window.orderBy("date")
    rows = front_contracts(volume).withColumn("changed", F.coalesce(F.col("front") != F.lag("front").over(days), F.lit(False)))
    near = F.max("changed").over(days.rowsBetween(-cfg.roll_buffer_days, cfg.roll_buffer_days))
    return rows.withColumn("is_roll", (F.col("share") < cfg.min_front_share) | near)


def trading_days(rows: DataFrame, date: str, holidays: list[str]) -> DataFrame:
    """Weekdays from the first to the last ``date`` of ``rows`` that are no holidays; none for an empty table."""
    ends = rows.agg(F.min(date).alias("first"), F.max(date).alias("last")).filter("first IS NOT NULL")
    days = ends.select(F.explode(F.sequence("first", "last")).alias("date"))
    return days.filter((F.dayofweek("date").between(2, 6)) & ~F.col("date").cast("string").isin(*holidays))


class BadDays(ValueError):
    """Days that must not be worked on."""


def enforce(counts: DataFrame, most_shown: int = 20) -> None:
    """Raise :class:`BadDays` if :func:`verdicts` refuses any day of ``counts`` (:func:`flag_counts`)."""
    bad = verdicts(counts).filter("verdict <> 'ok'").select(*DAY, "verdict").orderBy(*DAY)
    shown = bad.limit(most_shown).collect()
    if shown:
        raise BadDays("; ".join(f"{r[0]} {r[1]}: {r[2]}" for r in shown) + ("; and more" if len(shown) == most_shown else ""))


def check_definitions(definitions: DataFrame, expected: float, column: str = "tick_size") -> DataFrame:
    """Distinct tick sizes, to nine places, with ``ok`` where they are the expected one; a null is not."""
    sizes = definitions.select(F.round(F.col(column).cast("double"), 9).alias(column)).distinct()
    return sizes.withColumn("ok", F.col(column).eqNullSafe(F.round(F.lit(float(expected)), 9)))


def verify_tick_size(definitions: DataFrame, expected: float, column: str = "tick_size") -> None:
    """Raise if the definitions have another tick size than ``expected``, or none."""
    found = check_definitions(definitions, expected, column)
    n, good = found.agg(F.count(F.lit(1)), F.count_if("ok")).first()
    if n != 1 or good != 1:
        raise ValueError(f"tick sizes {sorted(str(r[0]) for r in found.limit(20).collect())} are not {expected}")
