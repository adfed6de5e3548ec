"""Limit-order-book reconstruction.

Every price level of a day is a running sum with a floor at zero: with S the
running sum since the last reset, the level is ``S - least(0, min S)``. Resets
are absolute sizes and clears. Single levels are window expressions; the whole
book after every event, which would multiply events by levels there, is a fold
of each day.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators import ladder
from tickloom.schema import ADD, ASK, BAD_SIZE, BID, CLEAR, CROSSED, DAY, DEFAULT, LOCKED, MODIFY, OUT_OF_RANGE, TRADE, Settings
from tickloom.sources.scratch import stored

#: Columns that the book adds to its events.
BOOK = {"row": T.LongType(), "bid_px": T.LongType(), "ask_px": T.LongType(), "bid_depth": T.ArrayType(T.LongType()), "ask_depth": T.ArrayType(T.LongType()), "book_flags": T.IntegerType()}
#: Rows of neighbouring slices that are folded together; a longer slice is folded by itself.
BLOCK = 1 << 13


def _day():
    return Window.partitionBy(*DAY).orderBy("sequence")


def _level():
    return Window.partitionBy(*DAY, "book_side", "price").orderBy("sequence")


def screened(events: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Events with ``row`` (dense number in the day), ``reject`` (0 or the flag of a refused event) and ``book_side``."""
    place = F.col("price") - F.col("first_price") + F.lit(cfg.price_window // 2)
    out = F.when(F.col("action") == CLEAR, 0).when((place < 0) | (place >= cfg.price_window), OUT_OF_RANGE)
    bad = (F.col("size") < 0) | ((F.col("size") == 0) & (F.col("action") != MODIFY))
    side = F.when(F.col("side") == BID, BID).otherwise(ASK)
    return events.withColumns({"row": F.row_number().over(_day()).cast("long"), "first_price": F.first("price").over(_day())}).withColumns(
        {"reject": out.when(bad, BAD_SIZE).otherwise(0), "book_side": F.when(F.col("action") == TRADE, -side).otherwise(side)}
    )


def level_states(events: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Size of the touched level before and after every accepted event; a clear touches all levels of its day."""
    rows = screened(events, cfg).filter("reject = 0").select(*DAY, "row", "sequence", "action", "book_side", "price", "size")
    touched = rows.filter(F.col("action") != CLEAR)
    clears = rows.filter(F.col("action") == CLEAR).select(*DAY, "row", "sequence", "action", F.lit(0).cast("long").alias("size"))
    levels = touched.select(*DAY, "book_side", "price").distinct()
    rows = touched.unionByName(clears.join(levels, [*DAY]))
    reset = F.col("action").isin(MODIFY, CLEAR)
    delta = F.when(F.col("action").isin(ADD, MODIFY), F.col("size")).when(F.col("action") == CLEAR, 0).otherwise(-F.col("size"))
    rows = rows.withColumns({"delta": delta, "segment": F.sum(F.when(reset, 1).otherwise(0)).over(_level())})
    inside = Window.partitionBy(*DAY, "book_side", "price", "segment").orderBy("sequence")
    rows = rows.withColumn("total", F.sum("delta").over(inside))
    rows = rows.withColumn("level", F.col("total") - F.least(F.lit(0), F.min("total").over(inside)))
    return rows.withColumn("before", F.coalesce(F.lag("level").over(_level()), F.lit(0))).drop("delta", "segment", "total")


def _columns(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Action, side, price, size and which prices are known."""
    column = lambda c, empty: table.column(c).combine_chunks().fill_null(empty).to_numpy(zero_copy_only=False).astype(np.int64)
    return column("action", -1), column("side", 0), column("price", 0), column("size", 0), table.column("price").is_valid().to_numpy(zero_copy_only=False)


def _in_order(table: pa.Table) -> pa.Table:
    return table.take(np.argsort(table.column("sequence").to_numpy(), kind="stable"))


def _with_book(table: pa.Table, found: dict[str, np.ndarray], levels: int, row: np.ndarray) -> pa.Table:
    n = table.num_rows
    px = [pa.array(found[f"{s}_px"], mask=~found[f"has_{s}"]) for s in ("bid", "ask")]
    depth = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * levels), pa.array(found[f"{s}_depth"].ravel())) for s in ("bid", "ask")]
    more = [pa.array(row), *px, *depth, pa.array(found["book_flags"].astype(np.int32))]
    return pa.table([*table.columns, *more], [*table.column_names, *BOOK])


def book_frame(events: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """The events with ``row`` and the book after each: ``bid_px``, ``ask_px`` (null: empty), dense depth arrays and ``book_flags``.

    A day of an instrument is one group: the days' number grows with the data,
    a day does not. Its rows meet in one exchange and are folded by array
    operations (:mod:`ladder`). Where ``cfg.slice_rows`` is set, longer days are
    folded in slices of about as many rows: see :func:`sliced_book_frame`.
    """
    if cfg.slice_rows:
        return sliced_book_frame(events, cfg.slice_rows, cfg)

    def day(table: pa.Table) -> pa.Table:
        table = _in_order(table)
        own = _columns(table)
        return _with_book(table, ladder.fold(*own, cfg.levels, cfg.price_window, ladder.first_price(own[2], own[4])), cfg.levels, np.arange(1, table.num_rows + 1))

    schema = T.StructType([*events.schema.fields, *(T.StructField(c, t) for c, t in BOOK.items())])
    return events.groupBy(*DAY).applyInArrow(day, schema)


def sliced(events: DataFrame, slice_rows: int) -> DataFrame:
    """Events with ``slice``, a stretch of sequence numbers of their day that holds about ``slice_rows`` rows, and the day's first row's ``first_price``."""
    days = events.groupBy(*DAY).agg(F.count(F.lit(1)).alias("n"), F.min("sequence").alias("lo"), F.max("sequence").alias("hi"), F.min_by(F.struct("price"), "sequence")["price"].alias("first_price"))
    days = days.withColumn("slices", F.ceil(F.col("n") / slice_rows))
    place = F.floor((F.col("sequence") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1) * F.col("slices"))
    return events.join(days, [*DAY]).withColumn("slice", F.least(place, F.col("slices") - 1)).drop("n", "lo", "hi", "slices")


def _block(slice_rows: int):
    """Number of the block of neighbouring slices that one group holds: about ``BLOCK`` rows, a slice at least."""
    return F.floor(F.col("slice") / max(1, BLOCK // slice_rows)).alias("block")


def slice_effects(cut: DataFrame, slice_rows: int, cfg: Settings = DEFAULT) -> DataFrame:
    """Effects of each slice on its levels (``book_side``, ``price``, ``gain``, ``least``, ``fixed``), and one row a slice without a side that has its ``n`` and ``cleared``."""

    def block(table: pa.Table) -> pa.Table:
        table = _in_order(table)  # a slice is a stretch of sequence numbers, so slices are in order too
        first = table.column("first_price")[0].as_py()
        part = table.column("slice").to_numpy()
        found = ladder.effects(*_columns(table), cfg.price_window, first, part)
        n, slices = len(found.gain), len(found.parts)
        key = [table.column(c).take(pa.array(np.zeros(n + slices, dtype=np.int64))) for c in DAY]
        one = lambda values, kind: pa.concat_arrays([pa.nulls(slices, kind), pa.array(values, type=kind)])
        each = lambda values, kind: pa.concat_arrays([pa.array(values, type=kind), pa.nulls(n, kind)])
        more = [one(x, pa.int64()) for x in (found.names[:, 0], found.names[:, 1], found.gain, found.least)] + [one(found.fixed, pa.bool_())]
        rows = np.diff(np.r_[np.searchsorted(part, found.parts), len(part)])
        return pa.table([*key, pa.array(np.r_[found.parts, found.part]), *more, each(rows, pa.int64()), each(found.cleared, pa.bool_())], [*DAY, "slice", "book_side", "price", "gain", "least", "fixed", "n", "cleared"])

    fields = ", ".join(f"{c} {cut.schema[c].dataType.simpleString()}" for c in (*DAY, "slice"))
    return cut.groupBy(*DAY, _block(slice_rows)).applyInArrow(block, f"{fields}, book_side long, price long, gain long, least long, fixed boolean, n long, cleared boolean")


def opening_levels(effects: DataFrame) -> DataFrame:
    """What each slice finds: the sizes of the levels that live before it, and the number of rows before it (``book_side`` 0).

    Effects compose: with A the sum of gains since the last fixed size, a level
    is A plus the greatest of 0 and of all ``least - A`` since then. A prefix
    over slices is therefore a running sum and a running maximum.
    """
    day = Window.partitionBy(*DAY).orderBy("slice")
    back = Window.partitionBy(*DAY).orderBy(F.desc("slice"))  # a frame that grows at its end, where one to the day's end is summed up anew for each row
    slices = effects.filter("book_side IS NULL").select(
        *DAY, "slice", F.sum("n").over(day.rowsBetween(Window.unboundedPreceding, -1)).alias("rows_before"), F.sum(F.col("cleared").cast("int")).over(day).alias("epoch"),
        F.min(F.when(F.col("cleared"), F.col("slice"))).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("next_clear"), F.max("slice").over(Window.partitionBy(*DAY)).alias("last"),
    )
    level = Window.partitionBy(*DAY, "book_side", "price", "epoch").orderBy("slice")
    rows = effects.filter("book_side IS NOT NULL").select(*DAY, "slice", "book_side", "price", "gain", "least", "fixed").join(slices, [*DAY, "slice"])
    rows = rows.withColumns({"stretch": F.sum(F.col("fixed").cast("int")).over(level), "next": F.lead("slice").over(level)})
    inside = Window.partitionBy(*DAY, "book_side", "price", "epoch", "stretch").orderBy("slice")
    rows = rows.withColumn("a", F.sum("gain").over(inside)).withColumn("size", F.col("a") + F.greatest(F.lit(0), F.max(F.col("least") - F.col("a")).over(inside)))
    until = F.least("next", "next_clear", "last")  # nulls do not count
    live = rows.filter((F.col("size") > 0) & (until > F.col("slice"))).select(*DAY, F.explode(F.sequence(F.col("slice") + 1, until)).alias("slice"), "book_side", "price", "size")
    return live.unionByName(slices.select(*DAY, "slice", F.lit(0).cast("long").alias("book_side"), F.lit(None).cast("long").alias("price"), F.coalesce("rows_before", F.lit(0)).alias("size")))


def sliced_book_frame(events: DataFrame, slice_rows: int, cfg: Settings = DEFAULT) -> DataFrame:
    """:func:`book_frame` by slices of a day, so that a day need not fit one worker; the same rows at any ``slice_rows``.

    Slices are folded apart twice: first what they do to any book before them,
    a row for each level they touch; then, with the sizes that a prefix over
    those rows gives, the book after every event. Short slices are folded many
    at a time, in the same array operations.
    """
    cut = sliced(events, slice_rows)
    openings = opening_levels(stored(slice_effects(cut, slice_rows, cfg), "slice-effects"))

    def block(table: pa.Table, opening: pa.Table) -> pa.Table:
        table = _in_order(table)
        first = table.column("first_price")[0].as_py() if table.num_rows else None
        part, of, side, price, size = (t.column(c).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False) for t, c in ((table, "slice"), (opening, "slice"), (opening, "book_side"), (opening, "price"), (opening, "size")))
        own, known = side != 0, np.flatnonzero(side == 0)
        found = ladder.fold_slices(*_columns(table), cfg.levels, cfg.price_window, first, part, (of[own], side[own], price[own], size[own]))
        known = known[np.argsort(of[known])]
        before = size[known][np.searchsorted(of[known], part)]
        row = before + np.arange(1, len(part) + 1) - np.searchsorted(part, part)
        return _with_book(table.drop_columns(["slice", "first_price"]), found, cfg.levels, row)

    schema = T.StructType([*events.schema.fields, *(T.StructField(c, t) for c, t in BOOK.items())])
    return cut.groupBy(*DAY, _block(slice_rows)).cogroup(openings.groupBy(*DAY, _block(slice_rows))).applyInArrow(block, schema)


def wide_depth(book: DataFrame, levels: int = DEFAULT.levels) -> DataFrame:
    """Depth arrays as columns ``bid_sz_i`` and ``ask_sz_i``."""
    return book.select("*", *(F.col("bid_depth")[i].alias(f"bid_sz_{i}") for i in range(levels)), *(F.col("ask_depth")[i].alias(f"ask_sz_{i}") for i in range(levels))).drop("bid_depth", "ask_depth")


def size_at(events: DataFrame, points: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Displayed size of the level of each point (day, ``book_side``, ``price``, ``sequence``) as of its sequence, 0 if none."""
    states = level_states(events, cfg).select(*DAY, "book_side", "price", "sequence", "level", F.lit(0).alias("kind"))
    asked = points.select(*DAY, "book_side", "price", "sequence", F.lit(None).cast("long").alias("level"), F.lit(1).alias("kind"))
    w = Window.partitionBy(*DAY, "book_side", "price").orderBy("sequence", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = states.unionByName(asked).withColumn("size_at", F.coalesce(F.last("level", ignorenulls=True).over(w), F.lit(0)))
    return both.filter("kind = 1").select(*DAY, "book_side", "price", "sequence", "size_at")


def vendor_flags(book: DataFrame) -> DataFrame:
    """Flags that follow from the prices alone, for feeds that come with a book."""
    return book.withColumn("book_flags", F.when(F.col("bid_px") > F.col("ask_px"), CROSSED).when(F.col("bid_px") == F.col("ask_px"), LOCKED).otherwise(0).cast("int"))
