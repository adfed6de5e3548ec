"""Metrics of a replay as of a clock, alerts over them, and their text form.

A metric is a row (``instrument_id``, ``metric``, ``label``, ``value``).
Counters end in ``_total``; a histogram has a row for each bound, cumulative.
Latest values are aggregates (the value of the last event), so no step needs
the rows of an instrument in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.schema import CROSSED, LOCKED, NEGATIVE_SIZE, OUT_OF_RANGE, SECOND, TRADE

#: Upper bounds of the latency histogram, in seconds.
LATENCY_BOUNDS = (1e-6, 5e-6, 1e-5, 5e-5, 1e-4, 5e-4, 1e-3, 5e-3, 1e-2, 5e-2)
CHECKS = {"crossed_book": CROSSED, "locked_book": LOCKED, "negative_size": NEGATIVE_SIZE, "out_of_range": OUT_OF_RANGE}


def _long(df: DataFrame, keys: list[str], named: dict[tuple[str, str], Column]) -> DataFrame:
    """One row a metric from aggregates in columns; ``named`` maps metric and label to a column."""
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(l).alias("label"), x.cast("double").alias("value")) for (m, l), x in named.items()))
    return df.select(*keys, F.inline(rows))


def market_metrics(rows: DataFrame, clock: int) -> DataFrame:
    """Counters and last values of each instrument's ``rows`` up to ``clock``.

    ``rows`` have the event columns, ``book_flags``, ``bid_px``, ``ask_px``,
    ``imbalance``, ``microprice``, ``ofi`` and ``in_session``. Values that are
    null at the last event are those of the last event that has them.
    """
    rows = rows.filter(F.col("ts_event") <= clock)
    order = F.struct("ts_event", "date", "sequence")
    last = lambda x: F.max_by(x, F.when(x.isNotNull(), order))
    made = {
        ("events_total", ""): F.count(F.lit(1)),
        ("trades_total", ""): F.count_if(F.col("action") == TRADE),
        **{("data_quality_errors_total", n): F.count_if(F.col("book_flags").bitwiseAND(bit) > 0) for n, bit in CHECKS.items()},
        ("events_per_second", ""): F.count_if(F.col("ts_event") > clock - SECOND),
        ("market_timestamp_seconds", ""): F.max("ts_event") / float(SECOND),
        ("in_session", ""): last(F.col("in_session").cast("int")),
        ("mid_ticks", ""): last(0.5 * (F.col("bid_px") + F.col("ask_px"))),
        ("spread_ticks", ""): last(F.col("ask_px") - F.col("bid_px")),
        ("queue_imbalance", ""): last(F.col("imbalance")),
        ("microprice_ticks", ""): last(F.col("microprice")),
        ("order_flow_imbalance", ""): last(F.col("ofi")),
    }
    columns = {k: f"c{i}" for i, k in enumerate(made)}
    found = rows.groupBy("instrument_id").agg(*(x.alias(columns[k]) for k, x in made.items()))
    return _long(found, ["instrument_id"], {k: F.col(c) for k, c in columns.items()})


def order_metrics(log: DataFrame, clock: int) -> DataFrame:
    """Orders started, filled and completed, and costs, of each strategy up to ``clock``; ``label`` is the strategy.

    ``log`` has ``decision_ts``, ``exec_ts``, ``filled_passive``, ``cost_ticks``
    and ``cost_usd``. Costs count when an order is completed.
    """
    started, done = F.col("decision_ts") <= clock, F.col("exec_ts") <= clock
    paid = lambda x: F.coalesce(F.sum(F.when(done, F.col(x))), F.lit(0.0))
    found = log.groupBy(F.col("strategy").alias("label")).agg(
        F.count_if(started).alias("orders_total"), F.count_if(done & F.col("filled_passive")).alias("passive_fills_total"), F.count_if(done).alias("completed_total"),
        paid("cost_ticks").alias("cumulative_cost_ticks"), paid("cost_usd").alias("cumulative_cost_usd"), F.avg(F.when(done, F.col("cost_ticks"))).alias("average_cost_ticks"),
    )
    names = [c for c in found.columns if c != "label"]
    return found.select("label", F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names))))


def latency_histogram(rows: DataFrame, seconds: Column, keys: tuple[str, ...] = ("instrument_id",), bounds: tuple[float, ...] = LATENCY_BOUNDS) -> DataFrame:
    """Cumulative counts by bound (``le``, null: all), and the sum, of ``seconds``."""
    counts = rows.groupBy(*keys).agg(*(F.count_if(seconds <= b).alias(f"b{i}") for i, b in enumerate(bounds)), F.count(seconds).alias("all"), F.sum(seconds).alias("sum_seconds"))
    each = [F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    return counts.select(*keys, "sum_seconds", F.inline(F.array(*each, F.struct(F.lit(None).cast("double").alias("le"), F.col("all").alias("n")))))


def replay_metrics(slices: DataFrame, now: float) -> DataFrame:
    """Lag, last wall time and whether the exporter is up, from a table of slices (``due``, ``began``, ``ended`` in seconds)."""
    found = slices.agg(F.max_by(F.col("began") - F.col("due"), "began").alias("replay_lag_seconds"), F.max("ended").alias("last_event_wall_timestamp_seconds"))
    return _long(found, [], {("replay_lag_seconds", ""): F.col("replay_lag_seconds"), ("last_event_wall_timestamp_seconds", ""): F.col("last_event_wall_timestamp_seconds"), ("up", ""): (F.lit(now) - F.col("last_event_wall_timestamp_seconds") < 10).cast("int")})


# -------------------------------------------------------------------- alerts


def no_data(rows: DataFrame, at_most_s: float = 5.0) -> DataFrame:
    """Events of the session that come more than ``at_most_s`` after the one before."""
    from pyspark.sql import Window

    from tickloom.schema import DAY

    w = Window.partitionBy(*DAY).orderBy("ts_event", "sequence")
    return rows.filter("in_session").withColumn("gap", F.col("ts_event") - F.lag("ts_event").over(w)).filter(F.col("gap") > int(at_most_s * SECOND)).select(*DAY, "ts_event", "gap")


def crossed(rows: DataFrame) -> DataFrame:
    """Minutes of an instrument with a crossed book."""
    return rows.filter(F.col("book_flags").bitwiseAND(CROSSED) > 0).groupBy("instrument_id", F.expr(f"ts_event div {60 * SECOND}").alias("minute")).agg(F.count(F.lit(1)).alias("crossed"))


def slow_features(rows: DataFrame, seconds: Column, at_most: float = 0.005, share: float = 0.99) -> DataFrame:
    """Minutes of an instrument in which the ``share`` quantile of ``seconds`` is above ``at_most``."""
    found = rows.groupBy("instrument_id", F.expr(f"ts_event div {60 * SECOND}").alias("minute")).agg(F.percentile(seconds, F.lit(share)).alias("p99_s"))
    return found.filter(F.col("p99_s") > at_most)


def lagging(slices: DataFrame, at_most_s: float = 1.0) -> DataFrame:
    """Slices that began more than ``at_most_s`` after they were due."""
    return slices.withColumn("lag_s", F.col("began") - F.col("due")).filter(F.col("lag_s") > at_most_s)


def down(metrics: DataFrame) -> DataFrame:
    """The rows that say that the exporter is not up."""
    return metrics.filter("metric = 'up' AND value = 0")


# ----------------------------------------------------------------- text form


def exposition(metrics: DataFrame, prefix: str = "tickloom_") -> DataFrame:
    """One line of text (``value``) a metric, in the usual exposition format; nulls are left out."""
    keys = [c for c in ("instrument_id", "label") if c in metrics.columns]
    pairs = F.filter(F.array(*(F.when(F.col(c).cast("string") != "", F.concat(F.lit(f'{c}="'), F.col(c).cast("string"), F.lit('"'))) for c in keys)), lambda x: x.isNotNull())
    labels = F.when(F.size(pairs) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    return metrics.filter("value IS NOT NULL").select(F.concat(F.lit(prefix), "metric", labels, F.lit(" "), F.col("value").cast("string")).alias("value"))
