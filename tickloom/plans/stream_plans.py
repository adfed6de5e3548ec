"""Queries of the replay: streamed features, counters, playback and alerts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import book, features, generate, quality
from tickloom.plans.registry import Catalog
from tickloom.plans.sql import DAY, book_sql, flow_sql, time_sum
from tickloom.plans.table_plans import CLOSE, OPEN, SESSION_SQL, session_rows
from tickloom.schema import DAY as KEYS
from tickloom.schema import MS, SECOND
from tickloom.sources.fixtures import MINI_LOG_SQL, l2_events, l2_sql, micros, mini_log, read
from tickloom.streaming import alerts, metrics, replay

catalog = Catalog()
ROW = (*KEYS, "sequence")
T0, T1 = 1_704_672_000_000_000, 1_705_276_800_000_000  # 2024-01-08 and 2024-01-15 in the fixtures' time


def streamed(spark, sf):
    rows = features.with_mid(book.book_frame(l2_events(spark, sf))).select(*ROW, "ts_event", "action", "side", "size", "bid_px", "ask_px", "qb", "qa")
    return replay.replayed(rows, replay.stream_features, "features")


_LIVE = [("events_total", "count(*)"), ("trades_total", "count(*) FILTER (action = 3)"), *((f"data_quality_errors_total.{n}", f"count(*) FILTER (book_flags & {bit} > 0)") for n, bit in metrics.CHECKS.items()), ("market_timestamp_ns", "max(ts_event)")]


@catalog.add("live_counters", f"WITH {book_sql('crossed')} " + " UNION ALL ".join(f"SELECT '{n}' AS metric, CAST({x} AS DOUBLE) AS value FROM book" for n, x in _LIVE))
def live_counters(spark, sf):
    """Counters that a running query reports trigger by trigger, at its end."""
    rows = book.book_frame(l2_events(spark, sf, "crossed")).select(*ROW, "ts_event", "action", "book_flags")
    live = alerts.LiveCounters("replay")
    spark.streams.addListener(live)
    try:
        replay.replayed(rows, lambda stream: alerts.observed(stream, "replay").select(*ROW), "counters")
        live.ended.wait(60)
    finally:
        spark.streams.removeListener(live)
    return live.metrics(spark).filter(F.col("metric").isin(*(n for n, _ in _LIVE)))


_HOLD = lambda x: f"last_value(CASE WHEN mid IS NOT NULL THEN {x} END IGNORE NULLS) OVER (PARTITION BY {DAY} ORDER BY sequence)"
_B, _S = time_sum("buy", 1000 * MS), time_sum("sell", 1000 * MS)


@catalog.add(
    "stream_features",
    f"WITH {flow_sql('main')} SELECT {DAY}, sequence, round({_HOLD('CASE WHEN qb + qa > 0 THEN (qb - qa) / (qb + qa) ELSE 0 END')}, 9) AS imbalance, round({_HOLD('CASE WHEN qb + qa > 0 THEN (bid_px * qa + ask_px * qb) / (qb + qa) - mid ELSE 0 END')}, 9) AS microprice, CAST(sum(ofi) OVER (PARTITION BY {DAY} ORDER BY sequence ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS DOUBLE) AS ofi, round(CASE WHEN {_B} + {_S} > 0 THEN ({_B} - {_S}) / ({_B} + {_S}) ELSE 0 END, 9) AS tfi FROM f",
)
def stream_features(spark, sf):
    return streamed(spark, sf).select(*ROW, *(F.round(c, 9).alias(c) for c in ("imbalance", "microprice")), "ofi", F.round("tfi", 9).alias("tfi"))


catalog.add("stream_replay", f"WITH {l2_sql()} SELECT {DAY}, count(*) AS n, max(sequence) AS last_sequence FROM l2 GROUP BY {DAY}")(lambda s, d: streamed(s, d).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.max("sequence").alias("last_sequence")))
catalog.add("replay_bounds", f"WITH {l2_sql()} SELECT {DAY}, sequence FROM l2 WHERE ts_event >= {T0} AND ts_event < {T1}")(lambda s, d: replay.bounded(l2_events(s, d), T0, T1).select(*ROW))
catalog.add("replay_stats", f"WITH {book_sql('crossed')} SELECT {DAY}, count(*) AS events, count(*) FILTER (action = 3) AS trades, count(*) FILTER (book_flags & 4 > 0) AS crossed, count(*) FILTER (book_flags & 8 > 0) AS locked FROM book GROUP BY {DAY}")(
    lambda s, d: book.book_frame(l2_events(s, d, "crossed")).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("action") == 3).alias("trades"), F.count_if(F.col("book_flags").bitwiseAND(4) > 0).alias("crossed"), F.count_if(F.col("book_flags").bitwiseAND(8) > 0).alias("locked"))
)
catalog.add("events_per_second", f"WITH {l2_sql()} SELECT instrument_id, ts_event // {SECOND} AS second, count(*) AS n FROM l2 GROUP BY ALL")(lambda s, d: l2_events(s, d).groupBy("instrument_id", F.expr(f"ts_event div {SECOND}").alias("second")).agg(F.count(F.lit(1)).alias("n")))
_BOUNDS = (1, 5, 10, 25, 50, 100, 250, 500, 1000, 5000)


@catalog.add("metric_rollup", f"WITH {l2_sql()}, g AS (SELECT instrument_id, (ts_event - lag(ts_event) OVER (PARTITION BY {DAY} ORDER BY sequence)) / 1e6::DOUBLE AS ms FROM l2) SELECT instrument_id, le, count(*) FILTER (ms <= le) AS n FROM g, (VALUES {', '.join(f'({b})' for b in _BOUNDS)}) b(le) GROUP BY ALL")
def metric_rollup(spark, sf):
    """Cumulative histogram of the time between events, by bucket bound."""
    rows = l2_events(spark, sf).withColumn("ms", (F.col("ts_event") - F.lag("ts_event").over(Window.partitionBy(*KEYS).orderBy("sequence"))) / 1e6)
    counts = rows.groupBy("instrument_id").agg(*(F.count_if(F.col("ms") <= b).alias(f"b{b}") for b in _BOUNDS))
    return counts.select("instrument_id", F.inline(F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"b{b}").alias("n")) for b in _BOUNDS))))


@catalog.add("playback_totals", f"WITH {MINI_LOG_SQL}, c AS (SELECT unnest(range(0, 20)) * 1000000 AS clock) SELECT strategy, clock, count(*) FILTER (decision_ts <= clock) AS started, count(*) FILTER (decision_ts + time_to_fill_ms * 1000 <= clock) AS completed FROM mini_log, c WHERE decision_ts >= 2000000 GROUP BY ALL")
def playback_totals(spark, sf):
    """Orders started and completed by the clock, without those decided before the start."""
    rows = mini_log(spark, sf).filter("decision_ts >= 2000000").withColumn("done_ts", F.col("decision_ts") + F.col("time_to_fill_ms") * 1000)
    tick = lambda x: F.greatest(F.lit(0), F.ceil(x / 1_000_000)).cast("long")
    starts = rows.groupBy("strategy", tick(F.col("decision_ts")).alias("k")).agg(F.count(F.lit(1)).alias("started"), F.lit(0).cast("long").alias("completed"))
    ends = rows.groupBy("strategy", tick(F.col("done_ts")).alias("k")).agg(F.lit(0).cast("long").alias("started"), F.count(F.lit(1)).alias("completed"))
    clock = rows.select("strategy").distinct().select("strategy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("k"), F.lit(0).cast("long").alias("started"), F.lit(0).cast("long").alias("completed"))
    steps = starts.unionByName(ends).unionByName(clock).groupBy("strategy", "k").agg(F.sum("started").alias("s"), F.sum("completed").alias("c"))
    w = Window.partitionBy("strategy").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("strategy", (F.col("k") * 1_000_000).alias("clock"), F.sum("s").over(w).alias("started"), F.sum("c").over(w).alias("completed")).filter("clock < 20000000")


catalog.add("alert_no_data", f"WITH {l2_sql()}, {SESSION_SQL}, g AS (SELECT {DAY}, ts_event, ts_event - lag(ts_event) OVER (PARTITION BY {DAY} ORDER BY ts_event, sequence) AS gap FROM sess WHERE in_session) SELECT {DAY}, ts_event, gap FROM g WHERE gap > 5000000000")(lambda s, d: metrics.no_data(session_rows(s, d)))
catalog.add("alert_crossed", f"WITH {book_sql('crossed')} SELECT instrument_id, ts_event // 60000000000 AS minute, count(*) AS crossed FROM book WHERE book_flags & 4 > 0 GROUP BY ALL")(
    lambda s, d: metrics.crossed(book.book_frame(l2_events(s, d, "crossed")))
)
CLOCK = 1_705_312_800_000_000  # 2024-01-15 10:00 in the fixtures' time
_LAST = lambda x: f"arg_max({x}, (ts_event, date, sequence)) FILTER ({x} IS NOT NULL)"
_SNAPSHOT = [
    ("events_total", "", "count(*)"), ("trades_total", "", "count(*) FILTER (action = 3)"),
    *(("data_quality_errors_total", n, f"count(*) FILTER (book_flags & {bit} > 0)") for n, bit in metrics.CHECKS.items()),
    ("events_per_second", "", f"count(*) FILTER (ts_event > {CLOCK - SECOND})"), ("market_timestamp_seconds", "", "max(ts_event) / 1e9"),
    ("in_session", "", _LAST(f"(ts_event >= {OPEN} AND ts_event < {CLOSE})::INT")), ("mid_ticks", "", _LAST("mid")), ("spread_ticks", "", _LAST("ask_px - bid_px")),
    ("queue_imbalance", "", _LAST("imbalance")), ("microprice_ticks", "", _LAST("microprice")), ("order_flow_imbalance", "", _LAST("ofi50")),
]


@catalog.add(
    "metrics_snapshot",
    f"""WITH {flow_sql('crossed')}, x AS (SELECT *, CASE WHEN mid IS NOT NULL THEN CASE WHEN qb + qa > 0 THEN (qb - qa) / (qb + qa) ELSE 0 END END AS imbalance,
  CASE WHEN mid IS NOT NULL THEN CASE WHEN qb + qa > 0 THEN (bid_px * qa + ask_px * qb) / (qb + qa) - mid ELSE 0 END END AS microprice,
  CASE WHEN mid IS NOT NULL THEN sum(ofi) OVER (PARTITION BY {DAY} ORDER BY sequence ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) END AS ofi50 FROM f),
y AS (SELECT * FROM x WHERE ts_event <= {CLOCK})
"""
    + " UNION ALL ".join(f"SELECT instrument_id, '{m}' AS metric, '{label}' AS label, round(CAST({x} AS DOUBLE), 9) AS value FROM y GROUP BY instrument_id" for m, label, x in _SNAPSHOT),
)
def metrics_snapshot(spark, sf):
    """All market metrics as of a clock."""
    rows = features.with_features(book.book_frame(l2_events(spark, sf, "crossed")))
    rows = quality.with_session(rows).withColumn("ofi", F.col("ofi_ev50"))
    return metrics.market_metrics(rows, CLOCK).withColumn("value", F.round("value", 9))


_ORDERS = {"orders_total": "count(*) FILTER (decision_ts <= 30000000)", "passive_fills_total": "count(*) FILTER (filled_passive AND exec_ts <= 30000000)", "completed_total": "count(*) FILTER (exec_ts <= 30000000)"}
_ORDERS |= {f"cumulative_cost_{u}": f"coalesce(sum(cost_{u}) FILTER (exec_ts <= 30000000), 0)" for u in ("ticks", "usd")} | {"average_cost_ticks": "avg(cost_ticks) FILTER (exec_ts <= 30000000)"}


@catalog.add(
    "metrics_orders",
    f"WITH {MINI_LOG_SQL}, x AS (SELECT *, decision_ts + time_to_fill_ms * 1000 AS exec_ts FROM mini_log) "
    + " UNION ALL ".join(f"SELECT strategy AS label, '{m}' AS metric, round(CAST({x} AS DOUBLE), 6) AS value FROM x GROUP BY strategy" for m, x in _ORDERS.items()),
)
def metrics_orders(spark, sf):
    """Order metrics of each strategy as of a clock."""
    log = mini_log(spark, sf).withColumn("exec_ts", F.col("decision_ts") + F.col("time_to_fill_ms") * 1000)
    return metrics.order_metrics(log, 30_000_000).withColumn("value", F.round("value", 6))


@catalog.add("alert_slow_features", "SELECT CAST(1 + user_id % 2 AS INTEGER) AS instrument_id, epoch_us(ts) // 60000000000 AS minute, round(quantile_cont(value / 2e4, 0.99::DOUBLE), 9) AS p99_s FROM events GROUP BY ALL HAVING quantile_cont(value / 2e4, 0.99::DOUBLE) > 0.005")
def alert_slow_features(spark, sf):
    """The value of an event stands in for its latency."""
    rows = read(spark, sf, "events").select((1 + F.col("user_id") % 2).cast("int").alias("instrument_id"), micros("ts").alias("ts_event"), (F.col("value") / 2e4).alias("latency_s"))
    return metrics.slow_features(rows, F.col("latency_s")).withColumn("p99_s", F.round("p99_s", 9))


@catalog.add("alert_lagging", "SELECT o_orderkey AS slice, (o_custkey % 300) / 100.0::DOUBLE AS lag_s FROM orders WHERE o_custkey % 300 > 100")
def alert_lagging(spark, sf):
    slices = read(spark, sf, "orders").select(F.col("o_orderkey").alias("slice"), F.lit(0.0).alias("due"), (F.col("o_custkey") % 300 / F.lit(100.0)).alias("began"))
    return metrics.lagging(slices).select("slice", "lag_s")


@catalog.add("metrics_text", "SELECT 'tickloom_events_total{instrument_id=\"' || (1 + user_id % 2) || '\"} ' || CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY user_id % 2")
def metrics_text(spark, sf):
    """Exposition lines of one metric."""
    rows = read(spark, sf, "events").groupBy((1 + F.col("user_id") % 2).alias("instrument_id")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return metrics.exposition(rows.select("instrument_id", F.lit("events_total").alias("metric"), F.lit("").alias("label"), "value"))


catalog.add("synth_events")(lambda s, d: generate.synthetic_days(s, days=4, minutes=2, seed=20_260_817))
