"""Order-book events derived from the shared ``events`` table, in Spark and in SQL.

The formulas are those of ``FIXTURES.md``: one day is compressed a thousandfold
(microseconds are read as nanoseconds), so windows of milliseconds and seconds
hold several rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.schema import DAY, EVENT_COLUMNS

VARIANTS = ("main", "tied", "clear", "crossed", "bad")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    """Microseconds since the epoch of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def l2_events(spark: SparkSession, sf_dir: str, variant: str = "main") -> DataFrame:
    """Level-by-level deltas with the columns of ``schema.EVENTS``, sequence dense in a day."""
    raw = read(spark, sf_dir, "events").select(
        F.col("event_id"), "user_id", "event_type", F.floor("value").cast("long").alias("v"), micros("ts").alias("ts_event"), F.to_date("ts").alias("date")
    )
    rest = F.when(F.expr("(event_id div 3) % 2 = 0"), 1).otherwise(-1)
    action = F.when(F.col("event_type").isin("click", "signup"), 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "error", 2).otherwise(3)
    off = F.expr("(7 * event_id + user_id) % 4")
    rows = raw.withColumns({"rest": rest, "action": action, "off": off, "instrument_id": (1 + F.col("user_id") % 2).cast("int")})
    trade, bid = F.col("action") == 3, F.col("rest") == 1
    price = F.when(trade, F.when(bid, 1000).otherwise(1001)).otherwise(F.when(bid, 1000 - F.col("off")).otherwise(1001 + F.col("off")))
    size = F.when(F.col("action") == 0, 5 + F.col("v") % 40).when(F.col("action") == 2, F.col("v") % 30).otherwise(1 + F.col("v") % 15)
    queue = F.when(F.col("action") == 1, F.col("v") % 20).when(trade, 0).otherwise(-1)
    rows = rows.withColumns({"side": F.when(trade, -F.col("rest")).otherwise(F.col("rest")), "price": price, "size": size, "queue_pos": queue})
    if variant == "tied":
        rows = rows.withColumn("ts_event", F.expr("ts_event div 600000000 * 600000000"))
    elif variant == "clear":
        rows = rows.withColumn("action", F.when(F.col("event_id") % 997 == 0, 4).otherwise(F.col("action")))
    elif variant == "crossed":
        rows = rows.withColumn("price", F.expr("998 + (event_id div 6 + user_id) % 6"))
    elif variant == "bad":
        rows = rows.withColumn("size", F.when(F.col("event_id") % 501 == 0, F.when(F.col("event_id") % 2 == 0, -1).otherwise(0)).otherwise(F.col("size")))
        rows = rows.withColumn("price", F.when(F.col("event_id") % 503 == 0, F.col("price") + 20000).otherwise(F.col("price")))
    rows = rows.withColumn("sequence", F.row_number().over(Window.partitionBy(*DAY).orderBy("event_id")).cast("long"))
    kinds = {"action": "int", "side": "int", "price": "long", "size": "long", "queue_pos": "long"}
    return rows.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in EVENT_COLUMNS))


def l2_sql(variant: str = "main") -> str:
    """The same as the common table expression ``l2``."""
    ts = "epoch_us(ts) // 600000000 * 600000000" if variant == "tied" else "epoch_us(ts)"
    action = "CASE WHEN event_type IN ('click', 'signup') THEN 0 WHEN event_type = 'view' THEN 1 WHEN event_type = 'error' THEN 2 ELSE 3 END"
    price = "CASE WHEN action0 = 3 THEN CASE WHEN rest = 1 THEN 1000 ELSE 1001 END WHEN rest = 1 THEN 1000 - off ELSE 1001 + off END"
    size = "CASE WHEN action0 = 0 THEN 5 + v % 40 WHEN action0 = 2 THEN v % 30 ELSE 1 + v % 15 END"
    final = "action0"
    if variant == "clear":
        final = "CASE WHEN event_id % 997 = 0 THEN 4 ELSE action0 END"
    elif variant == "crossed":
        price = "998 + (event_id // 6 + user_id) % 6"
    elif variant == "bad":
        size = f"CASE WHEN event_id % 501 = 0 THEN CASE WHEN event_id % 2 = 0 THEN -1 ELSE 0 END ELSE {size} END"
        price = f"CASE WHEN event_id % 503 = 0 THEN {price} + 20000 ELSE {price} END"
    return f"""l2_raw AS (SELECT *, {action} AS action0, CASE WHEN event_id // 3 % 2 = 0 THEN 1 ELSE -1 END AS rest, CAST(floor(value) AS BIGINT) AS v, (7 * event_id + user_id) % 4 AS off FROM events),
l2 AS (SELECT CAST(1 + user_id % 2 AS INTEGER) AS instrument_id, CAST(ts AS DATE) AS date, {ts} AS ts_event,
  row_number() OVER (PARTITION BY 1 + user_id % 2, CAST(ts AS DATE) ORDER BY event_id) AS sequence, CAST({final} AS INTEGER) AS action,
  CAST(CASE WHEN action0 = 3 THEN -rest ELSE rest END AS INTEGER) AS side, CAST({price} AS BIGINT) AS price, CAST({size} AS BIGINT) AS size,
  CAST(CASE WHEN action0 = 1 THEN v % 20 WHEN action0 = 3 THEN 0 ELSE -1 END AS BIGINT) AS queue_pos FROM l2_raw)"""


def mini_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade-log stand-in: every order under six strategies, the cell chosen by its key, months as days."""
    from tickloom.schema import QUEUE_MODELS, STRATEGIES

    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("date"))
    pick = lambda values, index: F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))
    k, s = F.col("k"), F.col("s")
    rows = orders.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(5))))
    filled = (k % 3 != 0) & s.isin(1, 2, 3, 4)
    return rows.select(
        "date", k.alias("decision_id"), (k * 1000).alias("decision_ts"), pick(QUEUE_MODELS, k % 4).alias("queue_model"), pick((0, 1, 10, 100), F.expr("(k div 4) % 4")).alias("latency_ms"),
        pick((5, 15, 30), F.expr("(k div 16) % 3")).alias("deadline_s"), pick(STRATEGIES, s).alias("strategy"), (((31 * k + 17 * s) % 9 - 4) / F.lit(2.0)).alias("cost_ticks"),
        filled.alias("filled_passive"), ((k * 7 + s * 13) % 5000).cast("double").alias("time_to_fill_ms"), F.when(filled, ((k + s) % 5 - 2) / F.lit(2.0)).alias("adverse_1s"),
        F.when(filled, ((k + 2 * s) % 7 - 3) / F.lit(2.0)).alias("adverse_5s"), (k % 10 == 0).alias("in_release_window"), (k % 400).cast("double").alias("minutes_since_open"),
        (F.col("cents") % 997 / F.lit(100.0)).alias("vol_300s"), (F.col("cents") % 1009).cast("double").alias("own_queue"), F.when(k % 7 == 0, 2.0).otherwise(1.0).alias("spread_ticks"),
        (((31 * k + 17 * s) % 9 - 4) / F.lit(2.0) * 15.625 + 2.5).alias("cost_usd"),
    )


MINI_LOG_SQL = """mini_log AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, o_orderkey AS decision_id, o_orderkey * 1000 AS decision_ts,
  ['pessimistic', 'proportional', 'optimistic', 'exact'][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS queue_model, [0, 1, 10, 100][CAST(o_orderkey // 4 % 4 + 1 AS INTEGER)] AS latency_ms, [5, 15, 30][CAST(o_orderkey // 16 % 3 + 1 AS INTEGER)] AS deadline_s,
  ['always_cross', 'always_post', 'model_direction', 'model_cost', 'new_level', 'oracle'][s + 1] AS strategy, ((31 * o_orderkey + 17 * s) % 9 - 4) / 2.0::DOUBLE AS cost_ticks,
  o_orderkey % 3 <> 0 AND s BETWEEN 1 AND 4 AS filled_passive, CAST((o_orderkey * 7 + s * 13) % 5000 AS DOUBLE) AS time_to_fill_ms,
  CASE WHEN o_orderkey % 3 <> 0 AND s BETWEEN 1 AND 4 THEN ((o_orderkey + s) % 5 - 2) / 2.0::DOUBLE END AS adverse_1s, CASE WHEN o_orderkey % 3 <> 0 AND s BETWEEN 1 AND 4 THEN ((o_orderkey + 2 * s) % 7 - 3) / 2.0::DOUBLE END AS adverse_5s,
  o_orderkey % 10 = 0 AS in_release_window, CAST(o_orderkey % 400 AS DOUBLE) AS minutes_since_open, CAST(round(o_totalprice * 100) AS BIGINT) % 997 / 100.0::DOUBLE AS vol_300s, CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 1009 AS DOUBLE) AS own_queue,
  CASE WHEN o_orderkey % 7 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS spread_ticks, ((31 * o_orderkey + 17 * s) % 9 - 4) / 2.0::DOUBLE * 15.625 + 2.5 AS cost_usd
  FROM orders, range(6) t(s))"""


def mini_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``always_post`` results of every order under all four queue models, for validation against the exact one."""
    from tickloom.schema import QUEUE_MODELS

    k, m = F.col("k"), F.col("m")
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("date")).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return rows.select(
        "date", k.alias("decision_id"), F.element_at(F.array(*map(F.lit, QUEUE_MODELS)), m + 1).alias("queue_model"), F.element_at(F.array(*map(F.lit, (0, 1, 10, 100))), (k % 4 + 1).cast("int")).alias("latency_ms"),
        F.element_at(F.array(*map(F.lit, (5, 15, 30))), (k % 3 + 1).cast("int")).alias("deadline_s"), ((k * 5 + m * 7) % 11 > m).alias("filled_passive"), (((13 * k + 5 * m) % 9 - 4) / F.lit(2.0)).alias("cost_ticks"), ((k * 3 + m * 101) % 5000).cast("double").alias("time_to_fill_ms"),
    )


MINI_POSTS_SQL = """mini_posts AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey AS decision_id, ['pessimistic', 'proportional', 'optimistic', 'exact'][m + 1] AS queue_model, [0, 1, 10, 100][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS latency_ms,
  [5, 15, 30][CAST(o_orderkey % 3 + 1 AS INTEGER)] AS deadline_s, (o_orderkey * 5 + m * 7) % 11 > m AS filled_passive, ((13 * o_orderkey + 5 * m) % 9 - 4) / 2.0::DOUBLE AS cost_ticks, CAST((o_orderkey * 3 + m * 101) % 5000 AS DOUBLE) AS time_to_fill_ms FROM orders, range(4) t(m))"""


def mini_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions stand-in: ``y`` and ``p`` with many ties, and regime columns."""
    e, v = F.col("event_id"), F.col("v")
    rows = read(spark, sf_dir, "events").select("event_id", F.floor("value").cast("long").alias("v"), F.to_date("ts").alias("date"), micros("ts").alias("ts_event"))
    return rows.select(
        "event_id", "date", "ts_event", F.when(7919 * e % 100 < 50 + v % 20, 1.0).otherwise(0.0).alias("y"), (v % 100 / F.lit(100.0)).alias("p"), ((v * 3 + 7) % 100 / F.lit(100.0)).alias("p2"), ((e * 13 + v) % 100 / F.lit(100.0)).alias("p3"),
        ((v % 41 - 20) / F.lit(20.0)).alias("imbalance"), ((e * 17 + v) % 5 - 2).cast("double").alias("ret_1s"), ((e * 29 + v) % 7 - 3).cast("double").alias("ret_5s"), (e % 10 == 0).alias("in_release_window"), (e % 400).cast("double").alias("minutes_since_open"),
        (v % 97 / F.lit(100.0)).alias("vol_300s"), (e * 31 % 503).cast("double").alias("total_queue"), F.when(e % 7 == 0, 2.0).otherwise(1.0).alias("spread"), (e % 3).cast("int").alias("fold"),
    )


MINI_PRED_SQL = """mini_pred AS (SELECT event_id, date, ts_event, CASE WHEN 7919 * event_id % 100 < 50 + v % 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, v % 100 / 100.0::DOUBLE AS p, (v * 3 + 7) % 100 / 100.0::DOUBLE AS p2, (event_id * 13 + v) % 100 / 100.0::DOUBLE AS p3,
  (v % 41 - 20) / 20.0::DOUBLE AS imbalance, CAST((event_id * 17 + v) % 5 - 2 AS DOUBLE) AS ret_1s, CAST((event_id * 29 + v) % 7 - 3 AS DOUBLE) AS ret_5s, event_id % 10 = 0 AS in_release_window, CAST(event_id % 400 AS DOUBLE) AS minutes_since_open,
  v % 97 / 100.0::DOUBLE AS vol_300s, CAST(event_id * 31 % 503 AS DOUBLE) AS total_queue, CASE WHEN event_id % 7 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS spread, CAST(event_id % 3 AS INTEGER) AS fold
  FROM (SELECT event_id, CAST(floor(value) AS BIGINT) AS v, CAST(ts AS DATE) AS date, epoch_us(ts) AS ts_event FROM events))"""


def mini_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily volume of two contracts, the second taking over as time goes by."""
    late = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01"))
    rows = read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"), (F.col("l_suppkey") % 2).alias("instrument_id"), (F.floor("l_quantity").cast("long") * F.when(F.col("l_suppkey") % 2 == F.floor(late / 90) % 2, 20).otherwise(1)).alias("q"))
    return rows.groupBy("date", "instrument_id").agg(F.sum("q").alias("volume"))


MINI_VOLUME_SQL = """mini_volume AS (SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey % 2 AS instrument_id,
  CAST(sum(CAST(floor(l_quantity) AS BIGINT) * CASE WHEN l_suppkey % 2 = CAST(floor(datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 90) AS BIGINT) % 2 THEN 20 ELSE 1 END) AS BIGINT) AS volume FROM lineitem GROUP BY ALL)"""

#: Fixed calendar rows: date, local time, event.
RELEASES = (("2024-01-05", "08:30", "payrolls"), ("2024-01-11", "08:30", "prices"), ("2024-01-17", "10:00", "sales"), ("2024-01-31", "14:00", "rates"))


def releases(spark: SparkSession) -> DataFrame:
    """The calendar with ``ts_ns``: the local time as compressed nanoseconds."""
    rows = spark.createDataFrame(list(RELEASES), "date string, time_et string, event string").coalesce(1)
    return rows.select(F.to_date("date").alias("date"), "time_et", "event", F.unix_micros(F.to_utc_timestamp(F.concat_ws(" ", "date", "time_et"), "America/New_York")).alias("ts_ns"))


RELEASES_SQL = (
    "releases AS (SELECT CAST(d AS DATE) AS date, t AS time_et, e AS event, epoch_us(CAST(d || ' ' || t || ':00' AS TIMESTAMP) AT TIME ZONE 'America/New_York') AS ts_ns FROM (VALUES "
    + ", ".join(f"('{d}', '{t}', '{e}')" for d, t, e in RELEASES)
    + ") v(d, t, e))"
)
