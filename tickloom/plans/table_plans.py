"""Queries over raw tables: scans, filters, calendars, quality, scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import scalar
from tickloom.operators import book, exact, features, joins, positions, quality, stats, targets
from tickloom.plans.registry import Catalog
from tickloom.plans.sql import DAY, book_sql, flow_sql
from tickloom.schema import DAY as KEYS
from tickloom.schema import SECOND
from tickloom.sources.fixtures import MINI_VOLUME_SQL, RELEASES_SQL, l2_events, l2_sql, micros, mini_volume, read, releases

catalog = Catalog()
ROW = (*KEYS, "sequence")
OPEN = "epoch_us((CAST(date AS TIMESTAMP) + INTERVAL '8 hours 30 minutes') AT TIME ZONE 'America/New_York')"
CLOSE = "epoch_us((CAST(date AS TIMESTAMP) + INTERVAL '15 hours') AT TIME ZONE 'America/New_York')"
WIDTH = 300_000_000  # five minutes in compressed time

catalog.add("scan_events", "SELECT event_id, ts, user_id, event_type, value FROM events")(lambda s, d: read(s, d, "events").select("event_id", "ts", "user_id", "event_type", "value"))
catalog.add("scan_pruned", "SELECT event_id, value FROM events WHERE value > 100 AND event_type = 'view'")(lambda s, d: read(s, d, "events").filter("value > 100 AND event_type = 'view'").select("event_id", "value"))
catalog.add("scan_glob", "SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT n_regionkey, n_name FROM nation")(
    lambda s, d: s.read.parquet(f"{d}/[r]egion.parquet").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")).unionByName(s.read.parquet(f"{d}/[n]ation.parquet").select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("name")))
)
catalog.add("available_days", f"WITH {l2_sql()} SELECT DISTINCT instrument_id, date FROM l2")(lambda s, d: l2_events(s, d).select(*KEYS).distinct())
catalog.add("releases_calendar", f"WITH {RELEASES_SQL}, {l2_sql()} SELECT r.date, r.time_et, r.event, r.ts_ns, count(l2.sequence) AS day_events FROM releases r LEFT JOIN l2 ON l2.date = r.date GROUP BY ALL")(
    lambda s, d: releases(s).join(l2_events(s, d).groupBy("date").agg(F.count("sequence").alias("day_events")), "date", "left").withColumn("day_events", F.coalesce("day_events", F.lit(0)))
)
catalog.add("ordered_events", f"WITH {l2_sql('tied')} SELECT instrument_id, date, ts_event, sequence, price FROM l2 ORDER BY instrument_id, date, ts_event, sequence")(lambda s, d: l2_events(s, d, "tied").select(*KEYS, "ts_event", "sequence", "price").orderBy(*KEYS, "ts_event", "sequence"))
catalog.add("project_cols", f"WITH {l2_sql()} SELECT instrument_id, ts_event, price FROM l2")(lambda s, d: l2_events(s, d).select("instrument_id", "ts_event", "price"))
catalog.add("compact_types", f"WITH {l2_sql()} SELECT ts_event, sequence, price, CAST(size AS INTEGER) AS size, CAST(queue_pos AS INTEGER) AS queue_pos, CAST(CAST(price AS DOUBLE) / 2 AS FLOAT) AS half FROM l2")(
    lambda s, d: l2_events(s, d).select("ts_event", "sequence", "price", F.col("size").cast("int").alias("size"), F.col("queue_pos").cast("int").alias("queue_pos"), (F.col("price").cast("double") / 2).cast("float").alias("half"))
)
catalog.add("union_days", f"WITH {l2_sql()}, a AS (SELECT * FROM l2 WHERE day(date) <= 10), b AS (SELECT * FROM l2 WHERE day(date) > 20) SELECT date, sequence, price FROM a UNION ALL SELECT date, sequence, price FROM b")(
    lambda s, d: l2_events(s, d).filter("day(date) <= 10").unionByName(l2_events(s, d).filter("day(date) > 20")).select("date", "sequence", "price")
)


@catalog.add("zip_by_key", f"WITH {book_sql()} SELECT a.instrument_id, a.date, a.sequence, a.price, b.bid_px FROM l2 a JOIN book b ON a.instrument_id = b.instrument_id AND a.date = b.date AND a.sequence = b.sequence")
def zip_by_key(spark, sf):
    events = l2_events(spark, sf)
    return events.select(*ROW, "price").join(book.book_frame(events).select(*ROW, "bid_px"), [*ROW])


@catalog.add("mbp_to_grid", "WITH v AS (SELECT o_orderkey AS id, list_transform(range(5), lambda i: 1000 - 2 * i - o_orderkey % 2) AS px, list_transform(range(5), lambda i: 1 + (o_orderkey + i) % 9) AS sz FROM orders) SELECT id, " + ", ".join(f"CAST(coalesce(list_sum(list_transform(list_filter(range(1, 6), lambda j: px[j] = px[1] - {i}), lambda j: sz[j])), 0) AS BIGINT) AS bid_sz_{i}" for i in range(6)) + " FROM v")
def mbp_to_grid(spark, sf):
    """Sparse levels of a vendor record on the dense grid of ticks."""
    k = F.col("id")
    level = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct((F.lit(1000) - 2 * i - k % 2).alias("px"), (1 + (k + i) % 9).alias("sz")))
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id")).withColumn("levels", level)
    at = lambda i: F.aggregate("levels", F.lit(0).cast("long"), lambda a, x: a + F.when(x["px"] == F.col("levels")[0]["px"] - i, x["sz"]).otherwise(0))
    return rows.select("id", *(at(i).alias(f"bid_sz_{i}") for i in range(6)))


catalog.add("definitions_distinct", "SELECT s_suppkey % 7 AS instrument_id, min(s_name) AS raw_symbol FROM supplier GROUP BY ALL")(
    lambda s, d: read(s, d, "supplier").withColumn("instrument_id", F.col("s_suppkey") % 7).groupBy("instrument_id").agg(F.min("s_name").alias("raw_symbol"))
)


@catalog.add("spend_guard", "WITH c AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS cost FROM orders), r AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS spent FROM c) SELECT o_custkey, o_orderkey, spent, spent <= 500000 AS allowed FROM r")
def spend_guard(spark, sf):
    """Requests that fit the budget, by the running total of their cost."""
    rows = read(spark, sf, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice").cast("long").alias("cost"))
    return rows.select("o_custkey", "o_orderkey", F.sum("cost").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("spent")).withColumn("allowed", F.col("spent") <= 500_000)


@catalog.add("calendar_upsert", f"WITH {RELEASES_SQL}, n AS (SELECT date, time_et, event FROM releases UNION SELECT date + 1, time_et, event FROM releases UNION SELECT date, time_et, event FROM releases) SELECT * FROM n ORDER BY ALL")
def calendar_upsert(spark, sf):
    old = releases(spark).select("date", "time_et", "event")
    return old.unionByName(old.withColumn("date", F.date_add("date", 1))).unionByName(old).distinct().orderBy("date", "time_et", "event")


def session_rows(spark, sf, variant="main"):
    return quality.with_session(l2_events(spark, sf, variant))


SESSION_SQL = f"sess AS (SELECT *, ts_event >= {OPEN} AND ts_event < {CLOSE} AS in_session FROM l2)"
catalog.add("session_mask", f"WITH {l2_sql()}, {SESSION_SQL} SELECT {DAY}, sequence, in_session FROM sess")(lambda s, d: session_rows(s, d).select(*ROW, "in_session"))
catalog.add("session_filter", f"WITH {l2_sql()}, {SESSION_SQL} SELECT {DAY}, sequence FROM sess WHERE in_session AND action <> 1")(lambda s, d: session_rows(s, d).filter(F.col("in_session") & ~(F.col("action") == 1)).select(*ROW))
catalog.add("session_bounds", f"WITH {l2_sql()} SELECT DISTINCT date, {OPEN} AS open_ns, {CLOSE} AS close_ns FROM l2")(lambda s, d: session_rows(s, d).select("date", "open_ns", "close_ns").distinct())
_RELEASE = f"EXISTS (SELECT 1 FROM releases r WHERE l2.ts_event >= r.ts_ns - {WIDTH} AND l2.ts_event < r.ts_ns + {WIDTH})"
catalog.add("release_window", f"WITH {l2_sql()}, {RELEASES_SQL} SELECT {DAY}, sequence, {_RELEASE} AS in_release_window FROM l2")(lambda s, d: quality.with_release_flag(l2_events(s, d), releases(s), WIDTH).select(*ROW, "in_release_window"))


@catalog.add("range_join_release", f"WITH {l2_sql()}, {RELEASES_SQL} SELECT instrument_id, l2.date, sequence, event, l2.ts_event - r.ts_ns AS offset_ns FROM l2 JOIN releases r ON l2.ts_event > r.ts_ns - {12 * WIDTH} AND l2.ts_event <= r.ts_ns + {12 * WIDTH}")
def range_join_release(spark, sf):
    """Events within an hour of a release, with their distance: a bucketed interval join."""
    windows = releases(spark).select("event", "ts_ns", (F.col("ts_ns") - 12 * WIDTH).alias("start"), (F.col("ts_ns") + 12 * WIDTH).alias("stop"))
    return joins.in_interval(windows, l2_events(spark, sf), [], "start", "stop", "ts_event", 24 * WIDTH).select(*ROW, "event", (F.col("ts_event") - F.col("ts_ns")).alias("offset_ns"))


_MODEL = f"mr AS (SELECT {DAY}, sequence, mid, qb, qa, in_session, lead(mid) OVER (PARTITION BY {DAY} ORDER BY sequence) AS nxt FROM (SELECT f.*, ts_event >= {OPEN} AND ts_event < {CLOSE} AS in_session FROM f))"


@catalog.add("modelling_rows", f"WITH {flow_sql('tied')}, {_MODEL.replace('lead(mid) OVER (PARTITION BY instrument_id, date ORDER BY sequence) AS nxt', '1 AS nxt')}, st AS (SELECT *, CASE WHEN mid IS NOT NULL AND (lag(mid) OVER (PARTITION BY {DAY} ORDER BY sequence) IS DISTINCT FROM mid) THEN 1 ELSE 0 END AS s FROM mr), ri AS (SELECT *, sum(s) OVER (PARTITION BY {DAY} ORDER BY sequence) AS run FROM st), rn AS (SELECT {DAY}, run, mid AS nm FROM ri WHERE s = 1) SELECT a.instrument_id, a.date, a.sequence FROM ri a JOIN rn b ON b.instrument_id = a.instrument_id AND b.date = a.date AND b.run = a.run + 1 WHERE a.in_session AND a.mid IS NOT NULL AND b.nm <> a.mid")
def modelling_rows(spark, sf):
    """Session rows with a target and an imbalance that are neither null nor NaN."""
    rows = quality.with_session(targets.with_targets(features.with_mid(book.book_frame(l2_events(spark, sf, "tied")))))
    rows = rows.withColumn("imbalance", F.when(F.col("mid").isNotNull(), features.ratio(F.col("qb") - F.col("qa"), F.col("qb") + F.col("qa"))))
    return rows.filter(F.col("in_session") & F.col("next_dir").isNotNull() & ~F.isnan("next_dir") & F.col("imbalance").isNotNull() & ~F.isnan("imbalance")).select(*ROW)


catalog.add("bucket_case", "SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'low' WHEN p_size <= 30 THEN 'mid' ELSE 'high' END AS bucket FROM part")(lambda s, d: read(s, d, "part").select("p_partkey", F.when(F.col("p_size") <= 10, "low").when(F.col("p_size") <= 30, "mid").otherwise("high").alias("bucket")))
catalog.add("tod_bucket", "SELECT event_id, CASE WHEN event_id % 400 < 90 THEN 'open' WHEN event_id % 400 < 300 THEN 'midday' WHEN event_id % 400 < 390 THEN 'close' ELSE 'outside' END AS tod FROM events")(lambda s, d: read(s, d, "events").select("event_id", stats.time_of_day(F.col("event_id") % 400).alias("tod")))
catalog.add("asof_horizon", f"WITH {flow_sql('tied')}, lastrow AS (SELECT {DAY}, ts_event, mid, sequence FROM f QUALIFY row_number() OVER (PARTITION BY {DAY}, ts_event ORDER BY sequence DESC) = 1) SELECT a.instrument_id, a.date, a.sequence, m.sequence AS later_sequence, CAST(m.mid AS DOUBLE) AS later_mid FROM f a ASOF LEFT JOIN lastrow m ON m.instrument_id = a.instrument_id AND m.date = a.date AND m.ts_event <= a.ts_event + {5 * SECOND}")(
    lambda s, d: (lambda rows: joins.as_of(rows.select(*ROW, (F.col("ts_event") + 5 * SECOND).alias("at")), rows.select(*KEYS, "ts_event", F.col("sequence").alias("later_sequence"), F.col("mid").alias("later_mid")), KEYS, "at", "ts_event", "later_sequence", ["later_sequence", "later_mid"]).drop("at"))(features.with_mid(book.book_frame(l2_events(s, d, "tied"))))
)

# ------------------------------------------------------------ data quality

_FAULTY = """fa AS (SELECT *, event_id_row FROM (SELECT l2.*, row_number() OVER (ORDER BY instrument_id, date, sequence) AS event_id_row FROM l2)),
raw AS (SELECT instrument_id, date, CASE WHEN sequence % 53 = 0 THEN ts_event - 400000000 ELSE ts_event END AS ts_event, sequence + sequence // 37 AS sequence, action, side, price, CASE WHEN sequence % 61 = 0 THEN 0 ELSE size END AS size, queue_pos, sequence * 2 AS arrival FROM l2),
raw2 AS (SELECT * FROM raw UNION ALL SELECT * REPLACE (arrival + 1 AS arrival) FROM raw WHERE sequence % 41 = 0),
ded AS (SELECT * EXCLUDE (arrival), min(arrival) AS arrival FROM raw2 GROUP BY ALL),
dif AS (SELECT *, ts_event - lag(ts_event) OVER (PARTITION BY instrument_id, date ORDER BY arrival) AS dt, sequence - lag(sequence) OVER (PARTITION BY instrument_id, date ORDER BY sequence, arrival) AS ds FROM ded)""".replace(
    "fa AS (SELECT *, event_id_row FROM (SELECT l2.*, row_number() OVER (ORDER BY instrument_id, date, sequence) AS event_id_row FROM l2)),\n", ""
)


def faulty(spark, sf):
    """Events with repeated rows, gaps in the sequence, late times and zero sizes, in arrival order."""
    rows = l2_events(spark, sf)
    seq = F.col("sequence")
    rows = rows.withColumns({"ts_event": F.when(seq % 53 == 0, F.col("ts_event") - 400_000_000).otherwise(F.col("ts_event")), "size": F.when(seq % 61 == 0, 0).otherwise(F.col("size")).cast("long"), "arrival": seq * 2, "sequence": F.expr("sequence + sequence div 37")})
    return rows.unionByName(rows.filter("sequence % 41 = 0").withColumn("arrival", F.col("arrival") + 1))


_COUNTS = f"""SELECT {DAY}, any_value(raw_n) AS raw_rows, count(*) AS rows, count(*) FILTER (dt < 0) AS out_of_order, count(*) FILTER (ds > 1) AS sequence_gaps,
CAST(coalesce(sum(ds - 1) FILTER (ds > 1), 0) AS BIGINT) AS missing_sequences, count(*) FILTER (size <= 0 AND action <> 4) AS bad_sizes, any_value(raw_n) - count(*) AS duplicates FROM dif JOIN (SELECT {DAY}, count(*) AS raw_n FROM raw2 GROUP BY {DAY}) USING ({DAY}) GROUP BY {DAY}"""
QC = f"WITH {l2_sql()}, {_FAULTY}, qc AS ({_COUNTS})"
catalog.add("quality_counts", f"{QC} SELECT * FROM qc")(lambda s, d: quality.day_counters(faulty(s, d)))
catalog.add("dedupe_rows", f"WITH {l2_sql()}, {_FAULTY} SELECT {DAY}, ts_event, sequence, action, side, price, size, queue_pos FROM ded")(lambda s, d: quality.deduplicated(faulty(s, d).drop("arrival")))
for _name, _columns in (("seq_gaps", ("sequence_gaps", "missing_sequences")), ("ooo_ts", ("out_of_order",)), ("bad_sizes", ("bad_sizes",))):
    catalog.add(_name, f"{QC} SELECT {DAY}, {', '.join(_columns)} FROM qc")(lambda s, d, c=_columns: quality.day_counters(faulty(s, d)).select(*KEYS, *c))
catalog.add("quality_summary", f"{QC} SELECT instrument_id, count(*) AS days, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(duplicates) AS BIGINT) AS duplicates, CAST(sum(missing_sequences) AS BIGINT) AS missing, max(bad_sizes) AS worst_bad_sizes FROM qc GROUP BY instrument_id")(
    lambda s, d: quality.day_counters(faulty(s, d)).groupBy("instrument_id").agg(F.count(F.lit(1)).alias("days"), F.sum("rows").alias("rows"), F.sum("duplicates").alias("duplicates"), F.sum("missing_sequences").alias("missing"), F.max("bad_sizes").alias("worst_bad_sizes"))
)
catalog.add("quality_table", f"{QC} SELECT instrument_id, date, rows, duplicates, sequence_gaps, bad_sizes FROM qc ORDER BY instrument_id, date")(lambda s, d: quality.day_counters(faulty(s, d)).select(*KEYS, "rows", "duplicates", "sequence_gaps", "bad_sizes").orderBy(*KEYS))
_GAP = f"g AS (SELECT {DAY}, ts_event - lag(ts_event) OVER (PARTITION BY {DAY} ORDER BY ts_event, sequence) AS gap FROM sess WHERE in_session)"
catalog.add("session_gaps", f"WITH {l2_sql()}, {SESSION_SQL}, {_GAP} SELECT {DAY}, count(*) FILTER (gap > 2000000000) AS gaps, round(coalesce(max(gap), 0) / 1e9::DOUBLE, 3) AS longest_gap_s FROM g GROUP BY {DAY}")(lambda s, d: quality.session_gaps(session_rows(s, d)))
_FLAGS = "count(*) FILTER (book_flags & 1 > 0) AS out_of_range, count(*) FILTER (book_flags & 2 > 0) AS negative_sizes, count(*) FILTER (book_flags & 4 > 0) AS crossed, count(*) FILTER (book_flags & 8 > 0) AS locked, count(*) FILTER (book_flags & 16 > 0) AS flagged_bad_sizes, count(*) AS rows"
catalog.add("flag_counts", f"WITH {book_sql('bad')} SELECT {DAY}, {_FLAGS} FROM book GROUP BY {DAY}")(lambda s, d: quality.flag_counts(book.book_frame(l2_events(s, d, "bad"))))
catalog.add("quality_verdict", f"WITH {book_sql('bad')}, c AS (SELECT {DAY}, {_FLAGS} FROM book GROUP BY {DAY}) SELECT {DAY}, CASE WHEN rows = 0 THEN 'empty' WHEN crossed > rows * 0.001 THEN 'crossed' WHEN out_of_range > 0 THEN 'out of range' ELSE 'ok' END AS verdict FROM c")(
    lambda s, d: quality.verdicts(quality.flag_counts(book.book_frame(l2_events(s, d, "bad")))).select(*KEYS, "verdict")
)

# -------------------------------------------------------- rolls and calendars

FRONT_SQL = "fr AS (SELECT date, arg_max(instrument_id, (volume, -instrument_id)) AS front, max(volume) / sum(volume)::DOUBLE AS share FROM mini_volume GROUP BY date)"
ROLL_SQL = f"{FRONT_SQL}, ch AS (SELECT *, coalesce(front <> lag(front) OVER (ORDER BY date), false) AS changed FROM fr), rl AS (SELECT *, share < 0.85 OR max(changed::INT) OVER (ORDER BY date ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS is_roll FROM ch)"
catalog.add("front_contract", f"WITH {MINI_VOLUME_SQL}, {FRONT_SQL} SELECT date, front, round(share, 9) AS share FROM fr")(lambda s, d: quality.front_contracts(mini_volume(s, d)).withColumn("share", F.round("share", 9)))
catalog.add("roll_days", f"WITH {MINI_VOLUME_SQL}, {ROLL_SQL} SELECT date, front, changed, is_roll FROM rl")(lambda s, d: quality.roll_days(mini_volume(s, d)).select("date", "front", "changed", "is_roll"))
catalog.add("lag_change", f"WITH {MINI_VOLUME_SQL}, {ROLL_SQL} SELECT date, changed FROM rl WHERE changed")(lambda s, d: quality.roll_days(mini_volume(s, d)).filter("changed").select("date", "changed"))
catalog.add("anti_roll_days", f"WITH {MINI_VOLUME_SQL}, {ROLL_SQL} SELECT DISTINCT date FROM mini_volume ANTI JOIN (SELECT date FROM rl WHERE is_roll) x USING (date)")(
    lambda s, d: (lambda v: v.select("date").distinct().join(quality.roll_days(v).filter("is_roll").select("date"), "date", "left_anti"))(mini_volume(s, d))
)
catalog.add("volume_shares", f"WITH {MINI_VOLUME_SQL} SELECT date, instrument_id, volume, round(volume / sum(volume) OVER (PARTITION BY date)::DOUBLE, 9) AS share FROM mini_volume")(lambda s, d: mini_volume(s, d).withColumn("share", F.round(F.col("volume") / F.sum("volume").over(Window.partitionBy("date")), 9)))
HOLIDAYS = ("1995-01-02", "1995-12-25", "1996-01-01", "1996-12-25")
catalog.add("trading_days", f"SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(range(min(CAST(o_orderdate AS DATE))::TIMESTAMP, max(CAST(o_orderdate AS DATE))::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d FROM orders) WHERE isodow(d) <= 5 AND CAST(d AS DATE) NOT IN ({', '.join(f'DATE {h!r}' for h in HOLIDAYS)})")(
    lambda s, d: quality.trading_days(read(s, d, "orders").select(F.to_date("o_orderdate").alias("day")), "day", list(HOLIDAYS))
)

# ------------------------------------------------------------------ scalars

catalog.add("scalar_math", "SELECT event_id, abs(value - 100) AS a, round(ln(value + 1), 9) AS b, round(exp(-value / 100), 9) AS c, round(sqrt(value), 9) AS d, least(greatest(value, 10), 50) AS e, CAST(floor(value) AS BIGINT) // 7 AS f, round(pow(value, 0.5), 9) AS g FROM events")(
    lambda s, d: read(s, d, "events").select("event_id", F.abs(F.col("value") - 100).alias("a"), F.round(F.log(F.col("value") + 1), 9).alias("b"), F.round(F.exp(-F.col("value") / 100), 9).alias("c"), F.round(F.sqrt("value"), 9).alias("d"), F.least(F.greatest("value", F.lit(10.0)), F.lit(50.0)).alias("e"), F.expr("cast(floor(value) as bigint) div 7").alias("f"), F.round(F.pow("value", F.lit(0.5)), 9).alias("g"))
)
catalog.add("logit", "WITH p AS (SELECT event_id, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, CAST(floor(value) AS BIGINT) % 101 / 100.0::DOUBLE)) AS p FROM events) SELECT event_id, round(ln(p / (1 - p)), 8) AS logit FROM p")(
    lambda s, d: read(s, d, "events").select("event_id", F.round(scalar.logit(F.floor("value").cast("long") % 101 / F.lit(100.0)), 8).alias("logit"))
)
catalog.add("label_format", "SELECT n_nationkey, replace(lower(n_name), '_', ' ') || ' (' || printf('%05d', n_nationkey) || ')' AS label FROM nation")(lambda s, d: read(s, d, "nation").select("n_nationkey", F.concat(F.regexp_replace(F.lower("n_name"), "_", " "), F.format_string(" (%05d)", "n_nationkey")).alias("label")))
catalog.add("day_seed", f"WITH {l2_sql()} SELECT DISTINCT instrument_id, date, ('0x' || substr(sha256(instrument_id || '|' || date), 1, 8))::BIGINT AS seed FROM l2")(lambda s, d: l2_events(s, d).select(*KEYS).distinct().withColumn("seed", scalar.day_seed(F.col("instrument_id"), F.col("date"))))
_CASE = lambda x, codes, default: f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in codes.items()) + f" ELSE {default} END"
catalog.add("code_map", f"WITH c AS (SELECT o_orderkey, substr('ACMTFRX', CAST(o_orderkey % 7 + 1 AS INTEGER), 1) AS a, substr('BANX', CAST(o_orderkey % 4 + 1 AS INTEGER), 1) AS b FROM orders) SELECT o_orderkey, {_CASE('a', scalar.ACTION_CODES, 2)} AS action, {_CASE('b', scalar.SIDE_CODES, 0)} AS side FROM c")(
    lambda s, d: read(s, d, "orders").select("o_orderkey", scalar.coded(F.expr("substring('ACMTFRX', cast(o_orderkey % 7 + 1 as int), 1)"), scalar.ACTION_CODES, 2).alias("action"), scalar.coded(F.expr("substring('BANX', cast(o_orderkey % 4 + 1 as int), 1)"), scalar.SIDE_CODES, 0).alias("side"))
)
catalog.add("nan_to_null", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS x FROM events")(lambda s, d: read(s, d, "events").select("event_id", scalar.nan_to_null(F.when(F.col("event_id") % 5 == 0, float("nan")).otherwise(F.col("value"))).alias("x")))

# -------------------------------------------------------- descriptive tables

_DESC = f"""WITH {flow_sql('main')}, ss AS (SELECT * FROM f WHERE ts_event >= {OPEN} AND ts_event < {CLOSE}), dm AS (SELECT *, lag(mid) OVER w AS lm, row_number() OVER w AS kk FROM ss WINDOW w AS (PARTITION BY {DAY} ORDER BY sequence)),
a AS (SELECT {DAY}, count(*) AS events, (max(ts_event) - min(ts_event)) / 3.6e12::DOUBLE AS hours, avg(CASE WHEN ask_px - bid_px = 1 THEN 1.0 WHEN mid IS NOT NULL THEN 0.0 END) AS one_tick, count(*) FILTER (kk > 1 AND coalesce(mid <> lm, true)) AS mid_changes, count(*) FILTER (action = 3) AS trades FROM dm GROUP BY {DAY}),
q AS (SELECT {DAY}, median(x) AS mq FROM (SELECT {DAY}, qb AS x FROM ss WHERE mid IS NOT NULL UNION ALL SELECT {DAY}, qa FROM ss WHERE mid IS NOT NULL) GROUP BY {DAY})"""


def descriptive(spark, sf):
    rows = quality.with_session(features.with_mid(book.book_frame(l2_events(spark, sf)))).filter("in_session")
    w = Window.partitionBy(*KEYS).orderBy("sequence")
    rows = rows.withColumns({"lm": F.lag("mid").over(w), "k": F.row_number().over(w)})
    spread = F.col("ask_px") - F.col("bid_px")
    both = F.explode(F.array(*(F.when(F.col("mid").isNotNull(), F.col(c)) for c in ("qb", "qa"))))
    days = rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("events"), ((F.max("ts_event") - F.min("ts_event")) / 3.6e12).alias("hours"), F.avg((spread == 1).cast("double")).alias("one_tick"),
        F.count_if((F.col("k") > 1) & F.coalesce(F.col("mid") != F.col("lm"), F.lit(True))).alias("mid_changes"), F.count_if(F.col("action") == 3).alias("trades"),
    )
    return days.join(rows.select(*KEYS, both.alias("x")).groupBy(*KEYS).agg(F.percentile("x", F.lit(0.5)).alias("mq")), [*KEYS], "left")


@catalog.add("descriptive_days", f"{_DESC} SELECT {DAY}, events, CASE WHEN hours > 0 THEN round(events / (hours * 3600), 6) END AS events_per_s, round(one_tick, 9) AS spread_1tick_share, mq AS median_best_queue, mid_changes, CASE WHEN hours > 0 THEN round(mid_changes / (hours * 60), 6) END AS mid_changes_per_min, trades FROM a LEFT JOIN q USING ({DAY})")
def descriptive_days(spark, sf):
    hours = F.col("hours")
    return descriptive(spark, sf).select(*KEYS, "events", F.when(hours > 0, F.round(F.col("events") / (hours * 3600), 6)).alias("events_per_s"), F.round("one_tick", 9).alias("spread_1tick_share"), F.col("mq").alias("median_best_queue"), "mid_changes", F.when(hours > 0, F.round(F.col("mid_changes") / (hours * 60), 6)).alias("mid_changes_per_min"), "trades")


@catalog.add("descriptive_summary", f"{_DESC} SELECT instrument_id, count(*) AS days, round(avg(events), 6) AS mean_events, round(avg(one_tick), 9) AS one_tick, median(mq) AS median_queue, CAST(sum(trades) AS BIGINT) AS trades FROM a LEFT JOIN q USING ({DAY}) GROUP BY instrument_id")
def descriptive_summary(spark, sf):
    return descriptive(spark, sf).groupBy("instrument_id").agg(F.count(F.lit(1)).alias("days"), F.round(F.avg("events"), 6).alias("mean_events"), F.round(F.avg("one_tick"), 9).alias("one_tick"), F.percentile("mq", F.lit(0.5)).alias("median_queue"), F.sum("trades").alias("trades"))


catalog.add("queue_sample", f"WITH {flow_sql('main')}, n AS (SELECT *, row_number() OVER (PARTITION BY {DAY} ORDER BY sequence) AS k FROM f) SELECT {DAY}, sequence, qb AS bid_queue FROM n WHERE (k - 1) % 50 = 0")(
    lambda s, d: features.with_mid(book.book_frame(l2_events(s, d))).withColumn("k", F.row_number().over(Window.partitionBy(*KEYS).orderBy("sequence"))).filter("(k - 1) % 50 = 0").select(*ROW, F.col("qb").alias("bid_queue"))
)
catalog.add("queue_hist", f"WITH {flow_sql('main')} SELECT qb // 10 AS bin, count(*) AS n FROM f WHERE mid IS NOT NULL GROUP BY ALL")(lambda s, d: features.with_mid(book.book_frame(l2_events(s, d))).filter("mid IS NOT NULL").groupBy(F.expr("qb div 10").alias("bin")).agg(F.count(F.lit(1)).alias("n")))
catalog.add("imbalance_bins", f"WITH {flow_sql('main')} SELECT CAST(floor((CASE WHEN qb + qa > 0 THEN (qb - qa) / (qb + qa) ELSE 0 END + 1) * 5) AS BIGINT) AS bin, count(*) AS n, CAST(sum(size) AS BIGINT) AS weight FROM f WHERE mid IS NOT NULL GROUP BY ALL")(
    lambda s, d: features.with_mid(book.book_frame(l2_events(s, d))).filter("mid IS NOT NULL").groupBy(F.floor((features.ratio(F.col("qb") - F.col("qa"), F.col("qb") + F.col("qa")) + 1) * 5).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"))
)
catalog.add("inject_faults", f"WITH {l2_sql()}, {_FAULTY} SELECT {DAY}, ts_event, sequence, size, arrival FROM raw2")(lambda s, d: faulty(s, d).select(*KEYS, "ts_event", "sequence", "size", "arrival"))


# ------------------------------------------------ exact and positional

_NET = "l_extendedprice::DOUBLE * (1 - l_discount::DOUBLE) * 1125899906842624"


@catalog.add("exact_sums", f"SELECT l_suppkey, n AS n_net, ((s // 1099511627776)::DOUBLE * 1099511627776::DOUBLE + (s % 1099511627776)::DOUBLE) / 1125899906842624::DOUBLE AS net FROM (SELECT l_suppkey, count(*) AS n, sum(CAST({_NET} AS HUGEINT)) AS s FROM lineitem GROUP BY l_suppkey)")
def exact_sums(spark, sf):
    """Sums of products of doubles that are the same to the last bit in any order; SQL adds them up as integers of 2^-50."""
    net = F.col("l_extendedprice").cast("double") * (1 - F.col("l_discount").cast("double"))
    return exact.sums(read(spark, sf, "lineitem").select("l_suppkey", net.alias("net")), ("l_suppkey",), ("net",))


_SHARES = (0.01, 0.25, 1 / 3, 0.5, 0.9, 0.999)
_COLUMNS = ("l_extendedprice", "l_quantity", "l_discount")


@catalog.add("exact_quantiles", " UNION ALL ".join(f"SELECT '{c}' AS name, {p!r}::DOUBLE AS share, round(quantile_cont({c}::DOUBLE, {p!r}::DOUBLE), 9) AS value FROM lineitem" for c in _COLUMNS for p in _SHARES))
def exact_quantiles(spark, sf):
    """Quantiles by counting leading bits; no task sorts a column, however few its rows are."""
    found = exact.quantiles(read(spark, sf, "lineitem"), {c: list(_SHARES) for c in _COLUMNS}, few=0)
    return spark.createDataFrame([(c, p, v) for c in _COLUMNS for p, v in zip(_SHARES, found[c], strict=True)], "name string, share double, value double").withColumn("value", F.round("value", 9))


@catalog.add("row_slices", "SELECT position // 20000 AS slice, count(*) AS n, min(position) AS first_position, sum(l_orderkey * (position % 20000 + 1)) AS digest FROM (SELECT l_orderkey, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS position FROM lineitem) GROUP BY ALL")
def row_slices(spark, sf):
    """Slices of 20,000 rows in order, each read from its own folders; the digest depends on every row's place."""
    rows = read(spark, sf, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber")
    slices = positions.Slices(rows, "l_shipdate", "l_orderkey", "l_linenumber")
    place = F.col("position")
    return slices.table().groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first_position"), F.sum(F.col("l_orderkey") * (place % 20000 + 1)).alias("digest"))


@catalog.add(
    "asof_long_key",
    f"""WITH {l2_sql()}, a AS (SELECT event_id, 2000 * event_id + epoch_us(ts) AS at FROM events)
SELECT a.event_id, l.ts_event, l.instrument_id, l.sequence FROM a ASOF LEFT JOIN (SELECT *, row_number() OVER (ORDER BY ts_event, instrument_id, date, sequence) AS o FROM l2 QUALIFY row_number() OVER (PARTITION BY ts_event ORDER BY instrument_id DESC, date DESC, sequence DESC) = 1) l ON l.ts_event <= a.at""",
)
def asof_long_key(spark, sf):
    """All instruments and days as one key: the last event of any before each point, in many tasks."""
    table = l2_events(spark, sf).withColumn("all", F.lit(1)).withColumn("o", F.struct("instrument_id", "date", "sequence"))
    points = read(spark, sf, "events").select(F.lit(1).alias("all"), "event_id", (F.lit(2000).cast("long") * F.col("event_id") + micros("ts")).alias("at"))
    return joins.as_of_long(points, table, ("all",), "at", "ts_event", "o", ["ts_event", "instrument_id", "sequence"]).drop("all", "at")
