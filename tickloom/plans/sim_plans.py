"""Queries over simulated orders: fills, checkpoints, strategies, trade logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import book, features, joins, policies, quality, simulator, stats
from tickloom.plans.book_plans import OPEN_SQL
from tickloom.plans.registry import Catalog
from tickloom.plans.sql import DAY, LEVELS, book_sql, flow_sql, time_sum
from tickloom.schema import DAY as KEYS
from tickloom.schema import DEFAULT, QUEUE_MODELS, SECOND
from tickloom.sources.fixtures import MINI_LOG_SQL, RELEASES_SQL, l2_events, l2_sql, mini_log, releases
from tickloom.sources.scratch import stored

catalog = Catalog()
#: Deadlines fit the compressed days of the fixtures.
SIM = DEFAULT.override(decisions_per_day=10, deadlines_s=(1, 2, 4), headline=("proportional", 10, 2))
ORDER = [*simulator.ORDER]
CELL = ["latency_ms", "deadline_s"]
K = f"{DAY}, decision_id"
KC = f"{K}, latency_ms, deadline_s"


def day_start():
    return F.unix_micros(F.to_utc_timestamp(F.concat(F.col("date").cast("string"), F.lit(" 00:00:00")), "UTC"))


def made(spark, sf):
    return simulator.decisions(l2_events(spark, sf).select(*KEYS).distinct(), SIM, day_start(), day_start() + 86_400_000_000)


def books(spark, sf):
    """The book, written once: one plan reads it many times."""
    return stored(book.book_frame(l2_events(spark, sf)), "book")


def sim(spark, sf, frame=None):
    """Simulated orders, written once: all strategies share them. ``frame`` is the book, if it is there already."""
    return stored(simulator.simulate(made(spark, sf), books(spark, sf) if frame is None else frame, SIM), "orders")


DEC_SQL = f"""dd AS (SELECT DISTINCT {DAY}, epoch_us(CAST(date AS TIMESTAMP)) AS d0 FROM l2), dh AS (SELECT {DAY}, CAST(i AS INTEGER) AS decision_id, d0 + 1000000000 AS lo, d0 + 86400000000 - 5000000000 AS hi, md5(instrument_id || '|' || date || '|' || i) AS h FROM dd, range(10) t(i)),
dec AS (SELECT {DAY}, decision_id, lo + ((('0x' || substr(h, 1, 8))::BIGINT * ((hi - lo) >> 12)) >> 20) AS t0, CASE WHEN ('0x' || substr(h, 9, 1))::INTEGER % 2 = 0 THEN 1 ELSE -1 END AS s FROM dh)"""
_ARR = lambda side: "[" + ", ".join(f"{side}_sz_{i}" for i in range(LEVELS)) + "]"
B_SQL = f"""b0 AS (SELECT instrument_id, date, ts_event, sequence, action, side, price, size, queue_pos, bid_px, ask_px, {_ARR('bid')} AS bd, {_ARR('ask')} AS ad FROM book),
b AS (SELECT *, lag(bid_px) OVER w AS pbid, lag(ask_px) OVER w AS pask, lag(bd) OVER w AS pbd, lag(ad) OVER w AS pad FROM b0 WINDOW w AS (PARTITION BY {DAY} ORDER BY sequence)),
lb AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY {DAY}, ts_event ORDER BY sequence DESC) = 1)"""


def asof_sql(points: str, columns: str, join: str = "LEFT") -> str:
    """``points`` (p, with ``ats``) as of the book (q)."""
    return f"SELECT p.*, {columns} FROM {points} p ASOF {join} JOIN lb q ON q.instrument_id = p.instrument_id AND q.date = p.date AND q.ts_event <= p.ats"


def shown(bid: str, ask: str, bd: str, ad: str) -> str:
    off = f"(CASE WHEN s = 1 THEN {bid} - px ELSE px - {ask} END)"
    return f"(CASE WHEN {off} IS NULL AND (CASE WHEN s = 1 THEN {bid} ELSE {ask} END) IS NULL THEN -2 WHEN {off} < 0 THEN -2 WHEN {off} >= {LEVELS} THEN -1 ELSE (CASE WHEN s = 1 THEN {bd} ELSE {ad} END)[CAST({off} + 1 AS INTEGER)] END)"


ORDERS_SQL = f"""WITH RECURSIVE {book_sql()}, {B_SQL}, {DEC_SQL},
o1 AS (SELECT * EXCLUDE (ats) FROM ({asof_sql('(SELECT *, t0 AS ats FROM dec)', '0.5 * (q.bid_px + q.ask_px) AS mid, CASE WHEN s = 1 THEN q.bd[1] ELSE q.ad[1] END AS own_queue, q.ask_px - q.bid_px AS spread', 'INNER')})),
o2 AS (SELECT * EXCLUDE (ats) FROM ({asof_sql('(SELECT *, t0 + latency_ms * 1000000 AS ats FROM o1, (VALUES (0), (1), (10), (100)) l(latency_ms))', 'q.sequence AS entry_seq, CASE WHEN s = 1 THEN q.bid_px ELSE q.ask_px END AS px, CAST(CASE WHEN s = 1 THEN q.bd[1] ELSE q.ad[1] END AS DOUBLE) AS ahead0, CASE WHEN s = 1 THEN q.ask_px ELSE q.bid_px END AS cross_px')})),
o3 AS (SELECT * EXCLUDE (ats) FROM ({asof_sql('(SELECT *, t0 + deadline_s * 1000000000::BIGINT + latency_ms * 1000000 AS ats FROM o2, (VALUES (1), (2), (4)) d(deadline_s))', 'CASE WHEN s = 1 THEN q.ask_px ELSE q.bid_px END AS end_px')}))"""


def walk_sql(orders: str, start: str, prefix: str = "") -> str:
    """Recursive walk over the events of each order, by queue model: ``{prefix}sim``."""
    x = prefix
    left = """CASE WHEN kind = 'trade' THEN w.ahead - e.size WHEN kind IN ('cancel', 'cut') THEN CASE WHEN w.m = 0 THEN w.ahead WHEN w.m = 2 THEN w.ahead - least(c, w.ahead)
      WHEN w.m = 3 AND pos >= 0 THEN w.ahead - greatest(least(pos + c, w.ahead) - greatest(pos, 0), 0) WHEN bef > 0 THEN w.ahead - c * least(w.ahead, bef) / bef ELSE w.ahead END ELSE w.ahead END"""
    return f"""{x}e0 AS (SELECT o.instrument_id, o.date, o.decision_id, o.latency_ms, o.deadline_s, o.s, o.px, b.sequence, b.ts_event, b.action, b.price, b.size, b.queue_pos, {shown('b.pbid', 'b.pask', 'b.pbd', 'b.pad')} AS bef, {shown('b.bid_px', 'b.ask_px', 'b.bd', 'b.ad')} AS now,
    coalesce(CASE WHEN s = 1 THEN b.ask_px <= px ELSE b.bid_px >= px END, false) AS touched, CASE WHEN b.action = 3 AND b.side = -s THEN CASE WHEN b.price * s < px * s THEN 'through' WHEN b.price = px THEN 'trade' END
      WHEN b.price = px AND (CASE WHEN b.side = 1 THEN 1 ELSE -1 END) = s THEN CASE WHEN b.action = 1 THEN 'cancel' WHEN b.action = 2 AND bef > 0 AND b.size < bef THEN 'cut' END END AS kind,
    row_number() OVER (PARTITION BY o.instrument_id, o.date, o.decision_id, o.latency_ms, o.deadline_s ORDER BY b.sequence) AS k
  FROM {orders} o JOIN b ON b.instrument_id = o.instrument_id AND b.date = o.date AND b.ts_event > {start} AND b.ts_event <= o.t0 + o.deadline_s * 1000000000::BIGINT),
{x}e AS (SELECT *, CASE WHEN kind = 'cut' THEN bef - size ELSE size END AS c, CASE WHEN kind = 'cut' THEN -1 ELSE queue_pos END AS pos FROM {x}e0),
{x}walk AS (SELECT {KC}, m, CAST(0 AS BIGINT) AS k, ahead0 AS ahead, false AS done, CAST(NULL AS BIGINT) AS fill_seq, CAST(NULL AS BIGINT) AS fill_ts FROM {orders}, range(4) t(m)
  UNION ALL SELECT w.instrument_id, w.date, w.decision_id, w.latency_ms, w.deadline_s, w.m, e.k, CASE WHEN f THEN w.ahead WHEN e.now = -2 THEN 0 WHEN e.now >= 0 AND l > e.now THEN e.now ELSE l END, f, CASE WHEN f THEN e.sequence END, CASE WHEN f THEN e.ts_event END
  FROM (SELECT w.*, e.*, {left} AS l, coalesce(kind = 'through' OR (kind = 'trade' AND e.size > w.ahead) OR touched, false) AS f FROM {x}walk w JOIN {x}e e ON e.instrument_id = w.instrument_id AND e.date = w.date AND e.decision_id = w.decision_id AND e.latency_ms = w.latency_ms AND e.deadline_s = w.deadline_s AND e.k = w.k + 1 WHERE NOT w.done)),
{x}last AS (SELECT * FROM {x}walk QUALIFY row_number() OVER (PARTITION BY {KC}, m ORDER BY k DESC) = 1),
{x}sim AS (SELECT o.*, m, ['pessimistic', 'proportional', 'optimistic', 'exact'][CAST(m + 1 AS INTEGER)] AS queue_model, done AS filled, fill_seq, fill_ts, CASE WHEN done THEN px ELSE end_px END AS passive_px FROM {orders} o JOIN {x}last USING ({KC}))"""


def _walk_fixed(orders: str, start: str, prefix: str = "") -> str:
    """The recursive step names its two sides plainly, so that no column is ambiguous."""
    sql = walk_sql(orders, start, prefix)
    x = prefix
    a = sql.index("  FROM (SELECT w.*, e.*,")
    b = sql.index(f"{x}last AS")
    inner = sql[a:b]
    left = inner[inner.index("w.*, e.*, ") + len("w.*, e.*, ") : inner.index(" AS l, coalesce")]
    step = f"""  FROM (SELECT w.instrument_id, w.date, w.decision_id, w.latency_ms, w.deadline_s, w.m, w.ahead, e.k, e.sequence, e.ts_event, e.now, {left} AS l, coalesce(kind = 'through' OR (kind = 'trade' AND e.size > w.ahead) OR touched, false) AS f
    FROM {x}walk w JOIN {x}e e ON e.instrument_id = w.instrument_id AND e.date = w.date AND e.decision_id = w.decision_id AND e.latency_ms = w.latency_ms AND e.deadline_s = w.deadline_s AND e.k = w.k + 1 WHERE NOT w.done) z),
"""
    head = sql[:a]
    cut = head.index("  UNION ALL SELECT w.instrument_id")
    head = head[:cut] + "  UNION ALL SELECT instrument_id, date, decision_id, latency_ms, deadline_s, m, k, CAST(CASE WHEN f THEN ahead WHEN now = -2 THEN 0 WHEN now >= 0 AND l > now THEN now ELSE l END AS DOUBLE), f, CASE WHEN f THEN sequence END, CASE WHEN f THEN ts_event END\n"
    return head + step + sql[b:]


SIM_SQL = f"{ORDERS_SQL}, {_walk_fixed('o3', 'o.t0 + o.latency_ms * 1000000')}"

catalog.add("decisions", f"WITH {l2_sql()}, {DEC_SQL} SELECT {K}, t0, s AS order_side FROM dec")(made)
catalog.add("grid_cells", f"WITH {MINI_LOG_SQL} SELECT q AS queue_model, l AS latency_ms, d AS deadline_s, count(decision_id) AS logged FROM (VALUES ('pessimistic'), ('proportional'), ('optimistic'), ('exact')) a(q) CROSS JOIN (VALUES (0), (1), (10), (100)) b(l) CROSS JOIN (VALUES (5), (15), (30)) c(d) LEFT JOIN mini_log ON queue_model = q AND latency_ms = l AND deadline_s = d GROUP BY ALL")(
    lambda s, d: policies.grid(s, DEFAULT).join(mini_log(s, d).groupBy("queue_model", *CELL).agg(F.count("decision_id").alias("logged")), ["queue_model", *CELL], "left").withColumn("logged", F.coalesce("logged", F.lit(0)))
)


@catalog.add("asof_book", f"WITH {book_sql()}, {B_SQL}, {DEC_SQL} SELECT instrument_id, date, decision_id, t0, sequence, bid_px, ask_px FROM ({asof_sql('(SELECT *, t0 AS ats FROM dec)', 'q.sequence, q.bid_px, q.ask_px')})")
def asof_book(spark, sf):
    rows = books(spark, sf).withColumn("seq", F.col("sequence"))
    return joins.as_of(made(spark, sf), rows, KEYS, "t0", "ts_event", "sequence", ["seq", "bid_px", "ask_px"]).select(*ORDER, "t0", F.col("seq").alias("sequence"), "bid_px", "ask_px")


@catalog.add("decision_events", f"WITH {l2_sql()}, {DEC_SQL} SELECT dec.instrument_id, dec.date, decision_id, sequence FROM dec JOIN l2 ON l2.instrument_id = dec.instrument_id AND l2.date = dec.date AND ts_event > t0 AND ts_event <= t0 + 4000000000")
def decision_events(spark, sf):
    points = made(spark, sf).withColumn("stop", F.col("t0") + 4_000_000_000)
    return joins.in_interval(points, l2_events(spark, sf), list(KEYS), "t0", "stop", "ts_event", 4_000_000_000).select(*ORDER, "sequence")


@catalog.add("checkpoint0", f"{ORDERS_SQL} SELECT {K}, latency_ms, own_queue AS ahead, cross_px FROM o2")
def checkpoint0(spark, sf):
    return simulator.orders_at_touch(made(spark, sf), books(spark, sf), SIM.override(deadlines_s=(4,))).select(*ORDER, "latency_ms", F.col("own_queue").alias("ahead"), "cross_px")


@catalog.add("entry_touch", f"{ORDERS_SQL} SELECT {K}, latency_ms, entry_seq, px AS entry_px, ahead0 FROM o2")
def entry_touch(spark, sf):
    return simulator.orders_at_touch(made(spark, sf), books(spark, sf), SIM.override(deadlines_s=(4,))).select(*ORDER, "latency_ms", "entry_seq", "entry_px", "ahead0")


@catalog.add("deadline_cross", f"{ORDERS_SQL} SELECT {KC}, end_px FROM o3")
def deadline_cross(spark, sf):
    return simulator.orders_at_touch(made(spark, sf), books(spark, sf), SIM).select(*ORDER, *CELL, "end_px")


CAP_SQL = f"cp AS (SELECT {DAY}, CAST(greatest(1, floor(median(q) * 0.25)) AS BIGINT) AS cap FROM (SELECT {DAY}, bd[1] AS q FROM b WHERE bid_px IS NOT NULL AND ask_px IS NOT NULL UNION ALL SELECT {DAY}, ad[1] FROM b WHERE bid_px IS NOT NULL AND ask_px IS NOT NULL) GROUP BY {DAY})"
catalog.add("new_level_cap", f"WITH {book_sql()}, {B_SQL}, {CAP_SQL} SELECT * FROM cp")(lambda s, d: simulator.new_level_cap(books(s, d), SIM))

NEW_SQL = f"""{ORDERS_SQL}, {CAP_SQL},
fr AS (SELECT o.instrument_id, o.date, o.decision_id, o.latency_ms, o.deadline_s, o.s, o.t0, b.sequence AS fresh_seq, CASE WHEN s = 1 THEN b.bid_px ELSE b.ask_px END AS px, b.ts_event + o.latency_ms * 1000000 AS ats
  FROM o3 o JOIN b ON b.instrument_id = o.instrument_id AND b.date = o.date AND b.ts_event > o.t0 + o.latency_ms * 1000000 AND b.ts_event <= o.t0 + o.deadline_s * 1000000000::BIGINT JOIN cp ON cp.instrument_id = o.instrument_id AND cp.date = o.date
  WHERE CASE WHEN s = 1 THEN b.bid_px > coalesce(b.pbid, -(1::BIGINT << 40)) AND b.bd[1] <= cap ELSE b.ask_px < coalesce(b.pask, 1::BIGINT << 40) AND b.ad[1] <= cap END),
ld AS (SELECT * FROM ({asof_sql('(SELECT * FROM fr WHERE ats <= t0 + deadline_s * 1000000000::BIGINT)', 'q.sequence AS entry_seq, q.bid_px, q.ask_px, q.bd, q.ad')}) WHERE NOT coalesce(CASE WHEN s = 1 THEN px >= ask_px ELSE px <= bid_px END, false)),
l1 AS (SELECT *, CAST(greatest({shown('bid_px', 'ask_px', 'bd', 'ad')}, 0) AS DOUBLE) AS ahead0 FROM ld QUALIFY row_number() OVER (PARTITION BY {KC} ORDER BY fresh_seq) = 1),
n3 AS (SELECT o.* EXCLUDE (entry_seq, px, ahead0), l1.entry_seq, l1.px, l1.ahead0, coalesce(l1.ats, o.t0 + o.deadline_s * 1000000000::BIGINT) AS landed FROM o3 o LEFT JOIN l1 USING ({KC}))"""


@catalog.add("entry_new_level", f"{NEW_SQL} SELECT {KC}, entry_seq, px AS entry_px, ahead0 FROM n3")
def entry_new_level(spark, sf):
    return simulator.orders_at_new_level(made(spark, sf), books(spark, sf), SIM).select(*ORDER, *CELL, "entry_seq", "entry_px", "ahead0")


_FILL = "filled, fill_seq, fill_ts, passive_px"


@catalog.add("fill_outcome", f"{SIM_SQL} SELECT {KC}, queue_model, {_FILL} FROM sim")
def fill_outcome(spark, sf):
    return sim(spark, sf).select(*ORDER, *CELL, "queue_model", "filled", "fill_seq", "fill_ts", "passive_px")


@catalog.add("queue_models", f"{SIM_SQL} SELECT queue_model, latency_ms, deadline_s, count(*) AS n, count(*) FILTER (filled) AS fills, CAST(sum((fill_ts - t0)) AS BIGINT) AS total_wait FROM sim GROUP BY ALL")
def queue_models(spark, sf):
    return sim(spark, sf).groupBy("queue_model", *CELL).agg(F.count(F.lit(1)).alias("n"), F.count_if("filled").alias("fills"), F.sum(F.col("fill_ts") - F.col("t0")).alias("total_wait"))


NEW_SIM_SQL = f"{NEW_SQL}, {_walk_fixed('n3', 'o.landed', 'n')}"


@catalog.add("strat_new_level", f"{NEW_SIM_SQL} SELECT {KC}, queue_model, {_FILL}, CASE WHEN filled THEN 'limit' WHEN px IS NOT NULL THEN 'limit_then_market' ELSE 'market' END AS order_type, CAST(s * (passive_px - mid) AS DOUBLE) + 0.0::DOUBLE AS cost_ticks FROM nsim")
def strat_new_level(spark, sf):
    rows = simulator.simulate_new_level(made(spark, sf), books(spark, sf), SIM)
    return policies.new_level(rows).select(*ORDER, *CELL, "queue_model", "filled", "fill_seq", "fill_ts", "passive_px", "order_type", "cost_ticks")


CP_SQL = f"""{SIM_SQL},
cj AS (SELECT sim.*, j, t0 + j * 250000000 AS ats FROM sim, range(1, 16) t(j) WHERE j < deadline_s * 4 AND NOT (filled AND fill_ts <= t0 + j * 250000000)),
c0 AS (SELECT * FROM cj UNION ALL SELECT sim.*, 0, t0 FROM sim),
c1 AS (SELECT * FROM ({asof_sql('c0', 'q.sequence AS cp_seq, CASE WHEN s = 1 THEN q.bid_px ELSE q.ask_px END AS own_best')})),
c2 AS (SELECT * FROM ({asof_sql('(SELECT * REPLACE (ats + latency_ms * 1000000 AS ats) FROM c1)', 'CASE WHEN s = 1 THEN q.ask_px ELSE q.bid_px END AS cp_cross')})),
c3 AS (SELECT c2.*, CASE WHEN j = 0 THEN CAST(own_queue AS DOUBLE) ELSE (SELECT arg_max(w.ahead, w.k) FROM walk w LEFT JOIN e ON e.instrument_id = w.instrument_id AND e.date = w.date AND e.decision_id = w.decision_id AND e.latency_ms = w.latency_ms AND e.deadline_s = w.deadline_s AND e.k = w.k
    WHERE w.instrument_id = c2.instrument_id AND w.date = c2.date AND w.decision_id = c2.decision_id AND w.latency_ms = c2.latency_ms AND w.deadline_s = c2.deadline_s AND w.m = c2.m AND (w.k = 0 OR e.ts_event <= c2.t0 + j * 250000000)) END AS ahead,
  (t0 + deadline_s * 1000000000::BIGINT - (t0 + j * 250000000)) / 1e9::DOUBLE AS tleft_s, CASE WHEN j = 0 OR own_best = px THEN 1 ELSE 0 END AS at_touch FROM c2)"""


def checkpoints(spark, sf, frame=None):
    frame = books(spark, sf) if frame is None else frame
    return stored(simulator.checkpoint_rows(sim(spark, sf, frame), frame, SIM), "checkpoints")


@catalog.add("checkpoints", f"{CP_SQL} SELECT {KC}, queue_model, CAST(j AS BIGINT) AS j, cp_seq, ahead, tleft_s, cp_cross, at_touch FROM c3")
def checkpoint_table(spark, sf):
    return checkpoints(spark, sf).select(*ORDER, *CELL, "queue_model", "j", "cp_seq", "ahead", "tleft_s", "cp_cross", "at_touch")


catalog.add("checkpoint_rows", f"{CP_SQL} SELECT queue_model, latency_ms, deadline_s, CAST(j AS BIGINT) AS j, count(*) AS n, count(*) FILTER (at_touch = 1) AS touching FROM c3 GROUP BY ALL")(
    lambda s, d: checkpoints(s, d).groupBy("queue_model", *CELL, "j").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("at_touch") == 1).alias("touching"))
)
catalog.add("gather_checkpoint", f"{CP_SQL} SELECT {KC}, queue_model, cp_cross AS cross_2 FROM c3 WHERE j = 2")(lambda s, d: checkpoints(s, d).filter("j = 2").select(*ORDER, *CELL, "queue_model", F.col("cp_cross").alias("cross_2")))
catalog.add("cost_to_go", f"{CP_SQL} SELECT {KC}, queue_model, CAST(j AS BIGINT) AS j, s * (passive_px - cp_cross) AS label FROM c3")(lambda s, d: policies.with_cost_to_go(checkpoints(s, d)).select(*ORDER, *CELL, "queue_model", "j", "label"))
catalog.add("cost_ticks", f"{SIM_SQL} SELECT {KC}, queue_model, CAST(s * (passive_px - mid) AS DOUBLE) + 0.0::DOUBLE AS cost_ticks FROM sim")(lambda s, d: policies.always_post(sim(s, d), SIM).select(*ORDER, *CELL, "queue_model", "cost_ticks"))
catalog.add("strat_always_cross", f"{SIM_SQL} SELECT {KC}, queue_model, CAST(s * (cross_px - mid) AS DOUBLE) + 0.0::DOUBLE AS cost_ticks, t0 + latency_ms * 1000000 AS exec_ts FROM sim")(lambda s, d: policies.always_cross(sim(s, d), SIM).select(*ORDER, *CELL, "queue_model", "cost_ticks", "exec_ts"))
_EXEC = "CASE WHEN filled THEN fill_ts ELSE t0 + deadline_s * 1000000000::BIGINT + latency_ms * 1000000 END AS exec_ts"
catalog.add("strat_always_post", f"{SIM_SQL} SELECT {KC}, queue_model, CAST(s * (passive_px - mid) AS DOUBLE) + 0.0::DOUBLE AS cost_ticks, CASE WHEN filled THEN 'limit' ELSE 'limit_then_market' END AS order_type, {_EXEC} FROM sim")(
    lambda s, d: policies.always_post(sim(s, d), SIM).select(*ORDER, *CELL, "queue_model", "cost_ticks", "order_type", "exec_ts")
)
_AB = f"""{CP_SQL}, ab AS (SELECT {KC}, queue_model, min(j) AS j FROM c3 WHERE ahead > 20 AND j % 2 = 1 GROUP BY ALL),
ao AS (SELECT sim.*, ab.j, c3.cp_cross FROM sim LEFT JOIN ab USING ({KC}, queue_model) LEFT JOIN c3 ON c3.instrument_id = sim.instrument_id AND c3.date = sim.date AND c3.decision_id = sim.decision_id AND c3.latency_ms = sim.latency_ms AND c3.deadline_s = sim.deadline_s AND c3.queue_model = sim.queue_model AND c3.j = ab.j)"""


def abandoned(spark, sf):
    """Orders given up at the first odd checkpoint with over 20 lots ahead."""
    rows = checkpoints(spark, sf)
    return policies.abandon(rows, (F.col("ahead") > 20) & (F.col("j") % 2 == 1), SIM)


catalog.add("first_abandon", f"{_AB} SELECT {KC}, queue_model, CAST(j AS BIGINT) AS j FROM ao")(lambda s, d: abandoned(s, d).select(*ORDER, *CELL, "queue_model", F.col("abandon_j").alias("j")))
catalog.add("abandon_outcome", f"{_AB} SELECT {KC}, queue_model, CAST(s * (CASE WHEN j IS NOT NULL THEN cp_cross ELSE passive_px END - mid) AS DOUBLE) + 0.0::DOUBLE AS cost_ticks, j IS NULL AND filled AS passive_fill FROM ao")(lambda s, d: abandoned(s, d).select(*ORDER, *CELL, "queue_model", "cost_ticks", "passive_fill"))
catalog.add("exec_ts", f"{_AB} SELECT {KC}, queue_model, CASE WHEN j IS NOT NULL THEN t0 + j * 250000000 + latency_ms * 1000000 WHEN filled THEN fill_ts ELSE t0 + deadline_s * 1000000000::BIGINT + latency_ms * 1000000 END AS exec_ts FROM ao")(lambda s, d: abandoned(s, d).select(*ORDER, *CELL, "queue_model", "exec_ts"))
ORACLE_COST = f"{CP_SQL}, mc AS (SELECT {KC}, queue_model, min(s * (cp_cross - mid) + 0.0::DOUBLE) AS c FROM c3 GROUP BY ALL) SELECT {KC}, queue_model, CAST(least(c, s * (passive_px - mid) + 0.0::DOUBLE) AS DOUBLE) AS cost_ticks FROM sim JOIN mc USING ({KC}, queue_model)"
catalog.add("oracle_cost", ORACLE_COST)(lambda s, d: policies.oracle(checkpoints(s, d)).select(*ORDER, *CELL, "queue_model", "cost_ticks"))
_ADV = f"""{SIM_SQL}, a0 AS (SELECT * FROM ({asof_sql('(SELECT *, fill_ts AS ats FROM sim WHERE filled)', '0.5 * (q.bid_px + q.ask_px) AS m0')})), a1 AS (SELECT * FROM ({asof_sql('(SELECT * REPLACE (fill_ts + 1000000000 AS ats) FROM a0)', '0.5 * (q.bid_px + q.ask_px) AS m1')})), a5 AS (SELECT * FROM ({asof_sql('(SELECT * REPLACE (fill_ts + 5000000000 AS ats) FROM a1)', '0.5 * (q.bid_px + q.ask_px) AS m5')}))
SELECT {KC}, queue_model, CAST(s * (m0 - m1) AS DOUBLE) AS adverse_1s, CAST(s * (m0 - m5) AS DOUBLE) AS adverse_5s FROM a5"""
catalog.add("adverse_move", _ADV)(lambda s, d: policies.adverse(sim(s, d).filter("filled"), features.with_mid(books(s, d))).select(*ORDER, *CELL, "queue_model", "adverse_1s", "adverse_5s"))
catalog.add("fees", f"{SIM_SQL} SELECT {KC}, queue_model, CAST(s * (passive_px - mid) * 15.625 + 2.5 AS DOUBLE) AS cost_usd, 2.5::DOUBLE AS fee_usd FROM sim")(lambda s, d: policies.with_fees(policies.always_post(sim(s, d), SIM), SIM).select(*ORDER, *CELL, "queue_model", "cost_usd", "fee_usd"))

_T = "AS (SELECT {}, queue_model".format(KC)
LOG_SQL = f"""{CP_SQL}, mc AS (SELECT {KC}, queue_model, min(s * (cp_cross - mid) + 0.0::DOUBLE) AS c FROM c3 GROUP BY ALL)
SELECT {KC}, queue_model, 'always_cross' AS strategy, 'market' AS order_type, false AS filled_passive, t0 + latency_ms * 1000000 AS exec_ts, CAST(s * (cross_px - mid) AS DOUBLE) + 0.0::DOUBLE AS cost_ticks FROM sim
UNION ALL SELECT {KC}, queue_model, 'always_post', CASE WHEN filled THEN 'limit' ELSE 'limit_then_market' END, filled, {_EXEC.replace(' AS exec_ts', '')}, CAST(s * (passive_px - mid) AS DOUBLE) + 0.0::DOUBLE FROM sim
UNION ALL SELECT {KC}, queue_model, 'oracle', 'oracle_upper_bound', false, t0, CAST(least(c, s * (passive_px - mid) + 0.0::DOUBLE) AS DOUBLE) FROM sim JOIN mc USING ({KC}, queue_model)"""


@catalog.add("trade_log", LOG_SQL)
def trade_log(spark, sf):
    """Strategies without a model on the same decisions; each model has a query of its own."""
    rows = checkpoints(spark, sf)
    orders = policies.orders_of(rows)
    parts = [policies.always_cross(orders, SIM), policies.always_post(orders, SIM), policies.oracle(rows)]
    return policies.union_log(parts).select(*ORDER, *CELL, "queue_model", "strategy", "order_type", "filled_passive", "exec_ts", "cost_ticks")


# ------------------------------------- from simulated orders to cost tables

#: Half a release window in the compressed time of the fixtures.
RELEASE_WIDTH = 300_000_000
_NEW_TAIL, _CP_TAIL, _FLOW_TAIL = NEW_SQL[len(ORDERS_SQL) :], CP_SQL[len(SIM_SQL) :], flow_sql()[len(book_sql()) :]
_END = "t0 + deadline_s * 1000000000::BIGINT + latency_ms * 1000000"
_BASE = f"{KC}, queue_model, t0, s, CAST(own_queue AS DOUBLE) AS own_queue, CAST(spread AS DOUBLE) AS spread_ticks"
_NEAR = lambda shift: f"(SELECT *, fill_ts + {shift} AS ats FROM pf)"
FULL_SQL = f"""{SIM_SQL}{_NEW_TAIL}, {_walk_fixed('n3', 'o.landed', 'n')}{_CP_TAIL}{_FLOW_TAIL}, {RELEASES_SQL},
mc AS (SELECT {KC}, queue_model, min(s * (cp_cross - mid) + 0.0::DOUBLE) AS c FROM c3 GROUP BY ALL),
lg AS (SELECT {_BASE}, 'always_cross' AS strategy, 'market' AS order_type, false AS filled_passive, t0 + latency_ms * 1000000 AS exec_ts, CAST(s * (cross_px - mid) AS DOUBLE) + 0.0::DOUBLE AS cost_ticks, CAST(NULL AS BIGINT) AS fill_ts FROM sim
  UNION ALL SELECT {_BASE}, 'always_post', CASE WHEN filled THEN 'limit' ELSE 'limit_then_market' END, filled, CASE WHEN filled THEN fill_ts ELSE {_END} END, CAST(s * (passive_px - mid) AS DOUBLE) + 0.0::DOUBLE, fill_ts FROM sim
  UNION ALL SELECT {_BASE}, 'new_level', CASE WHEN filled THEN 'limit' WHEN px IS NOT NULL THEN 'limit_then_market' ELSE 'market' END, filled, CASE WHEN filled THEN fill_ts ELSE {_END} END, CAST(s * (passive_px - mid) AS DOUBLE) + 0.0::DOUBLE, fill_ts FROM nsim
  UNION ALL SELECT {_BASE}, 'oracle', 'oracle_upper_bound', false, t0, CAST(least(c, s * (passive_px - mid) + 0.0::DOUBLE) AS DOUBLE), NULL FROM sim JOIN mc USING ({KC}, queue_model)),
vf AS (SELECT {DAY}, ts_event, sequence, CASE WHEN mid IS NOT NULL THEN CAST({time_sum('chg', 300 * SECOND)} / CAST(300 AS DOUBLE) AS DOUBLE) END AS vol_300s, (ts_event - {OPEN_SQL}) / CAST(60000000000 AS DOUBLE) AS minutes_since_open FROM f),
vl AS (SELECT * FROM vf QUALIFY row_number() OVER (PARTITION BY {DAY}, ts_event ORDER BY sequence DESC) = 1),
av AS (SELECT d.instrument_id, d.date, d.decision_id, vl.vol_300s, vl.minutes_since_open, EXISTS (SELECT 1 FROM releases r WHERE d.t0 >= r.ts_ns - {RELEASE_WIDTH} AND d.t0 < r.ts_ns + {RELEASE_WIDTH}) AS in_release_window FROM dec d ASOF LEFT JOIN vl ON vl.instrument_id = d.instrument_id AND vl.date = d.date AND vl.ts_event <= d.t0),
pf AS (SELECT {KC}, queue_model, strategy, s, fill_ts FROM lg WHERE filled_passive),
p0 AS ({asof_sql(_NEAR(0), '0.5 * (q.bid_px + q.ask_px) AS m0')}), p1 AS ({asof_sql(_NEAR(1000000000), '0.5 * (q.bid_px + q.ask_px) AS m1')}), p5 AS ({asof_sql(_NEAR(5000000000), '0.5 * (q.bid_px + q.ask_px) AS m5')}),
mv AS (SELECT {KC}, queue_model, strategy, CAST(p0.s * (m0 - m1) AS DOUBLE) + 0.0::DOUBLE AS adverse_1s, CAST(p0.s * (m0 - m5) AS DOUBLE) + 0.0::DOUBLE AS adverse_5s FROM p0 JOIN p1 USING ({KC}, queue_model, strategy) JOIN p5 USING ({KC}, queue_model, strategy)),
fl AS (SELECT lg.*, t0 AS decision_ts, (exec_ts - t0) / 1000000.0::DOUBLE AS time_to_fill_ms, cost_ticks * 15.625 + 2.5 AS cost_usd, adverse_1s, adverse_5s, vol_300s, minutes_since_open, in_release_window FROM lg JOIN av USING ({K}) LEFT JOIN mv USING ({KC}, queue_model, strategy))"""
_FULL = ("decision_ts", "own_queue", "spread_ticks", "strategy", "order_type", "filled_passive", "exec_ts", "time_to_fill_ms", "cost_ticks", "cost_usd", "adverse_1s", "adverse_5s", "vol_300s", "minutes_since_open", "in_release_window")


def full_log(spark, sf):
    """Every strategy that needs no model on the same decisions, as cost tables want it; written once."""
    frame = books(spark, sf)
    market = features.with_features(frame.withColumn("open_ns", quality.local_ns(F.col("date"), SIM.session[0])))
    rows = checkpoints(spark, sf, frame)
    orders = policies.orders_of(rows)
    fresh = policies.new_level(simulator.simulate_new_level(made(spark, sf), frame, SIM))
    log = policies.union_log([policies.always_cross(orders, SIM), policies.always_post(orders, SIM), fresh, policies.oracle(rows)])
    return stored(policies.complete(log, market, releases(spark), SIM, RELEASE_WIDTH), "trade-log")


catalog.add("trade_log_full", f"{FULL_SQL} SELECT {KC}, queue_model, {', '.join(_FULL)} FROM fl")(lambda s, d: full_log(s, d).select(*ORDER, *CELL, "queue_model", *_FULL))
_R8 = lambda x: f"round({x}, 8)"
_FILLED = "CASE WHEN filled_passive THEN 1.0 ELSE 0.0 END"


@catalog.add(
    "sim_cost_table",
    f"""{FULL_SQL} SELECT queue_model, latency_ms, deadline_s, strategy, count(*) AS n, {_R8('avg(cost_ticks)')} AS mean_cost_ticks, {_R8('stddev_samp(cost_ticks)')} AS sd_cost_ticks, quantile_cont(cost_ticks, 0.1) AS p10_cost_ticks, median(cost_ticks) AS median_cost_ticks,
quantile_cont(cost_ticks, 0.9) AS p90_cost_ticks, {_R8('avg(cost_usd)')} AS mean_cost_usd, {_R8(f'avg({_FILLED})')} AS passive_fill_rate, {_R8('avg(CASE WHEN filled_passive THEN time_to_fill_ms END)')} AS mean_ms_to_passive_fill,
{_R8('avg(time_to_fill_ms)')} AS mean_ms_to_done, {_R8('avg(adverse_1s)')} AS adverse_1s_ticks, {_R8('avg(adverse_5s)')} AS adverse_5s_ticks FROM fl WHERE NOT in_release_window GROUP BY ALL""",
)
def sim_cost_table(spark, sf):
    table = stats.cost_table(full_log(spark, sf))
    return table.withColumns({c: F.round(c, 8) for c in ("mean_cost_ticks", "sd_cost_ticks", "mean_cost_usd", "passive_fill_rate", "mean_ms_to_passive_fill", "mean_ms_to_done", "adverse_1s_ticks", "adverse_5s_ticks")})


_SIM_PAIRS = tuple((a, b) for a in ("always_post", "new_level", "oracle") for b in ("always_cross", "always_post") if a != b)
_SIM_DIFF = " UNION ALL ".join(f"SELECT date, queue_model, latency_ms, deadline_s, '{a}' AS strategy, '{b}' AS vs, {b} - {a} AS diff FROM fw" for a, b in _SIM_PAIRS)
_SIM_WIDE = ", ".join(f"max(cost_ticks) FILTER (strategy = '{x}') AS {x}" for x in ("always_cross", "always_post", "new_level", "oracle"))


@catalog.add("sim_savings", f"{FULL_SQL}, fw AS (SELECT {KC}, queue_model, {_SIM_WIDE} FROM fl WHERE NOT in_release_window GROUP BY ALL), fd AS ({_SIM_DIFF}) SELECT queue_model, latency_ms, deadline_s, strategy, vs, count(diff) AS n, count(DISTINCT date) AS test_days, {_R8('avg(diff)')} AS saving_ticks FROM fd WHERE diff IS NOT NULL GROUP BY ALL")
def sim_savings(spark, sf):
    """Savings of the simulated strategies over crossing and posting, decision by decision."""
    diff = stats.differences(stats.paired(full_log(spark, sf)), _SIM_PAIRS).filter("diff IS NOT NULL")
    return diff.groupBy(*stats.CELL, "strategy", "vs").agg(F.count("diff").alias("n"), F.count_distinct("date").alias("test_days"), F.round(F.avg("diff"), 8).alias("saving_ticks"))


_SIM_NAMES = ("always_cross", "always_post", "new_level")


@catalog.add(
    "sim_execution_breakdown",
    f"""{FULL_SQL}, ex AS (SELECT * FROM fl WHERE queue_model = 'proportional' AND latency_ms = 10 AND deadline_s = 2), fw AS (SELECT {K}, vol_300s, own_queue, spread_ticks, in_release_window, {_SIM_WIDE} FROM ex GROUP BY ALL),
cut AS (SELECT quantile_cont(vol_300s, 1/3.0::DOUBLE) AS c1, quantile_cont(vol_300s, 2/3.0::DOUBLE) AS c2, median(own_queue) AS c3 FROM fw WHERE NOT in_release_window),
bk AS (SELECT 'vol' AS dimension, CASE WHEN vol_300s <= c1 THEN 'low' WHEN vol_300s <= c2 THEN 'mid' ELSE 'high' END AS bucket, fw.* FROM fw, cut WHERE NOT in_release_window
  UNION ALL SELECT 'queue', CASE WHEN own_queue <= c3 THEN 'small' ELSE 'large' END, fw.* FROM fw, cut WHERE NOT in_release_window UNION ALL SELECT 'spread_state', CASE WHEN spread_ticks <= 1 THEN '1 tick' ELSE 'wider' END, fw.* FROM fw WHERE NOT in_release_window
  UNION ALL SELECT 'period', CASE WHEN in_release_window THEN 'release' ELSE 'normal' END, fw.* FROM fw)
SELECT dimension, bucket, count(*) AS n, {', '.join(f'round(avg({x}), 8) AS {x}' for x in _SIM_NAMES)} FROM bk GROUP BY ALL HAVING count(*) >= 30""",
)
def sim_execution_breakdown(spark, sf):
    rows = stats.execution_breakdown(full_log(spark, sf), SIM).filter("dimension <> 'tod'")
    return rows.select("dimension", "bucket", "n", *(F.round(x, 8).alias(x) for x in _SIM_NAMES))


assert QUEUE_MODELS == ("pessimistic", "proportional", "optimistic", "exact")
