"""Common table expressions that several oracle statements share."""

from __future__ import annotations

from tickloom.sources.fixtures import l2_sql

DAY = "instrument_id, date"
LEVELS = 10


def states_sql(variant: str = "main") -> str:
    """``l2``, ``r`` (screened events) and ``ls`` (level states)."""
    level = f"PARTITION BY {DAY}, bs, price"
    return f"""{l2_sql(variant)},
s AS (SELECT *, row_number() OVER d AS rn, first_value(price) OVER d AS fp FROM l2 WINDOW d AS (PARTITION BY {DAY} ORDER BY sequence)),
r AS (SELECT *, CASE WHEN action = 4 THEN 0 WHEN price - fp + 8192 < 0 OR price - fp + 8192 >= 16384 THEN 1 WHEN size < 0 OR (size = 0 AND action <> 2) THEN 16 ELSE 0 END AS rej,
  CASE WHEN (action = 3) = (side = 1) THEN -1 ELSE 1 END AS bs FROM s),
t AS (SELECT {DAY}, rn, sequence, action, bs, price, size FROM r WHERE rej = 0 AND action <> 4
  UNION ALL SELECT c.instrument_id, c.date, c.rn, c.sequence, 4, l.bs, l.price, 0 FROM r c JOIN (SELECT DISTINCT {DAY}, bs, price FROM r WHERE rej = 0 AND action <> 4) l USING ({DAY}) WHERE c.action = 4),
g AS (SELECT *, sum(CASE WHEN action IN (2, 4) THEN 1 ELSE 0 END) OVER ({level} ORDER BY rn) AS seg, CASE WHEN action IN (0, 2) THEN size WHEN action = 4 THEN 0 ELSE -size END AS delta FROM t),
h AS (SELECT *, sum(delta) OVER ({level}, seg ORDER BY rn) AS tot FROM g),
lv AS (SELECT *, CAST(tot - least(0, min(tot) OVER ({level}, seg ORDER BY rn)) AS BIGINT) AS level FROM h),
ls AS (SELECT {DAY}, rn, sequence, action, bs, price, size, level, coalesce(lag(level) OVER w, 0) AS before, coalesce(lead(rn) OVER w, 1000000000000) AS until FROM lv WINDOW w AS ({level} ORDER BY rn))"""


def book_sql(variant: str = "main") -> str:
    """The same and ``book``: prices, depth columns and flags after every event."""
    depth = ", ".join(f"CAST(coalesce(sum(level) FILTER (bs = {s} AND price = {px} {op} {i}), 0) AS BIGINT) AS {n}_sz_{i}" for s, px, op, n in ((1, "bid_px", "-", "bid"), (-1, "ask_px", "+", "ask")) for i in range(LEVELS))
    names = ", ".join(f"coalesce({n}_sz_{i}, 0) AS {n}_sz_{i}" for n in ("bid", "ask") for i in range(LEVELS))
    return f"""{states_sql(variant)},
live AS (SELECT e.instrument_id, e.date, e.rn, x.bs, x.price, x.level FROM r e JOIN ls x ON x.instrument_id = e.instrument_id AND x.date = e.date AND x.rn <= e.rn AND e.rn < x.until AND x.level > 0),
best AS (SELECT {DAY}, rn, max(price) FILTER (bs = 1) AS bid_px, min(price) FILTER (bs = -1) AS ask_px FROM live GROUP BY ALL),
deep AS (SELECT {DAY}, rn, bid_px, ask_px, {depth} FROM live JOIN best USING ({DAY}, rn) GROUP BY {DAY}, rn, bid_px, ask_px),
neg AS (SELECT {DAY}, rn FROM ls WHERE action IN (1, 3) AND size > before),
book AS (SELECT r.instrument_id, r.date, r.ts_event, r.sequence, r.action, r.side, r.price, r.size, r.queue_pos, r.rn, bid_px, ask_px, {names},
  CAST(CASE WHEN rej > 0 THEN rej WHEN action = 4 THEN 0 ELSE CASE WHEN neg.rn IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN bid_px > ask_px THEN 4 WHEN bid_px = ask_px THEN 8 ELSE 0 END END AS INTEGER) AS book_flags
  FROM r LEFT JOIN deep USING ({DAY}, rn) LEFT JOIN neg USING ({DAY}, rn))"""


def flow_sql(variant: str = "main") -> str:
    """The same and ``f``: mid, order flow, trades and runs of every event."""
    return f"""{book_sql(variant)},
m AS (SELECT *, 0.5 * (bid_px + ask_px) AS mid, bid_sz_0 AS qb, ask_sz_0 AS qa FROM book),
p AS (SELECT *, lag(bid_px) OVER w AS pbid, lag(ask_px) OVER w AS pask, lag(qb) OVER w AS pqb, lag(qa) OVER w AS pqa, lag(mid) OVER w AS pmid, row_number() OVER w AS k FROM m WINDOW w AS (PARTITION BY {DAY} ORDER BY sequence)),
f0 AS (SELECT *, CASE WHEN mid IS NOT NULL AND pmid IS NOT NULL THEN
    CASE WHEN bid_px >= pbid THEN qb ELSE 0 END - CASE WHEN bid_px <= pbid THEN pqb ELSE 0 END - CASE WHEN ask_px <= pask THEN qa ELSE 0 END + CASE WHEN ask_px >= pask THEN pqa ELSE 0 END ELSE 0 END AS ofi,
  CASE WHEN action = 3 AND side = 1 THEN size ELSE 0 END AS buy, CASE WHEN action = 3 AND side <> 1 THEN size ELSE 0 END AS sell,
  CASE WHEN mid IS NOT NULL AND pmid IS NOT NULL AND mid <> pmid THEN 1 ELSE 0 END AS chg,
  CASE WHEN k > 1 AND bid_px IS DISTINCT FROM pbid THEN 1 ELSE 0 END AS nb, CASE WHEN k > 1 AND ask_px IS DISTINCT FROM pask THEN 1 ELSE 0 END AS na FROM p),
f AS (SELECT *, sum(nb) OVER w AS brun, sum(na) OVER w AS arun FROM f0 WINDOW w AS (PARTITION BY {DAY} ORDER BY sequence))"""


def time_sum(x: str, width_ns: int) -> str:
    """Sum over (t - width, t] up to the row: the range frame less the row's later peers."""
    return (
        f"(sum({x}) OVER (PARTITION BY {DAY} ORDER BY ts_event RANGE BETWEEN {width_ns - 1} PRECEDING AND CURRENT ROW)"
        f" - coalesce(sum({x}) OVER (PARTITION BY {DAY}, ts_event ORDER BY sequence ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0))"
    )
