"""Queries over the reconstructed book, its features and its targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import book, features, targets
from tickloom.plans.registry import Catalog
from tickloom.plans.sql import DAY, book_sql, flow_sql, states_sql, time_sum
from tickloom.schema import DAY as KEYS
from tickloom.schema import DEFAULT, MS, SECOND
from tickloom.sources.fixtures import l2_events

catalog = Catalog()
ROW = (*KEYS, "sequence")
_STATES = f"SELECT {DAY}, sequence, CAST(action AS INTEGER) AS action, CAST(bs AS INTEGER) AS book_side, price, level, before FROM ls"
DEPTH = ", ".join(f"{s}_sz_{i}" for s in ("bid", "ask") for i in range(10))


def _states(variant):
    return lambda spark, sf: book.level_states(l2_events(spark, sf, variant)).select(*ROW, "action", "book_side", "price", "level", "before")


catalog.add("l2_level_state", f"WITH {states_sql()} {_STATES}")(_states("main"))
catalog.add("l2_clear", f"WITH {states_sql('clear')} {_STATES}")(_states("clear"))


@catalog.add("l2_top", f"WITH {states_sql()}, e AS (SELECT {DAY}, sequence, rn FROM r) SELECT e.instrument_id, e.date, e.sequence, max(x.price) FILTER (x.bs = 1) AS bid_px, min(x.price) FILTER (x.bs = -1) AS ask_px FROM e LEFT JOIN ls x ON x.instrument_id = e.instrument_id AND x.date = e.date AND x.rn <= e.rn AND e.rn < x.until AND x.level > 0 GROUP BY ALL")
def l2_top(spark, sf):
    return book.book_frame(l2_events(spark, sf)).select(*ROW, "bid_px", "ask_px")


def _frame(variant, cfg=DEFAULT):
    def plan(spark, sf):
        return book.wide_depth(book.book_frame(l2_events(spark, sf, variant), cfg)).select(*ROW, "ts_event", "action", "side", "price", "size", "bid_px", "ask_px", "book_flags", *DEPTH.split(", "))

    return plan


_BOOK = f"SELECT {DAY}, sequence, ts_event, action, side, price, size, bid_px, ask_px, book_flags, {DEPTH} FROM book"
catalog.add("l2_book_frame", f"WITH {book_sql('clear')} {_BOOK}")(_frame("clear"))
#: Slices are a few rows here, for the days of the fixtures are thin; the same rows as in one piece.
SLICED = DEFAULT.override(slice_rows=12)
catalog.add("l2_book_sliced", f"WITH {book_sql('clear')} {_BOOK}")(_frame("clear", SLICED))
catalog.add("l2_depth", f"WITH {book_sql()} SELECT {DAY}, sequence, {DEPTH} FROM book")(lambda spark, sf: _frame("main")(spark, sf).select(*ROW, *DEPTH.split(", ")))


@catalog.add("l2_flags", f"WITH {book_sql('bad')}, a AS (SELECT 'bad' AS variant, * FROM (SELECT {DAY}, sequence, book_flags FROM book)) SELECT * FROM a UNION ALL SELECT * FROM (WITH {book_sql('crossed')} SELECT 'crossed' AS variant, {DAY}, sequence, book_flags FROM book)")
def l2_flags(spark, sf):
    parts = [book.book_frame(l2_events(spark, sf, v)).select(F.lit(v).alias("variant"), *ROW, "book_flags") for v in ("bad", "crossed")]
    return parts[0].unionByName(parts[1])


@catalog.add("l2_flags_vendor", f"WITH {book_sql('crossed')} SELECT {DAY}, sequence, CAST(CASE WHEN bid_px > ask_px THEN 4 WHEN bid_px = ask_px THEN 8 ELSE 0 END AS INTEGER) AS book_flags FROM book")
def l2_flags_vendor(spark, sf):
    return book.vendor_flags(book.book_frame(l2_events(spark, sf, "crossed"))).select(*ROW, "book_flags")


@catalog.add("l2_size_at", f"WITH {states_sql('clear')}, q AS (SELECT DISTINCT r.instrument_id, r.date, p.bs, p.price, r.sequence FROM r JOIN (VALUES (1, 999), (1, 1000), (-1, 1001), (-1, 1003)) p(bs, price) ON r.sequence % 7 = 0) SELECT q.instrument_id, q.date, CAST(q.bs AS INTEGER) AS book_side, CAST(q.price AS BIGINT) AS price, q.sequence, coalesce(arg_max(x.level, x.sequence), 0) AS size_at FROM q LEFT JOIN ls x ON x.instrument_id = q.instrument_id AND x.date = q.date AND x.bs = q.bs AND x.price = q.price AND x.sequence <= q.sequence GROUP BY ALL")
def l2_size_at(spark, sf):
    events = l2_events(spark, sf, "clear")
    asked = F.array(*(F.struct(F.lit(s).alias("book_side"), F.lit(p).cast("long").alias("price")) for s, p in ((1, 999), (1, 1000), (-1, 1001), (-1, 1003))))
    points = events.filter("sequence % 7 = 0").select(*ROW, F.inline(asked))
    return book.size_at(events, points)


# ---------------------------------------------------------------- features

OPEN_SQL = "epoch_us((CAST(date AS TIMESTAMP) + INTERVAL '8 hours 30 minutes') AT TIME ZONE 'America/New_York')"


def session_open():
    """Opening of the day in microseconds, which the fixtures read as nanoseconds."""
    return F.unix_micros(F.to_utc_timestamp(F.concat(F.col("date").cast("string"), F.lit(" 08:30:00")), "America/New_York"))


def feature_rows(spark, sf, variant="tied"):
    return features.with_features(book.book_frame(l2_events(spark, sf, variant)).withColumn("open_ns", session_open()))


def _feature(name: str, columns: dict[str, str]) -> None:
    """A query of feature columns; ``columns`` has the SQL of each where the book is two-sided."""
    sql = ", ".join(f"CASE WHEN mid IS NOT NULL THEN CAST({x} AS DOUBLE) END AS {c}" if c != "minutes_since_open" else f"{x} AS {c}" for c, x in columns.items())
    catalog.add(name, f"WITH {flow_sql('tied')} SELECT {DAY}, sequence, {sql} FROM f")(lambda spark, sf: feature_rows(spark, sf).select(*ROW, *columns))


def _safe(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0 END"


_W = f"OVER (PARTITION BY {DAY} ORDER BY sequence"
_feature("feat_imbalance", {"imbalance": _safe("qb - qa", "qb + qa")})
_feature("feat_microprice", {"microprice": "CASE WHEN qb + qa > 0 THEN (bid_px * qa + ask_px * qb) / (qb + qa) - mid ELSE 0 END"})
_feature("feat_spread", {"spread": "ask_px - bid_px", "wide_spread": "CASE WHEN ask_px - bid_px > 1 THEN 1 ELSE 0 END", "bid_queue": "qb", "ask_queue": "qa"})
_sum = lambda s, k: "(" + " + ".join(f"{s}_sz_{i}" for i in range(k)) + ")"
_feature("feat_depth_imb", {f"depth_imb_{k}": _safe(f"{_sum('bid', k)} - {_sum('ask', k)}", f"{_sum('bid', k)} + {_sum('ask', k)}") for k in (3, 5, 10)})
_feature("feat_ofi_rows", {f"ofi_ev{n}": f"sum(ofi) {_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (10, 50, 200)})
_feature("feat_ofi_time", {f"ofi_ms{w}": time_sum("ofi", w * MS) for w in (100, 1000, 5000)})
_feature("feat_tfi", {f"tfi_ms{w}": _safe(f"{time_sum('buy', w * MS)} - {time_sum('sell', w * MS)}", f"{time_sum('buy', w * MS)} + {time_sum('sell', w * MS)}") for w in (100, 1000, 5000)})
_feature("feat_depletion", {f"{s}_depl_ms{w}": f"(arg_min({q}, sequence) OVER (PARTITION BY {DAY}, {run} ORDER BY ts_event RANGE BETWEEN {w * MS - 1} PRECEDING AND CURRENT ROW) - {q}) / CAST({w / 1000} AS DOUBLE)" for s, q, run in (("bid", "qb", "brun"), ("ask", "qa", "arun")) for w in (100, 1000, 5000)})
_feature("feat_since_change", {"since_mid_change_ms": f"(ts_event - coalesce(max(CASE WHEN chg = 1 THEN ts_event END) {_W}), first_value(ts_event) {_W}))) / 1000000.0::DOUBLE"})
_feature("feat_vol", {f"vol_{w}s": f"{time_sum('chg', w * SECOND)} / CAST({w} AS DOUBLE)" for w in (30, 300)})
_feature("feat_minutes", {"minutes_since_open": f"(ts_event - {OPEN_SQL}) / CAST(60000000000 AS DOUBLE)"})


@catalog.add("feat_ofi_event", f"WITH {flow_sql('main')} SELECT {DAY}, sequence, CAST(ofi AS BIGINT) AS ofi, CAST(chg AS BIGINT) AS mid_change FROM f")
def feat_ofi_event(spark, sf):
    return features.with_order_flow(book.book_frame(l2_events(spark, sf))).select(*ROW, "ofi", "mid_change")


@catalog.add("feat_signed", f"WITH {flow_sql('tied')}, o AS (SELECT *, CASE WHEN sequence % 2 = 0 THEN 1 ELSE -1 END AS own FROM f WHERE mid IS NOT NULL) SELECT {DAY}, sequence, CAST({_safe('qb - qa', 'qb + qa')} * own AS DOUBLE) AS imbalance, CAST((ask_px - bid_px) AS DOUBLE) AS spread, CAST((CASE WHEN qb + qa > 0 THEN (bid_px * qa + ask_px * qb) / (qb + qa) - mid ELSE 0 END) * own AS DOUBLE) AS microprice FROM o")
def feat_signed(spark, sf):
    rows = feature_rows(spark, sf).filter("mid IS NOT NULL")
    names = ["imbalance", "spread", "microprice"]
    return features.signed(rows, names, F.when(F.col("sequence") % 2 == 0, 1).otherwise(-1)).select(*ROW, *names)


# ----------------------------------------------------------------- targets


def target_rows(spark, sf, variant="tied"):
    return targets.with_targets(features.with_mid(book.book_frame(l2_events(spark, sf, variant))))


catalog.add("tgt_mid", f"WITH {flow_sql()} SELECT {DAY}, sequence, CAST(mid AS DOUBLE) AS mid FROM f")(lambda spark, sf: features.with_mid(book.book_frame(l2_events(spark, sf))).select(*ROW, "mid"))


@catalog.add(
    "tgt_next_dir",
    f"""WITH {flow_sql('tied')}, st AS (SELECT *, CASE WHEN mid IS NOT NULL AND (pmid IS NULL OR pmid <> mid) THEN 1 ELSE 0 END AS s FROM f),
rid AS (SELECT *, sum(s) OVER (PARTITION BY {DAY} ORDER BY sequence) AS run FROM st), runs AS (SELECT {DAY}, run, mid AS nmid, ts_event AS nts FROM rid WHERE s = 1)
SELECT a.instrument_id, a.date, a.sequence, CASE WHEN a.mid IS NOT NULL AND nmid <> a.mid THEN CASE WHEN nmid > a.mid THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS next_dir,
  CASE WHEN a.mid IS NOT NULL AND nmid <> a.mid THEN (nts - a.ts_event) / 1000000.0::DOUBLE END AS next_change_ms
FROM rid a LEFT JOIN runs b ON b.instrument_id = a.instrument_id AND b.date = a.date AND b.run = a.run + 1""",
)
def tgt_next_dir(spark, sf):
    return target_rows(spark, sf).select(*ROW, "next_dir", "next_change_ms")


_RET = ", ".join(f"CAST(CASE WHEN a.ts_event + {h * SECOND} <= max(a.ts_event) OVER (PARTITION BY a.instrument_id, a.date) THEN m{h}.mid - a.mid END AS DOUBLE) AS ret_{h}s" for h in (1, 5, 30))
_AS_OF = " ".join(f"ASOF LEFT JOIN lastrow m{h} ON m{h}.instrument_id = a.instrument_id AND m{h}.date = a.date AND m{h}.ts_event <= a.ts_event + {h * SECOND}" for h in (1, 5, 30))


@catalog.add("tgt_forward_ret", f"WITH {flow_sql('tied')}, lastrow AS (SELECT {DAY}, ts_event, mid FROM f QUALIFY row_number() OVER (PARTITION BY {DAY}, ts_event ORDER BY sequence DESC) = 1) SELECT a.instrument_id, a.date, a.sequence, {_RET} FROM f a {_AS_OF}")
def tgt_forward_ret(spark, sf):
    return target_rows(spark, sf).select(*ROW, "ret_1s", "ret_5s", "ret_30s")
