"""Backward-looking features, one row an event.

Sums over time windows are differences of two running sums: up to the row
itself, and up to the last row that has left the window. Both frames grow by
one end only, so a window costs the same whatever its width, and rows that
share a time stamp never see those behind them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.schema import BID, DAY, DEFAULT, MINUTE, MS, SECOND, TRADE, Settings


def _rows():
    return Window.partitionBy(*DAY).orderBy("sequence")


def _time():
    return Window.partitionBy(*DAY).orderBy("ts_event")

#: Names with these prefixes change sign with the side of an order.
DIRECTIONAL = ("imbalance", "microprice", "depth_imb", "ofi", "tfi")


def time_sum(x: Column, width_ns: int) -> Column:
    """Sum of ``x`` over the rows with time in ``(t - width, t]`` up to this row."""
    return F.sum(x).over(_rows().rowsBetween(Window.unboundedPreceding, 0)) - F.coalesce(F.sum(x).over(_time().rangeBetween(Window.unboundedPreceding, -width_ns)), F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def with_mid(book: DataFrame) -> DataFrame:
    """``mid``, and sizes at the touch."""
    return book.withColumns({"mid": 0.5 * (F.col("bid_px") + F.col("ask_px")), "qb": F.col("bid_depth")[0], "qa": F.col("ask_depth")[0]})


def with_order_flow(book: DataFrame) -> DataFrame:
    """``ofi`` of each event, traded volumes by aggressor, and whether the mid changed; the previous row must be two-sided too."""
    rows = with_mid(book)
    past = {c: F.lag(c).over(_rows()) for c in ("bid_px", "ask_px", "qb", "qa", "mid")}
    rows = rows.withColumns({f"prev_{c}": x for c, x in past.items()})
    both = F.col("mid").isNotNull() & F.col("prev_mid").isNotNull()
    bid, ask, pb, pa = F.col("bid_px"), F.col("ask_px"), F.col("prev_bid_px"), F.col("prev_ask_px")
    flow = F.when(bid >= pb, F.col("qb")).otherwise(0) - F.when(bid <= pb, F.col("prev_qb")).otherwise(0) - F.when(ask <= pa, F.col("qa")).otherwise(0) + F.when(ask >= pa, F.col("prev_qa")).otherwise(0)
    trade = F.col("action") == TRADE
    return rows.withColumns(
        {
            "ofi": F.when(both, flow).otherwise(0).cast("long"),
            "buy": F.when(trade & (F.col("side") == BID), F.col("size")).otherwise(0).cast("long"),
            "sell": F.when(trade & (F.col("side") != BID), F.col("size")).otherwise(0).cast("long"),
            "mid_change": F.when(both & (F.col("mid") != F.col("prev_mid")), 1).otherwise(0).cast("long"),
        }
    )


def with_features(book: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """All features; null where the book is one-sided, but ``minutes_since_open`` (which needs ``open_ns``)."""
    rows = with_order_flow(book)
    for side, px in (("bid", "bid_px"), ("ask", "ask_px")):
        new = F.when(F.col("sequence") == F.min("sequence").over(_rows()), 0).when(F.col(px).eqNullSafe(F.lag(px).over(_rows())), 0).otherwise(1)
        rows = rows.withColumn(f"{side}_run", F.sum(new).over(_rows()))
    rows = rows.withColumn("changed_at", F.coalesce(F.last(F.when(F.col("mid_change") > 0, F.col("ts_event")), ignorenulls=True).over(_rows()), F.first("ts_event").over(_rows())))
    two_sided = F.col("mid").isNotNull()
    qb, qa = F.col("qb"), F.col("qa")
    out: dict[str, Column] = {
        "imbalance": ratio(qb - qa, qb + qa),
        "microprice": F.when(qb + qa > 0, (F.col("bid_px") * qa + F.col("ask_px") * qb) / (qb + qa) - F.col("mid")).otherwise(0.0),
        "spread": (F.col("ask_px") - F.col("bid_px")).cast("double"),
        "wide_spread": F.when(F.col("ask_px") - F.col("bid_px") > 1, 1.0).otherwise(0.0),
        "bid_queue": qb.cast("double"),
        "ask_queue": qa.cast("double"),
    }
    total = lambda c, k: F.aggregate(F.slice(c, 1, k), F.lit(0).cast("long"), lambda a, x: a + x)
    for k in (k for k in cfg.depth_levels if k <= cfg.levels):
        b, a = total("bid_depth", k), total("ask_depth", k)
        out[f"depth_imb_{k}"] = ratio(b - a, b + a)
    for n in cfg.windows_events:
        out[f"ofi_ev{n}"] = F.sum("ofi").over(_rows().rowsBetween(1 - n, 0)).cast("double")
    for w in cfg.windows_ms:
        out[f"ofi_ms{w}"] = time_sum(F.col("ofi"), w * MS).cast("double")
    for w in cfg.windows_ms:
        b, s = time_sum(F.col("buy"), w * MS), time_sum(F.col("sell"), w * MS)
        out[f"tfi_ms{w}"] = ratio(b - s, b + s)
    for side, q in (("bid", "qb"), ("ask", "qa")):
        for w in cfg.windows_ms:
            run = Window.partitionBy(*DAY, f"{side}_run").orderBy("ts_event").rangeBetween(1 - w * MS, 0)
            out[f"{side}_depl_ms{w}"] = (F.min_by(q, "sequence").over(run) - F.col(q)) / (w / 1000)
    out["since_mid_change_ms"] = (F.col("ts_event") - F.col("changed_at")) / 1e6
    for w in cfg.vol_windows_s:
        out[f"vol_{w}s"] = time_sum(F.col("mid_change"), w * SECOND) / w
    columns = {k: F.when(two_sided, x) for k, x in out.items()}
    if "open_ns" in book.columns:
        columns["minutes_since_open"] = (F.col("ts_event") - F.col("open_ns")) / float(MINUTE)
    return rows.withColumns(columns)


def feature_names(cfg: Settings = DEFAULT) -> list[str]:
    names = ["imbalance", "microprice", "spread", "wide_spread", "bid_queue", "ask_queue", *(f"depth_imb_{k}" for k in cfg.depth_levels if k <= cfg.levels)]
    names += [*(f"ofi_ev{n}" for n in cfg.windows_events), *(f"ofi_ms{w}" for w in cfg.windows_ms), *(f"tfi_ms{w}" for w in cfg.windows_ms)]
    return [*names, *(f"{s}_depl_ms{w}" for s in ("bid", "ask") for w in cfg.windows_ms), "since_mid_change_ms", *(f"vol_{w}s" for w in cfg.vol_windows_s), "minutes_since_open"]


def signed(rows: DataFrame, names: list[str], side: Column) -> DataFrame:
    """Directional features times the order's side, others as they are."""
    return rows.withColumns({n: F.col(n) * side for n in names if n.startswith(DIRECTIONAL)})
