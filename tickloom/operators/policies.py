"""Execution strategies on simulated orders, their costs and trade logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import joins, quality
from tickloom.operators.features import DIRECTIONAL
from tickloom.schema import BID, DAY, DEFAULT, MINUTE, MS, QUEUE_MODELS, SECOND, Settings

ORDER = (*DAY, "decision_id")
CELL = ("latency_ms", "deadline_s", "queue_model")
LOG = (*ORDER, *CELL, "t0", "order_side", "arrival_mid", "own_queue", "spread_ticks", "strategy", "order_type", "entry_px", "ahead0", "filled_passive", "fill_px", "exec_ts", "cost_ticks", "fill_ts")


def grid(spark: SparkSession, cfg: Settings = DEFAULT) -> DataFrame:
    """Every cell: queue model, latency and deadline."""
    each = lambda values: F.explode(F.array(*map(F.lit, values)))
    return spark.range(1).select(each(QUEUE_MODELS).alias("queue_model")).withColumn("latency_ms", each(cfg.latencies_ms)).withColumn("deadline_s", each(cfg.deadlines_s))


def cost(price: Column) -> Column:
    """Ticks paid against the arrival mid; zero has no sign."""
    return (F.col("order_side") * (price - F.col("arrival_mid"))).cast("double") + F.lit(0.0)


def _deadline() -> Column:
    return F.col("t0") + F.col("deadline_s").cast("long") * SECOND + F.col("latency_ms").cast("long") * MS


def _passive_end() -> Column:
    return F.when(F.col("filled"), F.col("fill_ts")).otherwise(_deadline())


def _logged(rows: DataFrame, strategy: str, **columns: Column) -> DataFrame:
    return rows.withColumns({"strategy": F.lit(strategy), **columns})


def always_cross(orders: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    none = F.lit(None)
    return _logged(orders, "always_cross", order_type=F.lit("market"), filled_passive=F.lit(False), exec_ts=F.col("t0") + F.col("latency_ms").cast("long") * MS, cost_ticks=cost(F.col("cross_px")), fill_px=F.col("cross_px"), entry_px=none.cast("long"), ahead0=none.cast("double"))


def always_post(orders: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    return _logged(orders, "always_post", order_type=F.when(F.col("filled"), "limit").otherwise("limit_then_market"), filled_passive=F.col("filled"), exec_ts=_passive_end(), cost_ticks=cost(F.col("passive_px")), fill_px=F.col("passive_px"))


def new_level(orders: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    kind = F.when(F.col("filled"), "limit").when(F.col("entry_px").isNotNull(), "limit_then_market").otherwise("market")
    return _logged(orders, "new_level", order_type=kind, filled_passive=F.col("filled"), exec_ts=_passive_end(), cost_ticks=cost(F.col("passive_px")), fill_px=F.col("passive_px"))


_OF_ORDER = ("t0", "order_side", "arrival_mid", "own_queue", "spread_ticks", "entry_px", "ahead0", "cross_px", "end_px", "filled", "fill_seq", "fill_ts", "passive_px")


def orders_of(checkpoints: DataFrame) -> DataFrame:
    """The orders behind checkpoint rows; every order has checkpoint 0."""
    return checkpoints.filter("j = 0").select(*ORDER, *CELL, *_OF_ORDER)


def abandon(checkpoints: DataFrame, when: Column, cfg: Settings = DEFAULT, strategy: str = "abandon") -> DataFrame:
    """Orders given up by crossing at the first checkpoint where ``when`` is true; null counts as false."""
    gives_up = F.when(F.coalesce(when, F.lit(False)), F.col("j"))
    first = checkpoints.withColumn("__up", gives_up).groupBy(*ORDER, *CELL).agg(F.min("__up").alias("abandon_j"), F.min_by(F.struct("cp_cross"), "__up").alias("__x"))
    rows = orders_of(checkpoints).join(first, [*ORDER, *CELL]).withColumn("abandon_px", F.when(F.col("abandon_j").isNotNull(), F.col("__x.cp_cross"))).drop("__x")
    j, gone = F.col("abandon_j"), F.col("abandon_j").isNotNull()
    price = F.when(gone, F.col("abandon_px")).otherwise(F.col("passive_px"))
    fill = ~gone & F.col("filled")
    return _logged(
        rows, strategy, passive_fill=fill, filled_passive=fill, cost_ticks=cost(price), fill_px=price,
        order_type=F.when(j == 0, "market").when(gone | ~fill, "limit_then_market").otherwise("limit"),
        exec_ts=F.when(gone, F.col("t0") + j.cast("long") * (cfg.checkpoint_ms * MS) + F.col("latency_ms").cast("long") * MS).otherwise(_passive_end()),
        entry_px=F.when(j == 0, None).otherwise(F.col("entry_px")), ahead0=F.when(j == 0, None).otherwise(F.col("ahead0")),
    )


def tune(checkpoints: DataFrame, p: Column, cfg: Settings = DEFAULT) -> DataFrame:
    """``theta`` of each cell: giving up at the first checkpoint where ``p`` is above it costs least on average; the smallest among equals."""
    rows = checkpoints.withColumn("__p", p)
    up = [F.min_by("cp_cross", F.when(F.col("__p") > t, F.col("j"))).alias(f"x{i}") for i, t in enumerate(cfg.thresholds)]
    first = rows.groupBy(*ORDER, *CELL).agg(*up, *(F.first(c).alias(c) for c in ("order_side", "arrival_mid", "passive_px")))
    each = F.array(*(F.struct(F.lit(t).alias("theta"), cost(F.coalesce(f"x{i}", "passive_px")).alias("cost")) for i, t in enumerate(cfg.thresholds)))
    costs = first.select(*CELL, F.inline(each)).groupBy(*CELL, "theta").agg(F.round(F.avg("cost"), 9).alias("c"))
    return costs.groupBy(*CELL).agg(F.min_by("theta", F.struct("c", "theta")).alias("theta"))


def oracle(checkpoints: DataFrame) -> DataFrame:
    """Upper bound with future information: the cheapest of crossing at any checkpoint and waiting."""
    best = checkpoints.groupBy(*ORDER, *CELL).agg(F.min(cost(F.col("cp_cross"))).alias("__best"))
    rows = orders_of(checkpoints).join(best, [*ORDER, *CELL])
    none = F.lit(None)
    return _logged(rows, "oracle", order_type=F.lit("oracle_upper_bound"), filled_passive=F.lit(False), exec_ts=F.col("t0"), cost_ticks=F.least("__best", cost(F.col("passive_px"))), fill_px=none.cast("long"), entry_px=none.cast("long"), ahead0=none.cast("double")).drop("__best")


def with_cost_to_go(checkpoints: DataFrame) -> DataFrame:
    """``label``: what waiting from a checkpoint costs more than crossing there."""
    return checkpoints.withColumn("label", F.col("order_side") * (F.col("passive_px") - F.col("cp_cross")))


def checkpoint_features(checkpoints: DataFrame, market: DataFrame, names: list[str]) -> DataFrame:
    """Market features at the checkpoint's row, seen from the order's side, with the order's own state."""
    rows = checkpoints.join(market.select(*DAY, F.col("sequence").alias("cp_seq"), *names, "bid_queue", "ask_queue"), [*DAY, "cp_seq"])
    side, buy = F.col("order_side"), F.col("order_side") == BID
    rows = rows.withColumns({n: F.col(n) * side for n in names if n.startswith(DIRECTIONAL)})
    rows = rows.withColumns({"own_side_queue": F.when(buy, F.col("bid_queue")).otherwise(F.col("ask_queue")), "opp_queue": F.when(buy, F.col("ask_queue")).otherwise(F.col("bid_queue"))})
    return rows.withColumn("ahead_frac", F.col("ahead") / F.greatest("own_side_queue", F.lit(1.0)))


def adverse(fills: DataFrame, book: DataFrame) -> DataFrame:
    """Moves of the mid against a passive fill after one and five seconds; past the data's end the last row counts."""
    rows = fills
    for name, shift in (("m0", 0), ("m1", 1), ("m5", 5)):
        rows = joins.as_of(rows.withColumn("at", F.col("fill_ts") + shift * SECOND), book.select(*DAY, "ts_event", "sequence", F.col("mid").alias(name)), DAY, "at", "ts_event", "sequence", [name]).drop("at")
    side = F.col("order_side")
    return rows.withColumns({"adverse_1s": (side * (F.col("m0") - F.col("m1"))).cast("double") + F.lit(0.0), "adverse_5s": (side * (F.col("m0") - F.col("m5"))).cast("double") + F.lit(0.0)}).drop("m0", "m1", "m5")


def with_fees(log: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """One fee an order, and the cost in dollars."""
    return log.withColumns({"fee_usd": F.lit(cfg.fee_usd), "cost_usd": F.col("cost_ticks") * cfg.tick_value_usd + cfg.fee_usd})


def decision_state(decisions: DataFrame, market: DataFrame, releases: DataFrame, width_ns: int, names: tuple[str, ...] = ("minutes_since_open", "vol_300s")) -> DataFrame:
    """``decisions`` (with ``t0``) with the market's ``names`` at that time and whether it lies in a release window."""
    rows = joins.as_of(decisions, market.select(*DAY, "ts_event", "sequence", *names), DAY, "t0", "ts_event", "sequence", list(names))
    flagged = quality.with_release_flag(rows.withColumn("ts_event", F.col("t0")), releases, width_ns)
    return flagged.drop("ts_event")


def complete(log: DataFrame, market: DataFrame, releases: DataFrame, cfg: Settings = DEFAULT, width_ns: int | None = None) -> DataFrame:
    """A trade log with all that cost tables ask for.

    ``log`` has the columns of ``LOG``, ``market`` the book's ``mid`` and the
    features after each event. Added are the decision's time, its minutes since
    the open, volatility and release flag, the time to the order's end, the
    mid's moves against a passive fill, and the cost in dollars.
    """
    width = cfg.release_minutes * MINUTE if width_ns is None else width_ns
    at = decision_state(log.select(*ORDER, "t0").distinct(), market, releases, width).drop("t0")
    key = [*ORDER, *CELL, "strategy"]
    moves = adverse(log.filter("filled_passive").select(*key, "order_side", "fill_ts"), market).select(*key, "adverse_1s", "adverse_5s")
    rows = log.join(at, [*ORDER]).join(moves, key, "left")
    rows = rows.withColumns({"decision_ts": F.col("t0"), "time_to_fill_ms": (F.col("exec_ts") - F.col("t0")) / 1e6, "own_queue": F.col("own_queue").cast("double")})
    return with_fees(rows, cfg)


def union_log(parts: list[DataFrame]) -> DataFrame:
    """One trade log of several strategies."""
    return reduce(DataFrame.unionByName, (p.select(*LOG) for p in parts))
