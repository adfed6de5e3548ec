"""Queue-aware execution of limit orders as joins and one fold.

Decisions meet the book by as-of joins and their events by a bucketed interval
join. The events of one order, bounded by its deadline, are folded in time
order; the fold carries the quantity ahead under all four queue models at once.
Missing prices are null: nothing compares true with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import features, joins
from tickloom.operators.stats import hash_pick
from tickloom.schema import BID, CANCEL, DAY, DEFAULT, MODIFY, MS, QUEUE_MODELS, SECOND, TRADE, Settings

ORDER = (*DAY, "decision_id")
CELL = ("latency_ms", "deadline_s")
STATE = ("bid_px", "ask_px", "bid_depth", "ask_depth")
#: Buckets of time that the longest deadline is cut into where orders meet events: an order then meets few beyond its own.
BUCKETS = 8


def decisions(days: DataFrame, cfg: Settings, open_ns: Column, close_ns: Column) -> DataFrame:
    """Parent orders of each day: hash-drawn times from a second after the open to the longest deadline and a second before the close, and sides."""
    lo, hi = open_ns + SECOND, close_ns - (max(cfg.deadlines_s) + 1) * SECOND
    rows = days.select(*DAY, lo.alias("lo"), hi.alias("hi")).filter("hi > lo").withColumn("decision_id", F.explode(F.sequence(F.lit(0), F.lit(cfg.decisions_per_day - 1))))
    parts = [F.col("instrument_id"), F.col("date"), F.col("decision_id")]
    draw = F.shiftright(hash_pick(F.lit(1 << 32), *parts) * (F.shiftright(F.col("hi") - F.col("lo"), 12)), 20)
    parity = F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 9, 1), 16, 10).cast("int") % 2
    return rows.select(*ORDER, (F.col("lo") + draw).alias("t0"), F.when(parity == 0, 1).otherwise(-1).alias("order_side"))


def with_past(book: DataFrame) -> DataFrame:
    """The book's rows with the state before them."""
    w = Window.partitionBy(*DAY).orderBy("sequence")
    return book.withColumns({f"prev_{c}": F.lag(c).over(w) for c in STATE})


def _width(cfg: Settings) -> int:
    return max(1, max(cfg.deadlines_s) * SECOND // BUCKETS)


def shown(side: Column, price: Column, prefix: str = "") -> tuple[Column, Column]:
    """Whether the order's level is gone (nothing rests as good as its price), and the size there, null where the book does not reach that far."""
    best, depth = (F.when(side == BID, F.col(f"{prefix}bid_{c}")).otherwise(F.col(f"{prefix}ask_{c}")) for c in ("px", "depth"))
    behind = (best - price) * side
    return F.coalesce(behind < 0, F.lit(True)), F.when(behind >= 0, F.get(depth, behind.cast("int")))


def states_at(points: DataFrame, book: DataFrame, columns: list[str]) -> DataFrame:
    """``points`` (``DAY``, ``at``) with the ``columns`` of the book row in force."""
    return joins.as_of(points, book, DAY, "at", "ts_event", "sequence", columns)


def orders_at_touch(made: DataFrame, book: DataFrame, cfg: Settings) -> DataFrame:
    """Decisions by cell with arrival, entry at the touch after the latency, and the price of crossing at the end."""
    buy = F.col("order_side") == BID
    book = features.with_mid(book)
    start = states_at(made.withColumn("at", F.col("t0")), book, ["sequence", "mid", *STATE]).filter("sequence IS NOT NULL")
    start = start.select(
        *ORDER, "t0", "order_side", F.col("mid").alias("arrival_mid"), F.when(buy, F.col("bid_depth")[0]).otherwise(F.col("ask_depth")[0]).alias("own_queue"), (F.col("ask_px") - F.col("bid_px")).cast("double").alias("spread_ticks"),
    )
    lat = start.withColumn("latency_ms", F.explode(F.array(*map(F.lit, cfg.latencies_ms)))).withColumn("at", F.col("t0") + F.col("latency_ms").cast("long") * MS)
    lat = states_at(lat, book.withColumn("entry_seq", F.col("sequence")), ["entry_seq", *STATE]).drop("at")
    lat = lat.select(
        *ORDER, "t0", "order_side", "arrival_mid", "own_queue", "spread_ticks", "latency_ms", "entry_seq", F.when(buy, F.col("bid_px")).otherwise(F.col("ask_px")).alias("entry_px"),
        F.when(buy, F.col("bid_depth")[0]).otherwise(F.col("ask_depth")[0]).cast("double").alias("ahead0"), F.when(buy, F.col("ask_px")).otherwise(F.col("bid_px")).alias("cross_px"),
    )
    return with_end(lat.withColumn("deadline_s", F.explode(F.array(*map(F.lit, cfg.deadlines_s)))), book)


def with_end(rows: DataFrame, book: DataFrame) -> DataFrame:
    """``end_px``: the opposite touch at deadline plus latency."""
    rows = states_at(rows.withColumn("at", F.col("t0") + F.col("deadline_s").cast("long") * SECOND + F.col("latency_ms").cast("long") * MS), book.select(*DAY, "ts_event", "sequence", F.col("bid_px").alias("end_bid"), F.col("ask_px").alias("end_ask")), ["end_bid", "end_ask"])
    return rows.withColumn("end_px", F.when(F.col("order_side") == BID, F.col("end_ask")).otherwise(F.col("end_bid"))).drop("at", "end_bid", "end_ask")


def longest(orders: DataFrame, start: Column) -> DataFrame:
    """Orders that start alike and differ in their deadline as one with the longest, and theirs as ``cells``: what comes about until a deadline is the same."""
    alike = ("order_side", "t0", "entry_px", "ahead0")
    rest = [c for c in orders.columns if c not in (*ORDER, "latency_ms", *alike)]
    return orders.withColumn("__start", start).groupBy(*ORDER, "latency_ms", *alike, "__start").agg(F.max("deadline_s").alias("deadline_s"), F.collect_list(F.struct(*rest)).alias("cells"))


def paths(orders: DataFrame, book: DataFrame, start: Column, cfg: Settings, checkpoints: bool = True) -> DataFrame:
    """``orders`` with ``path``: the events after ``start`` up to the deadline that matter to the order, and its checkpoints, in order."""
    past = with_past(book).select(*DAY, "ts_event", "sequence", "action", "side", "price", "size", "queue_pos", *STATE, *(f"prev_{c}" for c in STATE))
    keyed = orders.select(*ORDER, *CELL, "order_side", "entry_px", start.alias("__from"), (F.col("t0") + F.col("deadline_s").cast("long") * SECOND).alias("__to"))
    rows = joins.in_interval(keyed, past, list(DAY), "__from", "__to", "ts_event", _width(cfg))
    s, p = F.col("order_side"), F.col("entry_px")
    own = F.when(F.col("side") == BID, 1).otherwise(-1) == s
    hits = (F.col("action") == TRADE) & (F.col("side") == -s)
    (gone, now), (_, before), ours = shown(s, p), shown(s, p, "prev_"), F.col("price") == p
    kind = F.when(hits & (F.col("price") * s < p * s), "through").when(hits & ours, "trade").when((F.col("action") == CANCEL) & ours & own, "cancel")
    kind = F.coalesce(kind.when((F.col("action") == MODIFY) & ours & own & (before > 0) & (F.col("size") < before), "cut"), F.lit("none"))
    size = F.when(kind == "cut", before - F.col("size")).otherwise(F.col("size")).cast("double")
    touched = F.coalesce(F.when(s == BID, F.col("ask_px") <= p).otherwise(F.col("bid_px") >= p), F.lit(False))
    step = F.struct(
        F.col("ts_event").alias("ts"), F.lit(0).alias("mark"), "sequence", kind.alias("kind"), size.alias("size"), before.cast("double").alias("before"), gone.alias("gone"),
        F.when(kind == "cut", -1).otherwise(F.col("queue_pos")).cast("double").alias("pos"), touched.alias("touched"), now.cast("double").alias("now"),
    )
    gathered = rows.groupBy(*ORDER, *CELL).agg(F.collect_list(step).alias("path"))
    out = orders.join(gathered, [*ORDER, *CELL], "left").withColumn("path", F.coalesce("path", F.array().cast(gathered.schema["path"].dataType)))
    if checkpoints:
        last = F.greatest(F.lit(0), F.ceil(F.col("deadline_s").cast("long") * SECOND / F.lit(float(cfg.checkpoint_ms * MS))).cast("int") - 1)
        number = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        none = F.lit(0.0)
        marks = F.transform(number, lambda j: F.struct((F.col("t0") + j.cast("long") * (cfg.checkpoint_ms * MS)).alias("ts"), F.lit(1).alias("mark"), j.cast("long").alias("sequence"), F.lit("mark").alias("kind"), none.alias("size"), none.alias("before"), F.lit(False).alias("gone"), none.alias("pos"), F.lit(False).alias("touched"), none.alias("now")))
        out = out.withColumn("path", F.concat("path", marks))
    return out.withColumn("path", F.array_sort("path"))


def _cancelled(model: str, ahead: Column, x: Column) -> Column:
    """Quantity ahead after a cancel of ``size`` at ``pos`` on a level of ``before``."""
    share = F.when(x["before"] > 0, ahead - x["size"] * F.least(ahead, x["before"]) / x["before"]).otherwise(ahead)
    if model == "pessimistic":
        return ahead
    if model == "optimistic":
        return ahead - F.least(x["size"], ahead)
    if model == "exact":
        return F.when(x["pos"] >= 0, ahead - F.greatest(F.least(x["pos"] + x["size"], ahead) - F.greatest(x["pos"], F.lit(0.0)), F.lit(0.0))).otherwise(share)
    return share


_LANES = "array<struct<ahead:double,done:boolean,seq:bigint,ts:bigint>>"
_POINT = f"array<struct<j:bigint,lanes:{_LANES}>>"


def _held(x: Column, build) -> Column:
    """``build(x)`` with ``x`` worked out once, however often it is named."""
    return F.transform(F.array(x), build)[0]


def folded(orders: DataFrame) -> DataFrame:
    """``result``: for each queue model (``lanes``) whether, where and when the order filled, and the states at the checkpoints.

    The order of checks inside a row: trade or cancel, then the opposite touch,
    then the clamp to what is displayed. Most rows change nothing and are passed
    by: those after the fill under all models, and those that neither concern
    the level nor show less there than any model has ahead.
    """

    def state(lanes: Column, points: Column) -> Column:
        ahead = lambda open_lanes: F.transform(open_lanes, lambda x: x["ahead"])
        of = lambda open_lanes: F.struct(lanes.alias("lanes"), points.alias("points"), (F.size(open_lanes) > 0).alias("open"), F.array_max(ahead(open_lanes)).alias("most"), F.array_min(ahead(open_lanes)).alias("least"))
        return _held(F.filter(lanes, lambda x: ~x["done"]), of)

    empty = F.struct(F.col("ahead0").cast("double").alias("ahead"), F.lit(False).alias("done"), F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("bigint").alias("ts"))
    start = state(F.array(*(empty for _ in QUEUE_MODELS)).cast(_LANES), F.array().cast(_POINT))

    def step(acc, x):
        tried = []
        for i, model in enumerate(QUEUE_MODELS):
            lane = acc["lanes"][i]
            old = lane["ahead"]
            fills = F.coalesce((x["kind"] == "through") | ((x["kind"] == "trade") & (x["size"] > old)) | x["touched"], F.lit(False))
            left = F.when(x["kind"] == "trade", old - x["size"]).when(x["kind"].isin("cancel", "cut"), _cancelled(model, old, x)).otherwise(old)
            tried.append(F.struct(lane.alias("was"), fills.alias("fills"), left.alias("left")))

        def lane_after(y):
            was, new = y["was"], y["fills"] & ~y["was"]["done"]
            left = F.when(x["gone"], 0.0).when(y["left"] > x["now"], x["now"]).otherwise(y["left"])  # null: not shown, so no bound
            return F.struct(
                F.when(was["done"] | y["fills"], was["ahead"]).otherwise(left).alias("ahead"), (was["done"] | new).alias("done"),
                F.when(new, x["sequence"]).otherwise(was["seq"]).alias("seq"), F.when(new, x["ts"]).otherwise(was["ts"]).alias("ts"),
            )

        no_less = F.when(x["gone"], (acc["most"] == 0) & (acc["least"] == 0)).otherwise(F.coalesce(x["now"] >= acc["most"], F.lit(True)))
        passed = ~acc["open"] | ((x["kind"] == "none") & ~x["touched"] & no_less)
        point = F.array(F.struct(x["sequence"].alias("j"), acc["lanes"].alias("lanes"))).cast(_POINT)
        marked = F.struct(acc["lanes"].alias("lanes"), F.concat(acc["points"], point).alias("points"), acc["open"].alias("open"), acc["most"].alias("most"), acc["least"].alias("least"))
        after = _held(F.transform(F.array(*tried), lane_after), lambda lanes: state(lanes, acc["points"]))
        return F.when(x["mark"] == 1, marked).when(passed, acc).otherwise(after)

    return orders.withColumn("result", F.aggregate("path", start, step, lambda acc: F.struct(acc["lanes"].alias("lanes"), acc["points"].alias("points")))).drop("path")


def by_deadline(runs: DataFrame, cfg: Settings) -> DataFrame:
    """Folded orders of :func:`longest`, one row a cell: what has come about until its own deadline."""
    rows = runs.withColumn("__cell", F.explode("cells")).drop("cells", "deadline_s", "__start").select("*", "__cell.*").drop("__cell")
    stop, r = F.col("deadline_s").cast("long") * SECOND, F.col("result")
    never = F.struct(F.lit(None).cast("double").alias("ahead"), F.lit(False).alias("done"), F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("bigint").alias("ts"))
    lanes = F.transform(r["lanes"], lambda x: F.when(x["ts"] > F.col("t0") + stop, never).otherwise(x))
    points = F.filter(r["points"], lambda x: x["j"] * (cfg.checkpoint_ms * MS) < stop)
    return rows.withColumn("result", F.struct(lanes.alias("lanes"), points.alias("points")))


def by_model(orders: DataFrame) -> DataFrame:
    """Folded orders, one row a queue model: ``filled``, ``fill_seq``, ``fill_ts``, ``passive_px`` and ``points`` before the fill."""
    rows = orders.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(len(QUEUE_MODELS) - 1))))
    m, r = F.col("m"), F.col("result")
    points = F.transform(F.filter(r["points"], lambda x: ~x["lanes"][m]["done"]), lambda x: F.struct(x["j"].alias("j"), x["lanes"][m]["ahead"].alias("ahead")))
    rows = rows.withColumns({"queue_model": F.element_at(F.array(*map(F.lit, QUEUE_MODELS)), m + 1), "filled": r["lanes"][m]["done"], "fill_seq": r["lanes"][m]["seq"], "fill_ts": r["lanes"][m]["ts"], "points": points})
    return rows.withColumn("passive_px", F.when(F.col("filled"), F.col("entry_px")).otherwise(F.col("end_px"))).drop("m", "result")


def followed(orders: DataFrame, book: DataFrame, start: Column, cfg: Settings, checkpoints: bool = True) -> DataFrame:
    """``orders`` for every queue model, followed from ``start`` to their deadlines."""
    return by_model(by_deadline(folded(paths(longest(orders, start), book, F.col("__start"), cfg, checkpoints)), cfg)).select(*orders.columns, "queue_model", "filled", "fill_seq", "fill_ts", "points", "passive_px")


def simulate(made: DataFrame, book: DataFrame, cfg: Settings = DEFAULT, checkpoints: bool = True) -> DataFrame:
    """Orders that join the touch, for every cell and queue model."""
    orders = orders_at_touch(made, book, cfg)
    return followed(orders, book, F.col("t0") + F.col("latency_ms").cast("long") * MS, cfg, checkpoints)


def new_level_cap(book: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """``cap`` of each day: the share of the median touch size, both sides pooled, that a fresh level may hold; one at least."""
    sizes = features.with_mid(book).filter("mid IS NOT NULL").select(*DAY, F.explode(F.array("qb", "qa")).alias("q"))
    return sizes.groupBy(*DAY).agg(F.greatest(F.lit(1), F.floor(F.percentile("q", F.lit(0.5)) * cfg.new_level_share)).cast("long").alias("cap"))


def orders_at_new_level(made: DataFrame, book: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Decisions that wait for a fresh, small own level and join it a latency later, unless it is marketable by then; null entry if none."""
    past = with_past(book)
    arrival = orders_at_touch(made, book, cfg).select(*ORDER, *CELL, "t0", "order_side", "arrival_mid", "own_queue", "spread_ticks", "cross_px", "end_px")
    keyed = arrival.select(*ORDER, *CELL, "order_side", (F.col("t0") + F.col("latency_ms").cast("long") * MS).alias("__from"), (F.col("t0") + F.col("deadline_s").cast("long") * SECOND).alias("__to"))
    buy = F.col("order_side") == BID
    seen = past.select(*DAY, "ts_event", "sequence", *STATE, "prev_bid_px", "prev_ask_px").join(new_level_cap(book, cfg), [*DAY])
    better_bid = F.col("bid_px").isNotNull() & (F.col("prev_bid_px").isNull() | (F.col("bid_px") > F.col("prev_bid_px"))) & (F.col("bid_depth")[0] <= F.col("cap"))
    better_ask = F.col("ask_px").isNotNull() & (F.col("prev_ask_px").isNull() | (F.col("ask_px") < F.col("prev_ask_px"))) & (F.col("ask_depth")[0] <= F.col("cap"))
    fresh = joins.in_interval(keyed, seen.filter(better_bid | better_ask), list(DAY), "__from", "__to", "ts_event", _width(cfg))
    fresh = fresh.filter(F.when(buy, better_bid).otherwise(better_ask)).select(
        *ORDER, *CELL, "order_side", "__to", F.col("sequence").alias("fresh_seq"), F.when(buy, F.col("bid_px")).otherwise(F.col("ask_px")).alias("entry_px"), (F.col("ts_event") + F.col("latency_ms").cast("long") * MS).alias("at")
    )
    landed = states_at(fresh.filter(F.col("at") <= F.col("__to")), book.withColumn("entry_seq", F.col("sequence")), ["entry_seq", *STATE])
    opposite = F.when(buy, F.col("ask_px") <= F.col("entry_px")).otherwise(F.col("bid_px") >= F.col("entry_px"))
    _, size = shown(F.col("order_side"), F.col("entry_px"))
    landed = landed.filter(~F.coalesce(opposite, F.lit(False))).withColumn("ahead0", F.coalesce(size, F.lit(0)).cast("double"))
    first = landed.groupBy(*ORDER, *CELL).agg(F.min_by(F.struct("entry_seq", "entry_px", "ahead0", "at"), "fresh_seq").alias("e"))
    return arrival.join(first, [*ORDER, *CELL], "left").select(*arrival.columns, "e.*").withColumnRenamed("at", "landed_ts")


def simulate_new_level(made: DataFrame, book: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Orders that join fresh levels only; those that never join cross at the end."""
    orders = orders_at_new_level(made, book, cfg)
    return followed(orders, book, F.coalesce("landed_ts", F.col("t0") + F.col("deadline_s").cast("long") * SECOND), cfg, checkpoints=False)


def checkpoint_rows(sim: DataFrame, book: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Checkpoints of each order: state, time left, price of crossing after the latency, and whether its price is the touch.

    Checkpoint 0 is the decision itself: the own touch is ahead, and the book is that before the latency.
    """
    zero = F.struct(F.lit(0).cast("long").alias("j"), F.col("own_queue").cast("double").alias("ahead"))
    kind = "array<struct<j:bigint,ahead:double>>"
    rows = sim.withColumn("x", F.explode(F.concat(F.array(zero).cast(kind), F.col("points").cast(kind)))).select(*[c for c in sim.columns if c != "points"], "x.j", "x.ahead")
    ts = F.col("t0") + F.col("j") * (cfg.checkpoint_ms * MS)
    rows = rows.withColumn("tleft_s", (F.col("t0") + F.col("deadline_s").cast("long") * SECOND - ts) / float(SECOND))
    when = rows.select(*ORDER, "latency_ms", "j", "order_side", ts.alias("at")).distinct()
    now = states_at(when, book.select(*DAY, "ts_event", "sequence", F.col("sequence").alias("cp_seq"), F.col("bid_px").alias("now_bid"), F.col("ask_px").alias("now_ask")), ["cp_seq", "now_bid", "now_ask"])
    later = states_at(now.withColumn("at", F.col("at") + F.col("latency_ms").cast("long") * MS), book.select(*DAY, "ts_event", "sequence", F.col("bid_px").alias("b"), F.col("ask_px").alias("a")), ["b", "a"])
    buy = F.col("order_side") == BID
    later = later.select(*ORDER, "latency_ms", "j", "cp_seq", F.when(buy, F.col("a")).otherwise(F.col("b")).alias("cp_cross"), F.when(buy, F.col("now_bid")).otherwise(F.col("now_ask")).alias("own_best"))
    rows = rows.join(later, [*ORDER, "latency_ms", "j"])
    # An order that has not joined by then waits behind the row that it is going to join at.
    seq = F.when((F.col("j") > 0) & (ts < F.col("t0") + F.col("latency_ms").cast("long") * MS), F.col("entry_seq")).otherwise(F.col("cp_seq"))
    return rows.withColumn("at_touch", F.when((F.col("j") == 0) | F.coalesce(F.col("own_best") == F.col("entry_px"), F.lit(False)), 1).otherwise(0)).withColumn("cp_seq", seq).drop("own_best")
