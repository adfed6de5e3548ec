"""Book reconstruction, features, targets and fills against hand cases and a plain model."""

from __future__ import annotations

import datetime
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import book, features, joins, ladder, quality, simulator, stats, targets
from tickloom.schema import ADD, ASK, BID, CANCEL, CLEAR, DEFAULT, EVENTS, MODIFY, TRADE

DAY = datetime.date(2024, 3, 1)
MS = 1_000_000


def events(spark, rows):
    """Rows (ms, action, side, price, size[, queue_pos]) of one day."""
    return spark.createDataFrame([(1, DAY, int(r[0] * MS), i + 1, *r[1:5], r[5] if len(r) > 5 else -1) for i, r in enumerate(rows)], EVENTS)


def plain(rows):
    """Price levels kept in dictionaries: best prices and flags after every event."""
    sides, out = {BID: {}, ASK: {}}, []
    base = rows[0][3] - DEFAULT.price_window // 2
    for _, action, side, price, size, *_ in rows:
        flag, refused = 0, 0
        own = BID if side == BID else ASK
        if action == CLEAR:
            sides = {BID: {}, ASK: {}}
        elif not 0 <= price - base < DEFAULT.price_window:
            refused = 1
        elif size < 0 or (size == 0 and action != MODIFY):
            refused = 16
        elif action == ADD:
            sides[own][price] = sides[own].get(price, 0) + size
        elif action == MODIFY:
            sides[own][price] = size
        else:
            levels = sides[-own if action == TRADE else own]
            flag = 2 if size > levels.get(price, 0) else 0
            levels[price] = max(0, levels.get(price, 0) - size)
        bid = max((p for p, s in sides[BID].items() if s > 0), default=None)
        ask = min((p for p, s in sides[ASK].items() if s > 0), default=None)
        if refused:
            flag = refused
        elif action != CLEAR and bid is not None and ask is not None:
            flag += 4 if bid > ask else 8 if bid == ask else 0
        out.append((bid, ask, flag, [sides[BID].get(bid - i, 0) for i in range(10)] if bid is not None else [0] * 10))
    return out


def many_days(spark):
    """Three days of two instruments with clears, refused rows, gaps in the sequence and a null price."""
    draw, rows = random.Random(23), []
    for day, n in ((0, 700), (1, 90), (2, 1)):
        sequence = 5
        for i in range(n):
            action = draw.choice([ADD, ADD, ADD, CANCEL, CANCEL, MODIFY, TRADE, TRADE, CLEAR if i % 150 == 77 else ADD])
            price = None if i % 211 == 9 else 1000 + draw.randint(-6, 6) + (20_000 if i % 97 == 5 else 0)
            for instrument in (1, 2) if i % 3 else (1,):
                rows.append((instrument, DAY + datetime.timedelta(days=day), i * MS, sequence, action, draw.choice([BID, ASK, ASK, 0]), price, draw.choice([0, -1, 1, 3, 8, 20]), -1))
            sequence += 1 if i % 50 else 40
    return spark.createDataFrame(rows, EVENTS).repartition(3)


@pytest.mark.parametrize("slice_rows", [1, 7, 64, 100_000])
def test_slices_of_a_day_give_the_same_book(spark, slice_rows):
    frame = many_days(spark)
    plain_rows = sorted(map(repr, book.book_frame(frame).collect()))
    got = book.book_frame(frame, DEFAULT.override(slice_rows=slice_rows))
    assert sorted(map(repr, got.collect())) == plain_rows
    if slice_rows == 7:
        assert book.sliced(frame, 7).select("instrument_id", "date", "slice").distinct().count() > 100
        assert book.book_frame(frame.limit(0), DEFAULT.override(slice_rows=7)).count() == 0


def test_an_empty_side_costs_no_more_than_a_full_one():
    """Two thousand levels of which one side has hardly any."""

    def took(bids):
        draw = np.random.default_rng(1)
        n = 50_000
        side = np.where(draw.random(n) < bids, BID, ASK)
        action = np.where(side == BID, draw.choice([ADD, CANCEL], n), draw.choice([ADD, ADD, CANCEL, MODIFY], n))
        price = np.where(side == BID, 10_000 - draw.integers(0, 2000, n), 10_001 + draw.integers(0, 2000, n))
        began = time.process_time()
        ladder.fold(action, side, price, draw.integers(1, 40, n), np.ones(n, dtype=bool), 10, DEFAULT.price_window, 10_000)
        return time.process_time() - began

    took(0.5)
    assert min(took(0.001) for _ in range(3)) < 2 * min(took(0.5) for _ in range(3)) + 0.05


def test_cover_takes_the_greatest_stretch():
    draw = np.random.default_rng(4)
    for n in (1, 2, 13, 64):
        start = draw.integers(0, n, 40)
        stop = start + 1 + np.array([draw.integers(0, n - s) for s in start])
        value = draw.integers(0, 9, 40)
        want = [max((v for a, b, v in zip(start, stop, value, strict=True) if a <= i < b), default=-1) for i in range(n)]
        assert ladder._cover(start, stop, value, n).tolist() == want
    assert ladder._cover(*(np.zeros(0, dtype=np.int64),) * 3, 3).tolist() == [-1, -1, -1]


def test_book_equals_a_plain_model(spark):
    draw = random.Random(11)
    rows = [(0, ADD, BID, 1000, 5)]
    for i in range(600):
        action = draw.choice([ADD, ADD, ADD, CANCEL, CANCEL, MODIFY, TRADE, TRADE, CLEAR if i % 150 == 7 else ADD])
        rows.append((i // 3, action, draw.choice([BID, ASK, ASK, 0]), 1000 + draw.randint(-6, 6) + (20_000 if i % 97 == 5 else 0), draw.choice([0, -1, 1, 3, 8, 20])))
    got = book.book_frame(events(spark, rows)).orderBy("sequence").select("bid_px", "ask_px", "book_flags", "bid_depth").collect()
    assert [(r[0], r[1], r[2], list(r[3])) for r in got] == plain(rows)


HAND = [(0, ADD, BID, 100, 10), (1, ADD, BID, 99, 20), (2, ADD, ASK, 101, 10), (500, ADD, BID, 100, 5), (700, TRADE, ASK, 100, 15), (900, ADD, ASK, 101, 5)]


def test_hand_features(spark):
    rows = features.with_features(book.book_frame(events(spark, HAND))).orderBy("sequence").collect()
    assert [r.ofi for r in rows] == [0, 0, 0, 5, -15, -5]
    assert rows[0].imbalance is None and rows[3].imbalance == 0.2
    assert rows[4].tfi_ms1000 == -1.0 and rows[5].bid_px == 99
    assert rows[5].since_mid_change_ms == 200.0


def test_features_never_look_ahead(spark):
    rows = [(i // 4, *x) for i, x in enumerate([(ADD, BID, 100 - i % 3, 4 + i % 5) if i % 2 else (ADD, ASK, 102 + i % 3, 3 + i % 7) for i in range(80)])]
    names = [n for n in features.feature_names() if n != "minutes_since_open"]
    whole = features.with_features(book.book_frame(events(spark, rows))).filter("sequence <= 50").orderBy("sequence").select(*names).collect()
    head = features.with_features(book.book_frame(events(spark, rows[:50]))).orderBy("sequence").select(*names).collect()
    assert whole == head


def test_targets_after_a_gap(spark):
    mids = [(0, 100.5), (1000, 100.5), (1500, None), (1600, 100.5), (3000, 101.0), (40000, 101.0)]
    rows = spark.createDataFrame([(1, DAY, t * MS, i, m) for i, (t, m) in enumerate(mids)], "instrument_id int, date date, ts_event long, sequence long, mid double")
    got = targets.with_targets(rows).orderBy("sequence").collect()
    assert [r.next_dir for r in got] == [None, None, None, 1.0, None, None]
    assert [r.ret_1s for r in got] == [0.0, 0.0, None, 0.0, 0.0, None]


#: Join behind 10 lots: a cancel of 4 at position 14, trades and a cancel at the front.
QUEUE = [(0, ADD, BID, 100, 20), (0, ADD, ASK, 101, 50), (1000, CANCEL, BID, 100, 4, 14), (2000, TRADE, ASK, 100, 7, 0), (2500, CANCEL, BID, 100, 2, 0), (3000, TRADE, ASK, 100, 2, 0), (4000, TRADE, ASK, 100, 2, 0), (5000, TRADE, ASK, 100, 2, 0), (9000, ADD, BID, 99, 1)]


def test_queue_models_order(spark):
    rows = book.book_frame(events(spark, QUEUE))
    made = spark.createDataFrame([(1, DAY, 0, 500 * MS, 1)], "instrument_id int, date date, decision_id int, t0 long, order_side int")
    cfg = DEFAULT.override(latencies_ms=(0,), deadlines_s=(8,))
    got = {r.queue_model: r for r in simulator.simulate(made, rows, cfg).collect()}
    assert got["pessimistic"].ahead0 == 20.0 and got["pessimistic"].entry_px == 100
    ahead = {m: got[m].points[-1].ahead if got[m].points else None for m in got}
    assert ahead["optimistic"] <= ahead["proportional"] <= ahead["pessimistic"]
    assert all(not r.filled or r.fill_ts <= 8500 * MS for r in got.values())
    rows = simulator.checkpoint_rows(simulator.simulate(made, rows, cfg), rows, cfg)
    assert rows.filter("j = 0 AND cp_cross = 101 AND at_touch = 1").count() == 4


def test_as_of_takes_the_last_row_at_or_before(spark):
    table = spark.createDataFrame([(1, 10, 1, "a"), (1, 10, 2, "b"), (1, 20, 3, "c")], "k int, ts long, o long, v string")
    points = spark.createDataFrame([(1, 9), (1, 10), (1, 15), (1, 99), (2, 15)], "k int, at long")
    got = {(r.k, r["at"]): r.v for r in joins.as_of(points, table, ("k",), "at", "ts", "o", ["v"]).collect()}
    assert got == {(1, 9): None, (1, 10): "b", (1, 15): "b", (1, 99): "c", (2, 15): None}


def test_interval_join_is_open_and_closed(spark):
    table = spark.createDataFrame([(1, t) for t in range(0, 50, 5)], "k int, ts long")
    points = spark.createDataFrame([(1, 5, 20)], "k int, a long, b long")
    assert sorted(r.ts for r in joins.in_interval(points, table, ["k"], "a", "b", "ts", 7).collect()) == [10, 15, 20]


def test_auc_with_ties(spark):
    rows = spark.createDataFrame([(0.0, 0.1), (0.0, 0.4), (1.0, 0.35), (1.0, 0.8)], "y double, p double").withColumn("g", F.lit(1))
    assert stats.auc(rows, ("g",)).first().auc == 0.75
    assert stats.auc(rows.withColumn("p", F.lit(0.3)), ("g",)).first().auc == 0.5
    assert stats.auc(rows.filter("y = 1"), ("g",)).first().auc is None


def test_roll_days_have_a_buffer(spark):
    shares = [97, 96, 70, 45, 20, 3, 3]
    rows = [(DAY + datetime.timedelta(days=i), c, v) for i, s in enumerate(shares) for c, v in ((1, s), (2, 100 - s))]
    got = quality.roll_days(spark.createDataFrame(rows, "date date, instrument_id long, volume long")).orderBy("date").collect()
    assert [r.is_roll for r in got] == [False, False, True, True, True, False, False]


def test_settings_reject_unknown_names():
    try:
        DEFAULT.override(depth=3)
    except ValueError as e:
        assert "depth" in str(e)
    else:
        raise AssertionError


def test_series_are_summed_where_they_lie(spark):
    """Lagged products and AUC over many partitions equal plain sums; short series and parts shorter than the lags too."""
    import numpy as np

    draw = np.random.default_rng(6)
    rows = [(k, i, float(x)) for k, n in ((1, 300), (2, 2), (3, 7)) for i, x in enumerate(draw.normal(size=n))]
    df = spark.createDataFrame(rows, "k int, o int, diff double")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = {r.k: r.hac_t for r in stats.hac_t(df, ("k",), ("o",), 50).collect()}
        scores = spark.createDataFrame([(int(g), float(y), float(p)) for g, y, p in zip(draw.integers(0, 3, 500), draw.integers(0, 2, 500), draw.integers(0, 60, 500) / 60, strict=True)], "g int, y double, p double")
        aucs = {r.g: r.auc for r in stats.auc(scores, ("g",)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for k in (1, 3):
        x = np.array([v for a, _, v in rows if a == k])
        e = x - x.mean()
        g = sum((1 if lag == 0 else 2 * (1 - lag / 51)) * (e[lag:] @ e[: len(e) - lag]) for lag in range(min(51, len(e))))
        assert got[k] is None if g <= 0 else abs(got[k] - x.mean() / np.sqrt(g / len(x) ** 2)) < 1e-5
    assert got[2] is None
    plain = scores.toPandas()
    for g, own in plain.groupby("g"):
        up, down = own[own.y == 1].p.to_numpy(), own[own.y == 0].p.to_numpy()
        assert abs(aucs[g] - ((up[:, None] > down).mean() + (up[:, None] == down).mean() / 2)) < 1e-9


def test_short_slices_are_folded_many_at_a_time(spark):
    """Slices of twelve rows: a group for each block of them, and no frame that is summed up anew for each slice."""
    draw, rows = random.Random(5), []
    for i in range(600):
        rows.append((i, draw.choice([ADD, ADD, CANCEL, MODIFY, TRADE, CLEAR if i % 90 == 50 else ADD]), draw.choice([BID, ASK]), 1000 + draw.randint(-4, 4), draw.choice([1, 3, 8])))
    want = [(r[0], r[1], r[2], r[3]) for r in plain(rows)]
    action, side, price, size = (np.array(x) for x in list(zip(*rows, strict=True))[1:])
    part, known = np.arange(600) // 12, np.ones(600, dtype=bool)
    cut = book.sliced(events(spark, rows), 12)
    opening = book.opening_levels(book.slice_effects(cut, 12))
    assert "rowframe, 1, unboundedfollowing" not in opening._jdf.queryExecution().optimizedPlan().toString().lower()
    held = np.array([(r.slice, r.book_side, r.price, r.size) for r in opening.collect() if r.book_side]).T
    found = ladder.fold_slices(action, side, price, size, known, 10, DEFAULT.price_window, int(price[0]), part, tuple(held))
    px = lambda name: [int(p) if has else None for p, has in zip(found[f"{name}_px"], found[f"has_{name}"], strict=True)]
    assert list(zip(px("bid"), px("ask"), found["book_flags"].tolist(), found["bid_depth"].tolist(), strict=True)) == want
    plan = book.book_frame(events(spark, rows), DEFAULT.override(slice_rows=12))._jdf.queryExecution().optimizedPlan().toString()
    assert "block" in plan
