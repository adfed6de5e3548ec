"""Orders in books made by hand, one a day, followed by hand."""

from __future__ import annotations

import datetime

import pytest

from tickloom.operators import book, simulator
from tickloom.schema import ADD, ASK, BID, CANCEL, DEFAULT, EVENTS, MODIFY, QUEUE_MODELS, TRADE

MS = 1_000_000
OPEN = [(0, ADD, BID, 100, 20, -1), (0, ADD, ASK, 101, 50, -1)]
#: (events after the opening, filled models and when in ms); a buyer joins 20 lots at 100 half a second in and has eight seconds.
CASES = {
    "nothing happens": ([], {}),
    "a trade as large as the queue does not reach the order": ([(1000, TRADE, ASK, 100, 20, 0)], {}),
    "the next one does": ([(1000, TRADE, ASK, 100, 20, 0), (2000, TRADE, ASK, 100, 1, 0)], {m: 2000 for m in QUEUE_MODELS}),
    "a larger trade": ([(1000, TRADE, ASK, 100, 21, 0)], {m: 1000 for m in QUEUE_MODELS}),
    "a trade through the price": ([(1500, TRADE, ASK, 99, 1, 0)], {m: 1500 for m in QUEUE_MODELS}),
    "a seller comes to the price": ([(1700, ADD, ASK, 100, 5, -1)], {m: 1700 for m in QUEUE_MODELS}),
    "buyers' trades do not count": ([(1000, TRADE, BID, 101, 40, 0)], {}),
    "a cancel at the front, others behind": (
        [(800, ADD, BID, 100, 30, -1), (1000, CANCEL, BID, 100, 10, 0), (2000, TRADE, ASK, 100, 12, 0)],
        {"optimistic": 2000, "exact": 2000},
    ),
    "a cancel behind the order": (
        [(800, ADD, BID, 100, 30, -1), (1000, CANCEL, BID, 100, 10, 30), (2000, TRADE, ASK, 100, 12, 0)],
        {"optimistic": 2000},
    ),
    "the queue is no longer than what is shown": ([(1000, MODIFY, BID, 100, 4, -1), (2000, TRADE, ASK, 100, 5, 0)], {m: 2000 for m in QUEUE_MODELS}),
    "too late": ([(8600, TRADE, ASK, 100, 50, 0)], {}),
}


@pytest.fixture(scope="module")
def found(spark):
    days = {name: datetime.date(2024, 3, 1 + i) for i, name in enumerate(CASES)}
    rows = [(1, days[name], int(r[0] * MS), i + 1, *r[1:]) for name, (more, _) in CASES.items() for i, r in enumerate([*OPEN, *more, (9000, ADD, ASK, 105, 1, -1)])]
    made = spark.createDataFrame([(1, d, 0, 500 * MS, 1) for d in days.values()], "instrument_id int, date date, decision_id int, t0 long, order_side int")
    cfg = DEFAULT.override(latencies_ms=(0,), deadlines_s=(8,))
    orders = simulator.simulate(made, book.book_frame(spark.createDataFrame(rows, EVENTS)), cfg).collect()
    names = {d: n for n, d in days.items()}
    return {(names[r.date], r.queue_model): r for r in orders}


@pytest.mark.parametrize("name", CASES)
def test_orders_fill_as_followed_by_hand(found, name):
    _, filled = CASES[name]
    for model in QUEUE_MODELS:
        r = found[name, model]
        assert (r.entry_px, r.ahead0, r.arrival_mid) == (100, 20.0, 100.5)
        assert (r.fill_ts // MS if r.filled else None) == filled.get(model), model
        assert r.passive_px == (100 if r.filled else r.end_px)


def test_orders_are_followed_once_for_all_deadlines(spark, monkeypatch):
    """One fold to the longest deadline, one book, and the same rows as from each deadline by itself."""
    from pyspark.sql import functions as F

    from tickloom.plans import sim_plans

    books, asked, real = [], [], simulator.folded
    kept = sim_plans.books
    monkeypatch.setattr(sim_plans, "books", lambda s, d: (books.append(d), kept(s, d))[1])
    monkeypatch.setattr(simulator, "folded", lambda runs: (asked.append(runs.select("decision_id").count()), real(runs))[1])
    together = sim_plans.checkpoints(spark, "/root/testdata/sf0.001")
    assert len(books) == 1
    cells = together.filter("j = 0 AND queue_model = 'exact'").count()
    assert asked == [cells // len(sim_plans.SIM.deadlines_s)]
    frame, made = kept(spark, "/root/testdata/sf0.001"), sim_plans.made(spark, "/root/testdata/sf0.001")
    short = sim_plans.SIM.override(deadlines_s=(1,))
    apart = simulator.checkpoint_rows(simulator.simulate(made, frame, short), frame, short)
    same = together.filter(F.col("deadline_s") == 1).select(*apart.columns)
    assert sorted(map(repr, apart.collect())) == sorted(map(repr, same.collect()))
