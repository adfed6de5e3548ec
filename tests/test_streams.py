"""The numbered source, alerts on silence and observed counters, on running queries."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from tickloom.operators import book, positions, quality
from tickloom.schema import DAY, TRADE
from tickloom.sources.fixtures import l2_events
from tickloom.streaming import alerts, source

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def slices(spark):
    rows = quality.with_session(book.book_frame(l2_events(spark, SF))).select(*DAY, "sequence", "ts_event", "action", "book_flags", "in_session")
    return positions.Slices(rows, "ts_event", *DAY, "sequence", rows_each=150)


def started(stream, root, **trigger):
    return stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/log").trigger(**(trigger or {"processingTime": "0 seconds"})).start()


def test_triggers_take_their_limit_and_restarts_lose_nothing(spark, slices, tmp_path):
    want = list(range(slices.count))

    def stream():
        return source.read_slices(spark, slices, f"{tmp_path}/progress", 90)

    query = started(stream(), tmp_path)
    while not any(p["numInputRows"] for p in query.recentProgress):
        time.sleep(0.05)
    query.stop()
    seen = spark.read.parquet(f"{tmp_path}/out")
    first = sorted(r[0] for r in seen.select("position").collect())
    assert first and first == want[: len(first)] and len(first) < len(want)
    query = started(stream(), tmp_path)
    query.processAllAvailable()
    took = [p["numInputRows"] for p in query.recentProgress]
    query.stop()
    assert max(took) <= 90 and sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out").select("position").collect()) == want


def test_a_batch_that_was_broken_off_is_planned_again(spark, slices, tmp_path):
    """The sink fails once in the second batch; the next run gives every row once."""
    failed = []

    def write(df, batch):
        if batch == 1 and not failed:
            failed.append(batch)
            raise RuntimeError("broken off")
        df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={batch}")

    for _ in range(2):
        stream = source.read_slices(spark, slices, f"{tmp_path}/progress", 200)
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/log").start()
        try:
            query.processAllAvailable()
        except Exception:
            assert failed
        query.stop()
    got = sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out").select("position").collect())
    assert failed == [1] and got == list(range(slices.count))


def test_a_pace_holds_rows_back(spark, slices, tmp_path):
    first, last = slices.table().agg(F.min("ts_event"), F.max("ts_event")).first()
    speed = (last - first) / 1e9 / 8  # eight seconds for all
    query = started(source.read_slices(spark, slices, f"{tmp_path}/progress", 10_000, speed, first), tmp_path)
    time.sleep(3)
    halfway = sum(p["numInputRows"] for p in query.recentProgress)
    deadline = time.time() + 60
    while sum(p["numInputRows"] for p in query.recentProgress) < slices.count and time.time() < deadline:
        time.sleep(0.2)
    total = sum(p["numInputRows"] for p in query.recentProgress)
    query.stop()
    assert halfway < slices.count == total
    with pytest.raises(ValueError):
        source.read_slices(spark, slices, "x", 0)


def test_silence_raises_each_alert_once(spark, tmp_path):
    """A stream of files that pauses and goes on."""
    for k, v in alerts.STATE_STORE.items():
        spark.conf.set(k, v)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        put = lambda i, ids, session=True: spark.createDataFrame([(x, i, session) for x in ids], "instrument_id int, ts_event long, in_session boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        put(1, [1, 2])
        put(1, [3], session=False)
        stream = spark.readStream.schema("instrument_id int, ts_event long, in_session boolean").parquet(f"{tmp_path}/in")
        query = alerts.silence(stream, 2.0, 5.0).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(processingTime="500 milliseconds").start()

        def found():
            rows = spark.read.schema(alerts.ALERTS).parquet(f"{tmp_path}/out").collect() if (tmp_path / "out").exists() else []
            return sorted((r.instrument_id, r.alert, r.silent_ms) for r in rows)

        def wait(n, seconds=40):
            deadline = time.time() + seconds
            while len(found()) < n and time.time() < deadline and query.isActive:
                time.sleep(0.3)
            return found()

        first = wait(4)
        assert query.exception() is None
        assert [(i, a) for i, a, _ in first] == [(1, "endpoint_down"), (1, "no_data"), (2, "endpoint_down"), (2, "no_data")]
        assert all(ms >= (2000 if a == "no_data" else 5000) for _, a, ms in first)
        time.sleep(3)
        assert found() == first
        put(2, [1])
        again = wait(6)
        query.stop()
        assert [(i, a) for i, a, _ in again].count((1, "resolved")) == 1 and [(i, a) for i, a, _ in again].count((1, "no_data")) == 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        for k in alerts.STATE_STORE:
            spark.conf.unset(k)
    with pytest.raises(ValueError):
        alerts.silence(stream, 5, 5)


def test_observed_counters_equal_the_batch_counts(spark, slices, tmp_path):
    live = alerts.LiveCounters("book")
    spark.streams.addListener(live)
    try:
        query = started(alerts.observed(source.read_slices(spark, slices, f"{tmp_path}/progress", 300), "book"), tmp_path)
        query.processAllAvailable()
        query.stop()
        assert live.ended.wait(30)
    finally:
        spark.streams.removeListener(live)
    rows = slices.table()
    want = rows.agg(F.count(F.lit(1)), F.count_if(F.col("action") == TRADE), F.max("ts_event")).first()
    assert (live.totals["events_total"], live.totals["trades_total"], live.totals["market_timestamp_ns"]) == tuple(want)
    assert len(live.triggers) == -(-slices.count // 300)
    assert live.metrics(spark).filter("metric = 'events_total'").first().value == want[0]
