"""Commands over a small table of events, sinks, and the settings they take."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tickloom import commands
from tickloom.functions.scalar import zip_strict
from tickloom.operators import quality
from tickloom.schema import DAY, DEFAULT, EVENTS
from tickloom.sources import tables
from tickloom.sources.fixtures import l2_events
from tickloom.streaming import replay

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """Three weeks of days, all within their sessions, through every command."""
    root = tmp_path_factory.mktemp("commands")
    rows = l2_events(spark, SF).filter("day(date) <= 12")
    opens = quality.local_ns(F.col("date"), DEFAULT.session[0])
    rows = rows.withColumn("ts_event", (opens + F.col("sequence") * 100_000_000).cast("long"))
    repeated = rows.unionByName(rows.filter("sequence % 9 = 0"))
    tables.write_days(repeated, f"{root}/events")
    (root / "settings.json").write_text(json.dumps({"min_train_days": 4, "test_block_days": 3, "decisions_per_day": 4, "deadlines_s": [1], "latencies_ms": [0, 10], "headline": ["proportional", 10, 1], "boost_rounds": 4, "boost_least_rows": 10, "bootstrap_reps": 20}))
    options = ["--config", str(root / "settings.json"), "--set", "session=[\"08:30\", \"15:00\"]"]
    assert commands.main([*options, "all", "--events", f"{root}/events", "--out", f"{root}/out"], spark) == 0
    assert commands.main([*options, "replay", "--out", f"{root}/out", "--slices", "2"], spark) == 0
    return root, rows


def test_all_leaves_tables_and_a_report(spark, built):
    root, rows = built
    made = tables.read_days(spark, f"{root}/out/features")
    assert 0 < made.count() <= rows.count() and made.groupBy(*DAY, "sequence").count().filter("count > 1").isEmpty()
    assert tables.available_days(spark, f"{root}/out/features").count() == made.select(*DAY).distinct().count()
    found = tables.read_result(spark, f"{root}/out/tables", "direction_metrics")
    assert {r.model for r in found.collect()} == set(commands.MODELS) and found.filter("auc BETWEEN 0 AND 1").count() > 0
    text = (root / "out" / "REPORT.md").read_text()
    assert "## cost_table" in text and "## savings" in text and "## descriptive" in text and "## direction_metrics" in text and "## stability" in text
    assert (root / "out" / "QUALITY.md").read_text().count("\n") > 10


def test_executed_orders_have_costs(spark, built):
    root, _ = built
    log = tables.read_days(spark, f"{root}/out/trade_log")
    cells = log.groupBy(*DAY, "decision_id", "queue_model", "latency_ms", "deadline_s").agg(F.countDistinct("strategy").alias("n"))
    assert not cells.isEmpty() and cells.filter("n <> 4").isEmpty()
    assert log.filter("decision_ts IS NULL OR in_release_window OR minutes_since_open < 0 OR (filled_passive AND adverse_5s IS NULL) OR time_to_fill_ms < 0").isEmpty()
    costs = {(r.queue_model, r.latency_ms, r.strategy): r for r in tables.read_result(spark, f"{root}/out/tables", "cost_table").collect()}
    assert len(costs) == 4 * 2 * 4
    assert all(costs[m, lat, "oracle"].mean_cost_ticks <= costs[m, lat, s].mean_cost_ticks + 1e-9 for m, lat, s in costs if s != "new_level")
    saved = tables.read_result(spark, f"{root}/out/tables", "savings")
    assert saved.count() == 4 * 2 * 5 and saved.filter("ci95_lo > saving_ticks + 1e-9 OR ci95_hi < saving_ticks - 1e-9").isEmpty()


def test_replay_gives_the_batch_features(spark, built):
    root, _ = built
    batch = tables.read_days(spark, f"{root}/out/features").filter("mid IS NOT NULL").select(*DAY, "sequence", "imbalance", "microprice", "ofi_ev50", "tfi_ms1000")
    both = batch.join(tables.read_days(spark, f"{root}/out/streamed").withColumnsRenamed({"imbalance": "i2", "microprice": "m2", "ofi": "o2", "tfi": "t2"}), [*DAY, "sequence"])
    off = both.filter("abs(imbalance - i2) + abs(microprice - m2) > 1e-9")
    assert both.count() == batch.count() and off.isEmpty()
    assert "tickloom_events_total" in (root / "out" / "metrics.txt").read_text()


def test_bad_days_are_refused(spark, tmp_path):
    tables.write_days(l2_events(spark, SF, "crossed").filter("day(date) <= 3"), f"{tmp_path}/events")
    with pytest.raises(quality.BadDays, match="crossed"):
        commands.build_features(spark, f"{tmp_path}/events", f"{tmp_path}/out")
    assert not (tmp_path / "out").exists()
    with pytest.raises(ValueError, match="nothing to test"):
        commands.build_features(spark, f"{tmp_path}/events", f"{tmp_path}/kept", keep_bad_days=True)
        commands.train(spark, f"{tmp_path}/kept")


def test_settings_come_from_a_file_and_pairs(tmp_path):
    (tmp_path / "s.json").write_text('{"levels": 5, "windows_ms": [10, 20]}')
    cfg = commands.settings(str(tmp_path / "s.json"), ["levels=7", "timezone=UTC"])
    assert (cfg.levels, cfg.windows_ms, cfg.timezone) == (7, (10, 20), "UTC")
    for wrong in (["depth=3"], ["levels"]):
        with pytest.raises(ValueError):
            commands.settings(None, wrong)


def test_sources_have_to_be_events(spark):
    with pytest.raises(ValueError, match="queue_pos"):
        tables.as_events(spark.createDataFrame([], EVENTS).drop("queue_pos"))
    assert tables.as_events(tables.in_memory(spark, []).withColumn("more", F.lit(1))).schema == EVENTS


def test_pace_and_ticks(spark):
    with pytest.raises(ValueError):
        replay.pace(1, 0)
    assert replay.pace(3_000_000_000, 2) == 1.5
    sizes = spark.createDataFrame([(0.015625,), (0.0156250000001,)], "tick_size double")
    quality.verify_tick_size(sizes, 0.015625)
    for bad in (sizes.limit(0), sizes.unionByName(spark.createDataFrame([(None,)], "tick_size double")), sizes.withColumn("tick_size", F.lit(0.25))):
        with pytest.raises(ValueError):
            quality.verify_tick_size(bad, 0.015625)


def test_arrays_are_zipped_strictly(spark):
    rows = spark.createDataFrame([([1, 2], [3])], "a array<int>, b array<int>")
    with pytest.raises(Exception, match="different sizes"):
        rows.select(zip_strict(a=F.col("a"), b=F.col("b"))).collect()


def test_markdown_is_for_small_tables(spark):
    assert tables.markdown(spark.createDataFrame([(1, 0.25, None)], "a int, b double, c string")) == "| a | b | c |\n|-|-|-|\n| 1 | 0.25 |  |\n"
    with pytest.raises(ValueError):
        tables.markdown(spark.range(20), 10)


def test_streamed_batches_carry_on(spark):
    """Features do not depend on where batches end."""
    import pandas as pd

    rows = pd.DataFrame({"bid_px": [100, 100, None, 99, 99, 100] * 8, "ask_px": [101, 101, 101, 101, 100, 101] * 8, "qb": range(48), "qa": range(50, 98), "ts_event": [i * 400_000_000 for i in range(48)], "size": range(1, 49), "action": [3, 0, 3] * 16, "side": [1, -1, -1, 1] * 12})
    start = (None, None, None, None, [], [], None, None)
    whole, after = replay.advance(rows, start, 5, 1_000_000_000)
    state, parts = start, []
    for a, b in ((0, 1), (1, 2), (2, 20), (20, 48)):
        found, state = replay.advance(rows.iloc[a:b], state, 5, 1_000_000_000)
        parts.append(pd.DataFrame(found))
    assert pd.DataFrame(whole).equals(pd.concat(parts, ignore_index=True)) and state == after
