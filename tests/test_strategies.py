"""The trade log of all six strategies: complete, priced alike, and bounded by the strategy that knows the future."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.plans import catalog

SF = "/root/testdata/sf0.001"
KEYS = ["instrument_id", "date", "decision_id", "latency_ms", "deadline_s", "queue_model"]


def test_six_strategies_on_the_same_orders(spark):
    log = catalog.QUERIES["simulate"](spark, SF)
    orders = log.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("strategy").alias("kinds"))
    assert orders.filter("n <> 6 OR kinds <> 6").isEmpty() and not orders.isEmpty()
    cost = log.groupBy(*KEYS).pivot("strategy", ["always_cross", "always_post", "model_direction", "model_cost", "oracle"]).agg(F.first("cost_ticks"))
    assert cost.filter("oracle > least(always_post, model_direction, model_cost) + 1e-9").isEmpty()
    assert log.filter("cost_usd IS NOT NULL AND abs(cost_usd - fee_usd - cost_ticks * 15.625) > 1e-9").isEmpty()


def test_stored_tables_go_to_the_shared_folder(spark):
    from tickloom.sources.scratch import scratch_root, stored

    rows = stored(spark.range(5), "few")
    assert rows.count() == 5
    assert all(f"{scratch_root(spark).removeprefix('file://')}/tickloom-few-" in f for f in rows.inputFiles())
    assert stored(spark.range(0), "none").dtypes == spark.range(0).dtypes  # files hold nullable columns
