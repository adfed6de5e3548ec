"""Queries that write through a sink and read back through a reader."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.functions.scalar import zip_strict
from tickloom.operators import quality
from tickloom.plans.registry import Catalog
from tickloom.plans.sql import DAY
from tickloom.schema import DAY as KEYS
from tickloom.sources import tables
from tickloom.sources.fixtures import l2_events, l2_sql, read
from tickloom.sources.scratch import scratch_root

catalog = Catalog()


def folder(spark, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/tickloom-{name}-{uuid.uuid4().hex}"


@catalog.add("write_days", f"WITH {l2_sql()} SELECT {DAY}, sequence, CASE WHEN day(date) % 7 = 0 THEN price + 1 ELSE price END AS price FROM l2")
def write_days(spark, sf):
    """Days are written, then every seventh is written again with other prices; the rest stay as they were."""
    rows, at = l2_events(spark, sf).select(*KEYS, "sequence", "price"), folder(spark, "days")
    tables.write_days(rows, at)
    tables.write_days(rows.filter("day(date) % 7 = 0").withColumn("price", F.col("price") + 1), at)
    return tables.read_days(spark, at).select(*KEYS, "sequence", "price")


@catalog.add("list_days", f"WITH {l2_sql()} SELECT DISTINCT {DAY} FROM l2")
def list_days(spark, sf):
    at = folder(spark, "days")
    tables.write_days(l2_events(spark, sf).select(*KEYS, "sequence"), at)
    return tables.available_days(spark, at)


@catalog.add("scan_day_pattern", f"WITH {l2_sql()} SELECT sequence, price FROM l2 WHERE instrument_id = 1 AND day(date) BETWEEN 10 AND 19")
def scan_day_pattern(spark, sf):
    """Many files by one pattern over the folders of days."""
    at = folder(spark, "days")
    tables.write_days(l2_events(spark, sf).select(*KEYS, "sequence", "price"), at)
    return tables.read_days(spark, f"{at}/instrument_id=1/date=*-1[0-9]", ["sequence", "price"])


_COSTS = "SELECT o_orderpriority AS priority, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders GROUP BY ALL"


def _costs(spark, sf):
    return read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").cast("long").alias("total"))


@catalog.add("csv_result", _COSTS)
def csv_result(spark, sf):
    at = folder(spark, "results")
    tables.write_result(_costs(spark, sf).limit(1), at, "costs")
    tables.write_result(_costs(spark, sf), at, "costs")
    return tables.read_result(spark, at, "costs", "priority string, n long, total long")


@catalog.add("csv_comments", "SELECT CAST(r_regionkey AS BIGINT) AS ts_ns, r_name AS name FROM region")
def csv_comments(spark, sf):
    """A calendar file with comment lines."""
    at = folder(spark, "calendar")
    lines = read(spark, sf, "region").select(F.concat(F.lit("# next\n"), F.col("r_regionkey").cast("string"), F.lit(","), F.col("r_name")).alias("value"))
    spark.createDataFrame([("# a comment\nts_ns,name",)], "value string").unionByName(lines).coalesce(1).write.text(at)
    return tables.read_csv(spark, at, "ts_ns long, name string")


@catalog.add("csv_missing", f"WITH {l2_sql()} SELECT date, count(*) AS events, CAST(0 AS BIGINT) AS in_release FROM l2 GROUP BY date")
def csv_missing(spark, sf):
    """A calendar that is not there is an empty one: no event is near a release."""
    calendar = tables.read_csv(spark, folder(spark, "none"), "ts_ns long, name string")
    rows = quality.with_release_flag(l2_events(spark, sf), calendar, 300_000_000)
    return rows.groupBy("date").agg(F.count(F.lit(1)).alias("events"), F.count_if("in_release_window").alias("in_release"))


@catalog.add("json_records", _COSTS)
def json_records(spark, sf):
    at = folder(spark, "records")
    tables.write_records(_costs(spark, sf), at)
    return tables.read_records(spark, at, "priority string, n long, total long")


@catalog.add("upsert_table", "SELECT n_nationkey AS k, n_name AS name FROM nation")
def upsert_table(spark, sf):
    """Two overlapping parts, the second twice."""
    rows, at = read(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), folder(spark, "calendar")
    tables.upsert(rows.filter("k < 15"), at)
    tables.upsert(rows.filter("k >= 10"), at)
    return tables.upsert(rows.filter("k >= 10"), at)


@catalog.add("clear_outputs", "SELECT CAST(count(DISTINCT event_type) AS INTEGER) AS cleared, false AS left_over FROM events")
def clear_outputs(spark, sf):
    at = folder(spark, "outputs")
    read(spark, sf, "events").select("event_type", "event_id").write.partitionBy("event_type").json(f"{at}/log")
    n = tables.clear(spark, f"{at}/log/event_type=*")
    return spark.createDataFrame([(n, tables.exists(spark, f"{at}/log/event_type=*"))], "cleared int, left_over boolean")


@catalog.add("definition_check", "SELECT DISTINCT round(CAST(1 + s_suppkey % 3 AS DOUBLE) / 64, 9) AS tick_size, s_suppkey % 3 = 0 AS ok FROM supplier")
def definition_check(spark, sf):
    sizes = read(spark, sf, "supplier").select(((1 + F.col("s_suppkey") % 3) / F.lit(64.0)).alias("tick_size"))
    return quality.check_definitions(sizes, 0.015625)


@catalog.add("zip_strict", "SELECT o_orderkey, unnest([o_custkey, o_orderkey]) AS a, unnest([o_orderkey, o_custkey]) AS b FROM orders")
def strictly_zipped(spark, sf):
    rows = read(spark, sf, "orders").select("o_orderkey", F.array("o_custkey", "o_orderkey").alias("a"), F.array("o_orderkey", "o_custkey").alias("b"))
    return rows.select("o_orderkey", F.inline(zip_strict(a=F.col("a"), b=F.col("b"))))
