"""What savings tables read, and how often."""

from __future__ import annotations

from tickloom.operators import stats
from tickloom.plans import catalog

SMALL = "/root/testdata/sf0.001"


def test_savings_pair_the_log_once(spark, monkeypatch):
    """The statistics start from one written table of paired rows: none of them pivots the log again."""
    kept, real = [], stats.stored
    monkeypatch.setattr(stats, "stored", lambda df, label: (kept.append(label), real(df, label))[1])
    out = catalog.QUERIES["savings_table"](spark, SMALL)
    assert kept.count("wide") == 1
    assert "orders.parquet" not in out._jdf.queryExecution().optimizedPlan().toString() and not any("/orders.parquet" in f for f in out.inputFiles())


def test_robustness_needs_intervals_only(spark, monkeypatch):
    expected = sorted(map(tuple, stats_by_table(spark)))
    monkeypatch.setattr(stats, "hac_t", None)
    assert sorted(map(tuple, catalog.QUERIES["robustness_counts"](spark, SMALL).collect())) == expected


def stats_by_table(spark):
    table = catalog.QUERIES["savings_table"](spark, SMALL)
    return table.groupBy("strategy", "vs").agg({"*": "count"}).join(
        table.selectExpr("strategy", "vs", "int(ci95_lo > 0) AS b", "int(ci95_hi < 0) AS w").groupBy("strategy", "vs").agg({"b": "sum", "w": "sum"}), ["strategy", "vs"]
    ).selectExpr("strategy", "vs", "`count(1)`", "`sum(b)`", "`sum(w)`").collect()
