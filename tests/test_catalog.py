"""Every query against its oracle at the smallest size, and the driver's contract."""

from __future__ import annotations

import functools
import math

import duckdb
import pytest

from tickloom.plans import catalog, model_plans, sim_plans

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module", autouse=True)
def shared():
    """What many queries derive from the same tables is derived once here: every query still runs on it."""
    kept = {(m, n): getattr(m, n) for m, names in ((sim_plans, ("books", "sim", "checkpoints", "full_log")), (model_plans, ("modelled",))) for n in names}
    for (m, n), plan in kept.items():
        setattr(m, n, functools.cache(plan))
    yield
    for (m, n), plan in kept.items():
        setattr(m, n, plan)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_oracle(spark, oracle, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    cursor = oracle.execute(catalog.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    want = sorted(repr([plain(r[columns.index(c)]) for c in names]) for r in cursor.fetchall())
    assert sorted(repr([plain(r[c]) for c in names]) for r in df.collect()) == want


def test_entry_points(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 1000


def test_the_library_does_not_need_the_corpus_operators():
    import pathlib

    for path in pathlib.Path(catalog.__file__).parents[1].rglob("*.py"):
        if "llm" not in path.parts:
            assert "tickloom.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
