"""The store of fitted models: versions, broken-off runs, and predictions from disk in another session."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import models
from tickloom.operators.store import ModelStore
from tickloom.schema import DEFAULT

NAMES = ("imbalance", "microprice", "ofi_ev50", "spread")
CFG = DEFAULT.override(min_train_days=2, test_block_days=2, boost_rounds=3, boost_least_rows=10)


@pytest.fixture(scope="module")
def learnt(spark):
    draw = random.Random(3)
    rows = []
    for day in range(1, 8):
        for i in range(80):
            x = draw.uniform(-1, 1)
            rows.append((f"2024-03-{day:02d}", i, x, draw.gauss(0, 1), float(draw.randint(-9, 9)), 1.0, float(draw.random() < 0.5 + x / 3)))
    frame = spark.createDataFrame(rows, "date string, sequence long, imbalance double, microprice double, ofi_ev50 double, spread double, y double")
    return frame.withColumn("date", F.to_date("date"))


def values(df):
    return sorted((str(r.date), r.sequence, r.fold, r.p_lookup, r.p_logistic, r.p_trees) for r in df.collect())


def test_models_predict_the_same_from_disk(spark, learnt, tmp_path):
    made = models.folds(learnt, CFG)
    store = ModelStore(spark, str(tmp_path / "models"))
    assert store.versions() == []
    out = values(models.walk_forward(learnt, made, NAMES, CFG, store))
    assert store.versions() == [1] and {x[2] for x in out} == {0, 1}
    elsewhere = ModelStore(spark.newSession(), str(tmp_path / "models"))
    bundle = elsewhere.load()
    assert values(bundle.score(learnt, made)) == out
    assert bundle.fold(1).features == {"logistic": models.LOGISTIC, "trees": NAMES} and bundle.thetas is None
    with pytest.raises(KeyError):
        bundle.fold(7)


def test_versions_are_whole_or_not_there(spark, learnt, tmp_path):
    days = learnt.filter("date <= '2024-03-03'")
    fold = models.fit_fold(days, days, NAMES, 0, CFG)
    store = ModelStore(spark, str(tmp_path / "models"))
    thetas = spark.createDataFrame([("exact", 0, 5, 0.6)], "queue_model string, latency_ms int, deadline_s int, theta double")
    assert store.save([fold], thetas) == 1
    assert store._create("claims/2", "") and not store._create("claims/2", "")  # another writer that broke off
    (tmp_path / "models" / "version=2").mkdir()
    assert store.versions() == [1]
    assert store.save([fold]) == 3 and store.versions() == [1, 3]
    assert store.load(1).thetas.collect() == thetas.collect() and store.load().version == 3
    for missing in (2, 9):
        with pytest.raises(KeyError):
            store.load(missing)
    with pytest.raises(ValueError):
        store.save([])
