"""Tests of the fourth round's findings on the order-book side."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import models
from tickloom.plans import catalog
from tickloom.schema import DEFAULT, QUEUE_MODELS

SF = "/root/testdata/sf0.001"


def test_cost_models_have_all_rounds(spark, monkeypatch):
    asked, boosted = [], models.boosted_cost

    def one_round(names, rounds):
        asked.append(rounds)
        return boosted(names, rounds=1)

    monkeypatch.setattr(models, "boosted_cost", one_round)
    out = catalog.QUERIES["cost_model"](spark, SF)
    assert set(asked) == {DEFAULT.cost_rounds} and len(asked) % len(QUEUE_MODELS) == 0  # 10 before
    assert out.groupBy("queue_model").count().count() == len(QUEUE_MODELS) and out.filter("prediction IS NULL").isEmpty()


CFG = DEFAULT.override(min_train_days=2, test_block_days=2, boost_rounds=2, boost_least_rows=10, hac_lags=3)
NAMES = ("imbalance", "microprice", "ofi_ev50")


@pytest.fixture(scope="module")
def walked(spark):
    """Seven days with release windows, in which up and down are the other way round, and a test row without a feature."""
    draw, rows = random.Random(3), []
    for day in range(1, 8):
        for i in range(120):
            x, release = draw.uniform(-1, 1), i % 3 == 0
            up = (draw.random() < 0.5 + x / 2) != release
            rows.append((f"2024-03-{day:02d}", i, day * 1000 + i, x, None if i == 1 else draw.gauss(0, 1), float(draw.randint(-9, 9)), float(up), release))
    frame = spark.createDataFrame(rows, "date string, sequence long, ts_event long, imbalance double, microprice double, ofi_ev50 double, y double, in_release_window boolean")
    frame = frame.withColumn("date", F.to_date("date"))
    out = models.walk_forward(frame, models.folds(frame, CFG), NAMES, CFG, in_sample=True)
    return out, models.evaluate(out, CFG).collect(), out.toPandas()


def test_walk_forward_has_every_step(walked):
    out, found, rows = walked
    assert {r.sample for r in found} == {"fold", "out_of_sample", "release_windows_oos", "in_sample", "loss_test"}
    test, train = rows[rows.role == "test"], rows[rows.role == "train"]
    assert not train.in_release_window.any() and len(test) == 4 * 120  # releases are tested on, not learnt from
    lacking = test[test.microprice.isna()]
    assert len(lacking) == 4 and (lacking[["p_lookup", "p_logistic", "p_trees"]] == 0.5).all(axis=None)
    assert (test.raw_lookup != test.p_lookup).any()  # the lookup is calibrated like the others


def test_walk_forward_figures_against_brute_force(walked):
    _, found, rows = walked
    clip = lambda p: np.clip(p.to_numpy(), 1e-6, 1 - 1e-6)
    loss = lambda d, m: -(d.y * np.log(clip(d[f"p_{m}"])) + (1 - d.y) * np.log(1 - clip(d[f"p_{m}"])))
    own = {(r.sample, r.fold, r.model, r.vs): r for r in found}
    test = rows[rows.role == "test"].sort_values("ts_event")
    parts = {("out_of_sample", None): test[~test.in_release_window], ("release_windows_oos", None): test[test.in_release_window], ("fold", 1): test[~test.in_release_window & (test.fold == 1)]}
    for m in ("lookup", "logistic", "trees"):
        for (sample, fold), d in parts.items():
            r, p = own[sample, fold, m, None], clip(d[f"p_{m}"])
            up, down = p[d.y == 1], p[d.y == 0]
            auc = np.mean((up[:, None] > down) + 0.5 * (up[:, None] == down))
            assert (r.n, r.log_loss, r.brier, r.auc, r.accuracy) == pytest.approx((len(d), loss(d, m).mean(), ((p - d.y) ** 2).mean(), auc, ((p > 0.5) == (d.y > 0.5)).mean()))
        folds = [d for _, d in rows[rows.role == "train"].groupby("fold")]
        assert (own["in_sample", None, m, None].n, own["in_sample", None, m, None].log_loss) == pytest.approx((np.mean([len(d) for d in folds]), np.mean([loss(d, m).mean() for d in folds])))
    normal = parts["out_of_sample", None]
    for a, b in models.TESTED:
        diff = (loss(normal, a) - loss(normal, b)).to_numpy()
        e, r = diff - diff.mean(), own["loss_test", None, a, b]
        g = e @ e + sum(2 * (1 - k / (CFG.hac_lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, CFG.hac_lags + 1))
        assert (r.mean_loss_diff, r.hac_se, r.hac_t) == pytest.approx((diff.mean(), np.sqrt(g) / len(e), diff.mean() * len(e) / np.sqrt(g)), rel=1e-5, abs=1e-8)
