"""Leaf-wise boosted trees against a plain implementation that looks at every row for every split."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import leafwise

NAMES = ("a", "b", "c")


def table(n=400, seed=2):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = draw.gauss(0, 1), float(draw.randint(-3, 3)), draw.random()
        rows.append((i, a, b, c, float(draw.random() < 1 / (1 + math.exp(-(2 * a * (b > 0) - b * c))))))
    return rows


def plain(rows, edges, how):
    """Margins after all trees: leaves hold row numbers, every cut of every leaf is tried."""
    bins = leafwise.binned([np.array([r[1 + i] for r in rows]) for i in range(3)], edges)
    y = np.array([r[4] for r in rows])
    margin = np.full(len(rows), math.log(y.mean() / (1 - y.mean())))
    keys = np.array([r[5] for r in rows], dtype=np.int64)
    for number in range(how.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        used = leafwise.sampled(keys, number, how.row_share, how.seed)
        allowed = leafwise.columns_of(3, number, how.column_share, how.seed)
        leaves = [np.ones(len(rows), dtype=bool)]

        def gain_of(mask, used=used, g=g, h=h, allowed=allowed):
            best = (0.0, None)
            score = lambda m: g[m & used].sum() ** 2 / (h[m & used].sum() + how.l2)
            for f in allowed:
                for cut in range(len(edges[f])):
                    left, right = mask & (bins[:, f] <= cut), mask & (bins[:, f] > cut)
                    if min((left & used).sum(), (right & used).sum()) >= how.least_rows and min(h[left & used].sum(), h[right & used].sum()) >= how.least_hessian:
                        gain = score(left) + score(right) - score(mask)
                        if gain > best[0] + 1e-9 * max(1.0, best[0]):
                            best = (gain, (left, right))
            return best

        while len(leaves) < how.leaves:
            found = [gain_of(m) for m in leaves]
            at = max(range(len(leaves)), key=lambda i: found[i][0])
            if found[at][0] <= 0:
                break
            leaves[at : at + 1] = found[at][1]
        for m in leaves:
            margin[m] += -how.rate * g[m & used].sum() / (h[m & used].sum() + how.l2)
    return margin


@pytest.mark.parametrize("how", [leafwise.Growth(rounds=3, leaves=6, rate=0.3, least_rows=10, row_share=1.0, column_share=1.0, bins=16), leafwise.Growth(rounds=10, leaves=4, rate=0.2, least_rows=15, row_share=0.7, column_share=0.6, bins=32, l2=3.0)])
def test_trees_equal_a_plain_implementation(spark, how):
    rows = table()
    frame = spark.createDataFrame(rows, "id long, a double, b double, c double, y double").repartition(3)
    model = leafwise.fit(frame.unionByName(frame.limit(3).withColumn("y", F.lit(None).cast("double"))), NAMES, ("id",), how=how)
    keyed = [(*r[:5], k) for r, k in zip(rows, [x[0] for x in frame.orderBy("id").select(F.xxhash64("id")).collect()], strict=True)]
    want = 1 / (1 + np.exp(-plain(keyed, model.edges, how)))
    got = [r.p for r in model.predict(frame, "p").orderBy("id").collect()]
    assert np.abs(np.array(got) - want).max() < 1e-9
    assert max(t.feature.count(-1) for t in model.trees) == how.leaves
    again = leafwise.Leafwise.from_json(model.to_json())
    assert [r.p for r in again.predict(frame, "p").orderBy("id").collect()] == got


def test_it_learns_and_scores_missing_values(spark):
    frame = spark.createDataFrame(table(600, 5), "id long, a double, b double, c double, y double")
    model = leafwise.fit(frame.filter("id < 400"), NAMES, ("id",), how=leafwise.Growth(rounds=12, leaves=8, rate=0.2, least_rows=10))
    loss = lambda p: -np.mean([math.log(q if r.y else 1 - q) for r, q in p])
    held = model.predict(frame.filter("id >= 400"), "p").collect()
    share = sum(r.y for r in held) / len(held)
    assert loss([(r, r.p) for r in held]) < loss([(r, share) for r in held]) - 0.05
    odd = spark.createDataFrame([(None, 1.0, 1.0), (float("nan"), 1.0, 1.0)], "a double, b double, c double")
    assert [r.p for r in model.predict(odd, "p").collect()] == [0.5, 0.5]
    with pytest.raises(ValueError, match="both labels"):
        leafwise.fit(frame.filter("y = 1"), NAMES, ("id",))


def test_a_row_costs_a_few_array_steps():
    """Rows of bins are read from their buffer, also from the middle of a column, and sums equal those by plain loops."""
    draw = np.random.default_rng(6)
    bins = draw.integers(0, 16, (500, 3)).astype(np.uint8)
    column = leafwise.packed(bins)
    assert [x.as_py() for x in column] == [x.tobytes() for x in bins]
    assert (leafwise.unpacked(column.slice(7, 90), 3) == bins[7:97]).all() and leafwise.unpacked(column.slice(0, 0), 3).shape == (0, 3)
    tree = leafwise.Tree()
    for node, feature, cut in ((0, 0, 7), (2, 1, 3), (1, 2, 11), (4, 0, 12)):
        tree.split(node, feature, cut)

    def plain(row):
        at = 0
        while tree.feature[at] >= 0:
            at = tree.left[at] + int(row[tree.feature[at]] > tree.cut[at])
        return at

    leaf = tree.leaf_of(bins)
    assert leaf.tolist() == [plain(x) for x in bins]
    total, weight, slot = np.zeros((2, 3, 16, 2)), draw.random(500), leaf % 2
    leafwise.added(total, bins, slot, (weight, np.ones(500)))
    want = np.zeros_like(total)
    for s, row, w in zip(slot, bins, weight, strict=True):
        for f in range(3):
            want[s, f, row[f]] += (w, 1)
    assert (total == want).all()
