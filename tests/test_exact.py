"""Exact quantiles and sums, global positions, and as-of joins over parts of a key."""

from __future__ import annotations

import math
import random
import struct
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import exact, joins, positions

ODD = [0.0, -0.0, 1.5, -1.5, 5e-324, -5e-324, 1e308, -1e308, 2.0**-1066, 2.0**1000, 1e-300, 3.3, 3.3, 1 / 3, -1e16, 1.0, 1e16]


def doubles(spark, values, parts=4):
    return spark.createDataFrame([(x,) for x in values], "x double").repartition(parts)


def test_order_statistics_equal_sorting(spark):
    draw = np.random.default_rng(3)
    values = [*ODD, *draw.normal(size=2000).tolist(), *draw.integers(-3, 3, 500).astype(float).tolist(), float("inf"), float("-inf"), float("nan")]
    rows = doubles(spark, [*values, None, None]).withColumn("y", -F.col("x"))
    ordered = sorted((v + 0.0 for v in values if v == v), key=lambda v: v) + [float("nan")]
    n = len(values)
    got = exact.order_statistics(rows, {"x": [0, 1, 7, n // 2, n // 2 + 1, n - 2, n - 1], "y": [0]})
    assert all(got["x"][r] == ordered[r] or r == n - 1 and math.isnan(got["x"][r]) for r in got["x"])
    assert got["y"] == {0: float("-inf")}


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_quantiles_equal_percentile(spark, few):
    draw = random.Random(5)
    rows = spark.createDataFrame([(draw.gauss(0, 1), float(draw.randint(0, 4)), None) for _ in range(1501)], "a double, b double, none double").repartition(3)
    shares = [0.0, 0.1, 1 / 3, 0.5, 2 / 3, 0.999, 1.0]
    want = rows.agg(*(F.percentile(c, F.array(*map(F.lit, shares))).alias(c) for c in ("a", "b"))).first()
    got = exact.quantiles(rows, {"a": shares, "b": shares, "none": [0.5]}, few)
    assert got == {"a": want["a"], "b": want["b"], "none": [None]}
    assert exact.quantiles(rows.limit(0), {"a": [0.5]}, few) == {"a": [None]}


def test_sums_are_exact_and_the_same_in_any_partitioning(spark):
    draw = random.Random(8)
    groups = {g: [draw.choice(ODD + [draw.uniform(-1, 1) * 10.0 ** draw.randint(-30, 30)]) for _ in range(300)] for g in range(5)}
    rows = [(g, x, float(g)) for g, xs in groups.items() for x in xs] + [(9, None, 1.0), (10, None, float("inf")), (10, 2.0, float("-inf")), (11, float("nan"), 1.0), (12, 1e308, 1.0), (12, 1e308, 1.0)]
    bits = lambda x: None if x is None else struct.pack("<d", x)
    seen = []
    for parts in (1, 3, 8):
        draw.shuffle(rows)
        frame = spark.createDataFrame(rows, "g int, x double, y double").repartition(parts)
        seen.append({r.g: (bits(r.x), r.n_x, bits(r.y)) for r in exact.sums(frame, ("g",), ("x", "y")).collect()})
    assert seen[0] == seen[1] == seen[2]

    def nearest(xs):
        total = sum(map(Fraction, xs))
        try:
            return float(total)
        except OverflowError:
            return math.inf if total > 0 else -math.inf

    for g, xs in groups.items():
        assert seen[0][g] == (bits(nearest(xs)), 300, bits(g * 300.0))
    assert seen[0][9] == (None, 0, bits(1.0)) and seen[0][10][0] == bits(2.0)
    nan, inf = (struct.unpack("<d", seen[0][g][i])[0] for g, i in ((10, 2), (12, 0)))
    assert math.isnan(nan) and inf == math.inf and math.isnan(struct.unpack("<d", seen[0][11][0])[0])
    assert exact.sums(spark.createDataFrame([], "g int, x double"), ("g",), ("x",)).count() == 0
    assert exact.means(spark.createDataFrame([(1, 1.0), (1, 2.0), (2, None)], "g int, x double"), ("g",), ("x",)).orderBy("g").collect() == [(1, 1.5), (2, None)]


def test_positions_and_slices(spark):
    draw = random.Random(1)
    values = [draw.randint(0, 10**6) for _ in range(1000)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long").repartition(5)
    want = sorted((v, i) for i, v in enumerate(values))
    got = sorted((r.position, r.v, r.id) for r in positions.numbered(rows, "v", "id").collect())
    assert got == [(p, v, i) for p, (v, i) in enumerate(want)]
    slices = positions.Slices(rows, F.desc("v"), F.desc("id"), rows_each=130)
    whole = [(r.v, r.id) for part in slices.each() for r in part.orderBy("position").collect()]
    assert whole == want[::-1]
    assert [r.position for r in slices.take(125, 140).orderBy("position").collect()] == list(range(125, 140))
    assert slices.take(990, 2000).count() == 10 and slices.take(5, 5).count() == 0
    plan = slices.take(125, 140)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slice" in plan
    assert list(positions.Slices(rows.limit(0), "v").each()) == []
    with pytest.raises(ValueError):
        slices.take(-1, 3)


@pytest.mark.parametrize("keys", [1, 40])
def test_as_of_over_parts_of_a_key(spark, keys):
    """One key in many parts, and parts with points only, equal the join that sorts a key in one task."""
    draw = random.Random(keys)
    key = lambda: draw.choice([None, *range(keys)]) if keys > 1 else 1
    table = spark.createDataFrame([(key(), draw.randint(300, 600), i, i * 1.5) for i in range(400)], "k int, ts long, seq long, v double")
    points = spark.createDataFrame([(key(), draw.choice([draw.randint(0, 1000), draw.randint(590, 2000)]), i) for i in range(900)], "k int, at long, id long").repartition(3)
    asked = lambda join: sorted(map(repr, join(points, table, ("k",), "at", "ts", "seq", ["v", "seq"]).collect()))
    assert asked(joins.as_of_long) == asked(joins.as_of)
    assert joins.as_of_long(points, table.limit(0), ("k",), "at", "ts", "seq", ["v"]).filter("v IS NULL").count() == 900
    assert joins.as_of_long(points.limit(0), table, ("k",), "at", "ts", "seq", ["v"]).count() == 0


def test_sums_do_not_multiply_rows(spark):
    rows = spark.createDataFrame([(i % 3, x) for i, x in enumerate([0.1, -3e300, 5e-324, 1e-310, 2.0**-52, None, float("nan"), 7e22, -0.0])], "k int, x double")
    plan = exact.sums(rows, ("k",), ("x",))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # a value is one row up to the grouping
    apart = exact._taken_apart(rows.filter("NOT isnan(x)"))
    for r in apart.collect():
        whole = sum(r[f"amount{i}"] << (max(max(r.top - i, exact.LEAST // exact.WIDTH) * exact.WIDTH, exact.LEAST) - exact.LEAST) for i in range(exact.PARTS))
        assert whole / (1 << -exact.LEAST) == (r.x or 0.0)
