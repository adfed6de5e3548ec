"""Exact order statistics and exact sums of columns of any length.

Quantiles are found by selection: values are counted by their leading bits, the
stretch that holds the wanted rank is kept, and the next bits are counted, so
no task ever holds a column. Sums are kept as integers by ranges of exponents:
integers add up to the same whatever their order, and only the last step rounds.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.sources.scratch import stored

#: Bits counted at once, and values so few that one task sorts them.
DIGIT, FEW = 16, 1 << 16
#: Bits of a double that one integer of a sum holds, and the exponent of the least double.
WIDTH, LEAST = 26, -1074
#: Integers that hold all bits of a double.
PARTS = 4


# --------------------------------------------------------------- quantiles


def sortable(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers in the same order; zeros have no sign, and NaN is above all."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(bits & top, ~bits, bits | top)


def _value(bits: int) -> float:
    plain = bits & ~(1 << 63) if bits >> 63 else ~bits & ((1 << 64) - 1)
    return float(np.array([plain], dtype=np.uint64).view(np.float64)[0])


def _counts(rows: DataFrame, wanted: list[tuple[int, int]], depth: int) -> DataFrame:
    """``asked`` (place in ``wanted``, of column and prefix), ``digit`` and ``n``: how many values of a column go on with a digit behind ``depth`` leading bits."""
    mask, shift = np.uint64((1 << DIGIT) - 1), np.uint64(64 - depth - DIGIT)
    columns = {c: np.array(sorted(p for own, p in wanted if own == c), dtype=np.uint64) for c, _ in wanted}
    number = {x: i for i, x in enumerate(wanted)}
    place = {c: np.array([number[c, int(p)] for p in prefixes], dtype=np.int64) for c, prefixes in columns.items()}

    def count(batches):
        for batch in batches:
            codes = []
            for c, prefixes in columns.items():
                keys = sortable(batch.column(c).drop_null().to_numpy())
                at = np.zeros(len(keys), dtype=np.int64)
                if depth:
                    own = keys >> np.uint64(64 - depth)
                    at = np.minimum(np.searchsorted(prefixes, own), len(prefixes) - 1)
                    keys, at = keys[prefixes[at] == own], at[prefixes[at] == own]
                codes.append((place[c][at] << DIGIT) | ((keys >> shift) & mask).astype(np.int64))
            found, n = np.unique(np.concatenate(codes), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found >> DIGIT), pa.array(found & int(mask)), pa.array(n)], ["asked", "digit", "n"])

    return rows.mapInArrow(count, "asked long, digit long, n long").groupBy("asked", "digit").agg(F.sum("n").alias("n"))


def order_statistics(rows: DataFrame, ranks: dict[str, list[int]]) -> dict[str, dict[int, float]]:
    """The values at ``ranks`` (from 0) among the non-null doubles of each column of ``rows``; ranks beyond the end are an error.

    What goes to and from the driver is a few numbers a rank.
    """
    names = list(ranks)
    rows = rows.select(*names)
    wanted = {(i, 0): {r: r for r in ranks[c]} for i, c in enumerate(names)}  # what is left of each rank within its prefix
    for depth in range(0, 64, DIGIT):
        asked = list(wanted)
        before = F.sum("n").over(Window.partitionBy("asked").orderBy("digit")) - F.col("n")  # at most 2^16 rows a prefix
        found = _counts(rows, asked, depth).withColumn("before", before)
        rests = rows.sparkSession.createDataFrame([(i, r) for i, own in enumerate(asked) for r in sorted(set(wanted[own].values()))], "asked long, rest long")
        holds = (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n"))
        hits = {(h.asked, h.rest): h for h in found.join(F.broadcast(rests), "asked").filter(holds).collect()}
        following = {}
        for i, (c, p) in enumerate(asked):
            for rank, rest in wanted[c, p].items():
                hit = hits[i, rest]
                following.setdefault((c, p << DIGIT | hit.digit), {})[rank] = rest - hit.before
        wanted = following
    return {name: {rank: _value(p) for (c, p), left in wanted.items() if c == i for rank in left} for i, name in enumerate(names)}


def quantiles(rows: DataFrame, shares: dict[str, list[float]], few: int = FEW) -> dict[str, list[float | None]]:
    """Interpolated quantiles of each column, as ``percentile`` gives them; nulls do not count, an empty column gives nulls.

    The columns are written once and counted four times. Where all rows are
    ``few``, one task sorts them instead, with the same result.
    """
    rows = stored(rows.select(*(F.col(c).cast("double").alias(c) for c in shares)), "columns")
    counts = rows.agg(*(F.count(c).alias(c) for c in shares), F.count(F.lit(1)).alias("__all")).first()
    if counts["__all"] <= few:
        found = rows.agg(*(F.percentile(c, F.array(*map(F.lit, at))).alias(c) for c, at in shares.items())).first()
        return {c: found[c] or [None] * len(at) for c, at in shares.items()}
    places = {c: [p * (counts[c] - 1) for p in at] for c, at in shares.items() if counts[c]}
    at = order_statistics(rows, {c: sorted({r for p in own for r in (math.floor(p), math.ceil(p))}) for c, own in places.items()})

    def between(c, p):
        low, high = math.floor(p), math.ceil(p)
        a, b = at[c][low], at[c][high]
        return a if a == b or low == high else (high - p) * a + (p - low) * b

    return {c: [between(c, p) for p in places[c]] if c in places else [None] * len(shares[c]) for c in shares}


# --------------------------------------------------------------------- sums


def _taken_apart(rows: DataFrame) -> DataFrame:
    """``rows`` with the double ``x`` as integers ``amount0`` to ``amount3`` of ``WIDTH`` bits, which hold all its bits, and ``top``, the range of exponents that the first counts.

    One column after the other, so that none is worked out again for those that follow.
    """
    x, lowest = F.col("x"), LEAST // WIDTH
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.withColumn("rest", F.when(finite, x).otherwise(0.0))
    rows = rows.withColumn("top", F.coalesce(F.greatest(F.floor(F.log2(F.abs("rest")) / WIDTH).cast("int"), F.lit(lowest)), F.lit(lowest)))
    for i in range(PARTS):
        rows = rows.withColumn("unit", F.pow(F.lit(2.0), F.greatest(_part(i) * WIDTH, F.lit(LEAST)).cast("double")))
        rows = rows.withColumn(f"amount{i}", (F.col("rest") / F.col("unit")).cast("long"))  # towards zero
        rows = rows.withColumn("rest", F.col("rest") - F.col(f"amount{i}").cast("double") * F.col("unit"))
    return rows.drop("rest", "unit")


def _part(i: int) -> Column:
    return F.greatest(F.col("top") - i, F.lit(LEAST // WIDTH))


def _rounded(totals: pd.Series) -> pd.Series:
    """The doubles nearest to sums that are given by their integers."""

    def one(parts) -> float:
        whole = sum(int(p["total"]) << (max(p["part"] * WIDTH, LEAST) - LEAST) for p in parts)
        try:
            return whole / (1 << -LEAST)
        except OverflowError:
            return math.inf if whole > 0 else -math.inf

    return totals.map(one)


def sums(rows: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """Exactly rounded sums of double columns for each group, with ``n_<column>``: the same to the last bit in any order and partitioning.

    Nulls do not count, and a group without values has a null sum; NaN and
    infinities give what they give in any sum. A group may have 2^34 rows.
    """
    each = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns))
    long = rows.select(*keys, F.inline(each)) if len(columns) > 1 else rows.select(*keys, F.lit(columns[0]).alias("name"), F.col(columns[0]).cast("double").alias("x"))
    x = F.col("x")
    odd = F.when(F.isnan(x) | (F.abs(x) == float("inf")), x)
    # A row a value: its integers are added up side by side, and become rows once there is one a group and range.
    by_top = _taken_apart(long).groupBy(*keys, "name", "top").agg(F.count(x).alias("n"), F.sum(odd).alias("odd"), *(F.sum(f"amount{i}").alias(f"total{i}") for i in range(PARTS)))
    parts = F.array(*(F.struct(_part(i).alias("part"), F.col(f"total{i}").alias("total")) for i in range(PARTS)))
    made = by_top.groupBy(*keys, "name").agg(F.flatten(F.collect_list(parts)).alias("parts"), F.sum("n").alias("n"), F.sum("odd").alias("odd"))
    rounded = F.pandas_udf(_rounded, "double")
    made = made.withColumn("value", F.when(F.col("n") > 0, F.coalesce("odd", rounded("parts"))))
    one = lambda c, name: F.max(F.when(F.col("name") == c, F.col(name)))
    return made.groupBy(*keys).agg(*(a for c in columns for a in (one(c, "value").alias(c), one(c, "n").alias(f"n_{c}"))))


def means(rows: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """Averages from :func:`sums`, each rounded twice: the sum and the quotient."""
    found = sums(rows, keys, columns)
    return found.select(*keys, *(F.when(F.col(f"n_{c}") > 0, F.col(c) / F.col(f"n_{c}")).alias(c) for c in columns))
