"""Sums over ordered series of any length, spread over partitions.

Rows are range-partitioned by series and order, each partition is worked on by
array operations, and what partitions say about each other (a few numbers for
each series in each) is put together behind them. Callers hand in stored
tables, for rows are read twice: once for the ranges, once for the sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows about parts that are sent at once.
TOGETHER = 1024


def changes(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before; nulls equal each other."""
    a, b = column[1:], column[:-1]
    other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return other | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))


def first_rows(columns: list[pa.Array], size: int) -> np.ndarray:
    """Which rows of a batch begin a run of equal keys."""
    first = np.zeros(size, dtype=bool)
    first[:1] = True
    for column in columns:
        first[1:] |= changes(column)
    return first


def _series(batches, width: int):
    """(number of the run in this partition, its key as arrays of one, values) of whole runs; the first ``width`` columns are the key."""
    held, key, number = [], None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns, values = batch.columns[:width], np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[width:]])
        starts = np.flatnonzero(first_rows(columns, batch.num_rows))
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            own = [c.slice(a, 1) for c in columns]
            if held and any(x[0].as_py() != y[0].as_py() for x, y in zip(own, key, strict=True)):
                yield number, key, np.concatenate(held)
                held, number = [], number + 1
            key = own
            held.append(values[a:b])
    if held:
        yield number, key, np.concatenate(held)


def _spread(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], values: list[str]) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return rows.select(*keys, *order, *values).repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).select(*keys, *values)


def _part_number(number: int) -> int:
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 32) + number


def _fields(rows: DataFrame, keys: tuple[str, ...]) -> str:
    return "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)


def _together(rows, schema: pa.Schema):
    """Rows (key as arrays of one, further values) in batches of ``TOGETHER``."""

    def batch(held):
        keys = [pa.concat_arrays([key[i] for key, _ in held]) for i in range(len(held[0][0]))]
        width = len(keys)
        return pa.RecordBatch.from_arrays([*keys, *(pa.array([rest[i] for _, rest in held], type=schema.field(width + i).type) for i in range(len(held[0][1])))], schema.names)

    held = []
    for row in rows:
        held.append(row)
        if len(held) == TOGETHER:
            yield batch(held)
            held = []
    if held:
        yield batch(held)


def _arrow(schema: str) -> pa.Schema:
    """Of a schema in Spark's words; on the driver only."""
    return to_arrow_schema(T.StructType.fromDDL(schema))


def lagged_products(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], value: str, weights: np.ndarray) -> DataFrame:
    """Sum over ``k`` of ``weights[k]`` times the sum of products of ``value`` with the one ``k`` rows before (``g``), for each series."""
    lags, width = len(weights) - 1, len(keys)
    fields = _fields(rows, keys)
    of_parts, of_series = f"{fields}part long, g double, head array<double>, tail array<double>", f"{fields}g double"
    part_arrow, series_arrow = _arrow(of_parts), _arrow(of_series)

    def part(batches):
        def rows_of():
            for number, key, x in _series(batches, width):
                x = x[:, 0]
                g = float(sum(w * (x[k:] @ x[: len(x) - k]) for k, w in enumerate(weights) if k < len(x)))
                yield key, (_part_number(number), g, x[:lags], x[max(0, len(x) - lags) :])

        return _together(rows_of(), part_arrow)

    def across(before: np.ndarray, head: np.ndarray) -> float:
        """Products of a part's first values with the last ones before it."""
        total = 0.0
        for k in range(1, lags + 1):
            i = np.arange(max(0, len(before) - k), min(len(before), len(before) - k + len(head)))
            total += weights[k] * float(before[i] @ head[i + k - len(before)])
        return total

    def stitch(batches):
        def rows_of():
            key = total = before = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                first = first_rows(batch.columns[:width], batch.num_rows)
                for i, (g, head, tail) in enumerate(zip(*(c.to_pylist() for c in batch.columns[width + 1 :]), strict=True)):
                    own = [c.slice(i, 1) for c in batch.columns[:width]]
                    if key is None or (first[i] and any(a[0].as_py() != b[0].as_py() for a, b in zip(own, key, strict=True))):
                        if key is not None:
                            yield key, (total,)
                        key, total, before = own, 0.0, np.zeros(0)
                    head, tail = np.array(head), np.array(tail)
                    total += g + (across(before, head) if len(before) else 0.0)
                    before = np.r_[before, tail][-lags:] if lags else before
            if key is not None:
                yield key, (total,)

        return _together(rows_of(), series_arrow)

    parts = _spread(rows, keys, order, [value]).mapInArrow(part, of_parts)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    together = parts.repartition(n, *keys) if keys else parts.coalesce(1)  # a row for each part of a series
    return together.sortWithinPartitions(*keys, "part").mapInArrow(stitch, of_series)


def wins_below(tally: DataFrame, keys: tuple[str, ...], p: str) -> DataFrame:
    """For each series the sum of ``pos`` times the ``neg`` below it and half of its own (``w``); ``p`` is distinct within a series."""
    width = len(keys)
    schema = f"{_fields(tally, keys)}part long, w double, pos double, neg double"
    arrow = _arrow(schema)

    def part(batches):
        def rows_of():
            for number, key, x in _series(batches, width):
                pos, neg = x.T
                yield key, (_part_number(number), float(pos @ (np.cumsum(neg) - neg / 2)), float(pos.sum()), float(neg.sum()))

        return _together(rows_of(), arrow)

    parts = _spread(tally, keys, (p,), ["pos", "neg"]).mapInArrow(part, schema)
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return parts.withColumn("w", F.col("w") + F.col("pos") * below).groupBy(*keys).agg(F.sum("w").alias("w"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
