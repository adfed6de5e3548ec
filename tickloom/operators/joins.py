"""As-of and interval joins as unions, windows and bucketed equi-joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.ordered import first_rows
from tickloom.sources.scratch import stored


def as_of(points: DataFrame, table: DataFrame, keys: tuple[str, ...], at: str, ts: str, order: str, columns: list[str]) -> DataFrame:
    """``points`` with the ``columns`` of the last row of ``table`` at or before ``at``.

    The tables are united and sorted once by key and time: rows of ``table``
    stand before points of the same time, and the last of them is carried on.
    Points before the first row get nulls; points after the last get the last.
    """
    carried = F.struct(*columns)
    left = table.select(*keys, F.col(ts).alias("__t"), F.lit(0).alias("__kind"), F.col(order).alias("__o"), carried.alias("__row"), F.lit(None).cast(points.select(F.struct("*")).schema[0].dataType).alias("__point"))
    right = points.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__kind"), F.lit(0).cast(table.schema[order].dataType).alias("__o"), F.lit(None).cast(table.select(carried).schema[0].dataType).alias("__row"), F.struct("*").alias("__point"))
    w = Window.partitionBy(*keys).orderBy("__t", "__kind", "__o").rowsBetween(Window.unboundedPreceding, 0)
    rows = left.unionByName(right).withColumn("__found", F.last("__row", ignorenulls=True).over(w)).filter("__kind = 1")
    return rows.select("__point.*", *(F.col(f"__found.{c}").alias(c) for c in columns))


def as_of_long(points: DataFrame, table: DataFrame, keys: tuple[str, ...], at: str, ts: str, order: str, columns: list[str]) -> DataFrame:
    """:func:`as_of` for keys with more rows than one task should sort: the same rows.

    Both tables are divided by ranges of key and time. A part carries the last
    row on as it streams by, and says which row it ends with; points that stand
    in their part before any row of their key get what earlier parts end with.
    """
    spark = points.sparkSession
    row_type = table.select(F.struct(*columns).alias("r")).schema[0].dataType
    point_type = points.select(F.struct("*").alias("p")).schema[0].dataType
    left = table.select(*keys, F.col(ts).alias("__t"), F.lit(0).alias("__kind"), F.col(order).alias("__o"), F.struct(*columns).alias("__row"), F.lit(None).cast(point_type).alias("__point"))
    right = points.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__kind"), F.lit(None).cast(table.schema[order].dataType).alias("__o"), F.lit(None).cast(row_type).alias("__row"), F.struct("*").alias("__point"))
    by = [*keys, "__t", "__kind", "__o"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    sorted_rows = left.unionByName(right).repartitionByRange(n, *by).sortWithinPartitions(*by)
    fields = [T.StructField(k, left.schema[k].dataType) for k in keys]
    schema = T.StructType([*fields, T.StructField("part", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("found", row_type), T.StructField("point", point_type)])
    width = len(keys)

    def carry(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = None  # the last batch's end: its key, and its last row in an array of one or none
        opening = True  # the part's first key, the only one that earlier parts may have
        out = lambda names, kind, found, point: pa.RecordBatch.from_arrays([*names, pa.array(np.full(len(kind), part, dtype=np.int32)), pa.array(kind.astype(np.int32)), found, point], [*keys, "part", "kind", "found", "point"])
        for batch in batches:
            if not batch.num_rows:
                continue
            names, kind, rows, asked = batch.columns[:width], batch.column(width).to_numpy(), batch.column(width + 1), batch.column(width + 2)
            size = batch.num_rows
            first = first_rows(names, size)
            same = held is not None and all(c[0].as_py() == k for c, k in zip(names, held[0], strict=True))
            opening &= held is None or same
            source = pa.concat_arrays([held[1], rows]) if same and len(held[1]) else rows
            ahead = len(source) - size
            run = np.maximum.accumulate(np.where(first, np.arange(size), 0))
            last = np.maximum.accumulate(np.where(kind == 0, np.arange(size), -1))
            place = np.where(last >= run, last + ahead, np.where((run == 0) & bool(ahead), ahead - 1, -1))
            own = np.flatnonzero(kind == 1)
            index = pa.array(place[own], mask=place[own] < 0)
            # Kind 2 may still be carried in.
            yield out([c.take(pa.array(own)) for c in names], np.where((place[own] < 0) & (run[own] == 0) & opening, 2, 1), source.take(index), asked.take(pa.array(own)))
            opening &= not first[1:].any()
            final = place[-1]
            tail = source.slice(final, 1) if final >= 0 else source.slice(0, 0)
            end = out([c.slice(size - 1, 1) for c in names], np.array([0]), tail if len(tail) else pa.nulls(1, rows.type), pa.nulls(1, asked.type))
            held = (tuple(c[-1].as_py() for c in names), tail, end)
        if held is not None:
            yield held[2]

    made = stored(sorted_rows.select(*keys, "__kind", "__row", "__point").mapInArrow(carry, schema), "as-of")
    # A row a part: what its last key ends with, and its first key.
    ends = made.filter("kind = 0 AND found IS NOT NULL").select(*keys, "part", "found")
    edge = made.filter("kind = 2").select(*keys, "part").distinct()
    before = Window.partitionBy(*keys).orderBy("part", "__asks").rowsBetween(Window.unboundedPreceding, 0)
    both = ends.withColumn("__asks", F.lit(1)).unionByName(edge.withColumn("__asks", F.lit(0)).withColumn("found", F.lit(None).cast(row_type)))
    carried = both.withColumn("__in", F.last("found", ignorenulls=True).over(before)).filter("__asks = 0").select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("part").alias("__part"), "__in")
    pending = made.filter("kind = 2").join(carried, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("part") == F.col("__part")], "left")
    out = made.filter("kind = 1").select("point", "found").unionByName(pending.select("point", F.col("__in").alias("found")))
    return out.select("point.*", *(F.col(f"found.{c}").alias(c) for c in columns))


def in_interval(points: DataFrame, table: DataFrame, keys: list[str], start: str, stop: str, ts: str, width: int) -> DataFrame:
    """Pairs of a point and a row of ``table`` with ``start < ts <= stop``.

    Time is cut into buckets of ``width``; a point meets the buckets its
    interval touches by equality, so no task sees all pairs of a key.
    """
    left = points.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width))))
    right = table.withColumn("__bucket", F.floor(F.col(ts) / width))
    return left.join(right, [*keys, "__bucket"]).filter((F.col(ts) > F.col(start)) & (F.col(ts) <= F.col(stop))).drop("__bucket")
