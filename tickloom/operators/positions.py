"""Global row numbers without one sorted partition, and slices by them."""

from __future__ import annotations

import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.sources.scratch import scratch_root, stored

_IN_PART = (1 << 33) - 1


def numbered(rows: DataFrame, *order: str | Column, name: str = "position") -> DataFrame:
    """``rows`` with their place (from 0) in ``order``, which should have no ties.

    Ranges of the order are sorted apart and written; how many rows each has,
    one number a range, gives the first place of the next.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    placed = stored(placed, "numbered").withColumn("__part", F.shiftright("__place", 33))
    sizes = sorted((r[0], r[1]) for r in placed.groupBy("__part").count().collect())  # one row a range
    starts = spark.createDataFrame(list(zip((p for p, _ in sizes), accumulate((c for _, c in sizes), initial=0), strict=False)), "__part long, __before long")
    out = placed.join(F.broadcast(starts), "__part").withColumn(name, F.col("__before") + F.col("__place").bitwiseAND(F.lit(_IN_PART)))
    return out.drop("__part", "__before", "__place")


class Slices:
    """A numbered table in folders of ``rows_each`` rows, so that a slice reads only the folders that it touches."""

    def __init__(self, rows: DataFrame, *order: str | Column, rows_each: int = 20_000):
        self.spark, self.rows_each = rows.sparkSession, rows_each
        self.path = f"{scratch_root(self.spark).rstrip('/')}/tickloom-slices-{uuid.uuid4().hex}"
        table = numbered(rows, *order).withColumn("slice", F.floor(F.col("position") / rows_each).cast("long"))
        self._schema = table.schema
        table.hint("rebalance", "slice").write.partitionBy("slice").parquet(self.path)
        self.count = self.table().agg(F.max("position")).first()[0]
        self.count = 0 if self.count is None else self.count + 1

    def table(self) -> DataFrame:
        return self.spark.read.schema(self._schema).parquet(self.path)

    def take(self, start: int, stop: int) -> DataFrame:
        """Rows at places [start, stop), with their ``position``; what lies beyond the end is not there."""
        if start < 0 or stop < start:
            raise ValueError("a slice begins at 0 or later and does not end before it begins")
        first, last = start // self.rows_each, max(start, stop - 1) // self.rows_each
        return self.table().filter((F.col("slice") >= first) & (F.col("slice") <= last) & (F.col("position") >= start) & (F.col("position") < stop)).drop("slice")

    def each(self):
        """The slices in order."""
        for start in range(0, self.count, self.rows_each):
            yield self.take(start, start + self.rows_each)
