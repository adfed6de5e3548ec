"""A streaming source of numbered rows with offsets and a limit on what a trigger takes.

The rows lie in folders of equally many, as :class:`positions.Slices` writes
them. An offset is a position; a trigger takes up to ``rowsPerTrigger`` rows, or
those that are due at a pace, and its tasks read the folders that it touches.
What was planned is noted beside the query's checkpoint, so a restarted query
goes on behind it: Spark plans the batch that was broken off again from its own
log, and nothing is repeated or lost.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tickloom.operators.positions import Slices

NAME = "tickloom_slices"


@dataclass
class Stretch(InputPartition):
    """Rows [start, stop) of one folder."""

    slice: int
    start: int
    stop: int


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class SliceReader(DataSourceStreamReader):
    def __init__(self, options: dict, names: list[str]):
        self.path, self.progress, self.names = options["path"], options["progress"], names
        self.total, self.each, self.limit = int(options["rows"]), int(options["rowseach"]), int(options["rowspertrigger"])
        self.first_ts, self.speed, self.time_column = int(options.get("firstts", 0)), float(options.get("speed", 0)), options.get("timecolumn", "ts_event")
        self.at = self._noted()
        self.began = time.time()

    # ---- driver

    def _noted(self) -> int:
        """The end of the last planned batch, 0 for a new query."""
        from pyarrow import fs

        system, path = _filesystem(self.progress)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return max((int(x.base_name) for x in found if x.base_name.isdigit()), default=0)

    def _note(self, end: int) -> None:
        system, path = _filesystem(self.progress)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{end}") as out:
            out.write(b"")

    def _due(self) -> int:
        """How many rows are due by now at the given pace; all of them without one."""
        if not self.speed:
            return self.total
        import pyarrow.dataset as ds

        clock = self.first_ts + int((time.time() - self.began) * 1e9 * self.speed)
        system, path = _filesystem(self.path)
        due = self.at
        while due < self.total:  # folder by folder, from where the query stands
            folder = ds.dataset(f"{path}/slice={due // self.each}", filesystem=system, format="parquet")
            stop = min(self.total, (due // self.each + 1) * self.each)
            ready = folder.count_rows(filter=(ds.field(self.time_column) <= clock) & (ds.field("position") >= due))
            due += ready
            if due < stop or due - self.at >= self.limit:
                break
        return due

    def initialOffset(self) -> dict:
        return {"position": 0}

    def latestOffset(self) -> dict:
        return {"position": max(self.at, min(self.total, self.at + self.limit, self._due()))}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        a, b = start["position"], end["position"]
        if b > a:
            self._note(b)
        self.at = max(self.at, b)
        return [Stretch(k, max(a, k * self.each), min(b, (k + 1) * self.each)) for k in range(a // self.each, -(-b // self.each))] if b > a else []

    # ---- tasks

    def read(self, partition: Stretch):
        import pyarrow.dataset as ds

        system, path = _filesystem(self.path)
        place = ds.field("position")
        folder = ds.dataset(f"{path}/slice={partition.slice}", filesystem=system, format="parquet")
        yield from folder.to_batches(columns=self.names, filter=(place >= partition.start) & (place < partition.stop))


class SliceSource(DataSource):
    """``spark.readStream.format(NAME)``; options: ``path``, ``rows``, ``rowsEach``, ``rowsPerTrigger``, ``progress``, and for a pace ``speed``, ``firstTs``, ``timeColumn``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        raise ValueError("give the schema of the rows")

    def streamReader(self, schema) -> SliceReader:
        return SliceReader({k.lower(): v for k, v in self.options.items()}, schema.names)


def read_slices(spark: SparkSession, slices: Slices, progress: str, rows_per_trigger: int, speed: float | None = None, first_ts: int = 0) -> DataFrame:
    """The stream of a numbered table; ``progress`` is a folder of the query's own."""
    if rows_per_trigger < 1 or (speed is not None and speed <= 0):
        raise ValueError("a trigger takes a row at least, and a pace is positive")
    spark.dataSource.register(SliceSource)
    names = [f for f in slices.table().schema.fields if f.name != "slice"]
    from pyspark.sql.types import StructType

    stream = spark.readStream.format(NAME).schema(StructType(names))
    options = {"path": slices.path, "rows": slices.count, "rowsEach": slices.rows_each, "rowsPerTrigger": rows_per_trigger, "progress": progress}
    if speed is not None:
        options |= {"speed": speed, "firstTs": first_ts}
    return stream.options(**options).load()
