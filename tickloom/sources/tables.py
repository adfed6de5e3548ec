"""Readers and sinks: event days, result tables, records, calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.schema import DAY, EVENTS
from tickloom.sources.scratch import stored


def _files(spark: SparkSession, pattern: str):
    """Hadoop's view of a path or pattern: its file system and what matches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, list(system.globStatus(path) or [])


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_files(spark, path)[1])


# ------------------------------------------------------------------- readers


def read_days(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A table of days written by :func:`write_days`, or any folder or pattern of Parquet files; ``columns`` prune the scan."""
    df = spark.read.option("mergeSchema", "false").parquet(path)
    return df if columns is None else df.select(*columns)


def as_events(df: DataFrame) -> DataFrame:
    """``df`` with the columns and types of ``schema.EVENTS``: what any source of events has to give, in batch or as a stream.

    Missing columns are an error; further ones are left out.
    """
    missing = [f.name for f in EVENTS.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"no event columns: {missing}")
    return df.select(*(F.col(f.name).cast(f.dataType) for f in EVENTS.fields))


def in_memory(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Events from Python rows in the order of ``schema.EVENTS``."""
    return spark.createDataFrame(rows, EVENTS)


def available_days(spark: SparkSession, path: str) -> DataFrame:
    """Days of a table of days by its folders' names: no file is opened."""
    found = [str(x.getPath()).rsplit("/", len(DAY))[1:] for x in _files(spark, "/".join([path.rstrip("/"), *(f"{c}=*" for c in DAY)]))[1]]
    names = spark.createDataFrame([tuple(p.split("=", 1)[1] for p in parts) for parts in found], ", ".join(f"{c} string" for c in DAY))
    return names.select(*(F.col(c).cast(EVENTS[c].dataType) for c in DAY)).orderBy(*DAY)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, comment: str = "#") -> DataFrame:
    """A CSV file with a header, typed columns and comment lines; an empty typed frame where there is no file. Malformed lines are an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, schema=schema, header=True, comment=comment, mode="FAILFAST", enforceSchema=False)


def read_result(spark: SparkSession, folder: str, name: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A result table that :func:`write_result` wrote; without a schema, types are taken from its values."""
    return spark.read.csv(f"{folder}/{name}.csv", header=True, schema=schema, inferSchema=schema is None)


def read_records(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """JSON records: one a line, or whole documents that span lines."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path, multiLine=not _has_lines(spark, path))


def _has_lines(spark: SparkSession, path: str) -> bool:
    """Whether the first file's first line is a record by itself."""
    first = spark.read.text(path).limit(1).select(F.try_parse_json("value").isNotNull()).first()
    return bool(first and first[0])


# --------------------------------------------------------------------- sinks


def write_days(df: DataFrame, path: str) -> None:
    """One folder a day; days in ``df`` replace those on disk, others stay. Days far larger than others are split into several files."""
    out = df.hint("rebalance", *DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy(*DAY).parquet(path)


def write_result(df: DataFrame, folder: str, name: str) -> None:
    """A result table as CSV with a header, in place of an older one."""
    df.write.mode("overwrite").csv(f"{folder}/{name}.csv", header=True)


def write_records(df: DataFrame, path: str) -> None:
    """JSON records, one a line, in place of older ones."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def upsert(new: DataFrame, path: str) -> DataFrame:
    """The table at ``path`` with the rows of ``new`` that it lacks, without repeats; it is made if it is not there.

    The union is written aside first, so a run that is broken off while it
    replaces the table loses nothing.
    """
    spark = new.sparkSession
    if exists(spark, path):
        new = spark.read.schema(new.schema).parquet(path).unionByName(new)
    whole = stored(new.distinct(), "upsert")
    whole.write.mode("overwrite").parquet(path)
    return spark.read.schema(new.schema).parquet(path)


def clear(spark: SparkSession, pattern: str) -> int:
    """Delete what matches ``pattern``; how many paths went."""
    system, found = _files(spark, pattern)
    return sum(bool(system.delete(x.getPath(), True)) for x in found)


def markdown(df: DataFrame, most: int = 500) -> str:
    """A small table as Markdown; more than ``most`` rows are an error, for reports show summaries."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in rows)]) + "\n"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A text file on any file system that Spark writes to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
