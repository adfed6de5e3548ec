"""Helpers shared by the corpus operators: scratch tables and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine, as in tests, a
    fresh temporary folder is set, once, and remembered in the session's
    configuration; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="spark-tickloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """Reliable, eager checkpoint: cuts lineage and survives lost executors."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back.

    Like :func:`cut`, but compressed and columnar, so later steps read only the
    columns they use.
    """
    path = f"{scratch_root(df.sparkSession).rstrip('/')}/tickloom-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
