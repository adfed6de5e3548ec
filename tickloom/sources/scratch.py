"""Tables written once to the shared scratch folder and read back by later steps."""

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
    return root


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as Parquet in the scratch folder: cuts the plan, and lost executors cost no rerun of earlier steps."""
    path = f"{scratch_root(df.sparkSession).rstrip('/')}/tickloom-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
