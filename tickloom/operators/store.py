"""A store of fitted models: numbered versions, each with all folds, calibrators, thresholds and feature lists.

A version is there once its manifest is: a run that is broken off leaves
nothing that a reader sees, and the next run takes the next number. Numbers are
claimed by creating a file, which only one of several writers can.
"""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.leafwise import Leafwise
from tickloom.operators.models import FoldModels, Lookup


class Bundle:
    """One version, read from disk."""

    def __init__(self, version: int, folds: list[FoldModels], thetas: DataFrame | None):
        self.version, self.folds, self.thetas = version, folds, thetas

    def fold(self, number: int) -> FoldModels:
        for x in self.folds:
            if x.fold == number:
                return x
        raise KeyError(f"version {self.version} has no fold {number}")

    def score(self, rows: DataFrame, made: DataFrame) -> DataFrame:
        """Predictions for the test days of the folds in ``made``, as :func:`models.walk_forward` gives them."""
        parts = [x.predict(rows.join(F.broadcast(made.filter((F.col("fold") == x.fold) & (F.col("role") == "test")).select("date")), "date")) for x in self.folds]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


class ModelStore:
    """Versions of fitted direction models in one folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _create(self, name: str, text: str) -> bool:
        """A new file with ``text``; false if there is one of that name."""
        system, path = self._file(name)
        try:
            out = system.create(path, False)
        except Exception as error:  # the JVM's exception, whose class depends on the file system
            if system.exists(path):
                return False
            raise error
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def versions(self) -> list[int]:
        """Numbers of the complete versions."""
        system, pattern = self._file("version=*/MANIFEST.json")
        return sorted(int(x.getPath().getParent().getName().removeprefix("version=")) for x in system.globStatus(pattern) or [])

    def save(self, folds: list[FoldModels], thetas: DataFrame | None = None) -> int:
        """Append a version; its number. ``thetas`` is a table of thresholds by cell, if there is one."""
        if not folds:
            raise ValueError("no folds to keep")
        version = max(self.versions(), default=0) + 1
        while not self._create(f"claims/{version}", ""):
            version += 1
        root, said = f"{self.path}/version={version}", []
        for x in folds:
            for name, model in x.fitted.items():
                if isinstance(model, Leafwise):
                    self._create(f"version={version}/fold={x.fold}/{name}.json", model.to_json())
                else:
                    model.save(f"{root}/fold={x.fold}/{name}")
            for name, model in x.calibrators.items():
                model.save(f"{root}/fold={x.fold}/{name}-calibrator")
            said.append({"fold": x.fold, "features": x.features, "leafwise": [n for n, m in x.fitted.items() if isinstance(m, Leafwise)], "calibrators": sorted(x.calibrators), "lookup": {"x": x.lookup.x, "edges": x.lookup.edges, "shares": sorted(x.lookup.shares.items())}})
        if thetas is not None:
            thetas.write.parquet(f"{root}/thetas")
        self._create(f"version={version}/MANIFEST.json", json.dumps({"folds": said, "thetas": thetas is not None}))
        return version

    def load(self, version: int | None = None) -> Bundle:
        """A version, the latest by default; one that is not there is an error."""
        known = self.versions()
        version = max(known, default=None) if version is None else version
        if version not in known:
            raise KeyError(f"no version {version} in {self.path}")
        root = f"{self.path}/version={version}"
        text = lambda path: self.spark.read.text(path, wholetext=True).first()[0]
        said = json.loads(text(f"{root}/MANIFEST.json"))
        folds = []
        for x in said["folds"]:
            where = f"{root}/fold={x['fold']}"
            fitted = {name: Leafwise.from_json(text(f"{where}/{name}.json")) if name in x["leafwise"] else PipelineModel.load(f"{where}/{name}") for name in x["features"]}
            calibrators = {name: IsotonicRegressionModel.load(f"{where}/{name}-calibrator") for name in x["calibrators"]}
            table = Lookup(x["lookup"]["x"], x["lookup"]["edges"], {int(b): p for b, p in x["lookup"]["shares"]})
            folds.append(FoldModels(x["fold"], {k: tuple(v) for k, v in x["features"].items()}, fitted, calibrators, table))
        return Bundle(version, folds, self.spark.read.parquet(f"{root}/thetas") if said["thetas"] else None)
