"""Direction and cost models on ``pyspark.ml``, walk-forward folds, calibration."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import exact, leafwise, stats
from tickloom.operators.leafwise import Leafwise
from tickloom.schema import DAY, DEFAULT, Settings
from tickloom.sources.scratch import stored

LOGISTIC = ("imbalance", "microprice", "ofi_ev50")


def folds(days: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """``fold``, ``role`` and ``date``: an expanding train set, one day to calibrate, a block to test.

    The last block may be short; a fold without a test day does not exist.
    """
    numbered = days.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)  # one row a day
    size = numbered.agg(F.count(F.lit(1)).alias("n"))
    start = cfg.min_train_days + 1
    blocks = size.filter(F.col("n") > start).select(F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1 - start) / cfg.test_block_days).cast("int"))).alias("fold"))
    first = start + F.col("fold") * cfg.test_block_days
    role = F.when(F.col("i") < first - 1, "train").when(F.col("i") == first - 1, "calibrate").when((F.col("i") >= first) & (F.col("i") < first + cfg.test_block_days), "test")
    return numbered.crossJoin(F.broadcast(blocks)).select("fold", role.alias("role"), "date").filter("role IS NOT NULL")  # days times folds, both few


def leaks(made: DataFrame) -> DataFrame:
    """Per fold, whether the roles are in order and none is empty."""
    ends = made.groupBy("fold").agg(*(F.max(F.when(F.col("role") == r, F.col("date"))).alias(f"{r}_max") for r in ("train", "calibrate")), *(F.min(F.when(F.col("role") == r, F.col("date"))).alias(f"{r}_min") for r in ("calibrate", "test")))
    return ends.select("fold", F.coalesce((F.col("train_max") < F.col("calibrate_min")) & (F.col("calibrate_max") < F.col("test_min")), F.lit(False)).alias("in_order"))


def fold_numbers(made: DataFrame) -> list[int]:
    """Numbers of the folds: one for each block of test days."""
    return [r[0] for r in made.select("fold").distinct().orderBy("fold").collect()]


def days_of(made: DataFrame, fold: int, *roles: str) -> DataFrame:
    """Days of some roles of one fold, with the role if there are several; broadcast, as they are calendar days."""
    return F.broadcast(made.filter((F.col("fold") == fold) & F.col("role").isin(*roles)).select("date", *(["role"] if len(roles) > 1 else [])))


def sample_days(rows: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """``n`` rows of each date, those with the least hash of key and seed."""
    w = Window.partitionBy("date").orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key)
    return rows.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= n).drop("__k")


@dataclass
class Lookup:
    """Smoothed up-share by quantile bin of one column: edges without repeats, a bin is the number of edges at or below."""

    x: str
    edges: list[float]
    shares: dict[int, float]

    def apply(self, rows: DataFrame) -> DataFrame:
        placed = self.placed(rows)
        share = F.element_at(F.create_map(*(F.lit(v) for kv in self.shares.items() for v in kv)), F.col("bin")) if self.shares else F.lit(None).cast("double")
        return placed.withColumn("p_lookup", F.coalesce(share, F.lit(0.5)))

    def placed(self, rows: DataFrame) -> DataFrame:
        edges = F.array(*map(F.lit, self.edges)).cast("array<double>")
        return rows.withColumn("bin", F.size(F.filter(edges, lambda e: e <= F.col(self.x))))


def fit_lookup(train: DataFrame, cfg: Settings = DEFAULT, x: str = "imbalance", y: str = "y") -> Lookup:
    shares = [i / cfg.imbalance_bins for i in range(1, cfg.imbalance_bins)]
    out = Lookup(x, sorted({e for e in exact.quantiles(train, {x: shares})[x] if e is not None}), {})
    table = out.placed(train).groupBy("bin").agg(((F.sum(y) + cfg.laplace_alpha) / (F.count(F.lit(1)) + 2 * cfg.laplace_alpha)).alias("p"))
    out.shares = {r.bin: r.p for r in table.collect()}  # one row a bin
    return out


def lookup(train: DataFrame, rows: DataFrame, cfg: Settings = DEFAULT, x: str = "imbalance", y: str = "y") -> DataFrame:
    """``p_lookup`` of ``rows`` from the shares in ``train``, 0.5 in bins that it lacks."""
    return fit_lookup(train, cfg, x, y).apply(rows)


def logistic(names=LOGISTIC, label: str = "y", reg: float = 1e-4) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(names), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), LogisticRegression(featuresCol="x", labelCol=label, regParam=reg, elasticNetParam=0.0)])


def boosted(names, label: str = "y", rounds: int = DEFAULT.boost_rounds) -> Pipeline:
    """Boosted trees: shallow and level-wise, so not equal to leaf-wise ones to the digit."""
    return Pipeline(stages=[VectorAssembler(inputCols=list(names), outputCol="x"), GBTClassifier(featuresCol="x", labelCol=label, maxDepth=5, stepSize=0.05, maxIter=rounds, subsamplingRate=0.8, minInstancesPerNode=20, seed=7)])


def boosted_cost(names, label: str = "label", rounds: int = DEFAULT.cost_rounds) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(names), outputCol="x"), GBTRegressor(featuresCol="x", labelCol=label, maxDepth=5, stepSize=0.05, maxIter=rounds, subsamplingRate=0.8, minInstancesPerNode=20, seed=7)])


def probability(model, rows: DataFrame, names, out: str) -> DataFrame:
    """``out``: the probability of up, 0.5 where a feature is missing."""
    whole = reduce(lambda a, b: a & b, (F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double")) for n in names))
    filled = rows.withColumn("__whole", whole).withColumns({f"__{n}": F.col(n) for n in names}).withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names})
    scored = model.transform(filled).withColumn(out, F.when(F.col("__whole"), vector_to_array("probability")[1]).otherwise(0.5))
    return scored.withColumns({n: F.col(f"__{n}") for n in names}).select(*rows.columns, out)


def fit_calibrator(fit_on: DataFrame, p: str, label: str = "y"):
    """Isotonic regression of the label on ``p``."""
    return IsotonicRegression(featuresCol="__p", labelCol=label, predictionCol="__out").fit(VectorAssembler(inputCols=[p], outputCol="__p").transform(fit_on))


def apply_calibrator(model, rows: DataFrame, p: str, out: str) -> DataFrame:
    """``out``: what the regression says, clipped to [1e-4, 1 - 1e-4]."""
    scored = model.transform(VectorAssembler(inputCols=[p], outputCol="__p").transform(rows))
    return scored.withColumn(out, stats.clipped(F.col("__out"), 1e-4)).drop("__p", "__out")


def calibrated(fit_on: DataFrame, rows: DataFrame, p: str, out: str, label: str = "y") -> DataFrame:
    """Isotonic calibration, clipped to [1e-4, 1 - 1e-4]."""
    return apply_calibrator(fit_calibrator(fit_on, p, label), rows, p, out)


def platt(fit_on: DataFrame, rows: DataFrame, p: str, out: str, label: str = "y") -> DataFrame:
    """Logistic calibration on the logit of ``p``."""
    z = F.log(stats.clipped(F.col(p)) / (1 - stats.clipped(F.col(p))))
    model = Pipeline(stages=[VectorAssembler(inputCols=["__z"], outputCol="__v"), LogisticRegression(featuresCol="__v", labelCol=label)]).fit(fit_on.withColumn("__z", z))
    scored = model.transform(rows.withColumn("__z", z)).withColumn(out, vector_to_array("probability")[1])
    return scored.select(*rows.columns, out)


def growth(cfg: Settings = DEFAULT) -> leafwise.Growth:
    """How the direction model's trees grow."""
    return leafwise.Growth(rounds=cfg.boost_rounds, leaves=cfg.boost_leaves, rate=cfg.boost_rate, l2=cfg.boost_l2, least_rows=cfg.boost_least_rows)


def raw(model: PipelineModel | Leafwise, rows: DataFrame, names, out: str) -> DataFrame:
    """A fitted model's probability of up, 0.5 where a feature is missing."""
    return model.predict(rows, out) if isinstance(model, Leafwise) else probability(model, rows, names, out)


@dataclass
class FoldModels:
    """What one fold has learnt: fitted models by name with their features, calibrators, and the lookup table."""

    fold: int
    features: dict[str, tuple[str, ...]]
    fitted: dict[str, PipelineModel | Leafwise]
    calibrators: dict[str, IsotonicRegressionModel]
    lookup: Lookup

    def predict(self, rows: DataFrame) -> DataFrame:
        """Raw and calibrated probabilities of the lookup and of each model (``raw_``, ``p_``), and ``fold``; all calibrated ones are 0.5 where a feature of any is missing."""
        rows = self.lookup.apply(rows).withColumnRenamed("p_lookup", "raw_lookup")
        for name, model in self.fitted.items():
            rows = raw(model, rows, self.features[name], f"raw_{name}")
        for name, model in self.calibrators.items():
            rows = apply_calibrator(model, rows, f"raw_{name}", f"p_{name}")
        used = sorted({self.lookup.x, *(n for names in self.features.values() for n in names)})
        whole = reduce(lambda a, b: a & b, (F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double")) for n in used))
        return rows.withColumns({f"p_{name}": F.when(whole, F.col(f"p_{name}")).otherwise(0.5) for name in self.calibrators}).withColumn("fold", F.lit(self.fold))


def fit_fold(train: DataFrame, cal: DataFrame, names, fold: int, cfg: Settings = DEFAULT) -> FoldModels:
    """The direction models of a fold: fitted on ``train``, calibrated on ``cal``."""
    features = {"logistic": LOGISTIC, "trees": tuple(names)}
    keys = tuple(c for c in (*DAY, "sequence") if c in train.columns)
    fitted = {"logistic": logistic().fit(train), "trees": leafwise.fit(train, tuple(names), keys, how=growth(cfg))}
    table = fit_lookup(train, cfg)
    cal = table.apply(cal).withColumnRenamed("p_lookup", "raw_lookup")
    for name, model in fitted.items():
        cal = raw(model, cal, features[name], f"raw_{name}")
    cal = stored(cal, "calibrate")
    return FoldModels(fold, features, fitted, {name: fit_calibrator(cal, f"raw_{name}") for name in ("lookup", *fitted)}, table)


def fit_folds(rows: DataFrame, made: DataFrame, names, cfg: Settings = DEFAULT):
    """The folds' models, their train rows and their test rows, one fold after the other.

    Rows without a label or an imbalance are left out. Nothing is learnt from
    rows without all features, nor, if rows have the flag, from those in a
    release window; both are in the test rows.
    """
    labelled = stored(rows.na.drop(subset=["imbalance", "y"]), "labelled")
    whole = labelled.na.drop(subset=[*names])
    whole = whole.filter("NOT in_release_window") if "in_release_window" in rows.columns else whole
    for fold in fold_numbers(made):
        train, cal = (whole.join(days_of(made, fold, r), "date") for r in ("train", "calibrate"))
        yield fit_fold(train, cal, names, fold, cfg), train, labelled.join(days_of(made, fold, "test"), "date")


def walk_forward(rows: DataFrame, made: DataFrame, names, cfg: Settings = DEFAULT, store=None, in_sample: bool = False) -> DataFrame:
    """Out-of-sample predictions of the three models, calibrated on the day before each block; one fit a fold, whose predictions are written before the next.

    A ``store`` (:class:`tickloom.operators.store.ModelStore`) keeps all folds as one new version. With ``in_sample``
    the rows that each fold learnt from are predicted too, and ``role`` tells ``train`` from ``test``.
    """
    parts, kept = [], []
    for model, train, test in fit_folds(rows, made, names, cfg):
        own = {"train": train, "test": test} if in_sample else {"test": test}
        parts += [stored(model.predict(x.withColumn("role", F.lit(role)) if in_sample else x), "predicted") for role, x in own.items()]
        kept.append(model)
    if store is not None:
        store.save(kept)
    return reduce(DataFrame.unionByName, parts)


#: Models whose losses are tested against each other.
TESTED = (("trees", "lookup"), ("trees", "logistic"), ("logistic", "lookup"))


def evaluate(out: DataFrame, cfg: Settings = DEFAULT, least_release: int = 100) -> DataFrame:
    """What predictions of :func:`walk_forward` (``in_sample``, with ``in_release_window``) are worth, as one table by ``sample``.

    ``fold``: metrics of each fold outside release windows; ``out_of_sample``:
    the same of all folds together; ``release_windows_oos``: of the rows in
    release windows, if there are more than ``least_release``; ``in_sample``:
    the folds' mean of the metrics on what they learnt from. ``loss_test``: the
    mean difference of the log losses of two models, row by row in time order
    outside release windows, with its standard error and t.
    """
    names = ("lookup", "logistic", "trees")
    sample = F.when(F.col("role") == "train", "in_sample").when(F.col("in_release_window"), "release_windows_oos").otherwise("out_of_sample")
    out = out.withColumn("sample", sample)
    long = out.select("sample", "fold", "y", F.inline(F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"p_{m}").alias("p")) for m in names))))
    by_fold = stored(stats.prediction_metrics(long.filter("sample <> 'release_windows_oos'"), ("sample", "fold", "model")), "fold-metrics")
    figures = ("n", "log_loss", "brier", "auc", "accuracy")
    pooled = stats.prediction_metrics(long.filter("sample <> 'in_sample'"), ("sample", "model")).filter((F.col("sample") == "out_of_sample") | (F.col("n") > least_release))
    learnt = by_fold.filter("sample = 'in_sample'").groupBy("sample", "model").agg(*(F.avg(c).alias(c) for c in figures))
    losses = {m: stats.log_loss(F.col("y"), F.col(f"p_{m}")) for m in names}
    pairs = F.array(*(F.struct(F.lit(a).alias("model"), F.lit(b).alias("vs"), (losses[a] - losses[b]).alias("diff")) for a, b in TESTED))
    order = ("ts_event", *(c for c in (*DAY, "sequence") if c in out.columns))
    tested = stats.hac_mean(out.filter("sample = 'out_of_sample'").select(*order, F.inline(pairs)), ("model", "vs"), order, cfg.hac_lags)
    tested = tested.select(F.lit("loss_test").alias("sample"), "model", "vs", "n", F.round("mean", 9).alias("mean_loss_diff"), F.round("se", 9).alias("hac_se"), F.round("t", 6).alias("hac_t"))
    parts = [by_fold.filter("sample = 'out_of_sample'").withColumn("sample", F.lit("fold")), pooled, learnt, tested]
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (p.withColumn("n", F.col("n").cast("double")) for p in parts))
    return table.select("sample", "fold", "model", "vs", *figures, "mean_loss_diff", "hac_se", "hac_t")
