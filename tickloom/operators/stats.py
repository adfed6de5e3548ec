"""Statistics of paired costs and of predictions, as aggregates and windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import exact, ordered
from tickloom.schema import DEFAULT, STRATEGIES, Settings
from tickloom.sources.scratch import stored

CELL = ("queue_model", "latency_ms", "deadline_s")
REGIME = ("minutes_since_open", "vol_300s", "own_queue", "spread_ticks")
COMPARED = ("model_cost", "model_direction", "always_post", "new_level", "oracle")
PAIRS = tuple((s, b) for s in COMPARED for b in ("always_cross", "always_post") if s != b)


def cost_table(log: DataFrame) -> DataFrame:
    """Costs and fill statistics of each cell and strategy outside release windows."""
    filled = F.col("filled_passive")
    return log.filter("NOT in_release_window").groupBy(*CELL, "strategy").agg(
        F.count(F.lit(1)).alias("n"), F.avg("cost_ticks").alias("mean_cost_ticks"), F.stddev_samp("cost_ticks").alias("sd_cost_ticks"),
        F.percentile("cost_ticks", F.lit(0.1)).alias("p10_cost_ticks"), F.percentile("cost_ticks", F.lit(0.5)).alias("median_cost_ticks"), F.percentile("cost_ticks", F.lit(0.9)).alias("p90_cost_ticks"),
        F.avg("cost_usd").alias("mean_cost_usd"), F.avg(filled.cast("double")).alias("passive_fill_rate"), F.avg(F.when(filled, F.col("time_to_fill_ms"))).alias("mean_ms_to_passive_fill"),
        F.avg("time_to_fill_ms").alias("mean_ms_to_done"), F.avg("adverse_1s").alias("adverse_1s_ticks"), F.avg("adverse_5s").alias("adverse_5s_ticks"),
    )


def paired(log: DataFrame, release: bool = False) -> DataFrame:
    """One row a decision and cell, one cost column a strategy."""
    rows = log.filter(F.col("in_release_window") if release else ~F.col("in_release_window"))
    return rows.groupBy("date", "decision_id", "decision_ts", *CELL, *REGIME).pivot("strategy", list(STRATEGIES)).agg(F.first("cost_ticks"))


def differences(wide: DataFrame, pairs=PAIRS) -> DataFrame:
    """``strategy``, ``vs`` and ``diff`` (positive: the strategy is cheaper) of each decision."""
    pairs = F.array(*(F.struct(F.lit(s).alias("strategy"), F.lit(b).alias("vs"), (F.col(b) - F.col(s)).alias("diff")) for s, b in pairs))
    return wide.select("date", "decision_ts", "decision_id", *CELL, F.inline(pairs))


def known_differences(wide: DataFrame, pairs=PAIRS) -> DataFrame:
    """:func:`differences` of decisions that have both strategies, from a row a decision that is written once for all statistics that start from it."""
    return differences(stored(wide.drop(*REGIME), "wide"), pairs).filter("diff IS NOT NULL")


def hash_pick(n: Column, *parts: Column) -> Column:
    """Integer in [0, n) from the MD5 of the parts, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long") % n


def bootstrap(diff: DataFrame, keys: tuple[str, ...], reps: int) -> DataFrame:
    """Day-block bootstrap: the 2.5 and 97.5 percentiles of resampled means, for each group.

    Only day sums are resampled: as many days as a group has are drawn with
    replacement, so the joined table has groups times days times ``reps`` rows.
    """
    days = diff.groupBy(*keys, "date").agg(F.sum("diff").alias("s"), F.count(F.lit(1)).alias("c"))
    by_group = Window.partitionBy(*keys)
    days = days.withColumns({"slot": F.row_number().over(by_group.orderBy("date")) - 1, "n_days": F.count(F.lit(1)).over(by_group)})
    # The draw depends on the number of days alone, so groups with as many days share it.
    drawn = days.select("n_days").distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_days") - 1)))
    drawn = drawn.withColumn("slot", hash_pick(F.col("n_days"), F.col("rep"), F.col("draw"))).groupBy("n_days", "rep", "slot").agg(F.count(F.lit(1)).alias("times"))
    means = days.join(drawn, ["n_days", "slot"]).groupBy(*keys, "rep").agg((F.sum(F.col("times") * F.col("s")) / F.sum(F.col("times") * F.col("c"))).alias("m"))
    return means.groupBy(*keys).agg(F.percentile("m", F.lit(0.025)).alias("ci95_lo"), F.percentile("m", F.lit(0.975)).alias("ci95_hi"))


def hac_mean(series: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], lags: int) -> DataFrame:
    """``n``, ``mean`` of ``diff``, its standard error ``se`` and its ``t``, with Bartlett weights over ``lags``; the last two are null under three rows or without variance.

    A series may be of any length: its parts are summed where they lie. The
    series are written once; their keys are kept as columns.
    """
    series = stored(series.select(*keys, *order, "diff"), "series")
    found = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("diff").alias("mean"), F.min("diff").alias("lo"), F.max("diff").alias("hi"))
    found = stored(found, "series-means")
    weights = np.array([1.0] + [2 * (1 - k / (lags + 1)) for k in range(1, lags + 1)])
    rows = series.select(*keys, *order, "diff").join(found.select(*keys, "mean"), [*keys]).withColumn("e", F.col("diff") - F.col("mean"))
    found = found.join(ordered.lagged_products(rows, keys, order, "e", weights), [*keys])
    flat = (F.col("n") < 3) | (F.col("lo") == F.col("hi"))
    found = found.withColumn("se", F.when(~flat & (F.col("g") > 0), F.sqrt(F.col("g") / F.col("n") / F.col("n"))))
    return found.select(*keys, "n", "mean", "se", (F.col("mean") / F.col("se")).alias("t"))


def hac_t(series: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], lags: int) -> DataFrame:
    """The rounded t of :func:`hac_mean`."""
    return hac_mean(series, keys, order, lags).select(*keys, F.round("t", 6).alias("hac_t"))


def savings(wide: DataFrame, cfg: Settings = DEFAULT, pairs=PAIRS) -> DataFrame:
    """Mean saving of each strategy over each base by cell, with interval, t and dollars; decisions that lack one of the two do not count."""
    diff = known_differences(wide, pairs)
    keys = (*CELL, "strategy", "vs")
    table = diff.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("test_days"), F.avg("diff").alias("saving_ticks"))
    table = table.join(bootstrap(diff, keys, cfg.bootstrap_reps), list(keys)).join(hac_t(diff, keys, ("decision_ts", "decision_id"), cfg.hac_lags), list(keys))
    return table.withColumn("saving_usd", F.col("saving_ticks") * cfg.tick_value_usd)


def buckets(rows: DataFrame, vol: str, queue: str, spread: str, minutes: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Regime columns ``tod``, ``vol``, ``queue``, ``spread_state``; cuts are exact quantiles of the whole frame, found where its rows lie."""
    cuts = exact.quantiles(rows, {vol: [1 / 3, 2 / 3], queue: [0.5]})
    (low, high), (middle,) = ([F.lit(x).cast("double") for x in cuts[c]] for c in (vol, queue))
    return rows.withColumns(
        {
            "tod": time_of_day(F.col(minutes)),
            "vol": F.when(F.col(vol) <= low, "low").when(F.col(vol) <= high, "mid").otherwise("high"),
            "queue": F.when(F.col(queue) <= middle, "small").otherwise("large"),
            "spread_state": F.when(F.col(spread) <= 1, "1 tick").otherwise("wider"),
        }
    )


def time_of_day(minutes: Column) -> Column:
    return F.when((minutes >= 0) & (minutes < 90), "open").when((minutes >= 90) & (minutes < 300), "midday").when((minutes >= 300) & (minutes < 390), "close").otherwise("outside")


def execution_breakdown(log: DataFrame, cfg: Settings = DEFAULT, least: int = 30) -> DataFrame:
    """Mean costs of the headline cell by regime; release rows are a period of their own."""
    cell = headline(log, cfg)
    wide = buckets(stored(paired(cell), "paired"), "vol_300s", "own_queue", "spread_ticks", "minutes_since_open")
    dims = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("bucket")) for d in ("tod", "vol", "queue", "spread_state")), F.struct(F.lit("period").alias("dimension"), F.lit("normal").alias("bucket")))
    names = STRATEGIES[:5]
    rows = wide.select(*names, F.inline(dims)).unionByName(paired(cell, release=True).select(*names, F.lit("period").alias("dimension"), F.lit("release").alias("bucket")))
    out = rows.groupBy("dimension", "bucket").agg(
        F.count(F.lit(1)).alias("n"), *(F.avg(s).alias(s) for s in names),
        F.avg(F.col("always_cross") - F.col("model_cost")).alias("model_cost_saving_vs_cross"), F.avg(F.col("always_post") - F.col("model_cost")).alias("model_cost_saving_vs_post"),
    )
    return out.filter(F.col("n") >= least)


def headline(rows: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    model, latency, deadline = cfg.headline
    return rows.filter((F.col("queue_model") == model) & (F.col("latency_ms") == latency) & (F.col("deadline_s") == deadline))


def auc(rows: DataFrame, keys: tuple[str, ...], y: str = "y", p: str = "p") -> DataFrame:
    """Tie-aware AUC of each group: equal scores share a rank. Null with one class only.

    Scores are counted first; ranges of scores then say how many wins they hold
    and how many losses lie below them.
    """
    tally = rows.groupBy(*keys, p).agg(F.sum(F.col(y)).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    total = ordered.wins_below(stored(tally, "tally"), keys, p)
    return total.select(*keys, F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("w") / (F.col("pos") * F.col("neg"))).alias("auc"))


def clipped(p: Column, at: float = 1e-6) -> Column:
    return F.greatest(F.lit(at), F.least(F.lit(1 - at), p))


def log_loss(y: Column, p: Column) -> Column:
    p = clipped(p)
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))


def prediction_metrics(rows: DataFrame, keys: tuple[str, ...], y: str = "y", p: str = "p") -> DataFrame:
    """``n``, ``log_loss``, ``brier``, ``accuracy`` and ``auc`` of each group of predictions; probabilities are clipped as for the loss."""
    rows = rows.withColumn("__p", clipped(F.col(p)))
    q, label = F.col("__p"), F.col(y)
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(log_loss(label, q)).alias("log_loss"), F.avg((q - label) * (q - label)).alias("brier"), F.avg(((q > 0.5) == (label > 0.5)).cast("int")).alias("accuracy"))
    return found.join(auc(rows, keys, y, "__p"), [*keys])


def queue_validation(posts: DataFrame) -> DataFrame:
    """Each queue model against the exact one on the same decisions."""
    keys = ["date", "decision_id", "latency_ms", "deadline_s"]
    exact = posts.filter("queue_model = 'exact'").select(*keys, F.col("filled_passive").alias("t_filled"), F.col("cost_ticks").alias("t_cost"), F.col("time_to_fill_ms").alias("t_time"))
    both = F.col("filled_passive") & F.col("t_filled")
    return posts.join(exact, keys).groupBy("queue_model", "latency_ms", "deadline_s").agg(
        F.avg(F.col("filled_passive").cast("int")).alias("fill_rate"), F.avg(F.col("t_filled").cast("int")).alias("true_fill_rate"), F.avg((F.col("filled_passive") == F.col("t_filled")).cast("int")).alias("fill_agreement"),
        (F.avg("cost_ticks") - F.avg("t_cost")).alias("cost_bias_ticks"), F.avg(F.when(both, F.abs(F.col("time_to_fill_ms") - F.col("t_time")))).alias("mae_fill_time_ms"),
    )
