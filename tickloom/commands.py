"""Commands: build features, train, execute orders, diagnose, report, replay, or all of them.

Every command takes tables from a folder and leaves tables there, so each can
be run again by itself. Settings come from a JSON file and ``--set name=value``.
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import book, features, models, policies, quality, simulator, stats, store, targets
from tickloom.schema import DAY, DEFAULT, Settings
from tickloom.sources import tables
from tickloom.sources.scratch import stored
from tickloom.streaming import metrics, replay

#: What the direction models learn from.
LEARNT = ("imbalance", "microprice", "spread", "bid_queue", "ask_queue", "depth_imb_3", "ofi_ev10", "ofi_ev50", "tfi_ms1000", "since_mid_change_ms")
MODELS = ("lookup", "logistic", "trees")
#: Comparisons of the strategies that need no model, and what a calendar of releases must have.
EXECUTED = tuple((s, b) for s in ("always_post", "new_level", "oracle") for b in ("always_cross", "always_post") if s != b)
RELEASES = "ts_ns long"


def settings(config: str | None, changes: list[str]) -> Settings:
    """``DEFAULT`` with the values of a JSON file, then those of ``name=value`` pairs; unknown names are an error."""
    values = json.loads(Path(config).read_text()) if config else {}
    for change in changes:
        name, eq, value = change.partition("=")
        if not eq:
            raise ValueError(f"not name=value: {change}")
        try:
            values[name] = json.loads(value)
        except ValueError:
            values[name] = value
    return DEFAULT.override(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def build_features(spark: SparkSession, events: str, out: str, cfg: Settings = DEFAULT, keep_bad_days: bool = False) -> DataFrame:
    """Events without repeats become the book, features and targets of each session day; counters of their quality go beside them.

    Days with a crossed or out-of-range book are refused before anything is
    written, unless ``keep_bad_days``.
    """
    rows = quality.deduplicated(tables.as_events(tables.read_days(spark, events)))
    frame = book.book_frame(rows, cfg)
    counts = quality.flag_counts(frame)
    if not keep_bad_days:
        quality.enforce(counts)
    tables.write_records(quality.verdicts(counts), f"{out}/quality")
    made = targets.with_targets(features.with_features(quality.with_session(frame, cfg), cfg), cfg).filter("in_session")
    names = [n for n in features.feature_names(cfg) if n in made.columns]
    tables.write_days(made.select(*DAY, "sequence", "ts_event", "action", "side", "size", "bid_px", "ask_px", "qb", "qa", "mid", "book_flags", "in_session", *names, *(c for c in made.columns if c.startswith(("next_", "ret_")))), f"{out}/features")
    summary = tables.read_records(spark, f"{out}/quality").orderBy(*DAY)
    tables.write_text(spark, f"{out}/QUALITY.md", "# Data quality by day\n\n" + tables.markdown(summary))
    return tables.read_days(spark, f"{out}/features")


def train(spark: SparkSession, out: str, cfg: Settings = DEFAULT) -> DataFrame:
    """Out-of-sample predictions of the direction models, fold by fold, and their metrics; the models are kept as a new version."""
    rows = tables.read_days(spark, f"{out}/features", [*DAY, "sequence", "ts_event", *LEARNT, "next_dir"]).withColumnRenamed("next_dir", "y")
    made = models.folds(rows, cfg)
    if made.isEmpty():
        raise ValueError(f"fewer days than {cfg.min_train_days + 2}: nothing to test on")
    tables.write_days(models.walk_forward(rows, made, LEARNT, cfg, store.ModelStore(spark, f"{out}/models")), f"{out}/predictions")
    long = _by_model(tables.read_days(spark, f"{out}/predictions"))
    p, y, keys = F.col("p"), F.col("y"), ("model", "fold")
    found = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(stats.log_loss(y, p)).alias("log_loss"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(((p > 0.5) == (y > 0.5)).cast("int")).alias("accuracy"))
    tables.write_result(found.join(stats.auc(long, keys, p="p"), [*keys]).orderBy(*keys), f"{out}/tables", "direction_metrics")
    return tables.read_result(spark, f"{out}/tables", "direction_metrics")


def _by_model(predictions: DataFrame) -> DataFrame:
    each = F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"p_{m}").alias("p")) for m in MODELS))
    return predictions.select(*DAY, "sequence", "ts_event", "fold", "y", F.inline(each))


def execute(spark: SparkSession, events: str, out: str, cfg: Settings = DEFAULT, releases: str | None = None) -> DataFrame:
    """Orders of the strategies that need no model, as a trade log, with its cost table, savings and breakdown by regime.

    ``releases`` names a CSV file of release times (``ts_ns``); decisions near
    one count in their own period only.
    """
    frame = stored(book.book_frame(quality.deduplicated(tables.as_events(tables.read_days(spark, events))), cfg), "book")
    names = [*DAY, "ts_event", "sequence", "mid", "minutes_since_open", "vol_300s"]
    market = stored(features.with_features(quality.with_session(frame, cfg), cfg).select(*names), "market")
    opens, closes = (quality.local_ns(F.col("date"), clock, cfg.timezone) for clock in cfg.session)
    made = simulator.decisions(frame.select(*DAY).distinct(), cfg, opens, closes)
    points = stored(simulator.checkpoint_rows(stored(simulator.simulate(made, frame, cfg), "orders"), frame, cfg), "checkpoints")
    orders = policies.orders_of(points)
    fresh = policies.new_level(simulator.simulate_new_level(made, frame, cfg))
    log = policies.union_log([policies.always_cross(orders, cfg), policies.always_post(orders, cfg), fresh, policies.oracle(points)])
    calendar = spark.createDataFrame([], RELEASES) if releases is None else tables.read_csv(spark, releases, RELEASES)
    tables.write_days(policies.complete(log, market, calendar, cfg), f"{out}/trade_log")
    log = tables.read_days(spark, f"{out}/trade_log")
    made = {
        "cost_table": stats.cost_table(log).orderBy(*stats.CELL, "strategy"),
        "savings": stats.savings(stored(stats.paired(log), "paired"), cfg, EXECUTED).orderBy(*stats.CELL, "strategy", "vs"),
        "execution_breakdown": stats.execution_breakdown(log, cfg).orderBy("dimension", "bucket"),
    }
    for name, df in made.items():
        tables.write_result(df, f"{out}/tables", name)
    return log


def diagnose(spark: SparkSession, out: str, cfg: Settings = DEFAULT) -> list[str]:
    """Result tables on the market, and on the predictions where there are any."""
    rows = tables.read_days(spark, f"{out}/features")
    two_sided = rows.filter("mid IS NOT NULL")
    spread = F.col("ask_px") - F.col("bid_px")
    made = {
        "descriptive": rows.groupBy(*DAY).agg(
            F.count(F.lit(1)).alias("events"), F.avg((spread == 1).cast("int")).alias("one_tick_share"), F.percentile_approx("qb", 0.5).alias("median_bid_queue"),
            F.percentile_approx("qa", 0.5).alias("median_ask_queue"),
        ).orderBy(*DAY),
        "signal": two_sided.groupBy(F.floor((F.col("imbalance") + 1) * 5).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("next_dir").alias("share_up")).orderBy("bin"),
        "alerts_no_data": metrics.no_data(rows).groupBy(*DAY).agg(F.count(F.lit(1)).alias("gaps"), F.max("gap").alias("longest_ns")).orderBy(*DAY),
        "alerts_crossed": metrics.crossed(rows).groupBy("instrument_id").agg(F.count(F.lit(1)).alias("minutes"), F.sum("crossed").alias("events")),
    }
    if tables.exists(spark, f"{out}/predictions"):
        long = _by_model(tables.read_days(spark, f"{out}/predictions"))
        made["stability"] = stats.auc(long, ("model", "date"), p="p").orderBy("model", "date")
    for name, df in made.items():
        tables.write_result(df, f"{out}/tables", name)
    return sorted(made)


def report(spark: SparkSession, out: str, most: int = 200) -> str:
    """``REPORT.md`` from all result tables in ``out``."""
    names = sorted(str(x.getPath().getName()).removesuffix(".csv") for x in tables._files(spark, f"{out}/tables/*.csv")[1])
    if not names:
        raise ValueError(f"no result tables in {out}/tables")
    parts = [f"## {n}\n\n{tables.markdown(tables.read_result(spark, f'{out}/tables', n), most)}" for n in names]
    text = "# Report\n\n" + "\n".join(parts)
    tables.write_text(spark, f"{out}/REPORT.md", text)
    return text


def run_replay(spark: SparkSession, out: str, start: int | None = None, end: int | None = None, speed: float | None = None, slices: int = 4) -> DataFrame:
    """Stream the built rows again and leave the streamed features and the last metrics in ``out``."""
    rows = replay.bounded(tables.read_days(spark, f"{out}/features"), start, end)
    streamed = replay.replayed(rows.select(*DAY, "sequence", "ts_event", "action", "side", "size", "bid_px", "ask_px", "qb", "qa"), replay.stream_features, "command", slices, speed)
    tables.write_days(streamed, f"{out}/streamed")
    clock = rows.agg(F.max("ts_event")).first()[0]
    if clock is not None:
        held = tables.read_days(spark, f"{out}/streamed").select(*DAY, "sequence", *(F.col(c).alias(f"s_{c}") for c in ("imbalance", "microprice", "ofi")))
        joined = rows.drop("imbalance", "microprice", "ofi").join(held, [*DAY, "sequence"]).withColumnsRenamed({f"s_{c}": c for c in ("imbalance", "microprice", "ofi")})
        lines = metrics.exposition(metrics.market_metrics(joined, clock)).orderBy("value").collect()  # some twenty an instrument
        tables.write_text(spark, f"{out}/metrics.txt", "".join(r[0] + "\n" for r in lines))
    return tables.read_days(spark, f"{out}/streamed")


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tickloom", description=__doc__.splitlines()[0])
    parser.add_argument("--config", help="JSON file of settings")
    parser.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="one setting; may be repeated")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("build-features", "train", "execute", "diagnose", "report", "replay", "all"):
        sub = commands.add_parser(name)
        sub.add_argument("--out", required=True, help="folder of the results")
        if name in ("build-features", "execute", "all"):
            sub.add_argument("--events", required=True, help="Parquet table of events")
        if name in ("execute", "all"):
            sub.add_argument("--releases", help="CSV file of release times (ts_ns)")
        if name in ("build-features", "all"):
            sub.add_argument("--keep-bad-days", action="store_true")
        if name == "replay":
            sub.add_argument("--start", type=int)
            sub.add_argument("--end", type=int)
            sub.add_argument("--speed", type=float)
            sub.add_argument("--slices", type=int, default=4)
    given = parser.parse_args(arguments)
    cfg = settings(given.config, given.set)
    spark = spark or SparkSession.builder.appName("tickloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.command in ("build-features", "all"):
        build_features(spark, given.events, given.out, cfg, given.keep_bad_days)
    if given.command in ("train", "all"):
        train(spark, given.out, cfg)
    if given.command in ("execute", "all"):
        execute(spark, given.events, given.out, cfg, given.releases)
    if given.command in ("diagnose", "all"):
        diagnose(spark, given.out, cfg)
    if given.command in ("report", "all"):
        report(spark, given.out)
    if given.command == "replay":
        run_replay(spark, given.out, given.start, given.end, given.speed, given.slices)
    return 0
