"""Queries over predictions and models."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import book, exact, features, leafwise, models, policies, quality, simulator, stats, store, targets
from tickloom.plans import sim_plans
from tickloom.plans.cost_plans import R, buckets_sql, rounded
from tickloom.plans.registry import Catalog
from tickloom.schema import DAY, DEFAULT, QUEUE_MODELS
from tickloom.sources.fixtures import MINI_PRED_SQL, l2_events, l2_sql, mini_pred, releases
from tickloom.sources.scratch import scratch_root, stored

catalog = Catalog()
ORDER = [*simulator.ORDER]
CELL = ["latency_ms", "deadline_s"]


def auc_sql(source: str, keys: str, y: str = "y", p: str = "p") -> str:
    """Mann-Whitney with average ranks."""
    g = f"PARTITION BY {keys} " if keys else ""
    k = f"{keys}, " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}CASE WHEN sum({y}) > 0 AND sum(1 - {y}) > 0 THEN (sum(r * {y}) - sum({y}) * (sum({y}) + 1) / 2) / (sum({y}) * sum(1 - {y})) END AS auc
FROM (SELECT *, rank() OVER ({g}ORDER BY {p}) + (count(*) OVER (PARTITION BY {k}{p}) - 1) / 2.0::DOUBLE AS r FROM {source}) {by}"""


catalog.add("auc", f"WITH {MINI_PRED_SQL} SELECT fold, {R('auc')} AS auc FROM ({auc_sql('mini_pred', 'fold')})")(lambda s, d: rounded(stats.auc(mini_pred(s, d), ("fold",)), "auc"))
_LL = lambda p: f"-(y * ln(greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, {p}))) + (1 - y) * ln(1 - greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, {p}))))"
METRICS_SQL = f"WITH {MINI_PRED_SQL}, a AS ({auc_sql('mini_pred', 'fold')}), m AS (SELECT fold, count(*) AS n, avg({_LL('p')}) AS ll, avg((p - y) * (p - y)) AS br, avg(((p > 0.5) = (y > 0.5))::INT) AS acc FROM mini_pred GROUP BY fold)"


def metrics(spark, sf):
    rows, p, y = mini_pred(spark, sf), F.col("p"), F.col("y")
    table = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg(stats.log_loss(y, p)).alias("log_loss"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(((p > 0.5) == (y > 0.5)).cast("int")).alias("accuracy"))
    return table.join(stats.auc(rows, ("fold",)), "fold")


catalog.add("direction_metrics", f"{METRICS_SQL} SELECT fold, n, {R('ll')} AS log_loss, {R('br')} AS brier, {R('acc')} AS accuracy, {R('auc')} AS auc FROM m JOIN a USING (fold)")(lambda s, d: rounded(metrics(s, d), "log_loss", "brier", "accuracy", "auc"))
catalog.add("fold_means", f"{METRICS_SQL} SELECT count(*) AS folds, {R('avg(ll)')} AS log_loss, {R('avg(auc)')} AS auc FROM m JOIN a USING (fold)")(lambda s, d: metrics(s, d).agg(F.count(F.lit(1)).alias("folds"), F.round(F.avg("log_loss"), 8).alias("log_loss"), F.round(F.avg("auc"), 8).alias("auc")))


@catalog.add("logloss_hac", f"""WITH {MINI_PRED_SQL}, l AS (SELECT event_id, ts_event, {_LL('p')} AS a, {_LL('p2')} AS b, {_LL('p3')} AS c FROM mini_pred), x AS (SELECT 'p-p2' AS pair, event_id, ts_event, a - b AS diff FROM l UNION ALL SELECT 'p-p3', event_id, ts_event, a - c FROM l UNION ALL SELECT 'p2-p3', event_id, ts_event, b - c FROM l),
e AS (SELECT pair, diff - avg(diff) OVER (PARTITION BY pair) AS e, row_number() OVER (PARTITION BY pair ORDER BY ts_event, event_id) AS k FROM x), g AS (SELECT pair, sum(a.e * b.e * CASE WHEN a.k = b.k THEN 1 ELSE 2 * (1 - (a.k - b.k) / 51.0::DOUBLE) END) AS g FROM e a JOIN (SELECT *, unnest(range(51)) AS lag FROM e) b USING (pair) WHERE a.k = b.k + b.lag GROUP BY pair)
SELECT pair, round(avg(diff) / sqrt(any_value(g) / count(*) / count(*)), 5) AS hac_t FROM x JOIN g USING (pair) GROUP BY pair""".replace("JOIN (SELECT *, unnest(range(51)) AS lag FROM e) b USING (pair) WHERE a.k = b.k + b.lag", "JOIN (SELECT pair, e, k, k + unnest(range(51)) AS k2 FROM e) b ON a.pair = b.pair AND a.k = b.k2").replace("SELECT pair, sum(a.e", "SELECT a.pair, sum(a.e").replace("GROUP BY pair)\nSELECT", "GROUP BY a.pair)\nSELECT"))
def logloss_hac(spark, sf):
    y = F.col("y")
    a, b, c = (stats.log_loss(y, F.col(p)) for p in ("p", "p2", "p3"))
    pairs = F.array(*(F.struct(F.lit(n).alias("pair"), d.alias("diff")) for n, d in (("p-p2", a - b), ("p-p3", a - c), ("p2-p3", b - c))))
    rows = mini_pred(spark, sf).select("event_id", "ts_event", F.inline(pairs))
    return stats.hac_t(rows, ("pair",), ("ts_event", "event_id"), DEFAULT.hac_lags).withColumn("hac_t", F.round("hac_t", 5))


@catalog.add("reliability", f"WITH {MINI_PRED_SQL}, e AS (SELECT list_distinct(list_sort(quantile_cont(p, [{', '.join(f'{i / 15}::DOUBLE' for i in range(1, 15))}]))) AS ed FROM mini_pred) SELECT len(list_filter(ed, lambda z: z <= p)) AS bin, count(*) AS n, {R('avg(p)')} AS mean_p, {R('avg(y)')} AS share_up FROM mini_pred, e GROUP BY ALL")
def reliability(spark, sf):
    """Mean prediction and observed share by quantile bin of the prediction."""
    rows = mini_pred(spark, sf)
    n = DEFAULT.reliability_bins
    edges = F.array(*map(F.lit, sorted(set(exact.quantiles(rows, {"p": [i / n for i in range(1, n)]})["p"]))))
    rows = rows.withColumn("bin", F.size(F.filter(edges, lambda z: z <= F.col("p"))).cast("long"))
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 8).alias("mean_p"), F.round(F.avg("y"), 8).alias("share_up"))


@catalog.add("baseline_a", f"WITH {MINI_PRED_SQL}, e AS (SELECT list_distinct(quantile_cont(imbalance, [{', '.join(f'{i / 10}::DOUBLE' for i in range(1, 10))}])) AS ed FROM mini_pred WHERE fold <> 2), b AS (SELECT mini_pred.*, len(list_filter(ed, lambda z: z <= imbalance)) AS bin FROM mini_pred, e), t AS (SELECT bin, (sum(y) + 1) / (count(*) + 2) AS p FROM b WHERE fold <> 2 GROUP BY bin) SELECT event_id, {R('coalesce(t.p, 0.5)')} AS p_lookup FROM b LEFT JOIN t USING (bin) WHERE fold = 2")
def baseline_a(spark, sf):
    rows = mini_pred(spark, sf)
    return models.lookup(rows.filter("fold <> 2"), rows.filter("fold = 2")).select("event_id", F.round("p_lookup", 8).alias("p_lookup"))


catalog.add("score_missing", f"WITH {MINI_PRED_SQL} SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0.5::DOUBLE ELSE p END AS p FROM mini_pred")(
    lambda s, d: mini_pred(s, d).withColumn("x", F.when(F.col("event_id") % 4 == 0, F.when(F.col("event_id") % 8 == 0, float("nan"))).otherwise(F.col("p"))).select("event_id", F.when(F.col("x").isNull() | F.isnan("x"), 0.5).otherwise(F.col("x")).alias("p"))
)
_DAYS = "dys AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM l2))"
FOLDS_SQL = f"WITH {l2_sql()}, {_DAYS}, bl AS (SELECT unnest(range((max(n) - 7) // 3 + 1)) AS fold FROM dys), fo AS (SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN i < 5 + 3 * fold THEN 'train' WHEN i = 5 + 3 * fold THEN 'calibrate' WHEN i < 9 + 3 * fold THEN 'test' END AS role, date FROM dys, bl)"
catalog.add("walk_forward_folds", f"{FOLDS_SQL} SELECT * FROM fo WHERE role IS NOT NULL")(lambda s, d: models.folds(l2_events(s, d)))
catalog.add("fold_leak_check", f"{FOLDS_SQL} SELECT fold, max(date) FILTER (role = 'train') < min(date) FILTER (role = 'calibrate') AND max(date) FILTER (role = 'calibrate') < min(date) FILTER (role = 'test') AS in_order FROM fo GROUP BY fold")(lambda s, d: models.leaks(models.folds(l2_events(s, d))))
catalog.add("sample_day", f"WITH {MINI_PRED_SQL} SELECT event_id, date FROM mini_pred QUALIFY row_number() OVER (PARTITION BY date ORDER BY md5(event_id || '|7'), event_id) <= 20")(lambda s, d: models.sample_days(mini_pred(s, d), 20, "event_id", 7).select("event_id", "date"))

_MB = f"""WITH {MINI_PRED_SQL}, {buckets_sql('mini_pred', 'vol_300s', 'total_queue', 'spread')}, x AS ({' UNION ALL '.join(f"SELECT '{d}' AS dimension, b_{d} AS bucket, y, p, p2 FROM bk WHERE NOT in_release_window" for d in ('tod', 'vol', 'queue', 'spread_state'))} UNION ALL SELECT 'period', CASE WHEN in_release_window THEN 'release' ELSE 'normal' END, y, p, p2 FROM bk),
z AS (SELECT dimension, bucket, 'p' AS model, y, p AS q FROM x UNION ALL SELECT dimension, bucket, 'p2', y, p2 FROM x), a AS ({auc_sql('z', 'dimension, bucket, model', p='q')}), c AS (SELECT dimension, bucket, model, count(*) AS n, avg(((q > 0.5) = (y > 0.5))::INT) AS acc FROM z GROUP BY ALL)"""


@catalog.add("model_breakdown", f"{_MB} SELECT dimension, bucket, model, n, {R('auc')} AS auc, {R('acc')} AS accuracy FROM a JOIN c USING (dimension, bucket, model) WHERE n >= 200 AND auc IS NOT NULL")
def model_breakdown(spark, sf):
    """AUC and accuracy by regime; cuts from all rows, release rows only in their own period."""
    rows = stats.buckets(mini_pred(spark, sf), "vol_300s", "total_queue", "spread", "minutes_since_open")
    normal = ~F.col("in_release_window")
    dims = F.array(*(F.when(normal, F.struct(F.lit(d).alias("dimension"), F.col(d).alias("bucket"))) for d in ("tod", "vol", "queue", "spread_state")), F.struct(F.lit("period").alias("dimension"), F.when(normal, "normal").otherwise("release").alias("bucket")))
    rows = rows.select("y", "p", "p2", F.explode(F.filter(dims, lambda x: x.isNotNull())).alias("x"))
    rows = rows.select("x.dimension", "x.bucket", "y", F.inline(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("q")) for m in ("p", "p2")))))
    keys = ("dimension", "bucket", "model")
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(((F.col("q") > 0.5) == (F.col("y") > 0.5)).cast("int")).alias("accuracy"))
    return rounded(counts.join(stats.auc(rows, keys, p="q"), [*keys]).filter("n >= 200 AND auc IS NOT NULL"), "auc", "accuracy")


_SD = f"""WITH {MINI_PRED_SQL}, h AS (SELECT 'next move' AS horizon, y AS v, y AS up, imbalance, p FROM mini_pred WHERE NOT in_release_window UNION ALL SELECT '1s', ret_1s, (ret_1s > 0)::INT::DOUBLE, imbalance, p FROM mini_pred WHERE NOT in_release_window UNION ALL SELECT '5s', ret_5s, (ret_5s > 0)::INT::DOUBLE, imbalance, p FROM mini_pred WHERE NOT in_release_window),
k AS (SELECT * FROM h WHERE horizon = 'next move' OR v <> 0), z AS (SELECT horizon, 'imbalance' AS signal, up AS y, imbalance AS q FROM k UNION ALL SELECT horizon, 'model', up, p FROM k), a AS ({auc_sql('z', 'horizon, signal', p='q')}), n AS (SELECT horizon, count(*) AS total FROM h GROUP BY ALL), m AS (SELECT horizon, count(*) AS n FROM k GROUP BY ALL)"""


@catalog.add("signal_decay", f"{_SD} SELECT horizon, signal, n, {R('n / total::DOUBLE')} AS moved_share, {R('auc')} AS auc FROM a JOIN n USING (horizon) JOIN m USING (horizon)")
def signal_decay(spark, sf):
    rows = mini_pred(spark, sf).filter("NOT in_release_window")
    up = lambda c: (F.col(c) > 0).cast("double")
    each = F.array(F.struct(F.lit("next move").alias("horizon"), F.lit(True).alias("moved"), F.col("y").alias("up")), *(F.struct(F.lit(h).alias("horizon"), (F.col(f"ret_{h}") != 0).alias("moved"), up(f"ret_{h}").alias("up")) for h in ("1s", "5s")))
    rows = rows.select("imbalance", "p", F.inline(each))
    shares = rows.groupBy("horizon").agg(F.count_if("moved").alias("n"), F.avg(F.col("moved").cast("double")).alias("moved_share"))
    moved = rows.filter("moved").select("horizon", F.col("up").alias("y"), F.inline(F.array(F.struct(F.lit("imbalance").alias("signal"), F.col("imbalance").alias("q")), F.struct(F.lit("model").alias("signal"), F.col("p").alias("q")))))
    return rounded(stats.auc(moved, ("horizon", "signal"), p="q").join(shares, "horizon"), "moved_share", "auc")


# --------------------------------------------------------- fitted models

NAMES = ("imbalance", "microprice", "spread", "bid_queue", "ask_queue", "depth_imb_3", "ofi_ev10", "ofi_ev50", "tfi_ms1000", "since_mid_change_ms")
#: Fewer folds and rounds of the direction model than ``DEFAULT`` has: the fixtures are a month, and every fit runs in the correctness check.
FEW = DEFAULT.override(test_block_days=12, boost_rounds=10, boost_least_rows=20)
#: Cost models that are fitted side by side.
FITS = 8


def modelled(spark, sf):
    rows = targets.with_targets(features.with_features(sim_plans.books(spark, sf)))
    return stored(rows.select(*DAY, "sequence", "ts_event", *NAMES, F.col("next_dir").alias("y")), "modelled")


def _split(spark, sf):
    rows = modelled(spark, sf).na.drop()
    return rows.filter("day(date) <= 20"), rows.filter("day(date) > 20 AND day(date) <= 23"), rows.filter("day(date) > 23")


@catalog.add("baseline_b")
def baseline_b(spark, sf):
    train, _, test = _split(spark, sf)
    return models.probability(models.logistic().fit(train), test, models.LOGISTIC, "p_logistic").select(*DAY, "sequence", "y", "p_logistic")


@catalog.add("gbt_direction")
def gbt_direction(spark, sf):
    train, _, test = _split(spark, sf)
    return models.probability(models.boosted(NAMES, rounds=FEW.boost_rounds).fit(train), test, NAMES, "p_trees").select(*DAY, "sequence", "y", "p_trees")


@catalog.add("leafwise_direction")
def leafwise_direction(spark, sf):
    """Trees that grow leaf by leaf; the days of the fixtures are thin, so leaves hold fewer rows."""
    train, _, test = _split(spark, sf)
    how = leafwise.Growth(rounds=FEW.boost_rounds, least_rows=20)
    return leafwise.fit(train, NAMES, (*DAY, "sequence"), how=how).predict(test, "p_trees").select(*DAY, "sequence", "y", "p_trees")


@catalog.add("calibrate")
def calibrate(spark, sf):
    train, cal, test = _split(spark, sf)
    model = models.logistic().fit(train)
    cal, test = (models.probability(model, x, models.LOGISTIC, "raw") for x in (cal, test))
    return models.platt(cal, models.calibrated(cal, test, "raw", "p_isotonic"), "raw", "p_platt").select(*DAY, "sequence", "raw", "p_isotonic", "p_platt")


@catalog.add("direction_walk_forward")
def direction_walk_forward(spark, sf):
    """Metrics of the three models by fold, of all folds, of release windows and in sample, and tests of their losses against each other."""
    rows = quality.with_release_flag(modelled(spark, sf), releases(spark), sim_plans.RELEASE_WIDTH)
    return models.evaluate(models.walk_forward(rows, models.folds(rows, FEW), NAMES, FEW, in_sample=True), FEW)


# ------------------------------------------------- strategies with a model

SIM = sim_plans.SIM


_TUNE = f"""{sim_plans.CP_SQL}, th AS (SELECT unnest([0.50::DOUBLE, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80]) AS theta), ab AS (SELECT {sim_plans.KC}, queue_model, theta, arg_min(cp_cross, j) FILTER (((cp_seq * 37 + j * 11) % 100) / 100.0::DOUBLE > theta) AS x FROM c3, th GROUP BY ALL),
co AS (SELECT queue_model, latency_ms, deadline_s, theta, round(avg(s * (coalesce(ab.x, passive_px) - mid)), 9) AS c FROM sim JOIN ab USING ({sim_plans.KC}, queue_model) GROUP BY ALL)
SELECT queue_model, latency_ms, deadline_s, arg_min(theta, (c, theta)) AS theta FROM co GROUP BY ALL"""


@catalog.add("tune_theta", _TUNE)
def tune_theta(spark, sf):
    """Threshold with the least mean cost of each cell, the smallest among equals; the signal is a hash of the row."""
    cps = sim_plans.checkpoints(spark, sf).withColumn("p", (F.col("cp_seq") * 37 + F.col("j") * 11) % 100 / F.lit(100.0))
    return policies.tune(cps, F.col("p"))


_GIVEN = f"""{sim_plans.CP_SQL}, pr AS (SELECT instrument_id, date, sequence, ((sequence * 37 + instrument_id * 11) % 100) / 100.0::DOUBLE AS p FROM book),
cq AS (SELECT c3.*, CASE WHEN c3.s = 1 THEN p ELSE 1 - p END AS pa FROM c3 JOIN pr ON pr.instrument_id = c3.instrument_id AND pr.date = c3.date AND pr.sequence = c3.cp_seq), th AS (SELECT unnest([0.50::DOUBLE, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80]) AS theta),
ca AS (SELECT {sim_plans.KC}, queue_model, theta, any_value(s) AS s, any_value(mid) AS mid, any_value(passive_px) AS passive_px, arg_min(cp_cross, j) FILTER (pa > theta) AS x FROM cq, th WHERE day(date) <= 20 GROUP BY {sim_plans.KC}, queue_model, theta),
ct AS (SELECT queue_model, latency_ms, deadline_s, arg_min(theta, (c, theta)) AS theta FROM (SELECT queue_model, latency_ms, deadline_s, theta, round(avg(s * (coalesce(x, passive_px) - mid)), 9) AS c FROM ca GROUP BY ALL) GROUP BY ALL),
gu AS (SELECT {sim_plans.KC}, queue_model, any_value(theta) AS theta, min(j) FILTER (pa > theta) AS j, arg_min(cp_cross, j) FILTER (pa > theta) AS x, any_value(s) AS s, any_value(mid) AS mid, any_value(passive_px) AS passive_px, any_value(filled) AS filled
  FROM cq JOIN ct USING (queue_model, latency_ms, deadline_s) WHERE day(date) > 20 GROUP BY {sim_plans.KC}, queue_model)
SELECT {sim_plans.KC}, queue_model, theta, CAST(j AS BIGINT) AS abandon_j, CAST(s * (CASE WHEN j IS NOT NULL THEN x ELSE passive_px END - mid) AS DOUBLE) + 0.0::DOUBLE AS cost_ticks, j IS NULL AND filled AS filled_passive FROM gu"""


@catalog.add("strat_direction_given", _GIVEN)
def strat_direction_given(spark, sf):
    """The direction strategy on stored predictions: thresholds are tuned on the first days' orders and used on the later ones."""
    given = stored(l2_events(spark, sf).select(*DAY, F.col("sequence").alias("cp_seq"), ((F.col("sequence") * 37 + F.col("instrument_id") * 11) % 100 / F.lit(100.0)).alias("p")), "predictions")
    rows = sim_plans.checkpoints(spark, sf).join(given, [*DAY, "cp_seq"]).withColumn("against", F.when(F.col("order_side") == 1, F.col("p")).otherwise(1 - F.col("p")))
    thetas = stored(policies.tune(rows.filter("day(date) <= 20"), F.col("against"), SIM), "thetas")
    later = rows.filter("day(date) > 20").join(F.broadcast(thetas), ["queue_model", *CELL])  # one row a cell
    log = policies.abandon(later, F.col("against") > F.col("theta"), SIM, "model_direction").join(F.broadcast(thetas), ["queue_model", *CELL])
    return log.select(*ORDER, *CELL, "queue_model", "theta", F.col("abandon_j").cast("long").alias("abandon_j"), "cost_ticks", "filled_passive")


@catalog.add("model_store")
def model_store(spark, sf):
    """Out-of-sample predictions from models that were kept and read again."""
    rows = modelled(spark, sf)
    made = models.folds(rows, FEW)
    kept = store.ModelStore(spark, f"{scratch_root(spark).rstrip('/')}/tickloom-models-{uuid.uuid4().hex}")
    models.walk_forward(rows, made, NAMES, FEW, kept)
    return kept.load().score(rows.na.drop(subset=[*NAMES, "y"]), made).select(*DAY, "sequence", "fold", "y", "p_lookup", "p_logistic", "p_trees")


COST_NAMES = ("imbalance", "microprice", "spread", "depth_imb_3", "ofi_ev10", "tfi_ms1000")
COST_ALL = (*COST_NAMES, "own_side_queue", "opp_queue", "ahead", "ahead_frac", "tleft_s", "at_touch", "latency_ms")
CPF_SQL = f"""{sim_plans.CP_SQL} SELECT c3.instrument_id, c3.date, decision_id, latency_ms, deadline_s, queue_model, CAST(j AS BIGINT) AS j, CASE WHEN s = 1 THEN b.bd[1] ELSE b.ad[1] END AS own_side_queue, CASE WHEN s = 1 THEN b.ad[1] ELSE b.bd[1] END AS opp_queue, round(c3.ahead / greatest(CASE WHEN s = 1 THEN b.bd[1] ELSE b.ad[1] END, 1), 9) AS ahead_frac,
round(CASE WHEN b.bd[1] + b.ad[1] > 0 THEN (b.bd[1] - b.ad[1]) / (b.bd[1] + b.ad[1]) ELSE 0 END * s, 9) AS imbalance FROM c3 JOIN b ON b.instrument_id = c3.instrument_id AND b.date = c3.date AND b.sequence = c3.cp_seq WHERE b.bid_px IS NOT NULL AND b.ask_px IS NOT NULL"""


@catalog.add("checkpoint_features", CPF_SQL)
def checkpoint_features(spark, sf):
    market = features.with_features(sim_plans.books(spark, sf)).filter("mid IS NOT NULL")
    rows = policies.checkpoint_features(sim_plans.checkpoints(spark, sf), market, ["imbalance"])
    return rows.select(*ORDER, *CELL, "queue_model", "j", F.col("own_side_queue").cast("long").alias("own_side_queue"), F.col("opp_queue").cast("long").alias("opp_queue"), F.round("ahead_frac", 9).alias("ahead_frac"), F.round("imbalance", 9).alias("imbalance"))


def _tables(spark, sf):
    """Book, features with targets, and checkpoints, each written once: later plans start from tables."""
    frame = stored(book.book_frame(l2_events(spark, sf)), "book")
    names = dict.fromkeys([*NAMES, *COST_NAMES, "bid_queue", "ask_queue", "mid"])
    market = targets.with_targets(features.with_features(frame)).select(*DAY, "sequence", *names, F.col("next_dir").alias("y"))
    orders = stored(simulator.simulate(sim_plans.made(spark, sf), frame, SIM), "orders")
    return frame, stored(market, "market"), stored(simulator.checkpoint_rows(orders, frame, SIM), "checkpoints")


def _roles(market):
    """Folds of the days: strategies are judged on every day that is some fold's test day."""
    return stored(models.folds(market, FEW), "folds")


def _test_days(made):
    return F.broadcast(made.filter("role = 'test'").select("date"))


def _by_direction(cps, market, made):
    """Checkpoints of the test days with the probability of an adverse move and the threshold of their cell.

    Fold by fold: the model learns on the days before, probabilities and
    thresholds come from the calibration day. A missing feature gives 0.5.
    """
    parts = []
    for fold in models.fold_numbers(made):
        train = market.join(models.days_of(made, fold, "train"), "date").na.drop(subset=[*models.LOGISTIC, "y"])
        rows = models.probability(models.logistic().fit(train), market.join(models.days_of(made, fold, "calibrate", "test"), "date"), models.LOGISTIC, "raw")
        rows = models.calibrated(rows.filter("role = 'calibrate'").na.drop(subset=["y"]), rows, "raw", "p_up").select(*DAY, F.col("sequence").alias("cp_seq"), "p_up")
        own = cps.join(models.days_of(made, fold, "calibrate", "test"), "date").join(rows, [*DAY, "cp_seq"], "left")
        own = stored(own.withColumn("p_adverse", F.coalesce(F.when(F.col("order_side") > 0, F.col("p_up")).otherwise(1 - F.col("p_up")), F.lit(0.5))), "direction")
        theta = policies.tune(own.filter("role = 'calibrate'"), F.col("p_adverse"), SIM)
        parts.append(own.filter("role = 'test'").join(theta, [*policies.CELL], "left").withColumn("theta", F.coalesce("theta", F.lit(max(SIM.thresholds)))).drop("role"))
    return reduce(DataFrame.unionByName, parts)


def _by_cost(cps, market, made):
    """Checkpoints of the test days with the predicted cost of waiting, by a model for each fold and queue model; null where a feature is missing.

    Each model has all rounds of the settings. The fits wait for Spark's small
    jobs most of the time, so several run side by side.
    """
    two_sided = market.filter("mid IS NOT NULL")
    rows = policies.with_cost_to_go(policies.checkpoint_features(cps, two_sided, list(COST_NAMES))).withColumn("label", F.col("label").cast("double"))
    rows = stored(rows.na.drop(subset=[*COST_ALL]).select(*ORDER, *CELL, "queue_model", "j", "label", *(n for n in COST_ALL if n not in CELL)), "cost-rows")
    keys = [*ORDER, *CELL, "queue_model", "j"]

    def predicted(fold, queue_model):
        own = rows.filter(F.col("queue_model") == queue_model)
        train = own.join(models.days_of(made, fold, "train"), "date").filter("label IS NOT NULL")
        model = models.boosted_cost(COST_ALL, rounds=DEFAULT.cost_rounds).fit(train)
        return stored(model.transform(own.join(models.days_of(made, fold, "test"), "date")).select(*keys, "prediction"), "predicted-cost")

    with ThreadPoolExecutor(FITS) as pool:
        parts = [*pool.map(predicted, *zip(*product(models.fold_numbers(made), QUEUE_MODELS), strict=True))]
    return cps.join(_test_days(made), "date").join(reduce(DataFrame.unionByName, parts), keys, "left")


def _give_up_by_cost(cps, market, made):
    return policies.abandon(_by_cost(cps, market, made), F.col("prediction") > SIM.cost_margin_ticks, SIM, "model_cost")


@catalog.add("cost_model")
def cost_model(spark, sf):
    """Cost of waiting against its prediction at the checkpoints of the test days."""
    _, market, cps = _tables(spark, sf)
    rows = policies.with_cost_to_go(_by_cost(cps, market, _roles(market))).filter("label IS NOT NULL AND prediction IS NOT NULL")
    return rows.select(*ORDER, *CELL, "queue_model", "j", "label", "prediction")


def _give_up_by_direction(cps, market, made):
    return policies.abandon(_by_direction(cps, market, made), F.col("p_adverse") > F.col("theta"), SIM, "model_direction")


@catalog.add("strat_direction")
def strat_direction(spark, sf):
    """Orders of the test days given up where the price is likely to move away."""
    _, market, cps = _tables(spark, sf)
    return _give_up_by_direction(cps, market, _roles(market)).select(*ORDER, *CELL, "queue_model", "cost_ticks", "order_type")


@catalog.add("strat_cost")
def strat_cost(spark, sf):
    """Orders of the test days given up where the predicted cost of waiting is positive; none is lost for a missing feature."""
    _, market, cps = _tables(spark, sf)
    return _give_up_by_cost(cps, market, _roles(market)).select(*ORDER, *CELL, "queue_model", "cost_ticks", "order_type")


@catalog.add("simulate")
def simulate(spark, sf):
    """The trade log of all six strategies on the same orders of the test days, with fees."""
    frame, market, cps = _tables(spark, sf)
    made = _roles(market)
    test = cps.join(_test_days(made), "date")
    orders = policies.orders_of(test)
    fresh = simulator.simulate_new_level(sim_plans.made(spark, sf).join(_test_days(made), "date"), frame.join(_test_days(made), "date"), SIM)
    parts = [
        policies.always_cross(orders, SIM), policies.always_post(orders, SIM), _give_up_by_direction(cps, market, made),
        _give_up_by_cost(cps, market, made), policies.new_level(fresh), policies.oracle(test),
    ]
    # Each strategy is written by itself: six plans of their own size instead of one of all.
    return policies.with_fees(policies.union_log([stored(p.select(*policies.LOG), "log") for p in parts]), SIM)
