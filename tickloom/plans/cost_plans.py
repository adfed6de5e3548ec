"""Queries over trade logs: cost tables, paired statistics, diagnostics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import stats
from tickloom.plans.registry import Catalog
from tickloom.schema import DEFAULT, STRATEGIES
from tickloom.sources.fixtures import MINI_LOG_SQL, MINI_POSTS_SQL, mini_log, mini_posts

catalog = Catalog()
CELL = "queue_model, latency_ms, deadline_s"
HEAD = "queue_model = 'proportional' AND latency_ms = 10 AND deadline_s = 15"
REGIME = "minutes_since_open, vol_300s, own_queue, spread_ticks"
#: The reference count of resamples is 2000; the whole grid is drawn with fewer here.
GRID = DEFAULT.override(bootstrap_reps=200)


def R(x: str, places: int = 8) -> str:  # noqa: N802
    return f"round({x}, {places})"


def rounded(df, *names, places: int = 8):
    return df.withColumns({n: F.round(n, places) for n in names})


@catalog.add(
    "cost_table",
    f"""WITH {MINI_LOG_SQL} SELECT {CELL}, strategy, count(*) AS n, {R('avg(cost_ticks)')} AS mean_cost_ticks, {R('stddev_samp(cost_ticks)')} AS sd_cost_ticks, quantile_cont(cost_ticks, 0.1) AS p10_cost_ticks, median(cost_ticks) AS median_cost_ticks,
quantile_cont(cost_ticks, 0.9) AS p90_cost_ticks, {R('avg(cost_usd)')} AS mean_cost_usd, {R('avg(CASE WHEN filled_passive THEN 1.0 ELSE 0.0 END)')} AS passive_fill_rate, {R('avg(CASE WHEN filled_passive THEN time_to_fill_ms END)')} AS mean_ms_to_passive_fill,
{R('avg(time_to_fill_ms)')} AS mean_ms_to_done, {R('avg(adverse_1s)')} AS adverse_1s_ticks, {R('avg(adverse_5s)')} AS adverse_5s_ticks FROM mini_log WHERE NOT in_release_window GROUP BY ALL""",
)
def cost_table(spark, sf):
    names = ("mean_cost_ticks", "sd_cost_ticks", "mean_cost_usd", "passive_fill_rate", "mean_ms_to_passive_fill", "mean_ms_to_done", "adverse_1s_ticks", "adverse_5s_ticks")
    return rounded(stats.cost_table(mini_log(spark, sf)), *names)


@catalog.add("group_by_all", f"WITH {MINI_LOG_SQL} SELECT strategy, deadline_s, count(*) AS n, {R('avg(cost_ticks)')} AS mean_cost FROM mini_log GROUP BY ALL ORDER BY ALL")
def group_by_all(spark, sf):
    return spark.sql("SELECT strategy, deadline_s, count(*) AS n, round(avg(cost_ticks), 8) AS mean_cost FROM {log} GROUP BY ALL ORDER BY ALL", log=mini_log(spark, sf))


_WIDE = ", ".join(f"max(cost_ticks) FILTER (strategy = '{s}') AS {s}" for s in STRATEGIES)
WIDE_SQL = f"wide AS (SELECT date, decision_id, decision_ts, {CELL}, {REGIME}, {_WIDE} FROM mini_log WHERE NOT in_release_window GROUP BY ALL)"
REL_SQL = f"rel AS (SELECT date, decision_id, decision_ts, {CELL}, {REGIME}, {_WIDE} FROM mini_log WHERE in_release_window GROUP BY ALL)"


@catalog.add("paired_wide", f"WITH {MINI_LOG_SQL}, {WIDE_SQL} SELECT * FROM wide")
def paired_wide(spark, sf):
    return stats.paired(mini_log(spark, sf))


@catalog.add("headline_cell", f"WITH {MINI_LOG_SQL} SELECT date, decision_id, strategy, cost_ticks FROM mini_log WHERE {HEAD}")
def headline_cell(spark, sf):
    return stats.headline(mini_log(spark, sf)).select("date", "decision_id", "strategy", "cost_ticks")


def diff_sql(wide: str = "wide") -> str:
    return "diffs AS (" + " UNION ALL ".join(f"SELECT date, decision_ts, decision_id, {CELL}, '{s}' AS strategy, '{b}' AS vs, {b} - {s} AS diff FROM {wide}" for s, b in stats.PAIRS) + ")"


def boot_sql(reps: int) -> str:
    g = f"{CELL}, strategy, vs"
    return f"""d1 AS (SELECT {g}, date, sum(diff) AS s, count(*) AS c, row_number() OVER (PARTITION BY {g} ORDER BY date) - 1 AS slot, count(*) OVER (PARTITION BY {g}) AS n_days FROM diffs GROUP BY {g}, date),
d2 AS (SELECT {g}, rep, ('0x' || substr(md5(rep || '|' || slot), 1, 8))::BIGINT % n_days AS pick FROM d1, range({reps}) r(rep)),
d3 AS (SELECT d2.queue_model, d2.latency_ms, d2.deadline_s, d2.strategy, d2.vs, rep, sum(s) / sum(c) AS m FROM d2 JOIN d1 ON d1.queue_model = d2.queue_model AND d1.latency_ms = d2.latency_ms AND d1.deadline_s = d2.deadline_s AND d1.strategy = d2.strategy AND d1.vs = d2.vs AND d1.slot = d2.pick GROUP BY ALL),
boot AS (SELECT {g}, quantile_cont(m, 0.025) AS ci95_lo, quantile_cont(m, 0.975) AS ci95_hi FROM d3 GROUP BY ALL)"""


def hac_sql(lags: int) -> str:
    g = f"{CELL}, strategy, vs"
    return f"""h1 AS (SELECT {g}, decision_ts, decision_id, diff, diff - avg(diff) OVER (PARTITION BY {g}) AS e, row_number() OVER (PARTITION BY {g} ORDER BY decision_ts, decision_id) AS k FROM diffs),
h2 AS (SELECT {g}, sum(a.e * b.e * CASE WHEN a.k = b.k THEN 1 ELSE 2 * (1 - (a.k - b.k) / {lags + 1}.0::DOUBLE) END) AS g FROM h1 a JOIN h1 b USING ({g}) WHERE b.k BETWEEN a.k - {lags} AND a.k GROUP BY ALL),
h3 AS (SELECT {g}, count(*) AS n, avg(diff) AS mean, min(diff) AS lo, max(diff) AS hi FROM diffs GROUP BY ALL),
hac AS (SELECT {g}, CASE WHEN n >= 3 AND lo <> hi AND g > 0 THEN round(mean / sqrt(g / n / n), 6) END AS hac_t FROM h2 JOIN h3 USING ({g}))"""


def savings_sql(wide_cte: str, wide: str, reps: int, lags: int) -> str:
    g = f"{CELL}, strategy, vs"
    return f"""WITH {MINI_LOG_SQL}, {wide_cte}, {diff_sql(wide)}, {boot_sql(reps)}, {hac_sql(lags)},
a AS (SELECT {g}, count(*) AS n, count(DISTINCT date) AS test_days, avg(diff) AS saving FROM diffs GROUP BY ALL)
SELECT {g}, n, test_days, {R('saving')} AS saving_ticks, {R('ci95_lo')} AS ci95_lo, {R('ci95_hi')} AS ci95_hi, round(hac_t, 5) AS hac_t, {R('saving * 15.625')} AS saving_usd FROM a JOIN boot USING ({g}) JOIN hac USING ({g})"""


def _savings(spark, sf, release):
    out = rounded(stats.savings(stats.paired(mini_log(spark, sf), release), GRID), "saving_ticks", "ci95_lo", "ci95_hi", "saving_usd")
    return out.withColumn("hac_t", F.round("hac_t", 5))


catalog.add("savings_table", savings_sql(WIDE_SQL, "wide", 200, 50))(lambda spark, sf: _savings(spark, sf, False))
catalog.add("savings_release", savings_sql(REL_SQL, "rel", 200, 50))(lambda spark, sf: _savings(spark, sf, True))
_HEAD_WIDE = f"hw AS (SELECT * FROM wide WHERE {HEAD})"


@catalog.add("bootstrap_ci", f"WITH {MINI_LOG_SQL}, {WIDE_SQL}, {_HEAD_WIDE}, {diff_sql('hw')}, {boot_sql(2000)} SELECT strategy, vs, {R('ci95_lo')} AS ci95_lo, {R('ci95_hi')} AS ci95_hi FROM boot")
def bootstrap_ci(spark, sf):
    diff = stats.differences(stats.paired(stats.headline(mini_log(spark, sf))))
    return rounded(stats.bootstrap(diff, (*stats.CELL, "strategy", "vs"), DEFAULT.bootstrap_reps), "ci95_lo", "ci95_hi").select("strategy", "vs", "ci95_lo", "ci95_hi")


@catalog.add("hac_t", f"WITH {MINI_LOG_SQL}, {WIDE_SQL}, {diff_sql()}, {hac_sql(50)} SELECT {CELL}, strategy, vs, round(hac_t, 5) AS hac_t FROM hac")
def hac_t(spark, sf):
    diff = stats.differences(stats.paired(mini_log(spark, sf)))
    return stats.hac_t(diff, (*stats.CELL, "strategy", "vs"), ("decision_ts", "decision_id"), DEFAULT.hac_lags).withColumn("hac_t", F.round("hac_t", 5))


@catalog.add("fee_sensitivity", f"WITH {MINI_LOG_SQL}, c AS (SELECT strategy, avg(cost_ticks) AS m FROM mini_log WHERE NOT in_release_window AND {HEAD} GROUP BY strategy), b AS (SELECT m AS base FROM c WHERE strategy = 'always_cross') SELECT fee AS fee_per_side_usd, strategy, {R('m * 15.625 + fee')} AS mean_cost_usd, {R('(base - m) * 15.625')} AS saving_vs_always_cross_usd FROM c, b, (VALUES (1.0::DOUBLE), (2.5::DOUBLE), (4.0::DOUBLE)) f(fee)")
def fee_sensitivity(spark, sf):
    costs = stats.headline(mini_log(spark, sf)).filter("NOT in_release_window").groupBy("strategy").agg(F.avg("cost_ticks").alias("m"))
    base = costs.filter("strategy = 'always_cross'").select(F.col("m").alias("base"))
    rows = costs.crossJoin(F.broadcast(base)).withColumn("fee_per_side_usd", F.explode(F.array(*map(F.lit, DEFAULT.fees_usd))))  # six rows and one
    tick = DEFAULT.tick_value_usd
    return rounded(rows.select("fee_per_side_usd", "strategy", (F.col("m") * tick + F.col("fee_per_side_usd")).alias("mean_cost_usd"), ((F.col("base") - F.col("m")) * tick).alias("saving_vs_always_cross_usd")), "mean_cost_usd", "saving_vs_always_cross_usd")


@catalog.add("daily_costs", f"WITH {MINI_LOG_SQL} SELECT date, strategy, {R('avg(cost_ticks)')} AS mean_cost FROM mini_log WHERE NOT in_release_window AND {HEAD} GROUP BY ALL")
def daily_costs(spark, sf):
    return rounded(stats.headline(mini_log(spark, sf)).filter("NOT in_release_window").groupBy("date", "strategy").agg(F.avg("cost_ticks").alias("mean_cost")), "mean_cost")


@catalog.add(
    "queue_validation",
    f"""WITH {MINI_POSTS_SQL}, t AS (SELECT * FROM mini_posts WHERE queue_model = 'exact') SELECT p.queue_model, p.latency_ms, p.deadline_s, {R('avg(p.filled_passive::INT)')} AS fill_rate, {R('avg(t.filled_passive::INT)')} AS true_fill_rate,
{R('avg((p.filled_passive = t.filled_passive)::INT)')} AS fill_agreement, {R('avg(p.cost_ticks) - avg(t.cost_ticks)')} AS cost_bias_ticks, {R('avg(CASE WHEN p.filled_passive AND t.filled_passive THEN abs(p.time_to_fill_ms - t.time_to_fill_ms) END)')} AS mae_fill_time_ms
FROM mini_posts p JOIN t USING (date, decision_id, latency_ms, deadline_s) GROUP BY ALL""",
)
def queue_validation(spark, sf):
    return rounded(stats.queue_validation(mini_posts(spark, sf)), "fill_rate", "true_fill_rate", "fill_agreement", "cost_bias_ticks", "mae_fill_time_ms")


def buckets_sql(source: str, vol: str, queue: str, spread: str) -> str:
    return f"""cut AS (SELECT quantile_cont({vol}, 1/3.0::DOUBLE) AS c1, quantile_cont({vol}, 2/3.0::DOUBLE) AS c2, median({queue}) AS c3 FROM {source}),
bk AS (SELECT {source}.*, CASE WHEN minutes_since_open >= 0 AND minutes_since_open < 90 THEN 'open' WHEN minutes_since_open >= 90 AND minutes_since_open < 300 THEN 'midday' WHEN minutes_since_open >= 300 AND minutes_since_open < 390 THEN 'close' ELSE 'outside' END AS b_tod,
  CASE WHEN {vol} <= c1 THEN 'low' WHEN {vol} <= c2 THEN 'mid' ELSE 'high' END AS b_vol, CASE WHEN {queue} <= c3 THEN 'small' ELSE 'large' END AS b_queue, CASE WHEN {spread} <= 1 THEN '1 tick' ELSE 'wider' END AS b_spread_state FROM {source}, cut)"""


@catalog.add("add_buckets", f"WITH {MINI_LOG_SQL}, {WIDE_SQL}, {_HEAD_WIDE}, {buckets_sql('hw', 'vol_300s', 'own_queue', 'spread_ticks')} SELECT decision_id, b_tod AS tod, b_vol AS vol, b_queue AS queue, b_spread_state AS spread_state FROM bk")
def add_buckets(spark, sf):
    wide = stats.paired(stats.headline(mini_log(spark, sf)))
    return stats.buckets(wide, "vol_300s", "own_queue", "spread_ticks", "minutes_since_open").select("decision_id", "tod", "vol", "queue", "spread_state")


_EXEC_AVG = ", ".join([*(f"{R(f'avg({s})')} AS {s}" for s in STRATEGIES[:5]), f"{R('avg(always_cross - model_cost)')} AS model_cost_saving_vs_cross", f"{R('avg(always_post - model_cost)')} AS model_cost_saving_vs_post"])
_EXEC_DIMS = " UNION ALL ".join([*(f"SELECT '{d}' AS dimension, b_{d} AS bucket, * FROM bk" for d in ("tod", "vol", "queue", "spread_state")), "SELECT 'period', 'normal', * FROM bk"])
EXEC_SQL = f"""WITH {MINI_LOG_SQL}, {WIDE_SQL}, {REL_SQL}, {_HEAD_WIDE}, {buckets_sql('hw', 'vol_300s', 'own_queue', 'spread_ticks')},
x AS (SELECT dimension, bucket, {', '.join(STRATEGIES[:5])} FROM ({_EXEC_DIMS}) UNION ALL SELECT 'period', 'release', {', '.join(STRATEGIES[:5])} FROM rel WHERE {HEAD})"""


@catalog.add("execution_breakdown", f"{EXEC_SQL} SELECT dimension, bucket, count(*) AS n, {_EXEC_AVG} FROM x GROUP BY ALL HAVING count(*) >= 30")
def execution_breakdown(spark, sf):
    return rounded(stats.execution_breakdown(mini_log(spark, sf)), *STRATEGIES[:5], "model_cost_saving_vs_cross", "model_cost_saving_vs_post")


@catalog.add("best_worst_bucket", f"{EXEC_SQL}, g AS (SELECT dimension || '/' || bucket AS label, count(*) AS n, {R('avg(always_cross - model_cost)')} AS saving FROM x GROUP BY dimension, bucket HAVING count(*) >= 30) SELECT arg_max(label, (saving, label)) AS best, max(saving) AS best_saving, arg_min(label, (saving, label)) AS worst, min(saving) AS worst_saving FROM g WHERE n >= 100")
def best_worst_bucket(spark, sf):
    rows = rounded(stats.execution_breakdown(mini_log(spark, sf)), "model_cost_saving_vs_cross").filter("n >= 100").select(F.concat_ws("/", "dimension", "bucket").alias("label"), F.col("model_cost_saving_vs_cross").alias("saving"))
    key = F.struct("saving", "label")
    return rows.agg(F.max_by("label", key).alias("best"), F.max("saving").alias("best_saving"), F.min_by("label", key).alias("worst"), F.min("saving").alias("worst_saving"))


@catalog.add("robustness_counts", f"{savings_sql(WIDE_SQL, 'wide', 200, 50).replace('SELECT queue_model, latency_ms, deadline_s, strategy, vs, n, test_days', 'SELECT strategy AS st, vs AS v, ci95_lo AS lo, ci95_hi AS hi, n, test_days')}".replace("WITH mini_log", "WITH fin AS (WITH mini_log", 1) + ") SELECT st AS strategy, v AS vs, count(*) AS cells, count(*) FILTER (ci95_lo > 0) AS better, count(*) FILTER (ci95_hi < 0) AS worse FROM fin GROUP BY ALL")
def robustness_counts(spark, sf):
    """Cells by the sign of their interval; every cell has one, so no other statistic is worked out."""
    diff = stats.known_differences(stats.paired(mini_log(spark, sf)))
    out = rounded(stats.bootstrap(diff, (*stats.CELL, "strategy", "vs"), GRID.bootstrap_reps), "ci95_lo", "ci95_hi")
    return out.groupBy("strategy", "vs").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("ci95_lo") > 0).alias("better"), F.count_if(F.col("ci95_hi") < 0).alias("worse"))


@catalog.add("cost_cdf", f"WITH {MINI_LOG_SQL} SELECT strategy, cost_ticks, {R('max(cd)')} AS cdf FROM (SELECT strategy, cost_ticks, cume_dist() OVER (PARTITION BY strategy ORDER BY cost_ticks) AS cd FROM mini_log WHERE NOT in_release_window AND {HEAD}) GROUP BY ALL")
def cost_cdf(spark, sf):
    rows = stats.headline(mini_log(spark, sf)).filter("NOT in_release_window").groupBy("strategy", "cost_ticks").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("strategy")
    below = F.sum("c").over(w.orderBy("cost_ticks").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("strategy", "cost_ticks", F.round(below / F.sum("c").over(w), 8).alias("cdf"))


_MATRIX = ", ".join(f"{R(f'max(m) FILTER (latency_ms = {v})')} AS lat_{v}" for v in (0, 1, 10, 100))


@catalog.add("sensitivity_matrix", f"WITH {MINI_LOG_SQL}, {WIDE_SQL}, c AS (SELECT queue_model, deadline_s, latency_ms, avg(always_cross - model_cost) AS m FROM wide GROUP BY ALL) SELECT queue_model, deadline_s, {_MATRIX} FROM c GROUP BY ALL")
def sensitivity_matrix(spark, sf):
    wide = stats.paired(mini_log(spark, sf)).withColumn("d", F.col("always_cross") - F.col("model_cost"))
    out = wide.groupBy("queue_model", "deadline_s").pivot("latency_ms", list(DEFAULT.latencies_ms)).agg(F.avg("d"))
    return out.select("queue_model", "deadline_s", *(F.round(str(v), 8).alias(f"lat_{v}") for v in DEFAULT.latencies_ms))


@catalog.add("report_headline", f"WITH {MINI_LOG_SQL}, c AS (SELECT strategy, avg(cost_ticks) AS m, avg(CASE WHEN filled_passive THEN 1.0 ELSE 0.0 END) AS f, count(*) AS n FROM mini_log WHERE NOT in_release_window AND {HEAD} GROUP BY ALL) SELECT strategy, n, {R('m')} AS mean_cost_ticks, {R('f')} AS fill_rate, {R('max(m) FILTER (strategy = $$always_cross$$) OVER () - m')} AS saving_vs_cross FROM c")
def report_headline(spark, sf):
    costs = stats.cost_table(stats.headline(mini_log(spark, sf))).select("strategy", "n", F.col("mean_cost_ticks").alias("m"), F.col("passive_fill_rate").alias("f"))
    base = costs.filter("strategy = 'always_cross'").select(F.col("m").alias("base"))
    rows = costs.crossJoin(F.broadcast(base))  # six rows and one
    return rows.select("strategy", "n", F.round("m", 8).alias("mean_cost_ticks"), F.round("f", 8).alias("fill_rate"), F.round(F.col("base") - F.col("m"), 8).alias("saving_vs_cross"))
