"""Queries of the metric operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.operators import metrics as M
from saltmarsh.plans.views import reg

COST = 3.5
NET = "(SELECT *, gross_bps - 3.5 AS net_bps FROM trades)"
ORD = "date, order_key, line"
PF = "CASE WHEN coalesce(sum(CASE WHEN {v} < 0 THEN -{v} END), 0) > 0 THEN coalesce(sum(CASE WHEN {v} > 0 THEN {v} END), 0.0) / sum(CASE WHEN {v} < 0 THEN -{v} END) ELSE coalesce(sum(CASE WHEN {v} > 0 THEN {v} END), 0.0) END"
SHARPE = "CASE WHEN count({v}) >= 2 AND stddev_samp({v}) > 0 THEN avg({v}) / stddev_samp({v}) * sqrt(252) ELSE 0.0 END"
SORTINO = "CASE WHEN sqrt(avg(pow(least({v}, 0.0), 2))) > 0 THEN avg({v}) / sqrt(avg(pow(least({v}, 0.0), 2))) * sqrt(252) ELSE 0.0 END"


def _dd(key: str, value: str, src: str, order: str) -> str:
    return f"""SELECT {key}, least(0.0, min(e - greatest(0.0, p))) AS max_drawdown FROM (SELECT *, max(e) OVER (PARTITION BY {key} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS p FROM (
      SELECT *, sum({value}) OVER (PARTITION BY {key} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS e FROM {src})) GROUP BY {key}"""


def _net(v):
    return M.net(v.trades, COST)


reg(
    "d06_economic_metrics", lambda v: M.economic_metrics(_net(v), ["config"]),
    f"""SELECT * FROM (SELECT config, count(*) AS n, avg(net_bps) AS expectancy, count(*) FILTER (net_bps > 0) / count(*) AS hit_rate,
      CASE WHEN count(*) FILTER (net_bps > 0) > 0 AND count(*) FILTER (net_bps < 0) > 0 THEN avg(net_bps) FILTER (net_bps > 0) / avg(-net_bps) FILTER (net_bps < 0) ELSE 0.0 END AS payoff, {PF.format(v='net_bps')} AS profit_factor FROM {NET} GROUP BY config)
      JOIN ({_dd('config', 'net_bps', NET, ORD)}) USING (config)
      JOIN (SELECT config, {SHARPE.format(v='d')} AS daily_sharpe, {SORTINO.format(v='d')} AS daily_sortino FROM (SELECT config, date, sum(net_bps) AS d FROM {NET} GROUP BY 1, 2) GROUP BY 1) USING (config)""",
    "config n", "expectancy hit_rate payoff profit_factor max_drawdown daily_sharpe daily_sortino",
)
reg("d07_max_drawdown", lambda v: M.drawdown(_net(v), ["side"], "net_bps", ["date", "order_key", "line"]), _dd("side", "net_bps", NET, ORD), "side", "max_drawdown")
reg(
    "d08_sharpe_sortino", lambda v: _net(v).groupBy("fold", "date").agg(F.sum("net_bps").alias("day")).groupBy("fold").agg(M.sharpe_of(F.col("day")).alias("sharpe"), M.sortino_of(F.col("day")).alias("sortino")),
    f"SELECT fold, {SHARPE.format(v='d')} AS sharpe, {SORTINO.format(v='d')} AS sortino FROM (SELECT fold, date, sum(net_bps) AS d FROM {NET} GROUP BY 1, 2) GROUP BY 1",
    "fold", "sharpe sortino",
)
reg("d09_contribution", lambda v: M.contribution(_net(v), "config"), f"SELECT config, sum(net_bps) AS total, coalesce(abs(sum(net_bps)) / nullif(abs(sum(sum(net_bps)) OVER ()), 0), 0.0) AS share FROM {NET} GROUP BY 1", "config", "total share")
reg("d10_concentration", lambda v: M.concentration(v.trades, ["fold"], "config"), "SELECT fold, count(*) AS distinct_names, max(n) / sum(n) AS max_share, CAST(sum(n) AS BIGINT) AS n FROM (SELECT fold, config, count(*) AS n FROM trades GROUP BY 1, 2) GROUP BY 1", "fold distinct_names n", "max_share")
reg(
    "d11_outcomes", lambda v: M.outcome_table(_net(v), ["config"], "side", "net_bps", ["A", "N", "R"]),
    f"SELECT config, count(*) AS n, avg(net_bps) AS ev, {PF.format(v='net_bps')} AS pf, " + ", ".join(f"count(*) FILTER (side = '{k}') AS n_{k}, avg(net_bps) FILTER (side = '{k}') AS ev_{k}" for k in "ANR") + f" FROM {NET} GROUP BY 1",
    "config n n_A n_N n_R", "ev pf ev_A ev_N ev_R",
)
reg(
    "d12_folds", lambda v: M.folds(_net(v), ["side"], "net_bps"),
    f"""SELECT side, fold, count(*) AS n, avg(net_bps) AS ev, 'bucket' AS kind FROM (SELECT t.side, t.net_bps, CAST(floor((d.r - 1) / 5) AS BIGINT) AS fold FROM {NET} t JOIN (SELECT side, date, row_number() OVER (PARTITION BY side ORDER BY date) AS r FROM (SELECT DISTINCT side, date FROM trades)) d USING (side, date)) GROUP BY 1, 2
      UNION ALL SELECT side, CAST(year(date) AS BIGINT), count(*), avg(net_bps), 'year' FROM {NET} GROUP BY 1, 2""",
    "side fold n kind", "ev",
)
reg(
    "d13_candidate_summary", lambda v: M.candidate_summary(_net(v), "config", "net_bps"),
    f"SELECT config, CAST(sum(n) AS BIGINT) AS n, min(s / n) AS worst_fold, avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END) AS positive_folds, sum(s) / sum(n) AS ev FROM (SELECT config, fold, count(*) AS n, sum(net_bps) AS s FROM {NET} GROUP BY 1, 2) GROUP BY 1",
    "config n", "worst_fold positive_folds ev",
)
reg(
    "d14_cost_scenarios", lambda v: M.cost_scenarios(v.trades, ["fold"], "gross_bps", [2, 3, 5, 8], 40.0, 30.0),
    f"SELECT fold, cost, count(*) AS n, avg(x) AS ev, {PF.format(v='x')} AS pf, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, (30 + cost) / 70 AS breakeven FROM (SELECT *, gross_bps - cost AS x FROM trades, (SELECT unnest([2.0, 3.0, 5.0, 8.0])::DOUBLE AS cost)) GROUP BY fold, cost",
    "fold cost n", "ev pf hit_rate breakeven",
)
reg(
    "d15_fill_rates", lambda v: M.fill_rates(v.trades.withColumn("ratio", F.col("quantity") / 25).withColumn("vol", F.pmod("order_key", F.lit(100)) / 100), ["side"], "ratio", "vol"),
    "SELECT side, count(*) AS n, count(*) FILTER (quantity / 25 >= 0.75) AS liquid, count(*) FILTER (quantity / 25 >= 0.75 AND (order_key % 100) / 100 <= 0.5) AS liquid_low_vol, count(*) FILTER (quantity / 25 >= 0.75) / count(*) AS fill_rate, count(*) FILTER (NOT quantity / 25 >= 0.75) AS missed FROM trades GROUP BY 1",
    "side n liquid liquid_low_vol missed", "fill_rate",
)
reg(
    "d16_breakdowns", lambda v: M.breakdowns(_net(v).withColumn("month", F.month("date").cast("long")), ["side", "status", "fold", "month"], "net_bps"),
    " UNION ALL ".join(f"SELECT '{d}' AS dim, CAST({e} AS VARCHAR) AS level, count(*) AS n, avg(net_bps) AS ev FROM {NET} GROUP BY {e}" for d, e in (("side", "side"), ("status", "status"), ("fold", "fold"), ("month", "month(date)"))),
    "dim level n", "ev",
)
reg(
    "d17_distribution", lambda v: M.distribution(_net(v), ["side"], "net_bps", ["order_key", "line"]),
    "SELECT side, " + ", ".join(f"s[CAST(floor({q} * (len(s) - 1)) AS BIGINT) + 1] AS {n}" for q, n in ((0.0, "lowest"), (0.05, "p05"), (0.5, "median"), (0.95, "p95"), (1.0, "highest"))) + f" FROM (SELECT side, list(net_bps ORDER BY net_bps) AS s FROM {NET} GROUP BY 1)",
    "side", "lowest p05 median p95 highest",
)
reg(
    "d18_streaks", lambda v: M.streaks(v.trades, ["config"], "gross_bps", ["date", "order_key", "line"]),
    f"""SELECT config, coalesce(max(n) FILTER (s = 1), 0) AS win_streak, coalesce(max(n) FILTER (s = -1), 0) AS loss_streak FROM (SELECT config, run, any_value(s) AS s, count(*) AS n FROM (
      SELECT *, sum(new) OVER (PARTITION BY config ORDER BY {ORD} ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN s = lag(s) OVER (PARTITION BY config ORDER BY {ORD}) THEN 0 ELSE 1 END AS new FROM (SELECT *, sign(gross_bps) AS s FROM trades))) GROUP BY 1, 2) GROUP BY 1""",
    "config win_streak loss_streak",
)
reg(
    "d19_binary_scores", lambda v: M.binary_scores(v.scores, ["symbol"], "p", "y"),
    """SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall FROM (
      SELECT symbol, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) AS n FROM scores GROUP BY 1))""",
    "symbol tp fp fn n", "precision recall f1",
)
reg(
    "d20_calibration", lambda v: M.calibration(v.scores, ["symbol"], "p", "y"),
    "SELECT symbol, sum(sq) / sum(n) AS brier, sum(abs(sp - sy)) / sum(n) AS ece, CAST(sum(n) AS BIGINT) AS n FROM (SELECT symbol, least(floor(p * 10), 9) AS b, count(*) AS n, sum(p) AS sp, sum(y) AS sy, sum(pow(p - y, 2)) AS sq FROM scores GROUP BY 1, 2) GROUP BY 1",
    "symbol n", "brier ece",
)
reg(
    "d21_by_side", lambda v: M.by_side(_net(v), "side", "net_bps", "config"),
    f"SELECT coalesce(side, 'all') AS side, count(*) AS n, avg(net_bps) AS ev, count(DISTINCT config) AS names, CAST(grouping(side) AS BIGINT) AS is_total FROM {NET} GROUP BY ROLLUP (side)",
    "side n names is_total", "ev",
)
reg(
    "d36_drift", lambda v: M.drift(v.bars.where("slot >= 12"), v.bars.where("slot < 12"), ["open", "high", "low", "close", "volume"]),
    "SELECT *, z >= 3 AS alert FROM (SELECT c AS feature, mean_live, mean_ref, coalesce(abs(mean_live - mean_ref) / nullif(sd_ref, 0), 0.0) AS z FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS c, avg({c}) FILTER (slot >= 12) AS mean_live, avg({c}) FILTER (slot < 12) AS mean_ref, stddev_pop({c}) FILTER (slot < 12) AS sd_ref FROM bars" for c in ("open", "high", "low", "close", "volume")) + "))",
    "feature alert", "mean_live mean_ref z",
)
reg(
    "d37_rank_ic", lambda v: M.rank_ic(v.panel, "date", "value", "n"),
    "SELECT date, count(*) AS n, corr(a, b) AS ic FROM (SELECT date, rank() OVER (PARTITION BY date ORDER BY value) + (count(*) OVER (PARTITION BY date, value) - 1) / 2 AS a, rank() OVER (PARTITION BY date ORDER BY n) + (count(*) OVER (PARTITION BY date, n) - 1) / 2 AS b FROM panel) GROUP BY 1",
    "date n", "ic",
)
reg("d41_null_rates", lambda v: M.null_rates(v.bars.withColumn("gap", F.when(F.col("slot") > 0, F.col("close"))), ["open", "gap"]), "SELECT 'open' AS feature, avg(CASE WHEN open IS NULL THEN 1.0 ELSE 0.0 END) AS rate FROM bars UNION ALL SELECT 'gap', avg(CASE WHEN slot > 0 THEN 0.0 ELSE 1.0 END) FROM bars", "feature", "rate")
reg(
    "d42_feature_coverage", lambda v: M.feature_coverage(v.bars.withColumn("gap", F.when(F.col("slot") > 0, F.col("close"))), ["volume", "gap"]),
    "SELECT *, present >= 0.95 AS eligible FROM (SELECT 'volume' AS feature, count(volume) / count(*) AS present, count(*) FILTER (volume <> 0) / count(*) AS nonzero FROM bars UNION ALL SELECT 'gap', count(*) FILTER (slot > 0) / count(*), count(*) FILTER (slot > 0 AND close <> 0) / count(*) FROM bars)",
    "feature eligible", "present nonzero",
)
reg(
    "d43_ledger_summary", lambda v: v.trades.groupBy("config").agg(F.count("*").alias("n_trades"), F.count_if(F.col("status") == "O").alias("n_open"), F.count_if(F.col("status") == "F").alias("n_closed"), F.sum(F.when(F.col("status") == "F", F.col("gross_bps"))).alias("pnl"), F.max(F.abs("gross_bps")).alias("worst")),
    "SELECT config, count(*) AS n_trades, count(*) FILTER (status = 'O') AS n_open, count(*) FILTER (status = 'F') AS n_closed, sum(gross_bps) FILTER (status = 'F') AS pnl, max(abs(gross_bps)) AS worst FROM trades GROUP BY 1",
    "config n_trades n_open n_closed", "pnl worst",
)
reg(
    "d45_halts", lambda v: M.halts(_net(v), ["config"], "net_bps", ["date", "order_key", "line"], 1000.0, 0.1),
    f"""SELECT d.config, max_drawdown, max_drawdown <= -100 AS halted, full3 AND lost AS loss_streak FROM ({_dd('config', 'net_bps', NET, ORD)}) d JOIN (SELECT config, count(*) = 3 AS full3, bool_and(net_bps < 0) AS lost FROM (
      SELECT *, row_number() OVER (PARTITION BY config ORDER BY date DESC, order_key DESC, line DESC) AS r FROM {NET}) WHERE r <= 3 GROUP BY 1) USING (config)""",
    "config halted loss_streak", "max_drawdown",
)
reg(
    "d46_summary_deltas", lambda v: _net(v).groupBy("side").agg(F.sum("net_bps").alias("net_sum"), F.count("*").alias("n")).crossJoin(F.broadcast(_net(v).agg((F.sum("net_bps") / 3).alias("ref")))).withColumn("delta", F.try_divide(F.col("net_sum") - F.col("ref"), F.abs("ref"))).withColumn("within", F.abs("delta") <= 0.1),
    f"SELECT *, abs(delta) <= 0.1 AS within FROM (SELECT side, n, net_sum, (net_sum - ref) / nullif(abs(ref), 0) AS delta FROM (SELECT side, count(*) AS n, sum(net_bps) AS net_sum FROM {NET} GROUP BY 1), (SELECT sum(net_bps) / 3 AS ref FROM {NET}))",
    "side n within", "net_sum delta",
)
reg(
    "d47_paired_test", lambda v: M.paired_test(v.trades, ["config"], "gross_bps", "quantity"),
    "SELECT config, n, mean_diff, CASE WHEN sd / sqrt(n) > 0 THEN mean_diff / (sd / sqrt(n)) ELSE 0.0 END AS t_stat, mean_diff - 1.96 * sd / sqrt(n) AS ci_low, mean_diff + 1.96 * sd / sqrt(n) AS ci_high FROM (SELECT config, count(*) AS n, avg(gross_bps - quantity) AS mean_diff, coalesce(stddev_samp(gross_bps - quantity), 0.0) AS sd FROM trades GROUP BY 1)",
    "config n", "mean_diff t_stat ci_low ci_high",
)
_Z = "1.959963984540054"
reg(
    "d47_wilson", lambda v: M.wilson(v.trades, ["config"], F.col("gross_bps") > 0),
    f"SELECT config, hits, n, greatest(0.0, (p + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) - {_Z} * sqrt((p * (1 - p) + {_Z} * {_Z} / (4 * n)) / n) / (1 + {_Z} * {_Z} / n)) AS low, least(1.0, (p + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) + {_Z} * sqrt((p * (1 - p) + {_Z} * {_Z} / (4 * n)) / n) / (1 + {_Z} * {_Z} / n)) AS high FROM (SELECT config, count(*) FILTER (gross_bps > 0) AS hits, count(*) AS n, count(*) FILTER (gross_bps > 0)::DOUBLE / count(*) AS p FROM trades GROUP BY 1)",
    "config hits n", "low high",
)
def _bootstrap_sql(statistic: str, block: str) -> str:
    return f"""WITH days AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY side) AS days FROM (SELECT side, date, sum(net_bps) AS s, count(*) AS n FROM {NET} GROUP BY 1, 2)),
      slots AS (SELECT side, rep, i AS slot, days, {block} AS block FROM days, range(100) r(rep)),
      drawn AS (SELECT side, rep, {statistic} AS mean FROM (SELECT side, rep, ('0x' || substr(sha256('42,' || rep || ',' || slot // block), 1, 8))::BIGINT % (days - block + 1) + slot % block AS i FROM slots) q JOIN days e USING (side, i) GROUP BY 1, 2)
      SELECT side, max(mean) FILTER (k = 4) AS ci_low, max(mean) FILTER (k = 94) AS ci_high FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY mean, rep) - 1 AS k FROM drawn) GROUP BY 1"""


reg("d48_day_bootstrap", lambda v: M.bootstrap(_net(v), ["side"], "date", "net_bps", 100, 0.9), _bootstrap_sql("sum(e.s) / sum(e.n)", "1"), "side", "ci_low ci_high")
reg("d48_block_bootstrap", lambda v: M.bootstrap(_net(v), ["side"], "date", "net_bps", 100, 0.9, "mean", moving_block=True), _bootstrap_sql("avg(e.s)", "CAST(floor(sqrt(days)) AS BIGINT)"), "side", "ci_low ci_high")
reg("d48_sharpe_bootstrap", lambda v: M.bootstrap(_net(v), ["side"], "date", "net_bps", 100, 0.9, "sharpe"), _bootstrap_sql("CASE WHEN stddev_samp(e.s) > 0 THEN avg(e.s) / stddev_samp(e.s) * sqrt(252) ELSE 0 END", "1"), "side", "ci_low ci_high")
reg(
    "d19_confusion_matrix",
    lambda v: M.confusion(v.trades.withColumn("actual", F.sign("gross_bps").cast("int")).withColumn("predicted", F.sign(F.col("quantity") - 25).cast("int")), ["side"], "actual", "predicted", [-1, 0, 1]),
    """WITH t AS (SELECT side, CAST(sign(gross_bps) AS INT) AS a, CAST(sign(quantity - 25) AS INT) AS p FROM trades),
      c AS (SELECT s.side, k.class, count(*) FILTER (a = k.class AND p = -1) AS as_0, count(*) FILTER (a = k.class AND p = 0) AS as_1, count(*) FILTER (a = k.class AND p = 1) AS as_2,
        count(*) FILTER (a = k.class AND p = k.class) AS tp, count(*) FILTER (a = k.class) AS n_a, count(*) FILTER (p = k.class) AS n_p FROM t s, (SELECT unnest([-1, 0, 1]) AS class) k GROUP BY 1, 2),
      r AS (SELECT *, CASE WHEN n_p > 0 THEN tp / n_p ELSE 0 END AS precision, CASE WHEN n_a > 0 THEN tp / n_a ELSE 0 END AS recall FROM c),
      f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r)
      SELECT *, avg(precision) OVER w AS macro_precision, avg(recall) OVER w AS macro_recall, avg(f1) OVER w AS macro_f1 FROM f WINDOW w AS (PARTITION BY side)""",
    "side class as_0 as_1 as_2", "precision recall f1 macro_precision macro_recall macro_f1",
)
reg(
    "d49_activity_band", lambda v: M.activity_band(v.trades.groupBy("side", "date").agg(F.count("*").alias("c")), "side", "date", "c", 60, 100),
    "SELECT CAST(floor(quantile_cont(s, 0.005)) AS BIGINT) AS low, CAST(ceil(quantile_cont(s, 0.995)) AS BIGINT) AS high, count(*) AS n_windows, count(*) >= 100 AS enough FROM (SELECT sum(c) OVER w AS s, count(*) OVER w AS k FROM (SELECT side, date, count(*) AS c FROM trades GROUP BY 1, 2) WINDOW w AS (PARTITION BY side ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) WHERE k = 60",
    "low high n_windows enough",
)
reg("d50_baseline", lambda v: v.trades.groupBy("fold").agg(F.avg("gross_bps").alias("mean_return"), F.count("*").alias("n")), "SELECT fold, avg(gross_bps) AS mean_return, count(*) AS n FROM trades GROUP BY 1", "fold n", "mean_return")
reg("b34_reprice", lambda v: M.net(v.trades, 8.0), "SELECT *, gross_bps - 8.0 AS net_bps FROM trades", "order_key line", "gross_bps net_bps")
