"""Backtest, metric and event-study queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest, decisions, signals, studies
from ..plans import views
from .base import BARS, FILLS, GRID, num, register, when
from .decisions import LIMITS, TARGETS, rebalance_inputs
from .signals import MOMENTUM, REGIME

BENCH = views.BENCHMARK


def weights(spark, root):
    """Two runs: return-proportional targets, and equal weights on rising symbols."""
    expected, prices, equity, _ = rebalance_inputs(spark, root)
    sized = decisions.targets(decisions.candidates(expected, prices, LIMITS), equity, LIMITS)
    rising = expected.filter("expected_return > 0")
    count = rising.groupBy("rebalance").agg(F.count("*").alias("_n"))
    equal = rising.join(count, "rebalance").select(
        F.lit("equal").alias("run"), F.col("rebalance").alias("ts"), "symbol",
        (F.lit(0.95) / F.col("_n")).alias("weight"))
    return sized.select(F.lit("proportional").alias("run"), F.col("rebalance").alias("ts"),
                        "symbol", "weight").unionByName(equal)


def curve(spark, root):
    return backtest.backtest(weights(spark, root), views.bars(spark, root), 2.0, 30)


WEIGHTS = f"""{TARGETS}, weights AS (
  SELECT 'proportional' AS run, ts, symbol, weight FROM wanted
  UNION ALL SELECT 'equal', ts, symbol, 0.95 / count(*) OVER (PARTITION BY ts) FROM m WHERE er > 0)"""
CURVE = f"""{WEIGHTS}, full_grid AS (
  SELECT r.run, n.ts, n.symbol, n.bar_no, n.price,
    CASE WHEN n.bar_no > 30 THEN w.weight END AS weight
  FROM n CROSS JOIN (SELECT DISTINCT run FROM weights) r
  LEFT JOIN weights w ON w.run = r.run AND w.ts = n.ts AND w.symbol = n.symbol),
moved AS (SELECT run, ts, symbol, bar_no,
    price / lag(price) OVER k - 1 AS r, lag(weight, 1) OVER k AS w1, lag(weight, 2) OVER k AS w2
  FROM full_grid WINDOW k AS (PARTITION BY run, symbol ORDER BY ts)),
steps AS (SELECT run, bar_no, ts, coalesce(sum(w2 * coalesce(r, 0)), 0) AS gross_return,
    sum(abs(coalesce(w1, 0) - coalesce(w2, 0))) AS turnover, coalesce(sum(w2), 0) AS exposure,
    coalesce(max(w2), 0) AS concentration FROM moved GROUP BY ALL),
net AS (SELECT *, turnover * 2.0 / 1e4 AS cost, gross_return - turnover * 2.0 / 1e4 AS net_return FROM steps),
curve AS (SELECT *, 100 * exp(sum(ln(1 + net_return)) OVER (PARTITION BY run ORDER BY bar_no)) AS equity FROM net),
hold AS (SELECT ts, price / first_value(price) OVER (ORDER BY ts) * 100 AS benchmark
  FROM bars WHERE symbol = '{BENCH}')"""


@register("weight_backtest", f"""WITH {CURVE} SELECT run, bar_no, {when('ts', 'ts')},
  {', '.join(num(c, c) for c in ('gross_return', 'turnover', 'exposure', 'concentration', 'cost', 'net_return'))},
  {num('ln(equity)', 'log_equity')} FROM curve""")
def _backtest(spark, root):
    return curve(spark, root).withColumn("log_equity", F.log("equity")).drop("equity")


@register("benchmark_curve", f"""WITH {BARS} SELECT {when('ts', 'ts')},
  {num('price / first_value(price) OVER (ORDER BY bars.ts) * 100', 'benchmark')} FROM bars WHERE symbol = '{BENCH}'""")
def _benchmark(spark, root):
    return backtest.benchmark_curve(views.bars(spark, root), BENCH)


@register("performance_metrics", f"""WITH {CURVE}, d AS (
  SELECT *, equity / max(equity) OVER (PARTITION BY run ORDER BY bar_no) - 1 AS drawdown
  FROM curve LEFT JOIN hold USING (ts))
SELECT run, count(*) AS n_bars, {num('ln(arg_max(equity, ts) / arg_min(equity, ts))', 'log_total_return')},
  {num('arg_max(benchmark, ts) / arg_min(benchmark, ts) - 1', 'benchmark_return')},
  {num('stddev_samp(net_return) * sqrt(252)', 'volatility')},
  {num('avg(net_return) / stddev_samp(net_return) * sqrt(252)', 'sharpe')},
  {num('avg(net_return) / sqrt(avg(least(net_return, 0) ** 2)) * sqrt(252)', 'sortino')},
  {num('min(drawdown)', 'max_drawdown')},
  {num('count(*) FILTER (net_return > 0) / count(*) FILTER (net_return <> 0)', 'hit_rate')},
  {num('avg(net_return) FILTER (net_return > 0)', 'avg_win')},
  {num('avg(net_return) FILTER (net_return < 0)', 'avg_loss')}, {num('avg(turnover)', 'avg_turnover')},
  {num('avg(exposure)', 'avg_exposure')}, {num('max(concentration)', 'max_concentration')},
  {num('sum(cost)', 'cost_drag')},
  {num('ln(1 + arg_max(equity, ts) / arg_min(equity, ts) - arg_max(benchmark, ts) / arg_min(benchmark, ts))', 'log_excess_return')}
FROM d GROUP BY run""")
def _performance(spark, root):
    rows = backtest.performance(curve(spark, root),
                                backtest.benchmark_curve(views.bars(spark, root), BENCH))
    return rows.withColumns({"log_total_return": F.log1p("total_return"),
                             "log_excess_return": F.log1p("excess_return")}
                            ).drop("total_return", "excess_return")


@register("performance_by_regime", f"""WITH {CURVE.replace(GRID, REGIME)}, l AS (
  SELECT c.*, risk_on FROM curve c LEFT JOIN regime USING (ts))
SELECT run, {num('risk_on', 'regime_risk_on')}, CAST(grouping(run, risk_on) AS BIGINT) AS level,
  count(*) AS n, {num('avg(net_return)', 'mean_return')}, {num('stddev_samp(net_return)', 'deviation')},
  {num('avg(CASE WHEN net_return > 0 THEN 1 ELSE 0 END)', 'hit_rate')}
FROM l GROUP BY GROUPING SETS ((run, risk_on), (run), ())""")
def _by_regime(spark, root):
    regime = signals.regime_features(views.bars(spark, root), BENCH)
    return backtest.performance_by(curve(spark, root), regime, "regime_risk_on")


@register("day_boundaries", f"""WITH {CURVE}, t AS (
  SELECT *, date_trunc('month', ts) AS mon FROM curve)
SELECT run, bar_no, {num('ln(first_value(equity) OVER (PARTITION BY run, CAST(ts AS DATE) ORDER BY bar_no))', 'log_day_start')},
  {num('0', 'day_pnl')}, CAST(CASE WHEN turnover > 0 THEN 1 ELSE 0 END AS BIGINT) AS trades_today FROM t""")
def _days(spark, root):
    c = curve(spark, root)
    trades = c.select("run", "bar_no", (F.col("turnover") > 0).cast("int").alias("n_trades"))
    return backtest.day_starts(c, trades).select(
        "run", "bar_no", F.log("day_start_equity").alias("log_day_start"), "day_pnl", "trades_today")


@register("next_bar_fills", f"""WITH {GRID}, d AS (SELECT symbol, ts, price,
    CASE WHEN ({MOMENTUM['momentum_roc20']}) > 0 THEN 'BUY' ELSE 'SELL' END AS side,
    lead(ts) OVER k AS fill_ts, lead(price) OVER k AS p FROM grid
  WINDOW k AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, {when('ts', 'ts')}, side, {when('fill_ts', 'fill_ts')},
  {num("p * CASE WHEN side = 'BUY' THEN 1.0002 ELSE 0.9998 END", 'fill_price')}
FROM d WHERE price IS NOT NULL AND p IS NOT NULL""")
def _fills(spark, root):
    bars = views.bars(spark, root)
    orders = signals.momentum_features(bars).select(
        "symbol", "ts", F.when(F.col("momentum_roc20") > 0, "BUY").otherwise("SELL").alias("side"))
    return backtest.next_bar_fills(orders, bars, 2.0)


@register("fill_divergence", f"""WITH {FILLS}, a AS (
  SELECT ts, symbol, side, sum(qty) AS q, sum(qty * fill_price) / sum(qty) AS p FROM fills GROUP BY ALL),
late AS (SELECT CASE WHEN seq % 7 = 0 THEN ts + INTERVAL 12 HOUR ELSE ts END AS ts, symbol, side, qty, fill_price FROM fills),
b AS (SELECT ts, symbol, side, sum(qty) AS q, sum(qty * fill_price * 1.001) / sum(qty) AS p FROM late GROUP BY ALL)
SELECT {when('ts', 'ts')}, symbol, side, {num('a.q', 'qty_paper', 4)}, {num('a.p + 1.1e-6', 'price_paper', 4)},
  {num('b.q', 'qty_simulated', 4)}, {num('b.p + 1.1e-6', 'price_simulated', 4)},
  {num('coalesce(a.q, 0) - coalesce(b.q, 0)', 'qty_gap', 4)}, {num('a.p - b.p + 1.1e-6', 'price_gap', 4)},
  CASE WHEN a.q IS NULL THEN 'only_simulated' WHEN b.q IS NULL THEN 'only_paper' ELSE 'both' END AS status
FROM a FULL JOIN b USING (ts, symbol, side)""", digits=4)
def _divergence(spark, root):
    # The simulation fills dearer, and some orders half a day late, which the comparison reports.
    fills = views.fills(spark, root)
    late = F.when(F.col("seq") % 7 == 0, F.timestamp_add("HOUR", F.lit(12), F.col("ts"))).otherwise(F.col("ts"))
    simulated = fills.withColumn("fill_price", F.col("fill_price") * 1.001).withColumn("ts", late)
    rows = backtest.divergence(fills, simulated)
    # The offset keeps exact ties off the rounding boundary in both engines.
    return rows.withColumns({c: F.col(c) + 1.1e-6
                             for c in ("price_paper", "price_simulated", "price_gap")})


# ------------------------------------------------------------ event studies

def speed(spark, root):
    news = views.news_times(spark, root).select(
        "event_id", F.col("session").alias("symbol"), F.col("ts").alias("received_at"),
        F.concat(F.lit("kind"), (F.col("event_id") % 3).cast("string")).alias("event_type"))
    ticks = views.ticks(spark, root).withColumnRenamed("session", "symbol")
    return studies.news_speed(news, ticks.select("symbol", "ts", "price", "event_id"))


SPEED = """ticks AS (SELECT user_id % 4 AS symbol, ts, arg_max(value, event_id) AS price FROM events
  WHERE event_type <> 'signup' GROUP BY ALL),
probes AS (SELECT event_id, user_id % 4 AS symbol, 'kind' || (event_id % 3) AS event_type, o AS offset_min,
    ts + to_minutes(CAST(o AS BIGINT)) AS probe_ts
  FROM events CROSS JOIN (VALUES (0), (1), (5), (15), (30), (60)) f(o) WHERE event_type = 'signup'),
speed AS (SELECT p.*, t.price, t.ts AS price_ts FROM probes p ASOF LEFT JOIN ticks t
  ON p.symbol = t.symbol AND p.probe_ts >= t.ts),
rets AS (SELECT s.*, s.price / nullif(b.price, 0) - 1 AS r FROM speed s JOIN speed b
  ON b.event_id = s.event_id AND b.symbol = s.symbol AND b.offset_min = 0 WHERE s.offset_min > 0)"""


@register("news_speed", f"""WITH {SPEED} SELECT event_id, symbol, event_type,
  CAST(offset_min AS BIGINT) AS offset_min, {num('price', 'price')}, {when('price_ts', 'price_ts')} FROM speed""")
def _speed(spark, root):
    return speed(spark, root).select("event_id", "symbol", "event_type", "offset_min", "price", "price_ts")


@register("event_study", f"""WITH {SPEED} SELECT event_type, CAST(offset_min AS BIGINT) AS offset_min,
  count(*) AS n, {num('avg(r)', 'mean_return')}, {num('quantile_cont(r, 0.5)', 'median_return')},
  {num('stddev_samp(r)', 'deviation')}, {num('avg(CASE WHEN r > 0 THEN 1 ELSE 0 END)', 'win_rate')},
  {num('min(r)', 'min_return')}, {num('max(r)', 'max_return')}
FROM rets WHERE r IS NOT NULL GROUP BY ALL""")
def _study(spark, root):
    return studies.event_study(studies.event_returns(speed(spark, root)), ["event_type"])


TAUS = (30.0, 120.0, 1440.0)


@register("decay_fit", f"""WITH {SPEED}, prof AS (SELECT event_type, offset_min AS x, avg(abs(r)) AS y, count(*) AS w
  FROM rets WHERE r IS NOT NULL GROUP BY ALL),
g AS (SELECT event_type, tau, sum(w) AS w, sum(w * exp(-x / tau)) AS d, sum(w * y) AS v,
    sum(w * exp(-x / tau) ** 2) AS dd, sum(w * exp(-x / tau) * y) AS dv, sum(w * y * y) AS vv
  FROM prof CROSS JOIN (VALUES (30.0), (120.0), (1440.0)) t(tau) GROUP BY ALL),
r AS (SELECT event_type, tau, (dv - d * v / w) / (dd - d * d / w) AS slope,
    (dv - d * v / w) ** 2 / ((dd - d * d / w) * (vv - v * v / w)) AS r2 FROM g)
SELECT event_type, {num('tau', 'tau')}, {num('slope', 'slope', 4)}, {num('r2', 'r2', 4)} FROM r
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY r2 DESC, tau) = 1""", digits=4)
def _decay(spark, root):
    returns = studies.event_returns(speed(spark, root)).filter("event_return IS NOT NULL")
    profile = returns.groupBy("event_type", "offset_min").agg(
        F.avg(F.abs("event_return")).alias("strength"), F.count("*").alias("n"))
    return studies.decay_fit(profile, TAUS)
