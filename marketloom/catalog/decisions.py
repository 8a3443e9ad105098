"""Portfolio and risk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions, signals
from ..plans import views
from ..plans.ordered import number_bars
from .base import BARS, GRID, SYMBOL_LIST, num, register, when
from .signals import MOMENTUM

LIMITS = decisions.Limits(min_adv=350_000.0, max_ann_vol=0.6)


def rebalance_inputs(spark, root):
    bars = views.bars(spark, root)
    expected = signals.momentum_features(bars).select(
        F.col("ts").alias("rebalance"), "symbol", (F.col("momentum_roc20") / 10).alias("expected_return"))
    prices = bars.select(F.col("ts").alias("rebalance"), "symbol", "price")
    numbered = number_bars(bars)
    equity = numbered.select(F.col("ts").alias("rebalance"),
                             (F.lit(20.0) + F.col("bar_no")).alias("equity")).distinct()
    odd = F.col("bar_no") + F.length("symbol")
    positions = numbered.filter(odd % 3 == 0).select(
        F.col("ts").alias("rebalance"), "symbol", ((odd % 4) / 100.0).alias("qty"))
    return expected, prices, equity, positions


TARGETS = f"""{GRID}, n AS (SELECT *, dense_rank() OVER (ORDER BY ts) AS bar_no,
    ({MOMENTUM['momentum_roc20']}) / 10 AS er FROM grid),
m AS (SELECT ts, symbol, price, er, 20.0 + bar_no AS equity,
    CASE WHEN (bar_no + length(symbol)) % 3 = 0 THEN ((bar_no + length(symbol)) % 4) / 100.0 END AS held
  FROM n WHERE price IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY er DESC, symbol) AS position_rank,
    sum(er) OVER (PARTITION BY ts) AS total FROM m WHERE er >= 0.002 AND price >= 5),
wanted AS (SELECT *, least(er / total * 0.95, 0.25) AS weight FROM ranked
  WHERE least(er / total * 0.95, 0.25) * equity >= 5)"""


@register("rank_candidates", f"""WITH {TARGETS} SELECT {when('ts', 'rebalance')}, symbol,
  {num('er', 'expected_return')}, CAST(position_rank AS BIGINT) AS position_rank FROM ranked""")
def _rank(spark, root):
    expected, prices, _, _ = rebalance_inputs(spark, root)
    return decisions.candidates(expected, prices, LIMITS).select(
        "rebalance", "symbol", "expected_return", "position_rank")


@register("target_weights", f"""WITH {TARGETS}
SELECT {when('ts', 'rebalance')}, symbol, {num('weight', 'weight')} FROM wanted""")
def _targets(spark, root):
    expected, prices, equity, _ = rebalance_inputs(spark, root)
    ranked = decisions.candidates(expected, prices, LIMITS)
    return decisions.targets(ranked, equity, LIMITS).select("rebalance", "symbol", "weight")


@register("construct_portfolio", f"""WITH {TARGETS}, buys AS (
  SELECT ts, symbol, position_rank, weight * equity / price - coalesce(held, 0) AS d, price FROM wanted)
SELECT {when('ts', 'rebalance')}, symbol, 'BUY' AS side, {num('round(d, 6)', 'qty')}, 'market' AS order_type,
  'day' AS tif, CAST(position_rank AS BIGINT) AS position_rank FROM buys WHERE d * price >= 5
UNION ALL SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), symbol, 'SELL', round(CAST(held AS DOUBLE), 6) + 0.0, 'market',
  'day', NULL FROM m WHERE held > 0 AND ts IN (SELECT ts FROM ranked)
  AND NOT EXISTS (SELECT 1 FROM wanted w WHERE w.ts = m.ts AND w.symbol = m.symbol)""")
def _construct(spark, root):
    return decisions.construct(*rebalance_inputs(spark, root), LIMITS).drop("reason")


def risk_inputs(spark, root):
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    names = F.array(*[F.lit(s) for s in [*views.SYMBOLS, "OTHER"]])
    proposals = views.table(spark, root, "orders").select(
        k.alias("proposal_id"), F.when(k % 113 == 0, -1).otherwise(F.col("o_custkey")).alias("account"),
        F.element_at(names, (k % 7 + 1).cast("int")).alias("symbol"),
        F.when(k % 97 == 0, "HOLD").when(k % 109 == 0, None).when(F.col("o_orderstatus") == "F", "SELL").otherwise("BUY")
        .alias("side"), F.when(k % 107 != 0, (k % 41 - 1) / 20.0).alias("qty"),
        F.when(k % 101 == 0, None).when(F.col("o_orderpriority") == "1-URGENT", "market")
        .when(k % 13 == 0, "stop").otherwise("limit").alias("order_type"),
        F.when(k % 103 == 0, None).when(k % 29 == 0, "gtc").otherwise("day").alias("tif"))
    equity = F.lit(5000.0) + F.abs("c_acctbal") * 2
    customers = views.table(spark, root, "customer")
    accounts = customers.select(
        c.alias("account"), equity.alias("equity"), F.col("c_acctbal").alias("cash"),
        equity.alias("day_start_equity"),
        F.when(c % 19 == 0, equity * -0.06).otherwise(0.0).alias("day_pnl"),
        (c % 12).alias("trades_today"))
    positions = customers.select(
        c.alias("account"), F.explode(F.array(
            F.element_at(names, (c % 6 + 1).cast("int")),
            F.element_at(names, ((c + 3) % 6 + 1).cast("int")))).alias("symbol"),
        ((c % 5) / 2.0).alias("qty"))
    bars = views.bars(spark, root)
    market = bars.groupBy("symbol").agg(
        F.max_by("price", "ts").alias("price"),
        F.avg(F.col("price") * F.col("volume")).alias("adv_dollar_volume"),
        (F.stddev_samp("price") / F.avg("price") * 10).alias("ann_vol"))
    universe = bars.select("symbol").distinct().filter("symbol <> 'PROMO'")
    return proposals, accounts, positions, market, universe


RISK = f"""{BARS}, market AS (SELECT symbol, arg_max(price, ts) AS price, avg(price * volume) AS adv,
    stddev_samp(price) / avg(price) * 10 AS vol FROM bars GROUP BY symbol),
prop AS (SELECT o_orderkey AS proposal_id, CASE WHEN o_orderkey % 113 = 0 THEN -1 ELSE o_custkey END AS account,
    list_append({SYMBOL_LIST}, 'OTHER')[o_orderkey % 7 + 1] AS symbol,
    CASE WHEN o_orderkey % 97 = 0 THEN 'HOLD' WHEN o_orderkey % 109 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'SELL' ELSE 'BUY' END AS side,
    CASE WHEN o_orderkey % 107 <> 0 THEN (o_orderkey % 41 - 1) / 20.0 END AS qty,
    CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 'market' WHEN o_orderkey % 13 = 0 THEN 'stop'
         ELSE 'limit' END AS order_type,
    CASE WHEN o_orderkey % 103 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN 'gtc' ELSE 'day' END AS tif FROM orders),
acc AS (SELECT c_custkey AS account, 5000.0 + abs(c_acctbal) * 2 AS equity, c_acctbal AS cash,
    CASE WHEN c_custkey % 19 = 0 THEN (5000.0 + abs(c_acctbal) * 2) * -0.06 ELSE 0 END AS pnl,
    c_custkey % 12 AS trades FROM customer),
pos AS (SELECT c_custkey AS account, unnest([{SYMBOL_LIST}[c_custkey % 6 + 1],
    {SYMBOL_LIST}[(c_custkey + 3) % 6 + 1]]) AS symbol, (c_custkey % 5) / 2.0 AS held FROM customer),
gross AS (SELECT account, sum(held * coalesce(price, 0)) AS gross FROM pos LEFT JOIN market USING (symbol)
  GROUP BY account),
j AS (SELECT p.*, coalesce(held, 0) AS held, equity, cash, pnl, trades, coalesce(gross, 0) AS gross,
    coalesce(m.price, 0) AS price, coalesce(m.adv, 0) AS adv, coalesce(m.vol, 0) AS vol,
    p.symbol IN (SELECT symbol FROM bars WHERE symbol <> 'PROMO') AS listed
  FROM prop p LEFT JOIN acc USING (account) LEFT JOIN gross USING (account)
  LEFT JOIN pos ON pos.account = p.account AND pos.symbol = p.symbol
  LEFT JOIN market m ON m.symbol = p.symbol),
decided AS (SELECT *, CASE WHEN NOT listed THEN 'UNKNOWN_SYMBOL' WHEN equity IS NULL THEN 'UNKNOWN_ACCOUNT'
  WHEN side = 'SELL' AND held <= 0 THEN 'SHORT_ATTEMPT'
  WHEN side = 'SELL' AND qty > held + 1e-9 THEN 'OVERSELL'
  WHEN side IS NULL OR side NOT IN ('BUY', 'SELL') THEN 'SHORT_ATTEMPT'
  WHEN qty IS NULL OR qty <= 0 THEN 'NONPOSITIVE_QTY'
  WHEN order_type IS NULL OR order_type NOT IN ('market', 'limit') THEN 'BAD_ORDER_TYPE'
  WHEN tif IS DISTINCT FROM 'day' THEN 'BAD_TIF' WHEN price < 5 THEN 'PENNY_STOCK'
  WHEN adv < 350000 THEN 'ILLIQUID' WHEN vol > 0.6 THEN 'EXCESS_VOLATILITY'
  WHEN side = 'BUY' AND (held + qty) * price > 0.25 * equity + 1e-9 THEN 'OVER_CONCENTRATION'
  WHEN side = 'BUY' AND gross + qty * price > 0.95 * equity + 1e-9 THEN 'OVER_EXPOSURE'
  WHEN pnl <= -0.05 * equity THEN 'DAILY_LOSS_HALT' WHEN trades >= 10 THEN 'MAX_TRADES'
  WHEN side = 'BUY' AND qty * price > cash + 1e-9 THEN 'INSUFFICIENT_CAPITAL' ELSE 'ALLOW' END AS code FROM j)"""


@register("risk_decisions", f"""WITH {RISK} SELECT proposal_id, account, symbol, side,
  {num('qty', 'qty')}, order_type, tif, code = 'ALLOW' AS allow, code FROM decided""")
def _risk(spark, root):
    return decisions.evaluate(*risk_inputs(spark, root), LIMITS).drop("violations")


@register("risk_summary", f"""WITH {RISK} SELECT symbol, count(*) FILTER (code = 'ALLOW') AS allowed,
  count(*) FILTER (code <> 'ALLOW') AS rejected FROM decided GROUP BY symbol""")
def _summary(spark, root):
    return decisions.decision_summary(decisions.evaluate(*risk_inputs(spark, root), LIMITS), ["symbol"])


@register("risk_violations", f"""WITH {RISK}, v AS (
  SELECT 'UNKNOWN_SYMBOL' AS code FROM j WHERE NOT listed
  UNION ALL SELECT 'UNKNOWN_ACCOUNT' FROM j WHERE equity IS NULL
  UNION ALL SELECT 'SHORT_ATTEMPT' FROM j WHERE side IS NULL OR side NOT IN ('BUY', 'SELL') OR (side = 'SELL' AND held <= 0)
  UNION ALL SELECT 'OVERSELL' FROM j WHERE side = 'SELL' AND qty > held + 1e-9
  UNION ALL SELECT 'NONPOSITIVE_QTY' FROM j WHERE qty IS NULL OR qty <= 0
  UNION ALL SELECT 'BAD_ORDER_TYPE' FROM j WHERE order_type IS NULL OR order_type NOT IN ('market', 'limit')
  UNION ALL SELECT 'BAD_TIF' FROM j WHERE tif IS DISTINCT FROM 'day'
  UNION ALL SELECT 'PENNY_STOCK' FROM j WHERE price < 5
  UNION ALL SELECT 'ILLIQUID' FROM j WHERE adv < 350000
  UNION ALL SELECT 'EXCESS_VOLATILITY' FROM j WHERE vol > 0.6
  UNION ALL SELECT 'OVER_CONCENTRATION' FROM j WHERE side = 'BUY' AND (held + qty) * price > 0.25 * equity + 1e-9
  UNION ALL SELECT 'OVER_EXPOSURE' FROM j WHERE side = 'BUY' AND gross + qty * price > 0.95 * equity + 1e-9
  UNION ALL SELECT 'DAILY_LOSS_HALT' FROM j WHERE pnl <= -0.05 * equity
  UNION ALL SELECT 'MAX_TRADES' FROM j WHERE trades >= 10
  UNION ALL SELECT 'INSUFFICIENT_CAPITAL' FROM j WHERE side = 'BUY' AND qty * price > coalesce(cash, 0) + 1e-9)
SELECT code, count(*) AS n FROM v GROUP BY code""")
def _violations(spark, root):
    rows = decisions.evaluate(*risk_inputs(spark, root), LIMITS)
    return rows.select(F.explode("violations").alias("code")).groupBy("code").agg(
        F.count("*").alias("n"))


@register("position_weights", f"""WITH {RISK}, v AS (SELECT account, symbol, held, held * coalesce(price, 0) AS value
  FROM pos LEFT JOIN market USING (symbol)),
t AS (SELECT account, sum(value) AS invested FROM v GROUP BY account)
SELECT account, symbol, {num('held', 'qty', 4)}, {num('value', 'value', 4)}, {num('invested', 'invested', 4)},
  {num('invested + cash', 'equity', 4)}, {num('value / nullif(invested + cash, 0)', 'weight', 4)}
FROM v JOIN t USING (account) JOIN acc USING (account)""", digits=4)
def _weights(spark, root):
    _, accounts, positions, market, _ = risk_inputs(spark, root)
    return decisions.position_weights(positions, market, accounts)
