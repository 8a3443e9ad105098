"""Portfolio construction and rule-ordered risk decisions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

EPSILON = 1e-9


@dataclass(frozen=True)
class Limits:
    """Risk parameters of one run."""

    max_position_pct: float = 0.25
    max_gross_pct: float = 0.95
    min_trade_notional: float = 5.0
    min_price: float = 5.0
    min_adv: float = 1e7
    max_ann_vol: float = 1.0
    order_types: tuple[str, ...] = ("market", "limit")
    tifs: tuple[str, ...] = ("day",)
    max_daily_loss_pct: float = 0.05
    max_trades_per_day: int = 10


# Reject codes in the order the rules are checked.
CODES = ("KILL_SWITCH", "UNKNOWN_SYMBOL", "UNKNOWN_ACCOUNT", "SHORT_ATTEMPT", "OVERSELL", "NONPOSITIVE_QTY",
         "BAD_ORDER_TYPE", "BAD_TIF", "PENNY_STOCK", "ILLIQUID", "EXCESS_VOLATILITY",
         "OVER_CONCENTRATION", "OVER_EXPOSURE", "DAILY_LOSS_HALT", "MAX_TRADES",
         "INSUFFICIENT_CAPITAL")


# ------------------------------------------------------------ construct

def candidates(expected: DataFrame, prices: DataFrame, limits: Limits, min_er_bps: float = 20.0,
               key: str = "rebalance") -> DataFrame:
    """Rows clearing the return threshold and the price floor, with their rank by return.

    Ties are ranked by symbol. The rank window covers one rebalance's cross-section, which the
    universe bounds; nothing else here depends on it.
    """
    priced = expected.join(prices.select(key, "symbol", "price"), [key, "symbol"], "left")
    kept = priced.filter((F.col("expected_return") >= min_er_bps / 10_000.0)
                         & (F.coalesce("price", F.lit(0.0)) >= limits.min_price))
    order = Window.partitionBy(key).orderBy(F.desc("expected_return"), "symbol")
    return kept.withColumn("position_rank", F.row_number().over(order))


def targets(ranked: DataFrame, equity: DataFrame, limits: Limits,
            key: str = "rebalance") -> DataFrame:
    """Return-proportional weights under the position cap; dust is dropped, not redistributed.

    The gross cap needs no running check: the uncapped weights already sum to it.
    """
    total = ranked.groupBy(key).agg(F.sum("expected_return").alias("_total"))
    weight = F.least(F.col("expected_return") / F.col("_total") * limits.max_gross_pct,
                     F.lit(limits.max_position_pct))
    return (ranked.join(total, key).join(equity.select(key, "equity"), key)
            .withColumn("weight", weight)
            .filter(F.col("weight") * F.col("equity") >= limits.min_trade_notional)
            .drop("_total"))


def construct(expected: DataFrame, prices: DataFrame, equity: DataFrame, positions: DataFrame,
              limits: Limits, min_er_bps: float = 20.0, key: str = "rebalance") -> DataFrame:
    """Order proposals per rebalance: buys towards target weights, sells of what has none.

    Overweight holdings are not trimmed. A rebalance without candidates gives no orders at all;
    one whose candidates are all dust sells everything held.
    """
    # Candidates are what is left of the cross-section; totals, buys and sells all read them.
    ranked = cut_lineage(candidates(expected, prices, limits, min_er_bps, key))
    wanted = targets(ranked, equity, limits, key)
    held = positions.select(key, "symbol", F.col("qty").alias("held"))
    delta = F.col("weight") * F.col("equity") / F.col("price") - F.coalesce("held", F.lit(0.0))
    order = [F.lit("market").alias("order_type"), F.lit("day").alias("tif")]
    buys = (wanted.join(held, [key, "symbol"], "left").withColumn("_delta", delta)
            .filter(F.col("_delta") * F.col("price") >= limits.min_trade_notional)
            .select(key, "symbol", F.lit("BUY").alias("side"), F.bround("_delta", 6).alias("qty"),
                    *order, F.concat(F.lit("target_weight="), F.format_string("%.3f", "weight"))
                    .alias("reason"), "position_rank"))
    active = ranked.select(key).distinct()
    sells = (held.filter("held > 0").join(active, key, "left_semi")
             .join(wanted.select(key, "symbol"), [key, "symbol"], "left_anti")
             .select(key, "symbol", F.lit("SELL").alias("side"), F.bround("held", 6).alias("qty"),
                     *order, F.lit("no_longer_in_target").alias("reason"),
                     F.lit(None).cast("int").alias("position_rank")))
    return buys.unionByName(sells)


# ------------------------------------------------------------- evaluate

def gross_exposure(positions: DataFrame, market: DataFrame, by: Sequence[str] = ("account",)) -> DataFrame:
    """Marked value of all positions per account; a symbol without price counts as zero."""
    return (positions.join(market.select("symbol", "price"), "symbol", "left")
            .groupBy(*by).agg(F.sum(F.col("qty") * F.coalesce("price", F.lit(0.0))).alias("gross")))


def risk_rules(limits: Limits, kill_switch: bool) -> list[tuple[str, Column]]:
    """(code, violated) in checking order."""
    c, zero = F.col, F.lit(0.0)
    buy, sell = c("side") == "BUY", c("side") == "SELL"
    # What must hold of an order is violated where it is unknown.
    holds = lambda condition: F.coalesce(condition, F.lit(False))
    known_side = holds(buy | sell)
    price, held = F.coalesce("price", zero), F.coalesce("held", zero)
    notional = c("qty") * price
    day_start = F.coalesce("day_start_equity", "equity")
    return [
        ("KILL_SWITCH", F.lit(kill_switch)),
        ("UNKNOWN_SYMBOL", c("_listed").isNull()),
        ("UNKNOWN_ACCOUNT", c("equity").isNull()),
        ("SHORT_ATTEMPT", ~known_side | (sell & (held <= 0))),
        ("OVERSELL", sell & (c("qty") > held + EPSILON)),
        ("NONPOSITIVE_QTY", ~holds((c("qty") > 0) & ~F.isnan(c("qty").cast("double")))),
        ("BAD_ORDER_TYPE", ~holds(c("order_type").isin(*limits.order_types))),
        ("BAD_TIF", ~holds(c("tif").isin(*limits.tifs))),
        ("PENNY_STOCK", price < limits.min_price),
        ("ILLIQUID", F.coalesce("adv_dollar_volume", zero) < limits.min_adv),
        ("EXCESS_VOLATILITY", F.coalesce("ann_vol", zero) > limits.max_ann_vol),
        ("OVER_CONCENTRATION",
         buy & ((held + c("qty")) * price > limits.max_position_pct * c("equity") + EPSILON)),
        ("OVER_EXPOSURE", buy & (F.coalesce("gross", zero) + notional
                                 > limits.max_gross_pct * c("equity") + EPSILON)),
        ("DAILY_LOSS_HALT",
         F.coalesce("day_pnl", zero) <= -limits.max_daily_loss_pct * day_start),
        ("MAX_TRADES", F.coalesce("trades_today", F.lit(0)) >= limits.max_trades_per_day),
        ("INSUFFICIENT_CAPITAL", buy & (notional > F.coalesce("cash", zero) + EPSILON)),
    ]


def evaluate(proposals: DataFrame, accounts: DataFrame, positions: DataFrame, market: DataFrame,
             universe: DataFrame, limits: Limits, kill_switch: bool = False) -> DataFrame:
    """ALLOW or the first violated rule for each proposal, plus all violated rules.

    proposals(account, symbol, side, qty, order_type, tif, …); accounts(account, equity, cash,
    day_start_equity, day_pnl, trades_today); positions(account, symbol, qty);
    market(symbol, price, adv_dollar_volume, ann_vol); universe(symbol).
    """
    # Account and symbol facts are put together first, so proposals are shuffled three times only.
    account_facts = accounts.join(gross_exposure(positions, market), "account", "left")
    listed = universe.select("symbol").distinct().withColumn("_listed", F.lit(True))
    symbol_facts = market.join(listed, "symbol", "full_outer")
    joined = (proposals
              .join(positions.select("account", "symbol", F.col("qty").alias("held")),
                    ["account", "symbol"], "left")
              .join(account_facts, "account", "left")
              .join(symbol_facts, "symbol", "left"))
    rules = risk_rules(limits, kill_switch)
    hits = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), code)
                                     for code, bad in rules]))
    return (joined.withColumn("violations", hits)
            .withColumn("code", F.coalesce(F.try_element_at("violations", F.lit(1)), F.lit("ALLOW")))
            .withColumn("allow", F.col("code") == "ALLOW")
            .select(*proposals.columns, "allow", "code", "violations"))


def decision_summary(decisions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return decisions.groupBy(*by).agg(F.count_if("allow").alias("allowed"),
                                      F.count_if(~F.col("allow")).alias("rejected"))


def position_weights(positions: DataFrame, market: DataFrame, cash: DataFrame) -> DataFrame:
    """Value of each position and its share of account equity (cash plus all values)."""
    valued = (positions.join(market.select("symbol", "price"), "symbol", "left")
              .withColumn("value", F.col("qty") * F.coalesce("price", F.lit(0.0))))
    totals = valued.groupBy("account").agg(F.sum("value").alias("invested"))
    equity = F.col("invested") + F.coalesce("cash", F.lit(0.0))
    return (valued.join(totals, "account").join(cash.select("account", "cash"), "account", "left")
            .select("account", "symbol", "qty", "value", "invested", equity.alias("equity"),
                    F.try_divide(F.col("value"), equity).alias("weight")))
