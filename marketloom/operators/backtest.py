"""Weight-based backtests: many runs at once, from target weights to metrics.

A weight decided on bar t trades at bar t+1 and therefore earns the return of bar t+2. All steps
up to the per-run curve are equi-joins on shifted bar numbers and aggregates; only the curve, one
row per run and bar, is scanned in order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import BarFrame, ratio
from ..plans.ordered import (CHUNK_BARS, chunk_scan, drop_halo, number_bars,
                             running_max, running_sum, with_halo)
from ..session import cut_lineage

BARS_PER_YEAR = 252


def fill_price(price: Column, side: Column, slippage_bps: float) -> Column:
    """Next-bar price moved against the trade."""
    step = slippage_bps / 1e4
    return price * F.when(side == "BUY", 1 + step).otherwise(1 - step)


def next_bar_fills(decisions: DataFrame, bars: DataFrame, slippage_bps: float) -> DataFrame:
    """Orders (symbol, ts, side, …) priced at the symbol's next bar."""
    numbered = number_bars(bars)
    at = numbered.select("ts", "bar_no").distinct()
    following = numbered.select("symbol", (F.col("bar_no") - 1).alias("bar_no"),
                                F.col("ts").alias("fill_ts"), F.col("price").alias("_p"))
    return (decisions.join(at, "ts").join(following, ["symbol", "bar_no"])
            .withColumn("fill_price", fill_price(F.col("_p"), F.col("side"), slippage_bps))
            .drop("_p", "bar_no"))


def unknown_symbols(weights: DataFrame, bars: DataFrame) -> DataFrame:
    """Weights naming a symbol the panel does not have; must be empty."""
    return weights.join(bars.select("symbol").distinct(), "symbol", "left_anti")


def backtest(weights: DataFrame, bars: DataFrame, cost_bps: float = 2.0, embargo_bars: int = 5,
             start: float = 100.0, chunk_bars: int = CHUNK_BARS) -> DataFrame:
    """Equity curve per run: (run, bar_no, ts, gross_return, turnover, cost, net_return, exposure,
    concentration, equity) from weights(run, ts, symbol, weight).

    Weights decided in the first ``embargo_bars`` bars are ignored.
    """
    f = BarFrame()
    numbered = number_bars(bars)
    calendar = numbered.select("ts", "bar_no").distinct()
    panel = with_halo(numbered, 1, chunk_bars=chunk_bars)
    returns = drop_halo(panel.withColumn("_r", ratio(f.price, f.back(f.price, 1)) - 1)).select(
        "symbol", "bar_no", "_r")
    # Weights usually end a long plan and are read once per shifted use below.
    placed = cut_lineage(weights.join(calendar, "ts").select("run", "symbol", "bar_no", "weight"))
    live = placed.filter(F.col("bar_no") > embargo_bars)

    earning = (live.withColumn("bar_no", F.col("bar_no") + 2)
               .join(returns, ["symbol", "bar_no"], "left")
               .groupBy("run", "bar_no")
               .agg(F.sum(F.col("weight") * F.coalesce("_r", F.lit(0.0))).alias("gross_return"),
                    F.sum("weight").alias("exposure"), F.max("weight").alias("concentration")))
    shifted = lambda by, sign: live.select("run", "symbol", (F.col("bar_no") + by).alias("bar_no"),
                                           (F.col("weight") * sign).alias("_d"))
    traded = (shifted(1, 1).unionByName(shifted(2, -1)).groupBy("run", "symbol", "bar_no")
              .agg(F.sum("_d").alias("_d")).groupBy("run", "bar_no")
              .agg(F.sum(F.abs("_d")).alias("turnover")))
    spine = _spine(placed.select("run").distinct(), calendar)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    steps = (spine.join(earning, ["run", "bar_no"], "left").join(traded, ["run", "bar_no"], "left")
             .select("run", "bar_no", "ts", zero("gross_return").alias("gross_return"),
                     zero("turnover").alias("turnover"), zero("exposure").alias("exposure"),
                     zero("concentration").alias("concentration"))
             .withColumn("cost", F.col("turnover") * cost_bps / 1e4)
             .withColumn("net_return", F.col("gross_return") - F.col("cost")))
    # One row per run and bar, read by the curve scan and again by every metric on it.
    steps = cut_lineage(steps)
    curve = chunk_scan(steps, ["run"], F.floor(F.col("bar_no") / chunk_bars), ["bar_no"],
                       [running_sum("_growth", F.log1p("net_return"))])
    return curve.withColumn("equity", F.exp("_growth") * start).drop("_growth")


def _spine(runs: DataFrame, calendar: DataFrame, chunk_bars: int = CHUNK_BARS) -> DataFrame:
    """One row per run and bar, generated chunk by chunk from the number of bars."""
    top = calendar.agg(F.max("bar_no").alias("n")).scalar()
    cells = (runs.withColumn("_n", top)
             .withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"),
                                                    F.floor((F.col("_n") - 1) / chunk_bars))))
             .select("run", F.explode(F.sequence(
                 F.col("_b") * chunk_bars + 1,
                 F.least((F.col("_b") + 1) * chunk_bars, F.col("_n")))).alias("bar_no")))
    return cells.join(calendar, "bar_no")


def benchmark_curve(bars: DataFrame, benchmark: str, start: float = 100.0) -> DataFrame:
    """Buy-and-hold from the benchmark's first price."""
    own = bars.filter(F.col("symbol") == benchmark)
    first = own.agg(F.min_by("price", "ts").alias("p")).scalar()
    return own.select("ts", (F.col("price") / first * start).alias("benchmark"))


def drawdowns(curve: DataFrame, chunk_bars: int = CHUNK_BARS) -> DataFrame:
    """Peak so far and relative drawdown."""
    seen = chunk_scan(curve, ["run"], F.floor(F.col("bar_no") / chunk_bars), ["bar_no"],
                      [running_max("peak", F.col("equity"))])
    return seen.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def total_return(curve: DataFrame, value: str = "equity", by: Sequence[str] = ("run",)) -> DataFrame:
    return curve.groupBy(*by).agg(
        (F.max_by(value, "ts") / F.min_by(value, "ts") - 1).alias("total_return"))


def performance(curve: DataFrame, benchmark: DataFrame,
                bars_per_year: int = BARS_PER_YEAR) -> DataFrame:
    """One row of metrics per run."""
    year = math.sqrt(bars_per_year)
    r = F.col("net_return")
    joined = drawdowns(curve).join(benchmark, "ts", "left")
    downside = F.sqrt(F.avg(F.least(r, F.lit(0.0)) ** 2))
    out = joined.groupBy("run").agg(
        F.count("*").alias("n_bars"),
        (F.max_by("equity", "ts") / F.min_by("equity", "ts") - 1).alias("total_return"),
        (F.max_by("benchmark", "ts") / F.min_by("benchmark", "ts") - 1).alias("benchmark_return"),
        (F.stddev_samp(r) * year).alias("volatility"),
        (F.try_divide(F.avg(r), F.stddev_samp(r)) * year).alias("sharpe"),
        (F.try_divide(F.avg(r), downside) * year).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"),
        F.try_divide(F.count_if(r > 0), F.count_if(r != 0)).alias("hit_rate"),
        F.avg(F.when(r > 0, r)).alias("avg_win"), F.avg(F.when(r < 0, r)).alias("avg_loss"),
        F.avg("turnover").alias("avg_turnover"), F.avg("exposure").alias("avg_exposure"),
        F.max("concentration").alias("max_concentration"), F.sum("cost").alias("cost_drag"))
    return out.withColumn("excess_return", F.col("total_return") - F.col("benchmark_return"))


def performance_by(curve: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Mean return, deviation and hit rate by run and label, by run, and over all."""
    marked = curve.join(labels.select("ts", label), "ts", "left")
    r = F.col("net_return")
    return marked.groupingSets([("run", label), ("run",), ()], "run", label).agg(
        F.grouping_id().alias("level"), F.count("*").alias("n"), F.avg(r).alias("mean_return"),
        F.stddev_samp(r).alias("deviation"), F.avg((r > 0).cast("double")).alias("hit_rate"))


def divergence(paper: DataFrame, simulated: DataFrame) -> DataFrame:
    """Fills of two sources side by side by (ts, symbol, side) with the differences."""
    sides = [d.groupBy("ts", "symbol", "side").agg(
        F.sum("qty").alias(f"qty_{n}"),
        F.try_divide(F.sum(F.col("qty") * F.col("fill_price")), F.sum("qty")).alias(f"price_{n}"))
        for d, n in ((paper, "paper"), (simulated, "simulated"))]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    both = sides[0].join(sides[1], ["ts", "symbol", "side"], "full_outer")
    return (both.withColumn("qty_gap", zero("qty_paper") - zero("qty_simulated"))
            .withColumn("price_gap", F.col("price_paper") - F.col("price_simulated"))
            .withColumn("status", F.when(F.col("qty_paper").isNull(), "only_simulated")
                        .when(F.col("qty_simulated").isNull(), "only_paper").otherwise("both")))


def day_starts(curve: DataFrame, trades: DataFrame, chunk_bars: int = CHUNK_BARS) -> DataFrame:
    """Day-boundary state: equity at a day's first bar, day P&L and trades so far that day.

    trades(run, bar_no, n_trades). A day of one run holds a bounded number of bars.
    """
    day = F.to_date("ts")
    w = Window.partitionBy("run", "_day").orderBy("bar_no")
    to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    return (curve.join(trades, ["run", "bar_no"], "left").withColumn("_day", day)
            .withColumn("day_start_equity", F.first("equity").over(to_here))
            .withColumn("day_pnl", F.col("equity") - F.col("day_start_equity"))
            .withColumn("trades_today", F.sum(F.coalesce("n_trades", F.lit(0))).over(to_here))
            .drop("_day", "n_trades"))
