"""Signal families over a long bar table ``(symbol, ts, price, volume)``.

``prepare`` numbers the bars, attaches the benchmark price and lays out the chunks; every
single-feature function then maps columns to a column over that layout, so all features of all
families share one shuffle and one sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import BarFrame, flag, nonzero, ratio
from ..plans.ordered import CHUNK_BARS, bar_calendar, drop_halo, number_bars, with_halo

BARS_PER_YEAR = 252

def prepare(bars: DataFrame, lookback: int, benchmark: str | None = None,
            chunk_bars: int = CHUNK_BARS, lookahead: int = 0) -> DataFrame:
    """Numbered, chunked panel; with a benchmark, its price at the same bar as ``bench_price``."""
    panel = number_bars(bars)
    if benchmark is not None:
        bench = (bars.filter(F.col("symbol") == benchmark)
                 .select("ts", F.col("price").alias("bench_price")))
        panel = panel.join(bench, "ts", "left")
    return with_halo(panel, lookback, chunk_bars=chunk_bars, lookahead=lookahead)


# ------------------------------------------------------------ momentum

def roc(f: BarFrame, price: Column, n: int = 20) -> Column:
    return ratio(price, f.back(price, n)) - 1


def ma_trend(f: BarFrame, price: Column, n: int = 50) -> Column:
    return ratio(price, f.full(F.avg, price, n)) - 1


def breakout(f: BarFrame, price: Column, volume: Column, n: int = 20) -> Column:
    near_high = price >= f.full(F.max, price, n) * 0.999
    heavy = volume > f.full(F.avg, volume, n) * 1.5
    return flag(near_high & heavy)


def momentum_columns(f: BarFrame) -> dict[str, Column]:
    return {"momentum_roc20": roc(f, f.price, 20), "momentum_roc60": roc(f, f.price, 60),
            "momentum_ma50": ma_trend(f, f.price, 50), "momentum_breakout20": breakout(f, f.price, f.volume, 20)}


# ------------------------------------------------------ mean reversion

def reversal(f: BarFrame, price: Column, n: int = 5) -> Column:
    return -roc(f, price, n)


def centred(f: BarFrame, x: Column, n: int) -> Column:
    """(x - mean) / sample deviation over the last ``n`` bars."""
    return (x - f.full(F.avg, x, n)) / nonzero(f.full(F.stddev_samp, x, n))


def zscore(f: BarFrame, price: Column, n: int = 20) -> Column:
    return -centred(f, price, n)


def dist_vwap(f: BarFrame, price: Column, volume: Column, n: int = 20) -> Column:
    vwap = f.full(F.sum, price * volume, n) / nonzero(f.full(F.sum, volume, n))
    return -(ratio(price, vwap) - 1)


def mean_reversion_columns(f: BarFrame) -> dict[str, Column]:
    return {"mr_reversal5": reversal(f, f.price, 5), "mr_zscore20": zscore(f, f.price, 20),
            "mr_dist_vwap20": dist_vwap(f, f.price, f.volume, 20)}


# -------------------------------------------------------- cross-section

def excess_vs_benchmark(f: BarFrame, price: Column, bench: Column, n: int = 20) -> Column:
    return roc(f, price, n) - roc(f, bench, n)


def excess_return(f: BarFrame) -> Column:
    return excess_vs_benchmark(f, f.price, f.bench, 1)


def vol_adjusted_strength(f: BarFrame, excess: Column, n: int = 60) -> Column:
    """Compounded excess over ``n`` bars by its sample deviation."""
    return (f.full(F.product, excess + 1, n) - 1) / nonzero(f.full(F.stddev_samp, excess, n))


# ------------------------------------------------------------ volatility

def log_return(f: BarFrame, price: Column) -> Column:
    step = ratio(price, f.back(price, 1))
    return F.when(step > 0, F.log(step))


def realized_vol(f: BarFrame, log_ret: Column, n: int = 20) -> Column:
    return f.full(F.stddev_samp, log_ret, n) * math.sqrt(BARS_PER_YEAR)


def vol_percentile(f: BarFrame, rv: Column, lookback: int = 252) -> Column:
    """Share of the last ``lookback`` values not above the current one."""
    history = f.full(F.collect_list, rv, lookback)
    return F.size(F.filter(history, lambda x: x <= rv)) / lookback


def expansion_flag(f: BarFrame, rv: Column, n: int = 20) -> Column:
    return flag(rv > f.full(lambda c: F.percentile(c, 0.5), rv, n) * 1.5)


# --------------------------------------------------------------- volume

def volume_zscore(f: BarFrame, volume: Column, n: int = 20) -> Column:
    return centred(f, volume, n)


def volume_columns(f: BarFrame) -> dict[str, Column]:
    z = volume_zscore(f, f.volume, 20)
    direction = F.coalesce(F.signum(f.price - f.back(f.price, 1)), F.lit(0.0))
    return {"volume_z20": z, "volume_x_ret20": F.coalesce(z, F.lit(0.0)) * direction,
            "volume_unusual": flag(F.abs(z) > 3.0)}


# -------------------------------------------------------------- families

def _emit(panel: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return drop_halo(panel.withColumns(columns)).select("symbol", "ts", *columns)


def momentum_features(bars: DataFrame, chunk_bars: int = CHUNK_BARS) -> DataFrame:
    return _emit(prepare(bars, 60, chunk_bars=chunk_bars), momentum_columns(BarFrame()))


def mean_reversion_features(bars: DataFrame, chunk_bars: int = CHUNK_BARS) -> DataFrame:
    return _emit(prepare(bars, 20, chunk_bars=chunk_bars), mean_reversion_columns(BarFrame()))


def volume_features(bars: DataFrame, chunk_bars: int = CHUNK_BARS) -> DataFrame:
    return _emit(prepare(bars, 20, chunk_bars=chunk_bars), volume_columns(BarFrame()))


def _with_volatility(panel: DataFrame, f: BarFrame) -> DataFrame:
    panel = panel.withColumn("_lr", log_return(f, f.price))
    panel = panel.withColumn("vol_realized20", realized_vol(f, F.col("_lr"), 20))
    rv = F.col("vol_realized20")
    return panel.withColumns({"vol_percentile252": vol_percentile(f, rv, 252),
                              "vol_expanding": expansion_flag(f, rv, 20)})


VOLATILITY = ("vol_realized20", "vol_percentile252", "vol_expanding")
VOLATILITY_LOOKBACK = 252 + 20


def volatility_features(bars: DataFrame, chunk_bars: int = CHUNK_BARS) -> DataFrame:
    panel = _with_volatility(prepare(bars, VOLATILITY_LOOKBACK, chunk_bars=chunk_bars), BarFrame())
    return drop_halo(panel).select("symbol", "ts", *VOLATILITY)


def _with_xsection(panel: DataFrame, f: BarFrame) -> DataFrame:
    panel = panel.withColumn("_excess", excess_return(f))
    return panel.withColumns({"xs_excess20": excess_vs_benchmark(f, f.price, f.bench, 20),
                              "xs_excess60": excess_vs_benchmark(f, f.price, f.bench, 60),
                              "xs_voladj60": vol_adjusted_strength(f, F.col("_excess"), 60)})


XSECTION = ("xs_excess20", "xs_excess60", "xs_voladj60")


def xsectional_features(bars: DataFrame, benchmark: str,
                        chunk_bars: int = CHUNK_BARS) -> DataFrame:
    """Benchmark-relative strength; the benchmark's own rows are dropped."""
    panel = _with_xsection(prepare(bars, 61, benchmark, chunk_bars), BarFrame())
    return (drop_halo(panel).filter(F.col("symbol") != benchmark)
            .select("symbol", "ts", *XSECTION))


def regime_features(bars: DataFrame, benchmark: str,
                    chunk_bars: int = CHUNK_BARS) -> DataFrame:
    """Market-level features, one row per bar time."""
    f = BarFrame()
    calendar = bar_calendar(bars)
    bench = (calendar.join(bars.filter(F.col("symbol") == benchmark).select("ts", "price"),
                           "ts", "left").withColumn("symbol", F.lit(benchmark)))
    panel = _with_volatility(with_halo(bench, VOLATILITY_LOOKBACK, chunk_bars=chunk_bars), f)
    panel = panel.withColumn("regime_spy_trend",
                             flag(f.price > f.full(F.avg, f.price, 50)) + flag(f.price > f.full(F.avg, f.price, 200)) - 1)
    market = drop_halo(panel).select(
        "ts", "regime_spy_trend", F.col("vol_percentile252").alias("regime_vol_percentile"),
        flag((F.col("regime_spy_trend") > 0) & (F.col("vol_percentile252") < 0.7))
        .alias("regime_risk_on"))
    return market.join(breadth(bars, benchmark, chunk_bars=chunk_bars), "ts", "left").select(
        "ts", "regime_spy_trend", "regime_vol_percentile",
        F.coalesce("regime_breadth", F.lit(0.0)).alias("regime_breadth"), "regime_risk_on")


def breadth(bars: DataFrame, benchmark: str, n: int = 50,
            chunk_bars: int = CHUNK_BARS) -> DataFrame:
    """Share of all non-benchmark symbols above their ``n``-bar average."""
    f = BarFrame()
    others = bars.filter(F.col("symbol") != benchmark)
    panel = with_halo(others.join(bar_calendar(bars), "ts"), n, chunk_bars=chunk_bars)
    above = drop_halo(panel.withColumn("_above", flag(f.price > f.full(F.avg, f.price, n))))
    universe = others.agg(F.countDistinct("symbol")).scalar()
    return (above.groupBy("ts").agg(F.sum("_above").alias("_n"))
            .select("ts", (F.col("_n") / universe).alias("regime_breadth")))


def feature_table(bars: DataFrame, benchmark: str, label_bars: int = 0,
                  chunk_bars: int = CHUNK_BARS) -> DataFrame:
    """All per-symbol families in one windowed pass, one row per (symbol, ts).

    With ``label_bars`` the return over the following bars is added as ``forward_return``.
    """
    f = BarFrame()
    panel = prepare(bars, VOLATILITY_LOOKBACK, benchmark, chunk_bars, label_bars)
    columns = {**momentum_columns(f), **mean_reversion_columns(f), **volume_columns(f)}
    label = {"forward_return": ratio(f.ahead(f.price, label_bars), f.price) - 1} if label_bars else {}
    panel = _with_xsection(_with_volatility(panel.withColumns({**columns, **label}), f), f)
    panel = panel.withColumns({c: F.when(F.col("symbol") != benchmark, F.col(c))
                               for c in XSECTION})
    return drop_halo(panel).select("symbol", "ts", "price", "volume", "bar_no",
                                   *columns, *VOLATILITY, *XSECTION, *label)


# --------------------------------------------- documented-only candidates

def cross_sectional_ranks(bars: DataFrame, long_bars: int = 252, skip_bars: int = 21,
                          chunk_bars: int = CHUNK_BARS) -> DataFrame:
    """Percentile rank across symbols of the skip-adjusted long return and of the last return.

    A bar's cross-section has one row per listed symbol, so that window is bounded by the universe.
    """
    f = BarFrame()
    panel = with_halo(number_bars(bars), long_bars, chunk_bars=chunk_bars)
    panel = panel.withColumns({
        "_long": ratio(f.back(f.price, skip_bars), f.back(f.price, long_bars)) - 1, "_last": roc(f, f.price, 1)})
    rows = drop_halo(panel)
    def rank(c: str, sign: int) -> Column:
        w = Window.partitionBy("ts", F.col(c).isNull()).orderBy(F.col(c) * sign, )
        return F.when(F.col(c).isNotNull(), F.percent_rank().over(w))
    return rows.select("symbol", "ts", rank("_long", 1).alias("xs_rank_long"),
                       rank("_last", -1).alias("xs_rank_reversal"))


def sector_relative(bars: DataFrame, sectors: DataFrame, n: int = 20,
                    chunk_bars: int = CHUNK_BARS) -> DataFrame:
    """``n``-bar return minus the mean return of the symbol's sector at that bar."""
    f = BarFrame()
    panel = with_halo(number_bars(bars), n, chunk_bars=chunk_bars)
    rows = (drop_halo(panel.withColumn("_roc", roc(f, f.price, n)))
            .join(sectors.select("symbol", "sector"), "symbol"))
    means = rows.groupBy("sector", "ts").agg(F.avg("_roc").alias("_mean"))
    return rows.join(means, ["sector", "ts"]).select(
        "symbol", "ts", "sector", (F.col("_roc") - F.col("_mean")).alias("sector_excess"))


def range_features(ohlc: DataFrame, n: int = 14, chunk_bars: int = CHUNK_BARS) -> DataFrame:
    """Average true range relative to price, and a contraction flag (range < half its average)."""
    f = BarFrame()
    panel = with_halo(number_bars(ohlc), n + 1, chunk_bars=chunk_bars)
    before = f.back(f.price, 1)
    panel = panel.withColumn("_tr", F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    atr = f.full(F.avg, F.col("_tr"), n)
    panel = panel.withColumns({"atr_rel": ratio(atr, f.price),
                               "contraction": flag(F.col("_tr") < atr * 0.5)})
    return drop_halo(panel).select("symbol", "ts", "atr_rel", "contraction")

