"""Windows against pandas, with chunks small enough that every row crosses a border."""

import numpy as np
import pandas as pd
import pytest

from marketloom.operators import panel, signals


@pytest.fixture(scope="module")
def prices():
    rng = np.random.default_rng(7)
    days = pd.bdate_range("2026-01-02", periods=330)
    wide = pd.DataFrame(100 * np.exp(np.cumsum(rng.normal(0.0005, 0.01, (330, 3)), axis=0)),
                        index=days, columns=["AAA", "BBB", "IDX"])
    volume = pd.DataFrame(rng.integers(1_000_000, 5_000_000, (330, 3)).astype(float),
                          index=days, columns=wide.columns)
    return wide, volume


@pytest.fixture(scope="module")
def bars(spark, prices):
    wide, volume = prices
    long = wide.stack().rename("price").to_frame().join(volume.stack().rename("volume")).reset_index()
    long.columns = ["ts", "symbol", "price", "volume"]
    return spark.createDataFrame(long).cache()


def wide_of(df, column):
    out = df.select("ts", "symbol", column).toPandas()
    return out.pivot(index="ts", columns="symbol", values=column).sort_index()


def same(got, want):
    want = want.reindex(columns=got.columns)
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("chunk", [16, 8192])
def test_momentum_against_pandas(bars, prices, chunk):
    p, v = prices
    got = signals.momentum_features(bars, chunk_bars=chunk)
    same(wide_of(got, "momentum_roc20"), p.pct_change(20))
    same(wide_of(got, "momentum_ma50"), p / p.rolling(50, min_periods=50).mean() - 1)
    flag = ((p >= p.rolling(20, min_periods=20).max() * 0.999)
            & (v > 1.5 * v.rolling(20, min_periods=20).mean())).astype(float)
    same(wide_of(got, "momentum_breakout20"), flag)


@pytest.mark.parametrize("chunk", [16, 8192])
def test_reversion_and_volume_against_pandas(bars, prices, chunk):
    p, v = prices
    got = signals.mean_reversion_features(bars, chunk_bars=chunk)
    mean, sd = p.rolling(20, min_periods=20).mean(), p.rolling(20, min_periods=20).std()
    same(wide_of(got, "mr_zscore20"), -(p - mean) / sd)
    vwap = (p * v).rolling(20, min_periods=20).sum() / v.rolling(20, min_periods=20).sum()
    same(wide_of(got, "mr_dist_vwap20"), -(p / vwap - 1))
    z = (v - v.rolling(20, min_periods=20).mean()) / v.rolling(20, min_periods=20).std()
    out = signals.volume_features(bars, chunk_bars=chunk)
    same(wide_of(out, "volume_x_ret20"), z.fillna(0) * np.sign(p.diff()).fillna(0))


@pytest.mark.parametrize("chunk", [64, 8192])
def test_volatility_against_pandas(bars, prices, chunk):
    p, _ = prices
    rv = np.log(p / p.shift(1)).rolling(20, min_periods=20).std() * np.sqrt(252)
    rank = rv.rolling(252, min_periods=252).apply(lambda x: np.mean(x <= x[-1]), raw=True)
    got = signals.volatility_features(bars, chunk_bars=chunk)
    same(wide_of(got, "vol_realized20"), rv)
    same(wide_of(got, "vol_percentile252"), rank)
    same(wide_of(got, "vol_expanding"),
         (rv > 1.5 * rv.rolling(20, min_periods=20).median()).astype(float))


def test_regime_warm_up_and_breadth(bars, prices):
    p, _ = prices
    got = signals.regime_features(bars, "IDX", chunk_bars=64).toPandas().set_index("ts").sort_index()
    b = p["IDX"]
    up = [(b > b.rolling(n, min_periods=n).mean()).astype(float) for n in (50, 200)]
    np.testing.assert_allclose(got["regime_spy_trend"], up[0] + up[1] - 1)
    assert (got["regime_spy_trend"].iloc[:49] == -1).all()
    others = p.drop(columns="IDX")
    share = (others > others.rolling(50, min_periods=50).mean()).mean(axis=1)
    np.testing.assert_allclose(got["regime_breadth"], share)


def test_missing_cells_equal_the_dense_grid(spark, bars, prices):
    p, v = prices
    holes = (p.reset_index().index.to_numpy() % 37) == 5
    gappy_p, gappy_v = p.copy(), v.copy()
    gappy_p.loc[holes, "AAA"], gappy_v.loc[holes, "AAA"] = np.nan, np.nan
    thin = bars.join(spark.createDataFrame(pd.DataFrame(
        {"symbol": "AAA", "ts": p.index[holes]})), ["symbol", "ts"], "left_anti")
    got = wide_of(signals.momentum_features(thin, chunk_bars=32), "momentum_roc20")
    same(got, gappy_p.pct_change(20, fill_method=None))
    dense = panel.densify(thin, chunk_bars=50)
    assert dense.count() == p.size
    assert dense.filter("price IS NULL").count() == holes.sum()
    filled = wide_of(panel.forward_fill(dense, ["price"], chunk_bars=11), "price")
    same(filled, gappy_p.ffill())


def test_wide_long_round_trip(bars):
    wide = panel.to_wide(bars, "price", ["AAA", "BBB", "IDX"])
    back = panel.to_long(wide)
    assert back.join(bars, ["symbol", "ts", "price"]).count() == bars.count()


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    assert panel.nan_to_null(df).filter("x IS NULL").count() == 1


def test_windows_share_one_sort(bars):
    """All families of the feature table run over one (symbol, chunk) partitioning."""
    plan = signals.feature_table(bars, "IDX")._jdf.queryExecution().executedPlan().toString()
    keyed = [line for line in plan.splitlines() if "Exchange hashpartitioning(symbol" in line and "_chunk" in line]
    assert len(keyed) == 1, plan
    assert "CartesianProduct" not in plan
