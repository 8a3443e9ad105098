"""Reject codes one by one, construction rules, ridge and backtest identities."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import backtest, decisions, ridge

LIMITS = decisions.Limits()
CASES = {  # code: (proposal, account, market, held) changes against an order that is allowed
    "ALLOW": ({}, {}, {}, 0.0),
    "UNKNOWN_SYMBOL": ({"symbol": "ZZZ"}, {}, {}, 0.0),
    "SHORT_ATTEMPT": ({"side": "SELL"}, {}, {}, 0.0),
    "OVERSELL": ({"side": "SELL", "qty": 2.0}, {}, {}, 1.0),
    "NONPOSITIVE_QTY": ({"qty": 0.0}, {}, {}, 0.0),
    "BAD_ORDER_TYPE": ({"order_type": "stop"}, {}, {}, 0.0),
    "BAD_TIF": ({"tif": "gtc"}, {}, {}, 0.0),
    "PENNY_STOCK": ({}, {}, {"price": 4.99}, 0.0),
    "ILLIQUID": ({}, {}, {"adv_dollar_volume": 1.0}, 0.0),
    "EXCESS_VOLATILITY": ({}, {}, {"ann_vol": 1.5}, 0.0),
    "OVER_CONCENTRATION": ({"qty": 3.0}, {}, {}, 0.0),
    "OVER_EXPOSURE": ({}, {"extra": 9.4}, {}, 0.0),
    "DAILY_LOSS_HALT": ({}, {"day_pnl": -5.0}, {}, 0.0),
    "MAX_TRADES": ({}, {"trades_today": 10}, {}, 0.0),
    "INSUFFICIENT_CAPITAL": ({}, {"cash": 9.0}, {}, 0.0),
}


@pytest.mark.parametrize("code", list(CASES))
def test_reject_codes(spark, code):
    change, account, market, held = CASES[code]
    p = {"account": 1, "symbol": "AAA", "side": "BUY", "qty": 1.0, "order_type": "market", "tif": "day", **change}
    a = {"equity": 100.0, "cash": 100.0, "day_start_equity": 100.0, "day_pnl": 0.0, "trades_today": 0, **account}
    m = {"price": 10.0, "adv_dollar_volume": 1e9, "ann_vol": 0.2, **market}
    proposals = spark.createDataFrame([tuple(p.values())], "account int, symbol string, side string, qty double, order_type string, tif string")
    accounts = spark.createDataFrame([(1, a["equity"], a["cash"], a["day_start_equity"], a["day_pnl"], a["trades_today"])],
                                     "account int, equity double, cash double, day_start_equity double, day_pnl double, trades_today int")
    positions = spark.createDataFrame([(1, "AAA", held), (1, "BBB", a.get("extra", 0.0)), (1, "NOPRICE", 9.0)],
                                      "account int, symbol string, qty double")
    quotes = spark.createDataFrame([("AAA", m["price"], m["adv_dollar_volume"], m["ann_vol"]), ("BBB", 10.0, 1e9, 0.2)],
                                   "symbol string, price double, adv_dollar_volume double, ann_vol double")
    universe = spark.createDataFrame([("AAA",), ("BBB",)], "symbol string")
    row = decisions.evaluate(proposals, accounts, positions, quotes, universe, LIMITS).first()
    assert row["code"] == code and row["allow"] == (code == "ALLOW")
    stopped = decisions.evaluate(proposals, accounts, positions, quotes, universe, LIMITS, kill_switch=True).first()
    assert stopped["code"] == "KILL_SWITCH"
    assert set(decisions.CODES) >= set(CASES) - {"ALLOW"}


def build(spark, er, prices, held, equity=100.0):
    frame = lambda d, v: spark.createDataFrame([(1, s, float(x)) for s, x in d.items()] or [], f"rebalance int, symbol string, {v} double")
    out = decisions.construct(frame(er, "expected_return"), frame(prices, "price"),
                              spark.createDataFrame([(1, equity)], "rebalance int, equity double"), frame(held, "qty"), LIMITS)
    return {(r["symbol"], r["side"]): round(r["qty"], 6) for r in out.collect()}


def test_construct_rules(spark):
    prices = {"A": 10.0, "B": 20.0, "C": 4.0, "D": 50.0}
    assert build(spark, {"A": 0.001, "C": 0.5}, prices, {"A": 3}) == {}  # no candidate: no orders
    got = build(spark, {"A": 0.02, "B": 0.02, "C": 0.9}, prices, {"B": 9, "D": 1})
    assert got == {("A", "BUY"): 2.5, ("D", "SELL"): 1.0}  # cap 25 %, no trim of B, D closed
    dust = build(spark, {"A": 0.02}, prices, {"D": 1}, equity=10.0)
    assert dust == {("D", "SELL"): 1.0}  # all candidates are dust: everything is sold
    assert build(spark, {"A": 0.02}, prices, {"A": 2.4}) == {}  # the step itself is dust


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(200, 4))
    y = 0.5 * x[:, 1] - 0.3 * x[:, 2] + rng.normal(0, 0.1, 200)
    pdf = pd.DataFrame(x, columns=list("abcd"))
    pdf["d"] = 1.0
    pdf["y"], pdf["bar_no"] = y, np.arange(1, 201)
    pdf.loc[::17, "a"] = np.nan
    pdf.loc[::13, "y"] = np.nan
    return pdf, spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                                      "a double, b double, c double, d double, y double, bar_no long")


def direct(pdf, features, alpha):
    x = pdf[features].to_numpy(float)
    mean, scale = np.nanmean(x, axis=0), np.nanstd(x, axis=0)
    scale[scale == 0] = 1
    z = np.nan_to_num((x - mean) / scale)
    ok = pdf["y"].notna().to_numpy()
    coef = np.linalg.solve(z[ok].T @ z[ok] + alpha * np.eye(len(features)), z[ok].T @ pdf["y"][ok].to_numpy())
    return z, coef, pdf["y"].mean()


def test_ridge_equals_direct_solve(panel):
    pdf, df = panel
    model = ridge.fit(df, list("abcd"), "y", 2.0)
    z, coef, intercept = direct(pdf, list("abcd"), 2.0)
    np.testing.assert_allclose(model.coef, coef, rtol=1e-9, atol=1e-12)
    got = model.explain(df).orderBy("bar_no").toPandas()
    np.testing.assert_allclose(got["expected_return"], intercept + z @ coef)
    total = got["contributions"].map(lambda ps: sum(p["contribution"] for p in ps)) + got["intercept"]
    np.testing.assert_allclose(total, got["expected_return"])
    assert all(abs(a[0]["contribution"]) >= abs(a[1]["contribution"]) for a in got["contributions"])
    assert model.explain(df, 2).first()["contributions"].__len__() == 2
    with pytest.raises(ValueError):
        ridge.fit(df, ["a"], "y", -1.0)
    m = ridge.Moments.of(ridge.ridge_moments(df, list("abcd"), "y").first(), 4)
    ok = pdf["y"].notna()
    want = ((pdf["y"] - intercept - z @ coef)[ok] ** 2).sum()
    assert ridge.squared_error(model, m) == pytest.approx(want)


def test_walk_forward_uses_only_the_past(panel):
    pdf, df = panel
    predictions, folds = ridge.walk_forward(df, ["b", "c"], "y", 25, 5, alphas=(0.1, 1.0, 1000.0))
    got = predictions.toPandas()
    for fold in folds.collect():
        start = (fold["block"] - 1) * 25
        train = pdf[pdf["bar_no"] < start - 5]
        x = train[["b", "c"]].to_numpy()
        _, coef, intercept = direct(train, ["b", "c"], fold["alpha"])
        test = got[got["fold"] == fold["fold"]]
        z = (test[["b", "c"]].to_numpy() - x.mean(axis=0)) / x.std(axis=0)
        np.testing.assert_allclose(test["prediction"], intercept + z @ coef)
        assert test["bar_no"].min() >= start + 25 and fold["alpha"] < 1000


@pytest.mark.parametrize("expanding,train_blocks", [(True, 2), (False, 3), (False, 1)])
@pytest.mark.parametrize("lift,drift", [(0.0, 0.0), (1e8, 0.0), (-3e7, 1e4)])
def test_walk_forward_of_columns_far_from_zero(spark, expanding, train_blocks, lift, drift):
    rng = np.random.default_rng(9)
    n, block, embargo, alpha = 700, 100, 10, (2.0, 0.5)
    pdf = pd.DataFrame({"bar_no": np.arange(n) + 200, "b": rng.normal(size=n), "c": rng.normal(size=n), "k": 7.25})
    pdf["y"] = 5.0 + 1.5 * pdf["b"] - 0.5 * pdf["c"] + 0.1 * rng.normal(size=n)
    pdf["b"] += lift + drift * (pdf["bar_no"] // block)
    pdf["y"] += lift / 1e6
    pdf.loc[::13, "b"] = None
    pdf.loc[::17, "y"] = None
    features = ["b", "c", "k"]
    predictions, folds = ridge.walk_forward(spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).to_dict("records"),
                                                                  "bar_no long, b double, c double, k double, y double"),
                                            features, "y", block, embargo, alpha, expanding, train_blocks)
    found = {f["fold"]: f for f in folds.collect()}
    assert len(found) == 7 - train_blocks - 1
    got = predictions.toPandas().set_index("bar_no")["prediction"]
    for fold, f in found.items():
        first = 200 + (0 if expanding else fold) * block
        last = 200 + (fold + train_blocks) * block
        train = pdf[(pdf["bar_no"] >= first) & (pdf["bar_no"] < last - embargo)]
        check = pdf[(pdf["bar_no"] >= last) & (pdf["bar_no"] < last + block - embargo)]
        x = train[features].to_numpy()
        mean, scale = np.nanmean(x, axis=0), np.nanstd(x, axis=0)
        scale[2] = 1
        shift = train["y"].mean()
        ok = train["y"].notna()
        z = np.nan_to_num((x - mean) / scale)[ok]
        fits = []
        for a in alpha:
            coef = np.linalg.solve(z.T @ z + a * np.eye(3), z.T @ (train["y"][ok] - shift) + z.sum(axis=0) * shift)
            zc = np.nan_to_num((check[features].to_numpy() - mean) / scale)
            fits.append((np.nanmean((check["y"] - shift - zc @ coef) ** 2), a, coef))
        mse, a, coef = min(fits, key=lambda r: r[0])
        assert f["block"] == last // block + 1 and f["alpha"] == a and f["scale"][2] == 1.0
        np.testing.assert_allclose(f["coef"], coef, rtol=2e-6, atol=2e-6)
        np.testing.assert_allclose(f["scale"], scale, rtol=1e-6)
        assert f["validation_mse"] == pytest.approx(mse, rel=1e-5) and f["intercept"] == pytest.approx(shift)
        test = pdf[(pdf["bar_no"] >= last + block) & (pdf["bar_no"] < last + 2 * block)]
        zt = np.nan_to_num((test[features].to_numpy() - mean) / scale)
        np.testing.assert_allclose(got.loc[test["bar_no"]], shift + zt @ coef, rtol=1e-6, atol=1e-5)


def test_states_merge_like_their_rows():
    rng = np.random.default_rng(3)
    x, y = 1e9 + rng.normal(size=60), rng.normal(size=60)

    def state(rows):
        a, b = x[rows], y[rows]
        return (len(rows), a.mean(), b.mean(), ((a - a.mean()) * (b - b.mean())).sum()) if len(rows) else ridge.EMPTY
    cuts = [0, 5, 5, 20, 21, 40, 60]
    parts = [np.arange(a, b) for a, b in zip(cuts, cuts[1:])]
    states = [state(p) for p in parts]
    for got, k in zip(ridge.prefix_merges(states), range(7)):
        np.testing.assert_allclose(got, state(np.arange(cuts[k])), rtol=1e-9, atol=1e-5)
    for width in (1, 2, 4, 6):
        merged = ridge.window_merges(states, width)
        assert len(merged) == 6 - width + 1
        for a, got in enumerate(merged):
            np.testing.assert_allclose(got, state(np.concatenate(parts[a:a + width])), rtol=1e-9, atol=1e-5)


def test_full_weight_earns_the_benchmark(spark):
    p = [10.0, 11.0, 9.0, 12.0, 12.6, 13.0]
    days = [datetime(2024, 1, 1 + i) for i in range(6)]
    bars = spark.createDataFrame([("AAA", d, x, 1.0) for d, x in zip(days, p)], "symbol string, ts timestamp, price double, volume double")
    weights = spark.createDataFrame([("r", d, "AAA", 1.0) for d in days], "run string, ts timestamp, symbol string, weight double")
    curve = backtest.backtest(weights, bars, cost_bps=10.0, embargo_bars=1).orderBy("bar_no").toPandas()
    # Decided on bar 2, traded on bar 3 (one turnover), earning from bar 4 on.
    assert curve["turnover"].tolist() == [0, 0, 1, 0, 0, 0]
    assert curve["equity"].iloc[-1] == pytest.approx(100 * (1 - 0.001) * p[-1] / p[2])
    worst = backtest.drawdowns(backtest.backtest(weights, bars, 0.0, 0)).agg({"drawdown": "min"}).first()[0]
    assert worst == pytest.approx(9 / 11 - 1)  # decided on bar 1, in from bar 2: the fall to bar 3
    assert backtest.unknown_symbols(weights, bars).isEmpty()
    first = backtest.benchmark_curve(bars, "AAA").orderBy("ts").toPandas()["benchmark"]
    assert first.iloc[0] == 100 and first.iloc[-1] == pytest.approx(130)


def test_unknown_order_fields_are_refused(spark):
    rows = [("acc", "AAA", "BUY", 1.0, "market", "day"), ("acc", "AAA", "BUY", None, "market", "day"),
            ("acc", "AAA", "BUY", 1.0, None, "day"), ("acc", "AAA", "BUY", 1.0, "market", None),
            ("acc", "AAA", None, 1.0, "market", "day"), ("none", "AAA", "SELL", 1.0, "market", "day"),
            ("acc", "AAA", "BUY", float("nan"), "market", "day")]
    proposals = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                      "id int, account string, symbol string, side string, qty double, order_type string, tif string")
    accounts = spark.createDataFrame([("acc", 1000.0, 1000.0, 1000.0, 0.0, 0)],
                                     "account string, equity double, cash double, day_start_equity double, day_pnl double, trades_today int")
    positions = spark.createDataFrame([("none", "AAA", 5.0)], "account string, symbol string, qty double")
    market = spark.createDataFrame([("AAA", 10.0, 1e9, 0.1)], "symbol string, price double, adv_dollar_volume double, ann_vol double")
    limits = decisions.Limits()
    out = decisions.evaluate(proposals, accounts, positions, market, market.select("symbol"), limits)
    assert {r["id"]: r["code"] for r in out.collect()} == {
        0: "ALLOW", 1: "NONPOSITIVE_QTY", 2: "BAD_ORDER_TYPE", 3: "BAD_TIF", 4: "SHORT_ATTEMPT", 5: "UNKNOWN_ACCOUNT",
        6: "NONPOSITIVE_QTY"}


def test_ridge_with_a_large_offset(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=300)
    pdf = pd.DataFrame({"x": 1e9 + x, "k": np.full(300, 0.1), "y": 3.0 * x})
    model = ridge.fit(spark.createDataFrame(pdf), ["x", "k"], "y", alpha=0.0 + 1e-9)
    assert model.coef[0] == pytest.approx(3.0 * np.std(x), rel=1e-5) and model.scale[1] == 1.0


def test_logistic_fit_solves_its_score_equations(spark):
    rng = np.random.default_rng(8)
    n = 500
    pdf = pd.DataFrame({"a": 1e6 + rng.normal(size=n), "b": 3 * rng.normal(size=n), "k": 2.0})
    p = 1 / (1 + np.exp(-(0.4 + 1.2 * (pdf["a"] - 1e6) - 0.3 * pdf["b"])))
    pdf["y"] = np.where(rng.uniform(size=n) < p, 0.01, -0.01)
    pdf.loc[::19, "b"] = np.nan
    pdf.loc[::23, "y"] = np.nan
    df = spark.createDataFrame(pdf).select(*[F.nanvl(F.col(c), F.lit(None)).alias(c) for c in pdf.columns])
    for alpha in (0.0, 0.05):
        model = ridge.fit_logistic(df, ["a", "b", "k"], "y", alpha)
        z = pdf[["a", "b", "k"]].to_numpy()
        z = np.nan_to_num((z - np.nanmean(z, axis=0)) / np.where(np.nanstd(z, axis=0) == 0, 1, np.nanstd(z, axis=0)))
        ok = pdf["y"].notna().to_numpy()
        fitted = 1 / (1 + np.exp(-(model.intercept + z @ model.coef)))
        gap = (fitted - (pdf["y"] > 0))[ok]
        assert abs(gap.mean()) < 1e-9 and np.abs(z[ok].T @ gap / ok.sum() + alpha * model.coef).max() < 1e-9
        assert model.steps < 12 and model.coef[2] == pytest.approx(0, abs=1e-9) and model.coef[0] > 0.5
        got = model.score(df).toPandas()["p_up"]
        np.testing.assert_allclose(np.sort(got), np.sort(fitted), atol=1e-6)
    apart = spark.createDataFrame([(float(i), 1.0 if i > 5 else -1.0) for i in range(12)], "x double, y double")
    with pytest.raises(ArithmeticError):
        ridge.fit_logistic(apart, ["x"], "y", max_steps=15)
    assert ridge.fit_logistic(apart, ["x"], "y", 0.1).coef[0] > 0
