"""Parameter recovery, residual law and window fits of the point-process operators."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import hawkes

MU, ALPHA, BETA = np.array([0.05, 0.1]), np.array([[0.1, 0.0], [0.6, 0.2]]), 2.0


def simulate(seed, horizon):
    """Thinning; test data only."""
    rng = np.random.default_rng(seed)
    t, excite, times = 0.0, np.zeros(2), ([], [])
    while True:
        bound = (MU + excite).sum()
        step = rng.exponential(1 / bound)
        t += step
        if t >= horizon:
            return times
        excite = excite * np.exp(-BETA * step)
        rate = MU + excite
        if rng.uniform() * bound < rate.sum():
            dim = int(rng.uniform() * rate.sum() > rate[0])
            times[dim].append(t)
            excite = excite + ALPHA[:, dim] * BETA


@pytest.fixture(scope="module")
def events(spark):
    rows = []
    for session in (0, 1):
        for dim, ts in enumerate(simulate(42 + session, 6000.0)):
            rows += [(session, dim, int(round(x * 1e6))) for x in ts]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["session", "dim", "t_us"])).cache()


def test_grid_fit_recovers_the_parameters(events):
    for r in hawkes.fit_grid(events, ["session"]).collect():
        assert 1.0 <= r["beta"] <= 3.5
        assert abs(r["alpha_1_0"] - 0.6) < 0.2 and abs(r["alpha_1_1"] - 0.2) < 0.12
        assert abs(r["mu_0"] - 0.05) < 0.02 and abs(r["mu_1"] - 0.1) < 0.03
        assert 0.1 < r["endogeneity"] < 0.4
        assert r["half_life"] == pytest.approx(np.log(2) / r["beta"])


def test_residuals_are_unit_exponential(spark, events):
    true = spark.createDataFrame([(s, BETA, 0.1, 0.6, 0.2) for s in (0, 1)],
                                 "session long, beta double, mu_1 double, alpha_1_0 double, alpha_1_1 double")
    res = hawkes.compensator(events, true, ["session"]).cache()
    stats = res.agg(F.avg("residual").alias("m"), F.min("residual").alias("lo")).first()
    assert abs(stats["m"] - 1) < 0.1 and stats["lo"] > 0
    assert all(r["exponential"] for r in hawkes.ks_exponential(res, ["session"]).collect())
    wrong = true.withColumn("alpha_1_0", F.lit(0.0))
    bad = hawkes.ks_exponential(hawkes.compensator(events, wrong, ["session"]), ["session"]).collect()
    assert not any(r["exponential"] for r in bad)


def test_rolling_windows(events):
    got = hawkes.rolling_fit(events, 3600, 900, 2.0).toPandas()
    assert len(got) == 2 * len({round(x) for x in got[got["session"] == 0]["window_start"]})
    assert ((got["window_end"] - got["window_start"]).round(6) == 3600).all()
    assert (got["news_count"] > 2).all() and (got["price_count"] > 50).all()
    last = events.groupBy("session").agg(F.max("t_us")).toPandas().set_index("session").iloc[:, 0] / 1e6
    assert all(r.window_end <= last[r.session] + 1e-9 for r in got.itertuples())


def test_ties_move_apart(spark):
    t = lambda s: datetime(2024, 1, 2, 15) + timedelta(microseconds=s)
    news = spark.createDataFrame([(1, t(5))], "session int, ts timestamp")
    jumps = spark.createDataFrame([(1, t(x)) for x in (7, 7, 7, 20)], "session int, ts timestamp")
    got = hawkes.streams(news, jumps)
    assert sorted((r["dim"], r["t_us"]) for r in got.collect()) == [(0, 0), (1, 2), (1, 3), (1, 4), (1, 15)]


def test_trading_hours_are_inclusive(spark):
    stamps = ["2024-07-01 13:29:59.999999", "2024-07-01 13:30:00", "2024-07-01 20:00:00", "2024-07-01 20:00:00.000001",
              "2024-01-02 14:30:00", "2024-01-02 21:00:00"]
    df = spark.createDataFrame([(s,) for s in stamps], "s string").select(F.col("s").cast("timestamp").alias("ts"))
    assert hawkes.trading_hours(df).count() == 4


def test_first_tick_is_not_a_jump(spark):
    df = spark.createDataFrame([(1, i, datetime(2024, 1, 1) + timedelta(hours=i), p) for i, p in
                                enumerate([5.0, 5.0, 6.0, 6.0, 4.0])], "session int, event_id int, ts timestamp, price double")
    got = hawkes.price_jumps(df).orderBy("event_id").collect()
    assert [(r["event_id"], r["price_change"]) for r in got] == [(2, 1.0), (4, -2.0)]


def test_closed_form_meets_the_optimality_conditions(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(200):
        a = rng.normal(size=(5, 3)) * rng.choice([1e-3, 1.0, 1e3], size=3)
        g = a.T @ a + 1e-9 * np.eye(3)
        r = a.T @ rng.normal(size=5)
        rows.append([*g[np.triu_indices(3)].tolist(), *r.tolist()])
    # Nothing to explain, a dead column, and two equal columns.
    rows += [[1.0, 0.0, 0.0, 1.0, 0.0, 1.0, -1.0, -2.0, 0.0], [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 2.0, 0.0, 3.0], [2.0, 2.0, 0.0, 2.0, 0.0, 1.0, 2.0, 2.0, 1.0]]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "i int, a double, b double, c double, d double, e double, f double, x double, y double, z double")
    m = [["a", "b", "c"], ["b", "d", "e"], ["c", "e", "f"]]
    w = hawkes.nonnegative_solution([[F.col(c) for c in row] for row in m], [F.col(c) for c in "xyz"])
    got = {r["i"]: np.array(r["w"]) for r in df.select("i", w.alias("w")).collect()}
    supports = set()
    for i, (a, b, c, d, e, f, *r) in enumerate(rows):
        g = np.array([[a, b, c], [b, d, e], [c, e, f]])
        unit = np.sqrt(np.diag(g))
        slope = (g @ got[i] - r) / np.where(unit == 0, 1, unit)
        size = np.linalg.norm(np.array(r) / np.where(unit == 0, 1, unit)) + 1e-9
        assert (got[i] >= 0).all() and (slope >= -1e-6 * size).all()
        assert np.abs(slope[got[i] > 0]).max(initial=0.0) <= 1e-6 * size
        supports.add(tuple(got[i] > 0))
    assert len(supports) == 8
    assert got[200].tolist() == [0, 0, 0] and got[201].tolist() == [2, 0, 3]


def test_fit_of_silent_and_single_streams(spark):
    df = spark.createDataFrame([(1, 1, 5_000_000), (1, 1, 9_000_000), (2, 0, 0)], "session long, dim int, t_us long")
    got = {r["session"]: r for r in hawkes.fit_grid(df, ["session"], [1.0, 2.0]).collect()}
    assert got[1]["alpha_1_0"] == 0 and got[1]["mu_0"] == 0 and got[1]["mu_1"] == pytest.approx(2 / 9, rel=0.4)
    assert got[2]["n0"] == 1 and got[2]["n1"] == 0


def test_dense_spans_are_cut(events, spark):
    """Parts bounded in rows carry the same decayed sums, ties included."""
    few = events.filter("t_us < 400000000").unionByName(spark.createDataFrame([(0, 0, 5_000_000), (0, 1, 5_000_000), (None, 1, 7)], events.schema))
    take = ["session", "dim", "t_us", "s0", "s1", "tie0", "tie1"]
    whole = hawkes.decayed_sums(few, ["session"], F.lit(0.5)).select(*take).toPandas().sort_values(take[:3]).to_numpy(float)
    parts = hawkes.decayed_sums(few, ["session"], F.lit(0.5), max_rows=10).select(*take).toPandas().sort_values(take[:3]).to_numpy(float)
    np.testing.assert_allclose(parts, whole, rtol=1e-9, atol=1e-12)
    pdf = few.filter("session = 0").toPandas().sort_values("t_us")
    t, dim = pdf["t_us"].to_numpy() / 1e6, pdf["dim"].to_numpy()
    for i in range(0, len(t), 17):
        want = [np.exp(-0.5 * (t[i] - t[(dim == j) & (t < t[i])])).sum() for j in (0, 1)]
        row = parts[(parts[:, 0] == 0) & (parts[:, 1] == dim[i]) & (parts[:, 2] == pdf["t_us"].iloc[i])][0]
        np.testing.assert_allclose(row[3:5], want, rtol=1e-9, atol=1e-12)
    truth = spark.createDataFrame([(s, BETA, 0.1, 0.6, 0.2) for s in (0, 1)],
                                  "session long, beta double, mu_1 double, alpha_1_0 double, alpha_1_1 double")
    a, b = (hawkes.compensator(few.filter("session IS NOT NULL"), truth, ["session"], max_rows=m).toPandas().sort_values(["session", "t_us"]).to_numpy(float)
            for m in (7, 1 << 20))
    np.testing.assert_allclose(a, b, rtol=1e-8, atol=1e-10)
