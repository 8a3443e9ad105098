"""Chunk scans and as-of joins against plain windows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.operators import audit, pit
from marketloom.plans.ordered import (asof_join, bar_calendar, chunk_scan, last_known, ordinal,
                                      previous_row, rows_chunk, running_max, running_min, running_sum)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 400, p=[0.7, 0.2, 0.1]), "seq": np.arange(400),
                        "x": rng.normal(size=400)})
    pdf.loc[rng.random(400) < 0.3, "x"] = np.nan
    df = spark.createDataFrame(pdf)
    return df.withColumn("x", F.when(~F.isnan("x"), F.col("x"))).cache()


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_scans_equal_windows(rows, size):
    w = Window.partitionBy("k").orderBy("seq")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    x = F.col("x")
    got = chunk_scan(rows, ["k"], rows_chunk("seq", size), ["seq"], [
        running_sum("s", x), running_max("m", x, inclusive=False), running_min("n", x),
        last_known("l", x), ordinal("i"), previous_row("p", x)])
    want = rows.select("*", F.coalesce(F.sum(x).over(upto), F.lit(0.0)).alias("ws"),
                       F.max(x).over(before).alias("wm"), F.min(x).over(upto).alias("wn"),
                       F.last(x, True).over(upto).alias("wl"), F.row_number().over(w).alias("wi"),
                       F.lag(x).over(w).alias("wp"))
    joined = got.drop("x").join(want, ["k", "seq"])
    assert joined.count() == 400
    close = lambda a, b: (F.col(a).eqNullSafe(F.col(b))) | (F.abs(F.col(a) - F.col(b)) < 1e-9)
    bad = joined.withColumn("p", F.col("p.v")).filter(~(
        close("s", "ws") & close("m", "wm") & close("n", "wn") & close("l", "wl")
        & close("i", "wi") & close("p", "wp")))
    assert bad.count() == 0


@pytest.mark.parametrize("chunk", [1, 60, 100_000])
def test_asof_equals_pandas(spark, chunk):
    rng = np.random.default_rng(2)
    t0 = pd.Timestamp("2024-01-01")
    left = pd.DataFrame({"k": rng.choice(["a", "b"], 60), "t": t0 + pd.to_timedelta(rng.integers(0, 500, 60), "s"),
                         "id": np.arange(60)}).sort_values("t")
    right = pd.DataFrame({"k": rng.choice(["a", "b"], 80), "q": t0 + pd.to_timedelta(rng.permutation(500)[:80], "s"),
                          "v": rng.normal(size=80)}).sort_values("q")
    for tolerance in (None, 20):
        want = pd.merge_asof(left, right, left_on="t", right_on="q", by="k",
                             tolerance=None if tolerance is None else pd.Timedelta(tolerance, "s"))
        got = asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", "q", ["v"],
                        chunk_seconds=chunk, tolerance_seconds=tolerance).toPandas()
        a, b = got.sort_values("id")["v"].to_numpy(float), want.sort_values("id")["v"].to_numpy(float)
        np.testing.assert_allclose(a, b)


def test_calendar_is_dense(spark):
    days = spark.range(900).select(F.timestamp_add("DAY", F.col("id").cast("int") * 2,
                                                   F.lit("2020-01-01").cast("timestamp")).alias("ts"))
    got = bar_calendar(days.union(days)).orderBy("ts").toPandas()
    assert got["bar_no"].tolist() == list(range(1, 901))


def test_guards(spark):
    rows = spark.createDataFrame([("A", "2024-01-02", "2024-01-01"), ("A", "2024-01-03", "2024-01-04")],
                                 "symbol string, as_of string, source_max_ts string")
    rows = rows.select("symbol", F.col("as_of").cast("timestamp").alias("as_of"),
                       F.col("source_max_ts").cast("timestamp").alias("source_max_ts"))
    with pytest.raises(pit.LeakageError, match="future_as_of"):
        pit.check_feature_rows(rows, "2024-01-02")
    with pytest.raises(pit.LeakageError, match="source_after_as_of"):
        pit.check_feature_rows(rows, "2024-01-05")
    with pytest.raises(pit.LeakageError, match="missing"):
        pit.check_feature_rows(rows.drop("as_of"), "2024-01-05")
    pit.check_feature_rows(pit.at_or_before(rows, "2024-01-02"), "2024-01-02")
    with pytest.raises(pit.LeakageError):
        pit.check_no_future_bars(rows.withColumnRenamed("as_of", "ts"), "2024-01-02")
    steps = spark.createDataFrame([(0, 1, 5), (0, 2, 5), (0, 3, 4)], "k int, seq int, ts int")
    with pytest.raises(pit.LeakageError):
        pit.assert_chronological(steps, ["k"], ["seq"], rows_chunk("seq", 1))
    pit.assert_chronological(steps.filter("seq < 3"), ["k"], ["seq"], rows_chunk("seq", 1))


@pytest.mark.parametrize("size", [3, 1000])
def test_clamped_positions_equal_a_loop(spark, size):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"account": 1, "seq": np.arange(1, 201), "symbol": rng.choice(["A", "B"], 200),
                        "side": rng.choice(["BUY", "SELL"], 200), "qty": rng.integers(1, 9, 200).astype(float),
                        "fill_price": rng.uniform(1, 9, 200)})
    held, price, want = {}, {}, []
    cash = 50.0
    for r in pdf.itertuples():
        before = held.get(r.symbol, 0.0)
        held[r.symbol] = before + r.qty if r.side == "BUY" else max(0.0, before - r.qty)
        cash += (-1 if r.side == "BUY" else 1) * r.qty * r.fill_price
        price[r.symbol] = r.fill_price
        want.append((before, held[r.symbol], cash + sum(held[s] * price[s] for s in held)))
    got = audit.account_state(spark.createDataFrame(pdf), 50.0, rows=size).orderBy("seq").toPandas()
    np.testing.assert_allclose(got[["held_before", "position", "equity"]].to_numpy(), np.array(want), atol=1e-9)


def test_concentration_blocks_do_not_change_the_result(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"account": rng.integers(0, 2, 300), "symbol": rng.choice(list("ABCDE"), 300),
                        "side": rng.choice(["BUY", "BUY", "SELL"], 300),
                        "qty": rng.integers(1, 9, 300).astype(float), "fill_price": rng.uniform(4, 9, 300)})
    pdf["seq"] = pdf.groupby("account").cumcount() + 1
    fills = spark.createDataFrame(pdf)
    results = [sorted(map(tuple, audit.audit_fills(fills, 2000.0, block=b).collect())) for b in (1, 7, 5000)]
    assert results[0] == results[1] == results[2] and results[0]


def test_asof_keeps_rows_without_key_or_time(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, None, 5), (3, "a", None), (4, "b", 1)], "id int, k string, s int")
    right = spark.createDataFrame([("a", 3, 30), (None, 3, 31), ("a", None, 32), ("b", 2, 33)], "k string, s int, v int")
    at = lambda df, name: df.withColumn(name, F.timestamp_seconds("s")).drop("s")
    out = asof_join(at(left, "t"), at(right, "u"), ["k"], "t", "u", ["v"]).collect()
    assert {r["id"]: r["v"] for r in out} == {1: 30, 2: None, 3: None, 4: None}


def test_scan_treats_null_keys_as_a_key(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, t int")
    out = chunk_scan(rows, ["k"], F.floor(F.col("t") / 2), ["t"], [ordinal("n")]).collect()
    assert sorted((str(r["k"]), r["t"], r["n"]) for r in out) == [("None", 1, 1), ("None", 2, 2), ("a", 1, 1)]


def test_hot_key_is_cut_by_depth(spark, monkeypatch):
    """One key holds nearly all rows, all within a few seconds of one time chunk."""
    from marketloom.plans import ordered

    rng = np.random.default_rng(5)
    t0 = pd.Timestamp("2024-01-01")
    right = pd.DataFrame({"k": ["hot"] * 1500 + ["cold"] * 20, "q": t0 + pd.to_timedelta(
        np.concatenate([rng.integers(0, 4_000_000, 1500), rng.integers(0, 10**11, 20)]), "us"), "v": np.arange(1520.0)})
    left = pd.DataFrame({"k": ["hot"] * 900 + ["cold"] * 5 + [None] * 2, "id": np.arange(907), "t": t0 + pd.to_timedelta(
        np.concatenate([rng.integers(0, 5_000_000, 900), rng.integers(0, 10**11, 7)]), "us")})
    depth = []
    real = ordered.equi_depth
    monkeypatch.setattr(ordered, "equi_depth", lambda *a, **k: depth.append(real(*a, **k)) or depth[-1])
    frames = spark.createDataFrame(left).repartition(4), spark.createDataFrame(right).repartition(4)
    got = asof_join(*frames, ["k"], "t", "q", ["v"], right_order=["v"], max_rows=100).toPandas().sort_values("id")
    keyed = left.dropna().sort_values("t", kind="stable")
    want = pd.merge_asof(keyed, right.sort_values(["q", "v"]), left_on="t", right_on="q", by="k").sort_values("id")
    np.testing.assert_allclose(got["v"].to_numpy(float)[:905], want["v"].to_numpy(float))
    assert got["v"].isna().tail(2).all() and len(got) == 907
    sizes = depth[0].groupBy("_s").count().toPandas()["count"]
    assert len(sizes) >= 20 and sizes.max() < 400
    # Without a hot key nothing is cut.
    depth.clear()
    asof_join(*frames, ["k"], "t", "q", ["v"], max_rows=5000)
    assert not depth


@pytest.mark.parametrize("max_rows", [3, 50])
def test_scans_over_cut_chunks_equal_windows(rows, max_rows):
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    got = chunk_scan(rows, ["k"], F.lit(0), ["seq"], [running_sum("s", F.col("x")), last_known("l", F.col("x")), ordinal("i")], max_rows)
    want = rows.select("k", "seq", F.coalesce(F.sum("x").over(w), F.lit(0.0)).alias("ws"), F.last("x", True).over(w).alias("wl"),
                       F.count("*").over(w).alias("wi"))
    bad = got.join(want, ["k", "seq"]).filter((F.abs(F.col("s") - F.col("ws")) > 1e-9) | ~F.col("l").eqNullSafe(F.col("wl")) | (F.col("i") != F.col("wi")))
    assert got.count() == 400 and bad.count() == 0
