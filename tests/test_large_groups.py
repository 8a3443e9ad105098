"""Groups far larger than a task: medians, long holdings, positions without keys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import audit, studies


@pytest.mark.parametrize("chunk_rows", [7, 100, 1 << 16])
def test_exact_median_of_one_huge_group(spark, chunk_rows):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"event_type": ["hot"] * 3000 + ["odd"] * 5 + ["even"] * 6 + [None] * 4, "offset_min": 5,
                        "event_return": np.concatenate([rng.normal(size=2000), np.zeros(1000), rng.normal(size=15)])})
    df = spark.createDataFrame(pdf).repartition(5).unionByName(
        spark.createDataFrame([("odd", 5, None), ("none", 5, None)], "event_type string, offset_min long, event_return double"))
    got = {r["event_type"]: r["median"] for r in studies.exact_median(df, ["event_type", "offset_min"], "event_return", chunk_rows).collect()}
    want = pdf.groupby("event_type", dropna=False)["event_return"].median()
    assert set(got) == {"hot", "odd", "even", None}
    for k, v in want.items():
        assert got[None if pd.isna(k) else k] == pytest.approx(v, abs=1e-15)
    small = studies.event_study(df, ["event_type"]).toPandas().sort_values("event_type").reset_index(drop=True)
    large = studies.event_study(df, ["event_type"], max_rows=10).toPandas().sort_values("event_type")[small.columns].reset_index(drop=True)
    pd.testing.assert_frame_equal(small, large)


def test_long_holdings_are_cut_down_before_they_are_written_out(spark):
    """One holding unchanged for 100,000 blocks; equity is low in a few of them only."""
    n = 100_000
    seq = F.col("id")
    dip = (seq % 25_000 == 12_345)
    state = spark.range(n + 1).select(
        F.lit("a").alias("account"), F.when(seq == 0, "X").otherwise("Y").alias("symbol"), seq.alias("seq"),
        F.when(dip, 100.0).when(seq == 77, -5.0).otherwise(1000.0).alias("equity"), F.when(seq == 0, 50.0).otherwise(1.0).alias("symbol_value"))
    got = sorted((r["seq"], r["symbol"]) for r in audit.concentrations(state, 0.25, block=1).collect())
    assert got == [(k, "X") for k in range(12_345, n, 25_000)]
    holdings = spark.createDataFrame([("a", 0, 50.0, n)], "account string, b long, v double, _to long")
    lowest = state.select("account", F.col("seq").alias("b"), F.col("equity").alias("_min")).filter("_min > 0")
    blocks = audit._in_low_blocks(holdings, lowest, 0.25)
    assert sorted(r["b"] for r in blocks.collect()) == [k for k in range(12_345, n, 25_000)]
    every = audit._in_low_blocks(holdings.withColumn("v", F.lit(1e6)), lowest, 0.25)
    assert every.count() == n - 1 and every.agg(F.min("b"), F.max("b")).first()[:] == (1, n)


def test_positions_without_account_or_symbol(spark):
    rows = [(None, "X", 0, "BUY", 2.0, 5.0), (None, "X", 1, "SELL", 5.0, 6.0), ("a", None, 2, "BUY", 1.0, 7.0),
            ("a", None, 3, "BUY", 1.0, 8.0), ("a", "X", 4, "SELL", 1.0, 9.0), (None, None, 5, "BUY", 3.0, 1.0)]
    df = spark.createDataFrame(rows, "account string, symbol string, seq long, side string, qty double, fill_price double")
    for size in (1, 100):
        got = {r["seq"]: (r["held_before"], r["position"], r["previous_price"]) for r in audit.running_positions(df, size).collect()}
        assert got == {0: (0, 2, None), 1: (2, 0, 5.0), 2: (0, 1, None), 3: (1, 2, 7.0), 4: (0, 0, None), 5: (0, 3, None)}
