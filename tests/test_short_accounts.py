"""Accounts of one chunk are shuffled once; longer ones still go chunk by chunk, with the same results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import audit
from marketloom.plans.ordered import numbered, rows_chunk

FILLS = "account string, seq long, symbol string, side string, qty double, fill_price double"


def fills(spark):
    rng = np.random.default_rng(4)
    rows = []
    for account, n in (("a", 9), ("b", 40), (None, 7), (None, 0), ("c", 1), ("d", 64)):
        rows += [(account, k, [None, "X", "Y"][rng.integers(3)], ["BUY", "SELL", "HOLD"][rng.integers(3)],
                  float(rng.integers(1, 9)), float(rng.integers(1, 50))) for k in range(1, n + 1)]
    rows += [("a", None, "X", "BUY", 3.0, 4.0), ("e", None, "X", "BUY", 2.0, 5.0)]
    return spark.createDataFrame(rows, FILLS)


def ordered(df, *columns):
    return sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))


@pytest.mark.parametrize("rows", [8, 41, 65_536])
def test_short_and_long_accounts_agree(spark, rows):
    columns = ["account", "seq", "symbol", "held_before", "position", "previous_price"]
    assert ordered(audit.running_positions(fills(spark), rows), *columns) == ordered(audit._positions_by_chunk(fills(spark), 4), *columns)
    columns += ["symbol_value", "cash", "gross", "equity"]
    assert ordered(audit.account_state(fills(spark), 100.0, rows), *columns) == ordered(audit.account_state(fills(spark), 100.0, 4), *columns)


def test_short_accounts_are_shuffled_once(spark):
    short = fills(spark).filter("seq IS NOT NULL")
    plan = audit.account_state(short, 100.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_numbers_of_small_and_large_keys(spark):
    for limit in (1, 8, 1000):
        got = numbered(fills(spark), ["account"], rows_chunk("qty", 2), ["qty", "fill_price", "seq", "symbol", "side"], "n", limit)
        dense = got.groupBy("account").agg(F.count("*").alias("rows"), F.count_distinct("n").alias("d"), F.min("n").alias("lo"), F.max("n").alias("hi"))
        assert all(r["rows"] == r["d"] == r["hi"] and r["lo"] == 1 for r in dense.collect())
        assert got.count() == fills(spark).count() and dict(got.dtypes)["n"] == "bigint"
        keys = [(r["qty"], r["fill_price"]) for r in got.filter("account = 'd'").orderBy("n").collect()]
        assert keys == sorted(keys) and len(keys) == 64


def test_repeated_numbers_are_not_taken_for_a_short_account(spark):
    twice = fills(spark).filter("seq IS NOT NULL")
    twice = twice.unionByName(twice.filter("account = 'b'"))
    short, rest = audit._short_accounts(twice, 100)
    assert {r[0] for r in short.select("account").distinct().collect()} == {"a", None, "c", "d"}
    assert {r[0] for r in rest.select("account").distinct().collect()} == {"b"}
