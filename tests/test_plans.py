"""Plan hygiene: no products, no key-wide windows, pushed filters, bounded rank lists."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marketloom.operators import neardup, pit
from marketloom.plans import views
from marketloom.sources import feature_store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "xsectional_features", "asof_tolerance", "version_articles", "risk_decisions", "running_positions",
    "news_speed", "interarrival_gaps", "fill_divergence", "chronology_violations", "impulse_intensity"])
def test_no_products(spark, root, name):
    text = plan(entry.queries()[name](spark, root))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name,key", [("running_positions", "account"), ("price_jumps", "session"),
                                      ("chronology_violations", "l_suppkey"), ("momentum_features", "symbol")])
def test_rows_never_gather_by_key_alone(spark, root, name, key):
    """Every window over rows is split by a chunk column; only chunk summaries gather by key."""
    text = plan(entry.queries()[name](spark, root))
    wide = [line for line in text.splitlines() if "Window [" in line and "row" in line.lower()]
    for line in wide:
        by = line.rsplit("], [", 2)[-2]
        assert key not in by or "_c" in by or "_c#" in line.rsplit("], [", 1)[-1], line


def test_filters_and_columns_reach_the_scan(spark, root, tmp_path):
    orders = views.table(spark, root, "orders")
    sliced = pit.at_or_before(orders.select(F.col("o_orderdate").alias("as_of"), "o_orderkey"),
                              F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"))
    text = plan(sliced)
    assert "PushedFilters: [IsNotNull(o_orderdate), LessThanOrEqual" in text and "o_totalprice" not in text
    rows = spark.createDataFrame([("A", "2024-01-02", "2024-01-02", 1.0)], "symbol string, as_of string, source_max_ts string, x double")
    rows = rows.withColumns({c: F.col(c).cast("timestamp") for c in ("as_of", "source_max_ts")})
    feature_store.append_features(feature_store.envelope(rows, ["x"]), str(tmp_path / "f"))
    pruned = plan(feature_store.load_features(spark, str(tmp_path / "f"), "2024-01-03 00:00:00"))
    assert "PartitionFilters: [isnotnull(as_of_date" in pruned
