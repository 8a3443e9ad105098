"""Point-in-time slices and leakage guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import chunk_scan, previous_row


class LeakageError(Exception):
    """A row used information from after its decision time."""


def as_time(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def at_or_before(rows: DataFrame, decision_time, column: str = "as_of") -> DataFrame:
    """All rows knowable at the decision time (not only the latest ones)."""
    return rows.filter(F.col(column) <= as_time(decision_time))


def leakage_report(rows: DataFrame, decision_time) -> DataFrame:
    """One row with the count of each kind of violation."""
    t = as_time(decision_time)
    return rows.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("as_of") > t).alias("future_as_of"),
        F.count_if(F.col("source_max_ts") > F.col("as_of")).alias("source_after_as_of"),
        F.count_if(F.col("source_max_ts") > t).alias("source_after_decision"))


def leaking_rows(rows: DataFrame, decision_time) -> DataFrame:
    """The violating rows with the first violated rule."""
    t = as_time(decision_time)
    rule = (F.when(F.col("as_of") > t, "future_as_of")
            .when(F.col("source_max_ts") > F.col("as_of"), "source_after_as_of")
            .when(F.col("source_max_ts") > t, "source_after_decision"))
    return rows.withColumn("rule", rule).filter("rule IS NOT NULL")


def check_feature_rows(rows: DataFrame, decision_time) -> None:
    """Raise :class:`LeakageError` on the first violated rule (runs one aggregation)."""
    for column in ("as_of", "source_max_ts"):
        if column not in rows.columns:
            raise LeakageError(f"column {column} is missing")
    report = leakage_report(rows, decision_time).first().asDict()
    for rule in ("future_as_of", "source_after_as_of", "source_after_decision"):
        if report[rule]:
            raise LeakageError(f"{report[rule]} rows violate {rule} at {decision_time}")


def check_no_future_bars(bars: DataFrame, decision_time) -> None:
    late = bars.agg(F.max("ts").alias("t")).filter(F.col("t") > as_time(decision_time))
    if not late.isEmpty():
        raise LeakageError(f"bars after {decision_time}")


def chronology_violations(rows: DataFrame, keys: Sequence[str], order: Sequence[str],
                          chunk: Column, ts: str = "ts") -> DataFrame:
    """Rows whose time is earlier than that of the row before them; equal times are fine."""
    seen = chunk_scan(rows, keys, chunk, order, [previous_row("_before", F.col(ts))])
    return (seen.withColumn("previous_ts", F.col("_before.v")).drop("_before")
            .filter(F.col(ts) < F.col("previous_ts")))


def assert_chronological(rows: DataFrame, keys: Sequence[str], order: Sequence[str],
                         chunk: Column, ts: str = "ts") -> None:
    first = chronology_violations(rows, keys, order, chunk, ts).head(1)
    if first:
        raise LeakageError(f"time runs backwards: {first[0]}")
