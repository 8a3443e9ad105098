"""Point-in-time queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pit, signals
from ..plans import views
from ..plans.ordered import asof_join, rows_chunk
from ..session import cut_lineage
from .base import GRID, SYMBOL_LIST, num, register, when
from .signals import MOMENTUM

CUTOFF = "1999-06-01 00:00:00"


def feature_rows(spark, root):
    """Momentum rows in the point-in-time envelope; every 97th cell claims newer source data."""
    table = signals.feature_table(views.bars(spark, root), views.BENCHMARK)
    late = (F.col("bar_no") + F.length("symbol")) % 97 == 0
    return table.select(
        "symbol", F.col("ts").alias("as_of"),
        F.when(late, F.timestamp_add("DAY", F.lit(1), F.col("ts"))).otherwise(F.col("ts"))
        .alias("source_max_ts"), "momentum_roc20", "momentum_ma50")


FEATURE_ROWS = f"""{GRID}, numbered AS (SELECT *, dense_rank() OVER (ORDER BY ts) AS bar_no FROM grid),
feature_rows AS (
  SELECT symbol, ts AS as_of,
    CASE WHEN (bar_no + length(symbol)) % 97 = 0 THEN ts + INTERVAL 1 DAY ELSE ts END AS source_max_ts,
    momentum_roc20, momentum_ma50
  FROM (SELECT *, {MOMENTUM['momentum_roc20']} AS momentum_roc20,
               {MOMENTUM['momentum_ma50']} AS momentum_ma50 FROM numbered)
  WHERE price IS NOT NULL)"""


@register("pit_slice", f"""WITH {FEATURE_ROWS} SELECT symbol, {when('as_of', 'as_of')},
  {when('source_max_ts', 'source_max_ts')}, {num('momentum_roc20', 'momentum_roc20')},
  {num('momentum_ma50', 'momentum_ma50')} FROM feature_rows WHERE as_of <= TIMESTAMP '{CUTOFF}'""")
def _slice(spark, root):
    return pit.at_or_before(feature_rows(spark, root), CUTOFF)


@register("leakage_report", f"""WITH {FEATURE_ROWS} SELECT count(*) AS n_rows,
  count(*) FILTER (as_of > TIMESTAMP '{CUTOFF}') AS future_as_of,
  count(*) FILTER (source_max_ts > as_of) AS source_after_as_of,
  count(*) FILTER (source_max_ts > TIMESTAMP '{CUTOFF}') AS source_after_decision FROM feature_rows""")
def _report(spark, root):
    return pit.leakage_report(feature_rows(spark, root), CUTOFF)


@register("leaking_rows", f"""WITH {FEATURE_ROWS} SELECT symbol, {when('as_of', 'as_of')}, rule FROM (
  SELECT *, CASE WHEN as_of > TIMESTAMP '{CUTOFF}' THEN 'future_as_of'
                 WHEN source_max_ts > as_of THEN 'source_after_as_of'
                 WHEN source_max_ts > TIMESTAMP '{CUTOFF}' THEN 'source_after_decision' END AS rule
  FROM feature_rows) WHERE rule IS NOT NULL""")
def _leaking(spark, root):
    return pit.leaking_rows(feature_rows(spark, root), CUTOFF).select("symbol", "as_of", "rule")


@register("chronology_violations", f"""SELECT l_suppkey, l_orderkey, {when('l_shipdate', 'ts')},
  {when('p', 'previous_ts')} FROM (SELECT *, lag(l_shipdate) OVER (PARTITION BY l_suppkey
    ORDER BY l_orderkey, l_linenumber, l_shipdate, l_partkey, l_quantity, l_extendedprice) AS p
  FROM lineitem) WHERE l_shipdate < p""")
def _chronology(spark, root):
    lines = views.table(spark, root, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
        F.col("l_shipdate").cast("timestamp").alias("ts"))
    order = ["l_orderkey", "l_linenumber", "ts", "l_partkey", "l_quantity", "l_extendedprice"]
    return pit.chronology_violations(lines, ["l_suppkey"], order, rows_chunk("l_orderkey")
                                     ).select("l_suppkey", "l_orderkey", "ts", "previous_ts")


@register("asof_features", f"""WITH {FEATURE_ROWS}, decisions AS (
  SELECT o_orderkey AS decision_id, CASE WHEN o_orderkey % 211 <> 0 THEN {SYMBOL_LIST}[o_custkey % 6 + 1] END AS symbol,
         CASE WHEN o_orderkey % 223 <> 0 THEN o_orderdate END AS decision_ts FROM orders)
SELECT decision_id, d.symbol, {when('decision_ts', 'decision_ts')}, {when('as_of', 'matched_as_of')},
  {num('momentum_roc20', 'momentum_roc20')}, {num('momentum_ma50', 'momentum_ma50')}
FROM decisions d ASOF LEFT JOIN feature_rows f
  ON d.symbol = f.symbol AND d.decision_ts >= f.as_of""")
def _asof(spark, root):
    # The feature table is a dataset of its own; the as-of scan reads it twice.
    return asof_join(views.decisions(spark, root), cut_lineage(feature_rows(spark, root)), ["symbol"],
                     "decision_ts", "as_of", ["momentum_roc20", "momentum_ma50"],
                     chunk_seconds=30 * 86_400)


@register("asof_tolerance", f"""WITH decisions AS (
  SELECT o_orderkey AS decision_id, CASE WHEN o_orderkey % 211 <> 0 THEN o_custkey END AS k,
    CASE WHEN o_orderkey % 223 <> 0 THEN o_orderdate END AS decision_ts FROM orders),
q AS (SELECT l_suppkey AS k, l_shipdate AS quote_ts, max(l_extendedprice) AS quote
      FROM lineitem GROUP BY 1, 2)
SELECT decision_id, d.k, {when('decision_ts', 'decision_ts')},
  CASE WHEN decision_ts - quote_ts <= INTERVAL 2 DAY
       THEN strftime(quote_ts, '%Y-%m-%d %H:%M:%S.%f') END AS matched_quote_ts,
  {num('CASE WHEN decision_ts - quote_ts <= INTERVAL 2 DAY THEN quote END', 'quote')}
FROM decisions d ASOF LEFT JOIN q ON d.k = q.k AND d.decision_ts >= q.quote_ts""")
def _asof_tolerance(spark, root):
    decisions = views.table(spark, root, "orders").select(
        F.col("o_orderkey").alias("decision_id"), F.when(F.col("o_orderkey") % 211 != 0, F.col("o_custkey")).alias("k"),
        F.when(F.col("o_orderkey") % 223 != 0, F.col("o_orderdate").cast("timestamp")).alias("decision_ts"))
    quotes = (views.table(spark, root, "lineitem")
              .groupBy(F.col("l_suppkey").alias("k"),
                       F.col("l_shipdate").cast("timestamp").alias("quote_ts"))
              .agg(F.max("l_extendedprice").alias("quote")))
    joined = asof_join(decisions, quotes, ["k"], "decision_ts", "quote_ts", ["quote"],
                       chunk_seconds=30 * 86_400, tolerance_seconds=2 * 86_400)
    return joined
