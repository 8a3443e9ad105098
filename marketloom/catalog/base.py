"""Query registration: a Spark callable plus, where SQL can state it, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune

SparkQuery = Callable[[SparkSession, str], DataFrame]
DIGITS = 6
# Added before rounding on both sides: exact binary ties (x.xxxxxx5) round differently in the two
# engines, and the shift moves every such value off the boundary.
NUDGE = 1e-9


@dataclass(frozen=True)
class Query:
    run: SparkQuery
    sql: str | None = None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, digits: int = DIGITS):
    """Decorator: tune the session, run the query, normalise the output columns."""
    def wrap(fn: SparkQuery) -> SparkQuery:
        def run(spark: SparkSession, root: str) -> DataFrame:
            return present(fn(tune(spark), root), digits)
        REGISTRY[name] = Query(run, sql)
        return fn
    return wrap


def present(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Comparable output: doubles rounded (no negative zero), times as text, integers as BIGINT."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        kind = field.dataType.simpleString()
        if kind in ("double", "float"):
            c = F.round(c.cast("double") + NUDGE, digits) + F.lit(0.0)
        elif kind in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(field.name))
    return df.select(*out)


# ------------------------------------------------------------ SQL pieces

def num(expression: str, name: str, digits: int = DIGITS) -> str:
    return f"round(CAST({expression} AS DOUBLE) + {NUDGE}, {digits}) + 0.0 AS {name}"


def when(expression: str, name: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"


def big(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"


BARS = """bars AS (
  SELECT p_type AS symbol, date_trunc('week', l_shipdate) AS ts,
         sum(l_extendedprice) / sum(l_quantity) AS price, sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""

DAILY_BARS = BARS.replace("'week'", "'day'")

GRID = BARS + """, grid AS (
  SELECT s.symbol, t.ts, b.price, b.volume
  FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN (SELECT DISTINCT ts FROM bars) t
  LEFT JOIN bars b ON b.symbol = s.symbol AND b.ts = t.ts)"""


def frame(aggregate: str, column: str, n: int, key: str = "symbol") -> str:
    """``aggregate`` over the last n grid rows, NULL unless n values are present."""
    over = f"OVER (PARTITION BY {key} ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return (f"CASE WHEN count({column}) {over} = {n} "
            f"THEN {aggregate.format(column)} {over} END")


def lag(column: str, n: int = 1, key: str = "symbol") -> str:
    return f"lag({column}, {n}) OVER (PARTITION BY {key} ORDER BY ts)"


def truth(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1.0 ELSE 0.0 END"


FILL_ORDER = ("l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, "
              "l_returnflag, l_discount, l_tax, l_linestatus")
FILLS = f"""fills AS (
  SELECT l_suppkey AS account,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY {FILL_ORDER}) AS seq,
         p_type AS symbol, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
         l_quantity AS qty, l_extendedprice / l_quantity AS fill_price, l_shipdate AS ts
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

LEDGER = """ledger AS (
  SELECT user_id AS chain, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
         ts, CASE event_type WHEN 'view' THEN 'signal' WHEN 'click' THEN 'proposal'
           WHEN 'purchase' THEN 'fill' WHEN 'error' THEN 'risk_decision' ELSE 'note' END AS type,
         '{"event_id":' || event_id || ',"value_cents":'
           || CAST(round(value * 100) AS BIGINT) || '}' AS body
  FROM events)"""

SYMBOL_LIST = "['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD']"

ARTICLES = f"""raw_articles AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, d.doc_id AS doc,
    split_part(text, chr(10), 1)
      || CASE WHEN kind = 1 THEN ' (update)' ELSE '' END AS headline,
    text AS summary,
    CASE WHEN d.doc_id % 71 = 70 THEN 'missing' WHEN d.doc_id % 53 = 52 THEN 'naive'
         ELSE 'ok' END AS created_state,
    TIMESTAMP '2024-01-01' + to_minutes(CAST(d.doc_id AS BIGINT)) AS created_at,
    CASE WHEN kind = 0 AND d.doc_id % 3 = 0
         THEN TIMESTAMP '2024-01-01' + to_minutes(CAST(d.doc_id AS BIGINT))
         ELSE TIMESTAMP '2024-01-01' + to_minutes(CAST(d.doc_id + edit AS BIGINT)) END AS updated_at,
    coalesce(url, '') AS url, d.doc_id % 89 <> 88 AS has_symbols,
    [{SYMBOL_LIST}[d.doc_id % 6 + 1], {SYMBOL_LIST}[(d.doc_id + 1) % 6 + 1]] AS symbols,
    TIMESTAMP '2024-01-01' + to_minutes(CAST(d.doc_id + arrive AS BIGINT)) AS received_at,
    (d.doc_id + arrive) * 4 + kind AS arrival_seq
  FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id
  CROSS JOIN (VALUES (0, 0, 0), (1, 30, 30), (2, 60, 10)) k(kind, arrive, edit)
  WHERE kind = 0 OR (kind = 1 AND d.doc_id % 10 = 0) OR (kind = 2 AND d.doc_id % 40 = 0)),
articles AS (
  SELECT * FROM raw_articles WHERE created_state = 'ok' AND has_symbols)"""

# Versions in arrival order: a row counts when it is newer than everything before it.
VERSIONS = ARTICLES + """, marked AS (
  SELECT *, max(updated_at) OVER (PARTITION BY id ORDER BY arrival_seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest_before FROM articles),
versions AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY arrival_seq) AS version,
         count(*) OVER (PARTITION BY id) AS n_versions
  FROM marked WHERE newest_before IS NULL OR updated_at > newest_before)"""
