"""Deterministic views over the driver tables, in the shapes the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import chunk_scan, numbered, ordinal

BENCHMARK = "STANDARD"
# The symbols of the bar view.
SYMBOLS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def bars(spark: SparkSession, root: str, grain: str = "week") -> DataFrame:
    """Weekly (or daily) volume-weighted price and volume per part type; daily bars have gaps.

    Checkpointed: a bar table is an input in its own right and plans refer to it many times
    (calendar, benchmark, windows), which must not aggregate the line items again each time.
    """
    lines = table(spark, root, "lineitem").select(
        "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    parts = table(spark, root, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("symbol"))
    return cut_lineage(lines.join(parts, "l_partkey")
                       .groupBy("symbol", F.date_trunc(grain, "l_shipdate").cast("timestamp")
                                .alias("ts"))
                       .agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"),
                            F.sum("l_quantity").alias("volume")))


def ohlc(spark: SparkSession, root: str) -> DataFrame:
    """Weekly high, low and mean unit price per part type."""
    parts = table(spark, root, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("symbol"))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return (table(spark, root, "lineitem").join(parts, "l_partkey")
            .groupBy("symbol", F.date_trunc("week", "l_shipdate").cast("timestamp").alias("ts"))
            .agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"),
                 F.max(unit).alias("high"), F.min(unit).alias("low")))


def fills(spark: SparkSession, root: str) -> DataFrame:
    """One fill per line item; ``seq`` numbers an account's fills in ship-date order.

    Checkpointed, because real fills arrive numbered and the scans over them read them repeatedly.
    """
    parts = table(spark, root, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("symbol"))
    lines = table(spark, root, "lineitem").withColumn("ts", F.col("l_shipdate").cast("timestamp"))
    order = ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
             "l_returnflag", "l_discount", "l_tax", "l_linestatus"]
    day = F.floor(F.unix_micros("ts") / 86_400_000_000)
    return cut_lineage(
        numbered(lines, ["l_suppkey"], day, order, "seq").join(parts, "l_partkey")
        .select(F.col("l_suppkey").alias("account"), "seq", "symbol",
                F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
                F.col("l_quantity").alias("qty"),
                (F.col("l_extendedprice") / F.col("l_quantity")).alias("fill_price"), "ts"))


def ticks(spark: SparkSession, root: str, sessions: int = 4) -> DataFrame:
    """Every event that is not a sign-up, as a price tick of one of ``sessions`` instruments."""
    return (table(spark, root, "events").filter("event_type <> 'signup'")
            .select((F.col("user_id") % sessions).alias("session"), "event_id",
                    F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price")))


def news_times(spark: SparkSession, root: str, sessions: int = 4) -> DataFrame:
    return (table(spark, root, "events").filter("event_type = 'signup'")
            .select((F.col("user_id") % sessions).alias("session"), "event_id",
                    F.col("ts").cast("timestamp").alias("ts")))


def ledger_records(spark: SparkSession, root: str) -> DataFrame:
    """Unhashed ledger rows: one chain per user, ``body`` is canonical JSON text."""
    kinds = F.element_at(
        F.create_map(*[F.lit(x) for pair in LEDGER_TYPES.items() for x in pair]), F.col("event_type"))
    rows = table(spark, root, "events").select(
        F.col("user_id").alias("chain"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
        kinds.alias("type"),
        F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"),
                 F.lit(',"value_cents":'),
                 F.round(F.col("value") * 100).cast("long").cast("string"), F.lit("}")).alias("body"))
    hour = F.floor(F.unix_micros("ts") / 3_600_000_000)
    return chunk_scan(rows, ["chain"], hour, ["ts", "event_id"], [ordinal("seq")])


# Which ledger record type stands for which event type.
LEDGER_TYPES = {"view": "signal", "click": "proposal", "purchase": "fill",
                "error": "risk_decision", "signup": "note"}


def raw_articles(spark: SparkSession, root: str) -> DataFrame:
    """Landed articles: originals, revisions (+30 min), stale copies, a few malformed rows."""
    docs = table(spark, root, "documents").select("doc_id", "text")
    pages = table(spark, root, "pages").select(F.col("page_id").alias("doc_id"), "url")
    base = docs.join(pages, "doc_id", "left")
    d = F.col("doc_id")
    kind = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(arrive).alias("arrive"),
                              F.lit(edit).alias("edit")) for k, arrive, edit in REVISIONS])
    wanted = F.filter(kind, lambda r: (r["kind"] == 0) | ((r["kind"] == 1) & (d % 10 == 0))
                      | ((r["kind"] == 2) & (d % 40 == 0)))
    rows = base.withColumn("r", F.explode(wanted))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    at = lambda minutes: F.timestamp_add("MINUTE", (d + minutes).cast("int"), start)
    iso = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    symbols = F.array(F.element_at(F.array(*map(F.lit, SYMBOLS)), (d % 6 + 1).cast("int")),
                      F.lit("OTHER"),
                      F.element_at(F.array(*map(F.lit, SYMBOLS)), ((d + 1) % 6 + 1).cast("int")))
    line = F.substring_index("text", "\n", 1)
    created = at(F.lit(0))
    return rows.select(
        d.cast("string").alias("id"),
        F.concat(line, F.when(F.col("r.kind") == 1, " (update)").otherwise("")).alias("headline"),
        F.col("text").alias("summary"), F.lit("desk").alias("author"),
        F.when(d % 71 == 70, None).when(d % 53 == 52, F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(iso(created)).alias("created_at"),
        F.when((F.col("r.kind") == 0) & (d % 3 == 0), "").otherwise(
            iso(at(F.col("r.edit")))).alias("updated_at"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.when(d % 89 != 88, symbols).alias("symbols"),
        at(F.col("r.arrive")).alias("received_at"),
        ((d + F.col("r.arrive")) * 4 + F.col("r.kind")).alias("arrival_seq"))


# Fixed values: (kind, minutes until arrival, minutes until edit) of original, revision, stale copy.
REVISIONS = [(0, 0, 0), (1, 30, 30), (2, 60, 10)]


def decisions(spark: SparkSession, root: str) -> DataFrame:
    """Decision points from orders: a symbol and a time, some of them missing."""
    symbol = F.element_at(F.array(*map(F.lit, SYMBOLS)), (F.col("o_custkey") % 6 + 1).cast("int"))
    key = F.col("o_orderkey")
    return table(spark, root, "orders").select(
        key.alias("decision_id"), F.when(key % 211 != 0, symbol).alias("symbol"),
        F.when(key % 223 != 0, F.col("o_orderdate").cast("timestamp")).alias("decision_ts"))
