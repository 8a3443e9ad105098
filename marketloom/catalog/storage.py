"""Stores and streams as queries: what is written and read back must equal the plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, backtest, decisions, news
from ..plans import views
from ..plans.ordered import equi_depth
from ..session import cut_lineage, scratch_path
from ..sources import feature_store, ledger_store, raw_store
from ..streaming import news_stream
from . import backtest as backtests
from . import news as articles
from .audit import CHAINED, records
from .base import ARTICLES, SYMBOL_LIST, VERSIONS, num, register, when
from .decisions import LIMITS, RISK, risk_inputs
from .pit import CUTOFF, FEATURE_ROWS, feature_rows


@register("raw_store_replay", f"""SELECT event_id AS ingest_seq, {when('ts', 'stored_at')}, props AS payload,
  strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = 'click'""")
def _raw(spark, root):
    path = scratch_path(spark, "raw")
    events = views.table(spark, root, "events")
    raw_store.append_raw(events.select(
        F.col("event_type").alias("source"), F.col("props").alias("payload"),
        F.col("ts").cast("timestamp").alias("stored_at"), F.col("event_id").alias("ingest_seq")), path)
    return raw_store.read_raw(spark, path, "click").select("ingest_seq", "stored_at", "payload", "day")


@register("feature_store_slice", f"""WITH {FEATURE_ROWS} SELECT symbol, {when('as_of', 'as_of')},
  CASE WHEN source_max_ts > as_of THEN 'source_after_as_of' ELSE 'stored' END AS status,
  {num('momentum_roc20', 'momentum_roc20')}, {num('momentum_ma50', 'momentum_ma50')}
FROM feature_rows WHERE source_max_ts > as_of OR as_of <= TIMESTAMP '{CUTOFF}'""")
def _features(spark, root):
    """All rows go in: what the guard lets through is read back up to a time, what it refuses is reported."""
    path = scratch_path(spark, "features")
    names = ["momentum_roc20", "momentum_ma50"]
    refused = feature_store.append_sound(feature_store.envelope(feature_rows(spark, root), names), path)
    loaded = feature_store.load_features(spark, path, CUTOFF).withColumn("reason", F.lit("stored"))
    both = loaded.unionByName(refused.select(*loaded.columns))
    return both.select("symbol", "as_of", F.col("reason").alias("status"), *[F.col("features")[n].alias(n) for n in names])


@register("ledger_store_roundtrip", f"""WITH RECURSIVE {CHAINED}
SELECT chain, seq, hash FROM built WHERE seq > 0""")
def _ledger(spark, root):
    path = scratch_path(spark, "ledger")
    ledger_store.append_ledger(audit.build_chain(records(spark, root)), path)
    return spark.read.parquet(path).select("chain", "seq", "hash")


@register("newest_page", f"""WITH {ARTICLES} SELECT id AS event_id, CAST(arrival_seq AS BIGINT) AS arrival_seq
FROM articles ORDER BY updated_at DESC, arrival_seq DESC LIMIT 50""")
def _page(spark, root):
    return raw_store.newest_page(articles.normalized(spark, root)).select("event_id", "arrival_seq")


@register("total_returns", f"""WITH {backtests.CURVE} SELECT run,
  {num('ln(arg_max(equity, ts) / arg_min(equity, ts))', 'log_total_return')} FROM curve GROUP BY run""")
def _total(spark, root):
    return backtest.total_return(backtests.curve(spark, root)).select(
        "run", F.log1p("total_return").alias("log_total_return"))


@register("model_classified", """SELECT doc_id, CASE WHEN n % 3 = 0 THEN 'rumour' ELSE 'jobs' END AS event_type,
  round(1.0 / (1 + n), 6) + 0.0 AS confidence, CASE WHEN n % 3 = 0 THEN 'event_type' ELSE '' END AS errors
FROM (SELECT doc_id, length(split_part(text, chr(10), 1)) + 7 * (length(text) - length(replace(text, 'e', ''))) AS n FROM documents)""")
def _model(spark, root):
    """The stand-in model looks at the headline and at the whole text."""
    import pandas as pd

    def by_letters(headline, summary):
        size = headline.str.len() + 7 * summary.str.count("e")
        return pd.DataFrame({"event_type": ["rumour" if n % 3 == 0 else "jobs" for n in size],
                             "event_direction": "neutral", "confidence": 1.0 / (1 + size)})
    docs = views.table(spark, root, "documents").select(
        "doc_id", F.substring_index("text", "\n", 1).alias("headline"), F.col("text").alias("summary"))
    return news.classify_with(docs, by_letters, "letters").select(
        "doc_id", "event_type", "confidence", F.array_join("errors", ",").alias("errors"))


@register("stream_sliding_counts", f"""WITH w AS (
  SELECT event_type, unnest(range(0, 4)) AS k, time_bucket(INTERVAL 6 HOUR, ts) AS b FROM events),
s AS (SELECT event_type, b - k * INTERVAL 6 HOUR AS window_start FROM w)
SELECT {when('window_start', 'window_start')}, {when('window_start + INTERVAL 24 HOUR', 'window_end')},
  event_type, count(*) AS n FROM s
WHERE window_start + INTERVAL 24 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""")
def _sliding(spark, root):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(root))
    counts = news_stream.sliding_counts(stream, "24 hours", "6 hours", "event_type")
    return _drain(spark, counts, "counts")


@register("stream_repeats_dropped", f"""SELECT DISTINCT event_id, {when('ts', 'updated_at')} FROM events""")
def _repeats(spark, root):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(root)
    twice = stream.select("event_id", F.col("ts").alias("received_at"), F.col("ts").alias("updated_at"),
                          F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return _drain(spark, news_stream.drop_repeats(twice).drop("copy"), "unique").select("event_id", "updated_at")


def _drain(spark, stream, name):
    """Run a stream to the end of its input into a table and return that table."""
    out = scratch_path(spark, name)
    query = (stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
             .option("checkpointLocation", scratch_path(spark, f"{name}-state")).option("path", out).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def landed(spark, root):
    """The raw articles as a stream of JSON files, normalised."""
    folder = scratch_path(spark, "landing")
    views.raw_articles(spark, root).write.json(folder)
    return news.normalize_articles(raw_store.land_articles(spark, folder), articles.UNIVERSE, "articles")


@register("landed_articles", f"""WITH {ARTICLES} SELECT id AS event_id, {when('received_at', 'received_at')},
  {when('updated_at', 'updated_at')}, headline, CAST(arrival_seq AS BIGINT) AS arrival_seq FROM articles""")
def _landed(spark, root):
    return _drain(spark, landed(spark, root), "landed").select(
        "event_id", "received_at", "updated_at", "headline", "arrival_seq")


@register("stream_versions", f"""WITH {VERSIONS} SELECT id AS event_id, version, CAST(arrival_seq AS BIGINT) AS arrival_seq
FROM versions""")
def _stream_versions(spark, root):
    return _drain(spark, news_stream.version_stream(landed(spark, root)), "versions").select(
        "event_id", "version", "arrival_seq")


@register("stream_clusters", f"""WITH RECURSIVE {articles.CLUSTERS}
SELECT id AS event_id, version, cluster_id FROM clustered""")
def _stream_clusters(spark, root):
    folder, out = scratch_path(spark, "versioned"), scratch_path(spark, "clusters")
    rows = articles.versions(spark, root).select("event_id", "version", "headline", "url", "received_at", "arrival_seq")
    news_stream.ordered_feed(rows, folder, ["received_at", "arrival_seq"], BATCHES)
    _feed(spark, rows.schema, folder, news_stream.cluster_batches(scratch_path(spark, "heads"), out), scratch_path(spark, "clusters-state"))
    return spark.read.parquet(out).select("event_id", "version", "cluster_id")


BATCHES = 6


def _feed(spark, schema, folder, assign, state):
    """Run ``assign`` for each new file of a folder, one file per batch."""
    (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).writeStream.foreachBatch(assign)
     .trigger(availableNow=True).option("checkpointLocation", state).start().awaitTermination())


@register("stream_enriched", f"""WITH ev AS (
  SELECT event_id, ts + INTERVAL 10000 DAY AS at, {SYMBOL_LIST}[user_id % 6 + 1] AS symbol FROM events),
px AS (SELECT symbol, ts + INTERVAL 10000 DAY - INTERVAL 3 HOUR AS ts, price FROM (
  SELECT user_id % 6 AS k, {SYMBOL_LIST}[user_id % 6 + 1] AS symbol, date_trunc('hour', ts) AS ts, sum(value) AS price FROM events GROUP BY ALL))
SELECT event_id, {when('ev.at', 'received_at')}, ev.symbol, {when('px.ts', 'matched_ts')}, {num('price', 'price')}
FROM ev ASOF LEFT JOIN px ON ev.symbol = px.symbol AND ev.at >= px.ts""")
def _enriched(spark, root):
    """Events in six batches; before each, the features known by then are added to their table."""
    rows = views.table(spark, root, "events")
    symbol = F.element_at(F.array(*[F.lit(s) for s in views.SYMBOLS]), (F.col("user_id") % 6 + 1).cast("int"))
    later = lambda c: F.timestamp_add("DAY", F.lit(10_000), c.cast("timestamp"))
    events = rows.select("event_id", later(F.col("ts")).alias("received_at"), symbol.alias("symbol"))
    hour = F.timestamp_add("HOUR", F.lit(-3), later(F.date_trunc("hour", "ts")))
    features = rows.groupBy(symbol.alias("symbol"), hour.alias("ts")).agg(F.sum("value").alias("price"))
    numbered = cut_lineage(equi_depth(events, ["received_at", "event_id"], -(-events.count() // BATCHES), "_part"))
    bounds = sorted(numbered.groupBy("_part").agg(F.max("received_at").alias("until")).collect())
    folder, table, out, state = (scratch_path(spark, k) for k in ("enrich-in", "enrich-features", "enriched", "enrich-state"))
    features = cut_lineage(features)
    assign = news_stream.enrich_batches(table, out, ["price"])
    since = F.lit("0001-01-01").cast("timestamp")
    for number, until in bounds:
        features.filter((F.col("ts") > since) & (F.col("ts") <= F.lit(until))).write.mode("append").parquet(table)
        numbered.filter(F.col("_part") == number).drop("_part").coalesce(1).write.mode("append").parquet(folder)
        _feed(spark, events.schema, folder, assign, state)
        since = F.lit(until)
    return spark.read.parquet(out).select("event_id", "received_at", "symbol", "matched_ts", "price")


@register("research_journal", """SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n,
  CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1""")
def _journal(spark, root):
    path = scratch_path(spark, "journal")
    ledger_store.append_journal(views.table(spark, root, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("recorded_at")), path)
    return (spark.read.parquet(path).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"))
            .agg(F.count("*").alias("n"), F.sum("o_orderkey").cast("long").alias("keys")))


@register("decision_report", f"""WITH {RISK} SELECT count(*) FILTER (code = 'ALLOW') AS allowed,
  count(*) FILTER (code <> 'ALLOW') AS rejected FROM decided""")
def _report(spark, root):
    folder = scratch_path(spark, "reports")
    proposals, accounts, positions, market, universe = risk_inputs(spark, root)
    decided = decisions.evaluate(proposals, accounts, positions, market, universe, LIMITS)
    ledger_store.write_reports(
        backtests.curve(spark, root), positions, views.ledger_records(spark, root),
        decided.withColumn("seq", F.col("proposal_id")), folder)
    return spark.read.json(f"{folder}/decision_summary").select("allowed", "rejected")


@register("missing_keys", """SELECT event_id, array_to_string(list_filter(['k', 'view', 'click', 'metric'],
  lambda r: r <> 'k' AND r <> event_type), ',') AS missing FROM events""")
def _missing(spark, root):
    events = views.table(spark, root, "events")
    present = F.concat(F.json_object_keys("props"), F.array("event_type"))
    return events.select("event_id", F.array_join(news.missing_keys(present, ["k", "view", "click", "metric"]), ",")
                         .alias("missing"))
