"""Streams give what their batch twins give."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketloom.operators import neardup, news
from marketloom.plans import views
from marketloom.sources import raw_store
from marketloom.streaming import news_stream


@pytest.fixture(scope="module")
def landing(spark, root, tmp_path_factory):
    """The article view as JSON files in arrival order, three files."""
    folder = tmp_path_factory.mktemp("landing")
    rows = views.raw_articles(spark, root).toPandas().sort_values("arrival_seq")
    size = len(rows) // 3 + 1
    for i in range(3):
        lo, hi = rows.iloc[i * size], rows.iloc[min((i + 1) * size, len(rows)) - 1]
        part = views.raw_articles(spark, root).filter(
            F.col("arrival_seq").between(int(lo["arrival_seq"]), int(hi["arrival_seq"])))
        part.coalesce(1).write.mode("append").json(str(folder / "all"))
    return str(folder / "all")


def run(stream, tmp_path, name, **sink):
    writer = (stream.writeStream.trigger(availableNow=True)
              .option("checkpointLocation", str(tmp_path / f"ckpt-{name}")))
    if "batch" in sink:
        query = writer.foreachBatch(sink["batch"]).start()
    else:
        query = writer.format("parquet").option("path", str(tmp_path / name)).outputMode("append").start()
    query.awaitTermination(300)
    assert query.exception() is None


def normalized(spark, folder):
    return news.normalize_articles(raw_store.land_articles(spark, folder, 1), views.SYMBOLS, "s")


def test_versions(spark, landing, root, tmp_path):
    run(news_stream.version_stream(normalized(spark, landing)), tmp_path, "versions")
    got = spark.read.parquet(str(tmp_path / "versions"))
    want = news.version_articles(news.normalize_articles(raw_store.read_articles(spark, landing), views.SYMBOLS, "s"))
    key = lambda d: sorted(map(tuple, d.select("event_id", "version", "arrival_seq").collect()))
    assert key(got) == key(want)


def test_repeats_are_dropped(spark, landing, tmp_path):
    twice = normalized(spark, landing).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    run(news_stream.drop_repeats(twice).drop("copy"), tmp_path, "unique")
    got = spark.read.parquet(str(tmp_path / "unique"))
    want = news.normalize_articles(raw_store.read_articles(spark, landing), views.SYMBOLS, "s")
    assert got.count() == want.dropDuplicates(["event_id", "updated_at"]).count()


def test_cluster_batches(spark, landing, tmp_path):
    versions = news_stream.version_stream(normalized(spark, landing))
    run(versions, tmp_path, "numbered")
    batch = spark.read.parquet(str(tmp_path / "numbered"))
    want = {(r["event_id"], r["version"]): r["cluster_id"] for r in neardup.cluster_articles(batch).collect()}
    # Re-play the numbered articles as two receipt-ordered files.
    cut = batch.agg(F.percentile(F.unix_seconds("received_at"), F.lit(0.5))).first()[0]
    late = F.unix_seconds("received_at") > cut
    for part in (batch.filter(~late), batch.filter(late)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "replay"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "replay"))
    run(stream, tmp_path, "clusters", batch=news_stream.cluster_batches(str(tmp_path / "heads"), str(tmp_path / "out")))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r["event_id"], r["version"]): r["cluster_id"] for r in rows} == want


def test_sliding_counts(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=i), i % 2) for i in range(0, 600, 3)]
    spark.createDataFrame(rows, "ts timestamp, dim int").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, dim int").parquet(str(tmp_path / "in"))
    run(news_stream.sliding_counts(stream, "1 hour", "15 minutes", "dim", late="0 seconds"), tmp_path, "counts")
    got = spark.read.parquet(str(tmp_path / "counts"))
    closed = got.agg(F.max("window_end")).first()[0]
    want = (spark.createDataFrame(rows, "ts timestamp, dim int").groupBy(F.window("ts", "1 hour", "15 minutes").alias("w"), "dim")
            .count().filter(F.col("w.end") <= F.lit(closed)))
    assert got.count() == want.count() > 0
    assert got.agg(F.sum("n")).first()[0] == want.agg(F.sum("count")).first()[0]


def test_enriched_batches(spark, tmp_path):
    start = datetime(2024, 1, 1)
    features = spark.createDataFrame([("A", start + timedelta(hours=h), float(h)) for h in range(5)], "symbol string, ts timestamp, x double")
    events = spark.createDataFrame([("A", start + timedelta(minutes=90 * i), i) for i in range(4)], "symbol string, received_at timestamp, id int")
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    run(stream, tmp_path, "joined", batch=news_stream.enrich_batches(features, str(tmp_path / "out"), ["x"]))
    got = sorted((r["id"], r["x"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, 0.0), (1, 1.0), (2, 3.0), (3, 4.0)]


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_revision_state_is_dropped_after_the_horizon(spark, tmp_path):
    """Three files months apart: the state of the first event goes, and with it its numbering."""
    schema = "event_id string, updated_at timestamp, arrival_seq long, headline string, url string, received_at timestamp"
    day = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    row = lambda e, d, n: (e, day(d), n, "h", "", day(d))
    path = str(tmp_path / "in")
    files = [[row("x", 0, 1), row("x", 1, 2)], [row("y", 100, 3), row("x", 101, 4)], [row("z", 200, 5)], [row("z", 201, 6)], [row("x", 202, 7)]]
    for rows in files:
        feed(spark, path, rows, schema)
    stream = news_stream.version_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), "30 days")
    query = (stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).format("parquet")
             .option("path", str(tmp_path / "out")).outputMode("append").start())
    query.awaitTermination(300)
    assert query.exception() is None
    got = sorted((r["arrival_seq"], r["version"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # x is known within its horizon, is met again at day 101 by the batch that first moves the watermark, and is new at day 202.
    assert got == [(1, 1), (2, 2), (3, 1), (4, 3), (5, 1), (6, 2), (7, 1)]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) <= 3 and held[-1] <= 2


def test_many_ordered_batches_and_expired_heads(spark, tmp_path):
    schema = "event_id string, version int, headline string, url string, received_at timestamp, arrival_seq long"
    rows = [(f"e{i}", 1, f"same old story number {i % 4} told once more today", "", datetime(2024, 1, 1) + timedelta(hours=3 * i), i)
            for i in range(120)]
    df = spark.createDataFrame(rows, schema).repartition(3)
    feed_path, heads, out = (str(tmp_path / k) for k in ("feed", "heads", "out"))
    news_stream.ordered_feed(df, feed_path, ["received_at", "arrival_seq"], 7)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(feed_path)
    run(stream, tmp_path, "ordered", batch=news_stream.cluster_batches(heads, out))
    got = spark.read.parquet(out)
    assert got.select("batch").distinct().count() >= 5
    want = {r["event_id"]: r["cluster_id"] for r in neardup.cluster_articles(df).collect()}
    assert {r["event_id"]: r["cluster_id"] for r in got.collect()} == want and len(set(want.values())) > 10
    late = news_stream.known_heads(spark, heads, 99, datetime(2024, 1, 15, 12))
    days = {r["day"].day for r in late.select("day").distinct().collect()}
    assert days and days <= {14, 15}
    assert "PartitionFilters: [isnotnull(batch" in late._jdf.queryExecution().toString() and "day#" in late._jdf.queryExecution().toString()


def test_growing_features(spark, tmp_path):
    start = datetime(2024, 1, 1)
    table, out, folder = (str(tmp_path / k) for k in ("features", "out", "in"))
    assign = news_stream.enrich_batches(table, out, ["x"])
    for k in range(3):
        feed(spark, table, [("A", start + timedelta(hours=k), float(k))], "symbol string, ts timestamp, x double")
        feed(spark, folder, [("A", start + timedelta(hours=k, minutes=30), k), ("B", start + timedelta(hours=k), 10 + k)], "symbol string, received_at timestamp, id int")
        stream = spark.readStream.schema("symbol string, received_at timestamp, id int").option("maxFilesPerTrigger", 1).parquet(folder)
        run(stream, tmp_path, "grown", batch=assign)
    got = sorted((r["id"], r["x"], r["batch"]) for r in spark.read.parquet(out).collect())
    assert got == [(0, 0.0, 0), (1, 1.0, 1), (2, 2.0, 2), (10, None, 0), (11, None, 1), (12, None, 2)]


def test_revision_state_is_grouped(spark, tmp_path, monkeypatch):
    """Python is called per group of events: far fewer groups than events, same numbers."""
    monkeypatch.setattr(news_stream, "BUCKETS", 7)
    schema = "event_id string, updated_at timestamp, arrival_seq long, headline string, url string, received_at timestamp"
    rows = [(f"e{i % 300}", datetime(2024, 1, 1) + timedelta(hours=(i * 7) % 11, minutes=i // 300), i, "h", "", datetime(2024, 1, 1) + timedelta(hours=i // 300))
            for i in range(1200)]
    path = str(tmp_path / "in")
    feed(spark, path, rows[:500], schema)
    feed(spark, path, rows[500:], schema)
    stream = news_stream.version_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    query = (stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).format("parquet")
             .option("path", str(tmp_path / "out")).outputMode("append").start())
    query.awaitTermination(300)
    assert query.exception() is None
    want, newest, count = set(), {}, {}
    for event, edited, seq, *_ in rows:
        if event not in newest or edited > newest[event]:
            newest[event], count[event] = edited, count.get(event, 0) + 1
            want.add((event, seq, count[event]))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("event_id", "arrival_seq", "version").collect()} == want
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 7
