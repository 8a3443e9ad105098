"""Streaming twins of the news operators."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.neardup import HORIZON_SECONDS, THRESHOLD, cluster_articles
from ..plans.ordered import asof_join, equi_depth


def drop_repeats(events: DataFrame, late: str = "24 hours") -> DataFrame:
    """Each (event, edit time) once within the watermark."""
    return (events.withWatermark("received_at", late)
            .dropDuplicatesWithinWatermark(["event_id", "updated_at"]))


def sliding_counts(events: DataFrame, size: str, step: str, by: str, ts: str = "ts",
                   late: str = "1 hour") -> DataFrame:
    """Event counts per sliding window, emitted once the watermark closes the window."""
    return (events.withWatermark(ts, late).groupBy(F.window(ts, size, step).alias("w"), by)
            .agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n"))


VERSION_SCHEMA = ("event_id string, updated_at timestamp, arrival_seq long, headline string, "
                  "url string, received_at timestamp, version long")


def ordered_feed(rows: DataFrame, path: str, order: list[str], batches: int) -> None:
    """Adds ``rows`` to a folder as about ``batches`` files, each later in ``order`` than the one before.

    A file source takes files by their time, so with one file per trigger a stream sees the rows as
    they would have arrived. Rows are dealt by range; each write reads its own range only.
    """
    total = rows.count()
    parts = equi_depth(rows, order, max(1, -(-total // batches)), "_part", total)
    for (number,) in sorted(parts.select("_part").distinct().collect()):
        parts.filter(F.col("_part") == number).drop("_part").coalesce(1).write.mode("append").parquet(path)


# Groups of the revision state. A call per event costs far more than its rows do.
BUCKETS = 4096


def version_stream(events: DataFrame, horizon: str = "30 days") -> DataFrame:
    """Revision numbering with keyed state: newest edit time and version seen so far.

    Events share a fixed number of state groups, each a list of (event, newest edit, version, last
    receipt), so Python is called per group and not per event. A micro-batch's rows are ordered by
    arrival before they meet the state; the source's file limit bounds how many there are. Older or
    repeated rows are dropped. An event leaves the state once the watermark (latest receipt less
    ``horizon``) has passed its last receipt, so the state holds what was received lately, not all
    that ever was; rows that come more than ``horizon`` late are dropped, and a revision after that
    would be numbered from one.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {event: (newest, version, last) for event, newest, version, last in json.loads(state.get[0])} if state.exists else {}
        mark = state.getCurrentWatermarkMs()
        met, result = set(), None
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values("arrival_seq")
            kept, numbers = [], []
            for position, (event, edited, received) in enumerate(zip(rows["event_id"], rows["updated_at"], rows["received_at"])):
                newest, version, last = known.get(event, (None, 0, 0))
                micros = edited.value // 1000
                if newest is None or micros > newest:
                    newest, version = micros, version + 1
                    kept.append(position)
                    numbers.append(version)
                # Times of the state are milliseconds; an event goes when the watermark is past its last receipt.
                last = max(last, mark + 1, 0 if pd.isna(received) else received.value // 1_000_000 + 1)
                known[event] = (newest, version, last)
                met.add(event)
            result = rows.iloc[kept].drop(columns="_bucket", errors="ignore").assign(version=numbers)
        known = {event: told for event, told in known.items() if event in met or told[2] > mark}
        if known:
            state.update((json.dumps([(event, *told) for event, told in known.items()]),))
            state.setTimeoutTimestamp(min(last for _, _, last in known.values()))
        else:
            state.remove()
        if result is not None:
            yield result

    slim = events.select("event_id", "updated_at", "arrival_seq", "headline", "url", "received_at",
                         F.pmod(F.xxhash64("event_id"), F.lit(BUCKETS)).alias("_bucket"))
    return slim.withWatermark("received_at", horizon).groupBy("_bucket").applyInPandasWithState(
        step, VERSION_SCHEMA, "events string", "append", GroupStateTimeout.EventTimeTimeout)


def known_heads(spark: SparkSession, state_folder: str, batch_id: int, first: datetime,
                horizon_seconds: int = HORIZON_SECONDS) -> DataFrame | None:
    """Heads of earlier batches inside the horizon before ``first``; older days are not read."""
    since = F.timestamp_add("SECOND", F.lit(-horizon_seconds), F.lit(first))
    try:
        heads = spark.read.parquet(state_folder)
    except AnalysisException:
        return None
    return heads.filter((F.col("batch") < batch_id) & (F.col("day") >= F.to_date(since)) & (F.col("received_at") >= since))


def cluster_batches(state_folder: str, out_folder: str, threshold: float = THRESHOLD,
                    horizon_seconds: int = HORIZON_SECONDS) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function assigning clusters against the heads still inside the horizon.

    Batches must arrive in receipt order (see :func:`ordered_feed`). Heads are kept by batch id and day of
    receipt, results by batch id, both with overwrite, so a repeated batch is harmless and a batch
    reads the heads of its last days only, however long the stream has run.
    """
    def assign(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        first = batch.agg(F.min("received_at").alias("t")).first()["t"]
        known = known_heads(spark, state_folder, batch_id, first, horizon_seconds)
        if known is not None:
            known = known.select(*batch.columns)
        result = cluster_articles(batch, threshold, horizon_seconds, open_heads=known)
        result.write.mode("overwrite").parquet(f"{out_folder}/batch={batch_id}")
        (spark.read.parquet(f"{out_folder}/batch={batch_id}").filter("is_head")
         .select(*batch.columns).withColumn("day", F.to_date("received_at"))
         .write.mode("overwrite").partitionBy("day").parquet(f"{state_folder}/batch={batch_id}"))
    return assign


def enrich_batches(features: DataFrame | str, out_folder: str, take: list[str]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function pairing per-symbol events with the latest known features.

    ``features`` may be the path of a table that grows while the stream runs: it is read anew for
    each batch, up to the batch's latest event. An event meets features of its own time only, so
    rows that were added later than it never count.
    """
    def enrich(batch: DataFrame, batch_id: int) -> None:
        table = batch.sparkSession.read.parquet(features) if isinstance(features, str) else features
        last = batch.agg(F.max("received_at")).first()[0]
        joined = asof_join(batch, table.filter(F.col("ts") <= F.lit(last)), ["symbol"], "received_at", "ts", take)
        joined.write.mode("overwrite").parquet(f"{out_folder}/batch={batch_id}")
    return enrich
