"""Article normalisation, revision history, classification and event features."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.taxonomy import (DECAY_MINUTES, DIRECTIONS, EVENT_TYPES, NO_MATCH_CONFIDENCE,
                                  RULE_CONFIDENCE, SURPRISE_SOURCES)
from ..functions.text import minutes_since, utc_timestamp
from ..plans.ordered import (CHUNK_ROWS, asof_join, chunk_scan, ordinal, rows_chunk, running_max,
                             seconds_chunk)


# ------------------------------------------------------------ normalise

def _reason(created: Column, updated: Column) -> Column:
    return (F.when(F.col("created_at").isNull(), "missing_created_at")
            .when(created.isNull(), "bad_created_at")
            .when(updated.isNull(), "bad_updated_at")
            .when(F.col("symbols").isNull(), "missing_symbols"))


def _parsed(raw: DataFrame) -> DataFrame:
    edited = F.coalesce(F.nullif(F.col("updated_at"), F.lit("")), F.col("created_at"))
    created, updated = utc_timestamp(F.col("created_at")), utc_timestamp(edited)
    return raw.withColumns({"_created": created, "_updated": updated,
                            "_reason": _reason(created, updated)})


def normalize_articles(raw: DataFrame, universe: Sequence[str], source: str) -> DataFrame:
    """Canonical, still unclassified events; malformed rows are left out.

    Symbols outside the universe are removed, order and duplicates of the rest are kept.
    """
    members = F.array(*[F.lit(s) for s in universe])
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return _parsed(raw).filter("_reason IS NULL").select(
        F.coalesce(F.col("id").cast("string"), F.lit("None")).alias("event_id"),
        "received_at", F.col("_created").alias("created_at"), F.col("_updated").alias("updated_at"),
        F.filter("symbols", lambda s: F.array_contains(members, s)).alias("symbols"),
        text("headline"), text("summary"), text("author"), text("url"),
        F.coalesce(F.col("url"), F.lit("")).alias("content_ref"), F.lit(source).alias("source"),
        "arrival_seq")


def quarantine_articles(raw: DataFrame) -> DataFrame:
    """The malformed rows with the reason they were refused."""
    return (_parsed(raw).filter("_reason IS NOT NULL")
            .withColumnRenamed("_reason", "reason").drop("_created", "_updated"))


# ------------------------------------------------------------ revisions

def version_articles(events: DataFrame, mode: str = "arrival") -> DataFrame:
    """Number the revisions of each event; older or repeated rows are dropped.

    ``arrival`` takes rows as they came: a row counts when it is newer than all before it.
    ``updated`` orders by edit time first, so late-arriving older revisions are kept.
    """
    if mode == "arrival":
        order, chunk = ["arrival_seq"], rows_chunk("arrival_seq", CHUNK_ROWS)
    else:
        order, chunk = ["updated_at", "arrival_seq"], seconds_chunk("updated_at", 86_400)
    seen = chunk_scan(events, ["event_id"], chunk, order,
                      [running_max("_newest", F.col("updated_at"), inclusive=False)])
    kept = seen.filter(F.col("_newest").isNull() | (F.col("updated_at") > F.col("_newest")))
    # Kept rows rise in both orders, so the same chunks number them.
    numbered = chunk_scan(kept.drop("_newest"), ["event_id"], chunk, order, [ordinal("version")])
    # The last record of an event carries its newest edit time, so the raw rows tell what follows.
    last = events.groupBy("event_id").agg(F.max("updated_at").alias("_last"))
    link = F.concat(F.col("event_id"), F.lit("#v"), (F.col("version") + 1).cast("string"))
    return (numbered.join(last, "event_id")
            .withColumn("supersedes", F.when(F.col("version") > 1, F.col("event_id")))
            .withColumn("superseded_by", F.when(F.col("updated_at") < F.col("_last"), link))
            .drop("_last"))


def newest_visible(versions: DataFrame, decision_times: Iterable[str]) -> DataFrame:
    """For every decision time, the newest version of each event edited at or before it.

    The decision times are a short list; each version is repeated only for the times that see it.
    """
    times = F.array(*[F.lit(t).cast("timestamp") for t in decision_times])
    seen = versions.withColumn("decision_time", F.explode(
        F.filter(times, lambda t: t >= F.col("updated_at"))))
    return (seen.groupBy("decision_time", "event_id")
            .agg(F.max_by(F.struct(*versions.columns), "version").alias("_v"))
            .select("decision_time", "_v.*"))


def newest_visible_for(versions: DataFrame, decisions: DataFrame, take: Sequence[str] = ("version",)) -> DataFrame:
    """Each row of a table of decisions with the newest version of its event edited by then.

    ``decisions`` has ``event_id, decision_time``; rows that see no version keep NULLs. Runs as one
    as-of scan, so neither side is repeated for the other.
    """
    return asof_join(decisions, versions, ["event_id"], "decision_time", "updated_at", take,
                     right_order=["version"])


# ------------------------------------------------------- classification

def classify(events: DataFrame, rules: DataFrame) -> DataFrame:
    """First matching keyword rule wins; a keyword matches as a plain substring.

    ``rules`` holds (ordinal, event_type, event_direction, keyword). It is configuration, written
    by people: it is read to the driver and becomes one literal array, in order.
    """
    listed = sorted(rules.select("ordinal", "event_type", "event_direction", "keyword").collect(),
                    key=lambda r: r["ordinal"])
    text = F.lower(F.concat(F.coalesce(F.col("headline"), F.lit("")), F.lit(" "),
                            F.coalesce(F.col("summary"), F.lit(""))))
    table = F.array(*[F.struct(*[F.lit(r[c]).cast("string").alias(c)
                                 for c in ("event_type", "event_direction", "keyword")]) for r in listed])
    none = F.lit(None).cast("struct<event_type:string,event_direction:string,keyword:string>")
    hit = F.get(F.filter(table, lambda r: F.col("_text").contains(r["keyword"])), F.lit(0)) if listed else none
    return (events.withColumn("_text", text).withColumn("_hit", hit)
            .withColumns({"event_type": F.coalesce("_hit.event_type", F.lit("unknown")),
                          "event_direction": F.coalesce("_hit.event_direction", F.lit("unknown")),
                          "confidence": F.when(F.col("_hit").isNotNull(), RULE_CONFIDENCE)
                          .otherwise(NO_MATCH_CONFIDENCE),
                          "classifier": F.lit("rules")})
            .drop("_text", "_hit"))


def classify_with(events: DataFrame, model: Callable[[pd.Series, pd.Series], pd.DataFrame],
                  name: str) -> DataFrame:
    """Labels from a caller's model, validated: adds the label columns and ``errors``.

    ``model`` maps Arrow batches of headlines and summaries to a frame with event_type,
    event_direction and confidence.
    """
    @F.pandas_udf("event_type string, event_direction string, confidence double")
    def label(headline: pd.Series, summary: pd.Series) -> pd.DataFrame:
        return model(headline, summary)
    labelled = events.withColumn("_m", label("headline", "summary")).select(
        *events.columns, "_m.*", F.lit(name).alias("classifier"))
    return validate_classifications(labelled)


def validate_classifications(rows: DataFrame) -> DataFrame:
    """Adds ``errors``, the list of violated schema rules (empty for a valid row).

    A surprise is a struct; a key that is absent there is NULL. Only the origin is mandatory in
    value, the other keys must merely exist in the struct type.
    """
    checks = [
        F.when(~F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False)), "event_type"),
        F.when(~F.coalesce(F.col("event_direction").isin(*DIRECTIONS), F.lit(False)),
               "event_direction"),
        F.when(~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False)), "confidence")]
    if "surprise" in rows.columns:
        origin = F.col("surprise.expectation_source")
        checks.append(F.when(F.col("surprise").isNotNull()
                             & ~F.coalesce(origin.isin(*SURPRISE_SOURCES), F.lit(False)),
                             "surprise_source"))
    return rows.withColumn("errors", F.array_compact(F.array(*checks)))


def missing_keys(present: Column, required: Sequence[str]) -> Column:
    """Required keys absent from an array of present keys."""
    return F.array_except(F.array(*[F.lit(k) for k in required]), present)


def split_by_confidence(rows: DataFrame, minimum: float) -> tuple[DataFrame, DataFrame]:
    """(usable, quarantined) by classifier confidence."""
    sure = F.coalesce(F.col("confidence") >= minimum, F.lit(False))
    return rows.filter(sure), rows.filter(~sure)


# ------------------------------------------------------------- features

def type_column(event_type: str) -> str:
    return f"type_{event_type}"


def event_features(rows: DataFrame, one_hot: bool = True) -> DataFrame:
    """Numeric features of classified events at ``decision_time``.

    Uses ``novelty`` (1.0 if absent) and ``surprise`` if present. ``one_hot=False`` keeps the
    type as one sparse column.
    """
    have = set(rows.columns)
    direction = F.lit(0.0)
    for name, value in DIRECTIONS.items():
        direction = F.when(F.col("event_direction") == name, value).otherwise(direction)
    minutes = minutes_since(F.col("received_at"), F.col("decision_time"))
    surprise = (F.coalesce(F.col("surprise.surprise_pct"), F.lit(0.0)), F.col("surprise").isNotNull()
                ) if "surprise" in have else (F.lit(0.0), F.lit(False))
    columns = {}
    if one_hot:
        columns.update({type_column(t): F.coalesce(F.col("event_type") == t, F.lit(False))
                        .cast("double") for t in EVENT_TYPES})
    columns.update({
        "direction": direction, "confidence": F.coalesce(F.col("confidence"), F.lit(0.0)),
        "has_surprise": surprise[1].cast("double"), "surprise_pct": surprise[0],
        "novelty": F.col("novelty") if "novelty" in have else F.lit(1.0),
        "minutes_since_event": minutes})
    columns.update({f"decay_{name}": F.exp(-minutes / tau) for name, tau in DECAY_MINUTES.items()})
    return rows.withColumns(columns)


def step_decay(minutes: Column) -> Column:
    """Full weight for an hour, half for a day, nothing after."""
    return F.when(minutes <= 60, 1.0).when(minutes <= 1440, 0.5).otherwise(0.0)


def cluster_novelty(clustered: DataFrame) -> DataFrame:
    """1 for the first event of a cluster, 1/rank for its follow-ups."""
    ranked = chunk_scan(clustered, ["cluster_id"], seconds_chunk("received_at", 3600),
                        ["received_at", "arrival_seq"], [ordinal("cluster_rank")])
    return ranked.withColumn("novelty", F.lit(1.0) / F.col("cluster_rank"))


def per_symbol(rows: DataFrame) -> DataFrame:
    """One row per named symbol; events naming none disappear."""
    return rows.withColumn("symbol", F.explode("symbols")).drop("symbols")


def pit_news_frame(raw: DataFrame, universe: Sequence[str], decision_times: Iterable[str],
                   rules: DataFrame, source: str = "articles") -> DataFrame:
    """Event features as known at each decision time; ``as_of`` is the version's edit time."""
    versions = version_articles(normalize_articles(raw, universe, source))
    seen = classify(newest_visible(versions, decision_times), rules)
    return event_features(seen).select(
        "decision_time", "event_id", "version", F.col("updated_at").alias("as_of"),
        F.col("updated_at").alias("source_max_ts"), "symbols",
        *[type_column(t) for t in EVENT_TYPES], "direction", "confidence", "has_surprise",
        "surprise_pct", "novelty", "minutes_since_event", *[f"decay_{d}" for d in DECAY_MINUTES])


def interactions(rows: DataFrame) -> DataFrame:
    """Event × price products; a missing factor counts as zero."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = {"inter_surprise_x_momentum": zero("surprise_pct") * zero("momentum_roc20"),
           "inter_surprise_x_volume_z": zero("surprise_pct") * zero("volume_z20"),
           "inter_direction_x_regime": zero("direction") * zero("regime_risk_on")}
    if "vol_percentile252" in rows.columns:
        known = (F.col("event_type") != "unknown").cast("double")
        out["inter_type_x_vol_regime"] = known * zero("vol_percentile252")
    return rows.withColumns(out)
