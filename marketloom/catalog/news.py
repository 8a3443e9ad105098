"""Article queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.taxonomy import DECAY_MINUTES, EVENT_TYPES
from ..operators import neardup, news, signals
from ..plans import views
from ..plans.ordered import asof_join
from ..session import cut_lineage
from .base import ARTICLES, VERSIONS, num, register, when
from .signals import MOMENTUM, REGIME, VOLUME

UNIVERSE = views.SYMBOLS
DECISION_TIMES = ["2024-01-01 06:00:00", "2024-01-01 12:00:00", "2024-01-03 00:00:00"]

# The caller's keyword rules for the test texts.
RULES = [(1, "guidance_change", "neutral", "eaux"), (2, "lawsuit", "negative", "sch"),
         (3, "product_launch", "positive", "ation"), (4, "upgrade", "positive", "the"),
         (5, "downgrade", "negative", "der")]


def rules(spark):
    return spark.createDataFrame(
        RULES, "ordinal int, event_type string, event_direction string, keyword string")


def normalized(spark, root):
    return news.normalize_articles(views.raw_articles(spark, root), UNIVERSE, "articles")


def versions(spark, root):
    return news.version_articles(normalized(spark, root))


@register("normalize_articles", f"""WITH {ARTICLES} SELECT id AS event_id,
  {when('received_at', 'received_at')}, {when('created_at', 'created_at')},
  {when('updated_at', 'updated_at')}, array_to_string(symbols, ',') AS symbols, headline,
  summary, 'desk' AS author, url, url AS content_ref, 'articles' AS source,
  CAST(arrival_seq AS BIGINT) AS arrival_seq FROM articles""")
def _normalize(spark, root):
    return normalized(spark, root).withColumn("symbols", F.array_join("symbols", ","))


@register("quarantine_articles", f"""WITH {ARTICLES} SELECT id, CAST(arrival_seq AS BIGINT) AS arrival_seq,
  CASE created_state WHEN 'missing' THEN 'missing_created_at' WHEN 'naive' THEN 'bad_created_at'
       ELSE 'missing_symbols' END AS reason
FROM raw_articles WHERE created_state <> 'ok' OR NOT has_symbols""")
def _quarantine(spark, root):
    return news.quarantine_articles(views.raw_articles(spark, root)).select(
        "id", "arrival_seq", "reason")


VERSION_COLUMNS = f"""id AS event_id, {when('updated_at', 'updated_at')},
  CAST(arrival_seq AS BIGINT) AS arrival_seq, version,
  CASE WHEN version > 1 THEN id END AS supersedes,
  CASE WHEN version < n_versions THEN id || '#v' || (version + 1) END AS superseded_by"""


@register("version_articles", f"WITH {VERSIONS} SELECT {VERSION_COLUMNS} FROM versions")
def _versions(spark, root):
    return versions(spark, root).select(
        "event_id", "updated_at", "arrival_seq", "version", "supersedes", "superseded_by")


@register("version_articles_by_edit", f"""WITH {ARTICLES}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id, updated_at ORDER BY arrival_seq) AS r FROM articles),
versions AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at) AS version,
  count(*) OVER (PARTITION BY id) AS n_versions FROM ranked WHERE r = 1)
SELECT {VERSION_COLUMNS} FROM versions""")
def _versions_by_edit(spark, root):
    return news.version_articles(normalized(spark, root), "updated").select(
        "event_id", "updated_at", "arrival_seq", "version", "supersedes", "superseded_by")


TIMES_SQL = ", ".join(f"(TIMESTAMP '{t}')" for t in DECISION_TIMES)
VISIBLE = VERSIONS + f""", visible AS (
  SELECT * FROM (SELECT v.*, t AS decision_time,
    row_number() OVER (PARTITION BY t, id ORDER BY version DESC) AS newest
    FROM versions v JOIN (VALUES {TIMES_SQL}) d(t) ON v.updated_at <= t) WHERE newest = 1)"""


@register("newest_visible_versions", f"""WITH {VISIBLE}
SELECT {when('decision_time', 'decision_time')}, id AS event_id, version,
  {when('updated_at', 'updated_at')} FROM visible""")
def _visible(spark, root):
    return news.newest_visible(versions(spark, root), DECISION_TIMES).select(
        "decision_time", "event_id", "version", "updated_at")


def _rule_case(field: int, default: str) -> str:
    lines = " ".join(f"WHEN contains(lower(headline || ' ' || summary), '{r[3]}') THEN '{r[field]}'"
                     for r in RULES)
    return f"CASE {lines} ELSE '{default}' END"


CLASSIFIED = f"""classified AS (SELECT *, {_rule_case(1, 'unknown')} AS event_type,
  {_rule_case(2, 'unknown')} AS event_direction,
  CASE WHEN ({_rule_case(1, 'unknown')}) = 'unknown' THEN 0.0 ELSE 0.55 END AS confidence FROM {{}})"""


@register("classify_articles", f"""WITH {VERSIONS}, {CLASSIFIED.format('versions')}
SELECT id AS event_id, version, event_type, event_direction, {num('confidence', 'confidence')},
  'rules' AS classifier FROM classified""")
def _classify(spark, root):
    return news.classify(versions(spark, root), rules(spark)).select(
        "event_id", "version", "event_type", "event_direction", "confidence", "classifier")


@register("classification_errors", """WITH c AS (
  SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'rumour' ELSE 'jobs' END AS t,
    CASE WHEN event_id % 7 = 0 THEN 'up' ELSE 'neutral' END AS d,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE value / 50 END AS conf,
    event_id % 3 = 0 AS has_s, CASE WHEN event_id % 6 = 0 THEN 'guess' ELSE 'article_text' END AS src
  FROM events)
SELECT event_id, concat_ws(',', CASE WHEN t = 'rumour' THEN 'event_type' END,
  CASE WHEN d = 'up' THEN 'event_direction' END,
  CASE WHEN conf IS NULL OR conf < 0 OR conf > 1 THEN 'confidence' END,
  CASE WHEN has_s AND src = 'guess' THEN 'surprise_source' END) AS errors FROM c""")
def _errors(spark, root):
    i = F.col("event_id")
    rows = views.table(spark, root, "events").select(
        "event_id", F.when(i % 5 == 0, "rumour").otherwise("jobs").alias("event_type"),
        F.when(i % 7 == 0, "up").otherwise("neutral").alias("event_direction"),
        F.when(i % 11 != 0, F.col("value") / 50).alias("confidence"),
        F.when(i % 3 == 0, F.struct(
            F.lit("revenue").alias("metric"), F.lit(1.0).alias("expected"),
            F.lit(1.1).alias("actual"), F.lit(10.0).alias("surprise_pct"),
            F.when(i % 6 == 0, "guess").otherwise("article_text").alias("expectation_source")))
        .alias("surprise"))
    return news.validate_classifications(rows).select(
        "event_id", F.array_join("errors", ",").alias("errors"))


FEATURES = f"""CASE event_direction WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 ELSE 0.0 END AS direction,
  greatest(0.0, epoch_us(decision_time) - epoch_us(received_at)) / 60e6 AS minutes"""
ONE_HOT = ", ".join(num(f"CASE WHEN event_type = '{t}' THEN 1 ELSE 0 END", f"type_{t}")
                    for t in EVENT_TYPES)
DECAYS = ", ".join(num(f"exp(-minutes / {tau})", f"decay_{name}") for name, tau in DECAY_MINUTES.items())


@register("pit_news_frame", f"""WITH {VISIBLE}, {CLASSIFIED.format('visible')},
f AS (SELECT *, {FEATURES} FROM classified)
SELECT {when('decision_time', 'decision_time')}, id AS event_id, version, {when('updated_at', 'as_of')},
  {when('updated_at', 'source_max_ts')}, array_to_string(symbols, ',') AS symbols, {ONE_HOT},
  {num('direction', 'direction')}, {num('confidence', 'confidence')}, {num('0', 'has_surprise')},
  {num('0', 'surprise_pct')}, {num('1', 'novelty')}, {num('minutes', 'minutes_since_event')}, {DECAYS}
FROM f""")
def _pit_news(spark, root):
    return news.pit_news_frame(views.raw_articles(spark, root), UNIVERSE, DECISION_TIMES,
                               rules(spark)).withColumn("symbols", F.array_join("symbols", ","))


@register("event_features", f"""WITH {VERSIONS}, {CLASSIFIED.format('versions')},
f AS (SELECT * EXCLUDE (decision_time), decision_time, {FEATURES} FROM (
  SELECT *, updated_at + INTERVAL 90 MINUTE AS decision_time FROM classified))
SELECT id AS event_id, version, {num('direction', 'direction')}, {num('minutes', 'minutes_since_event')},
  {DECAYS}, {num('CASE WHEN minutes <= 60 THEN 1 WHEN minutes <= 1440 THEN 0.5 ELSE 0 END', 'decay_step')}
FROM f""")
def _event_features(spark, root):
    rows = news.classify(versions(spark, root), rules(spark)).withColumn(
        "decision_time", F.timestamp_add("MINUTE", F.lit(90), F.col("updated_at")))
    out = news.event_features(rows, one_hot=False)
    return out.select("event_id", "version", "direction", "minutes_since_event",
                      *[f"decay_{d}" for d in DECAY_MINUTES],
                      news.step_decay(F.col("minutes_since_event")).alias("decay_step"))


@register("event_symbol_rows", f"""WITH {VERSIONS}, {CLASSIFIED.format('versions')}
SELECT symbol, event_type, count(*) AS n_events, {num('sum(confidence)', 'confidence_sum')}
FROM (SELECT unnest(symbols) AS symbol, * FROM classified) GROUP BY ALL""")
def _symbol_rows(spark, root):
    rows = news.per_symbol(news.classify(versions(spark, root), rules(spark)))
    return rows.groupBy("symbol", "event_type").agg(
        F.count("*").alias("n_events"), F.sum("confidence").alias("confidence_sum"))


@register("low_confidence_quarantine", f"""WITH {VERSIONS}, {CLASSIFIED.format('versions')}
SELECT id AS event_id, version, event_type FROM classified WHERE confidence < 0.5""")
def _low_confidence(spark, root):
    _, held = news.split_by_confidence(
        news.classify(versions(spark, root), rules(spark)), 0.5)
    return held.select("event_id", "version", "event_type")


@register("mentioned_percentages", r"""SELECT doc_id, CAST(len(p) AS BIGINT) AS n, array_to_string(p, '|') AS figures FROM (
  SELECT doc_id, regexp_extract_all(text, '([-+]?\d*\.?\d+\s*%)', 1) AS p FROM documents)
WHERE len(p) > 0""")
def _percentages(spark, root):
    docs = views.table(spark, root, "documents").withColumn("p", text.percentages(F.col("text")))
    return docs.filter(F.size("p") > 0).select(
        "doc_id", F.size("p").alias("n"), F.array_join("p", "|").alias("figures"))


# A statement made from an order's value stands in the middle of the whole text of a document.
_STATED = """CASE WHEN o_orderkey % 3 = 0 THEN ' Acme BEAT revenue estimates by ' WHEN o_orderkey % 3 = 1 THEN ' Acme missed eps expectations by ' END
  || (CAST(floor(o_totalprice) AS BIGINT) % 300) // 10 || '.' || (CAST(floor(o_totalprice) AS BIGINT) % 10) || '% '"""


@register("stated_surprises", rf"""WITH s AS (
  SELECT doc_id, text[:length(text) // 2] || coalesce({_STATED}, ' Acme did fine. ') || text[length(text) // 2 + 1:] AS line
  FROM documents JOIN orders ON o_orderkey = doc_id),
m AS (SELECT doc_id, regexp_extract(line, '(?i)(beat|beats|missed|misses)\s+(\w+)\s+(?:estimates|expectations)\s+by\s+(\d*\.?\d+)\s*%',
    ['verb', 'metric', 'size']) AS r FROM s)
SELECT doc_id, lower(r.metric) AS metric, round(CASE WHEN lower(r.verb) LIKE 'miss%' THEN -1 ELSE 1 END * CAST(r.size AS DOUBLE), 6) + 0.0 AS surprise_pct,
  'article_text' AS expectation_source FROM m WHERE r.verb <> ''""")
def _surprises(spark, root):
    orders = views.table(spark, root, "orders").select(F.col("o_orderkey").alias("doc_id"), F.floor("o_totalprice").alias("v"))
    docs = views.table(spark, root, "documents").select("doc_id", "text").join(orders, "doc_id")
    figure = F.concat(F.floor(F.col("v") % 300 / 10).cast("string"), F.lit("."), (F.col("v") % 10).cast("string"), F.lit("% "))
    verb = F.when(F.col("doc_id") % 3 == 0, " Acme BEAT revenue estimates by ").when(F.col("doc_id") % 3 == 1, " Acme missed eps expectations by ")
    half = F.floor(F.length("text") / 2).cast("int")
    line = F.concat(F.substring("text", F.lit(1), half), F.coalesce(F.concat(verb, figure), F.lit(" Acme did fine. ")),
                    F.substring("text", half + 1, F.length("text")))
    rows = docs.select("doc_id", text.parse_surprise(line).alias("s"))
    return rows.filter("s IS NOT NULL").select("doc_id", "s.metric", "s.surprise_pct", "s.expectation_source")


URL_SQL = r"regexp_replace(regexp_replace(lower(url), '/+$', ''), '[?#].*$', '')"
TOKENS_SQL = "list_sort(list_distinct(regexp_extract_all(lower(headline), '([a-z0-9]+)', 1)))"
JACCARD_SQL = ("CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / "
               "CAST(len({a}) + len({b}) - len(list_intersect({a}, {b})) AS DOUBLE) ELSE 0.0 END")


@register("url_keys", f"""SELECT page_id, {URL_SQL} AS url_key,
  regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '/+$', '') AS url_key_clean FROM pages""")
def _url_keys(spark, root):
    return views.table(spark, root, "pages").select(
        "page_id", text.url_key(F.col("url")).alias("url_key"),
        text.url_key(F.col("url"), query_first=True).alias("url_key_clean"))


@register("near_dup_pairs", f"""WITH {VERSIONS}, items AS (
  SELECT id || '#' || version AS id, received_at, epoch_us(received_at) // 86400000000 AS slot, {TOKENS_SQL} AS tokens,
         {URL_SQL} AS u FROM versions),
s AS (SELECT tokens, slot, min(id) AS rep, count(*) AS n, min(received_at) AS a, max(received_at) AS z
      FROM items WHERE len(tokens) > 0 GROUP BY tokens, slot),
g AS (SELECT u, slot, min(id) AS rep, count(*) AS n, min(received_at) AS a, max(received_at) AS z
      FROM items WHERE u <> '' GROUP BY u, slot),
p AS (SELECT 'headline' AS kind, x.rep AS left_id, y.rep AS right_id, x.n AS left_n, y.n AS right_n,
        {JACCARD_SQL.format(a='x.tokens', b='y.tokens')} AS score
      FROM s x JOIN s y ON (x.slot = y.slot AND array_to_string(x.tokens, ' ') < array_to_string(y.tokens, ' '))
        OR (y.slot = x.slot + 1 AND y.a - x.z <= INTERVAL 24 HOUR))
SELECT kind, left_id, right_id, left_n, right_n, {num('score', 'score')} FROM p WHERE score >= 0.85
UNION ALL SELECT 'url', x.rep, y.rep, x.n, y.n, 1.0::DOUBLE FROM g x JOIN g y
  ON x.u = y.u AND y.slot = x.slot + 1 AND y.a - x.z <= INTERVAL 24 HOUR""")
def _pairs(spark, root):
    return neardup.near_dup_edges(versions(spark, root))


@register("visible_versions_for_decisions", f"""WITH {VERSIONS}, decisions AS (
  SELECT doc_id AS decision_id, CAST(doc_id - doc_id % 10 AS VARCHAR) AS event_id,
    TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id + 15 AS BIGINT)) AS decision_time FROM documents)
SELECT decision_id, event_id, {when('decision_time', 'decision_time')}, version, {when('updated_at', 'matched_updated_at')}
FROM decisions d ASOF LEFT JOIN (SELECT id, version, updated_at FROM versions) v
  ON d.event_id = v.id AND d.decision_time >= v.updated_at""")
def _visible_for(spark, root):
    doc = F.col("doc_id")
    decisions = views.table(spark, root, "documents").select(
        doc.alias("decision_id"), (doc - doc % 10).cast("string").alias("event_id"),
        F.timestamp_add("MINUTE", (doc + 15).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("decision_time"))
    return news.newest_visible_for(versions(spark, root), decisions)


# The sequential definition: one article per step, against the list of heads so far.
CLUSTERS = f"""{VERSIONS}, items AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY received_at, arrival_seq) AS i, id, version, received_at,
         {TOKENS_SQL} AS tokens, {URL_SQL} AS u FROM versions),
near AS MATERIALIZED (SELECT x.i, any_value(x.id) AS id, any_value(x.version) AS version,
    list_sort(coalesce(list(h.i) FILTER (h.i IS NOT NULL), [])) AS matching
  FROM items x LEFT JOIN items h ON h.i < x.i AND x.received_at - h.received_at <= INTERVAL 24 HOUR
    AND ((x.u <> '' AND x.u = h.u) OR ({JACCARD_SQL.format(a='x.tokens', b='h.tokens')}) >= 0.85)
  GROUP BY x.i),
run(i, heads, head) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(0 AS BIGINT)
  UNION ALL
  SELECT i, CASE WHEN hit IS NULL THEN list_append(heads, i) ELSE heads END, coalesce(hit, i)
  FROM (SELECT n.i, r.heads, list_filter(n.matching, lambda m: list_contains(r.heads, m))[1] AS hit
        FROM run r JOIN near n ON n.i = r.i + 1)),
clustered AS (SELECT n.id, n.version, h.id AS cluster_id
  FROM run r JOIN items n ON n.i = r.i JOIN items h ON h.i = r.head)"""


@register("cluster_articles", f"""WITH RECURSIVE {CLUSTERS}
SELECT id AS event_id, version, cluster_id FROM clustered""")
def _clusters(spark, root):
    return neardup.cluster_articles(_slim(versions(spark, root))).select(
        "event_id", "version", "cluster_id")


def _slim(rows):
    """What clustering reads: its input is written once, without the texts."""
    return rows.select("event_id", "version", "headline", "url", "received_at", "arrival_seq")


@register("cluster_novelty", f"""WITH RECURSIVE {CLUSTERS}
SELECT r.id AS event_id, r.version, cluster_id, row_number() OVER (PARTITION BY cluster_id
    ORDER BY v.received_at, v.arrival_seq) AS cluster_rank,
  {num('1.0 / row_number() OVER (PARTITION BY cluster_id ORDER BY v.received_at, v.arrival_seq)', 'novelty')}
FROM clustered r JOIN versions v ON v.id = r.id AND v.version = r.version""")
def _novelty(spark, root):
    clustered = neardup.cluster_articles(_slim(versions(spark, root)))
    return news.cluster_novelty(clustered).select(
        "event_id", "version", "cluster_id", "cluster_rank", "novelty")


@register("news_price_interactions", f"""WITH {VERSIONS}, {CLASSIFIED.format('versions')},
ev AS (SELECT id, version, unnest(symbols) AS symbol, event_type, (CAST(id AS BIGINT) % 7 - 3) / 100.0 AS surprise,
    CASE event_direction WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 ELSE 0.0 END AS direction,
    TIMESTAMP '1996-01-01' + to_hours(CAST(id AS BIGINT) * 2) AS decision_ts FROM classified),
{REGIME}, px AS (
  SELECT f.*, risk_on FROM (
    SELECT symbol, ts, price, pct, {MOMENTUM['momentum_roc20']} AS roc20, {VOLUME['volume_z20']} AS z20
    FROM vol) f JOIN regime USING (ts) WHERE price IS NOT NULL),
j AS (SELECT * FROM ev ASOF LEFT JOIN px ON ev.symbol = px.symbol AND ev.decision_ts >= px.ts)
SELECT id AS event_id, version, symbol, {when('ts', 'matched_ts')},
  {num('surprise * coalesce(roc20, 0)', 'inter_surprise_x_momentum')},
  {num('surprise * coalesce(z20, 0)', 'inter_surprise_x_volume_z')},
  {num('direction * coalesce(risk_on, 0)', 'inter_direction_x_regime')},
  {num("CASE WHEN event_type <> 'unknown' THEN 1 ELSE 0 END * coalesce(pct, 0)", 'inter_type_x_vol_regime')}
FROM j""")
def _interactions(spark, root):
    bars = views.bars(spark, root)
    # The feature table is a dataset of its own; the as-of scan reads it twice.
    prices = cut_lineage(
        signals.feature_table(bars, views.BENCHMARK)
        .select("symbol", "ts", "momentum_roc20", "volume_z20", "vol_percentile252")
        .join(signals.regime_features(bars, views.BENCHMARK).select("ts", "regime_risk_on"), "ts"))
    when_decided = F.timestamp_add("HOUR", (F.col("event_id").cast("long") * 2).cast("int"),
                                   F.lit("1996-01-01 00:00:00").cast("timestamp"))
    surprise = F.struct(((F.col("event_id").cast("long") % 7 - 3) / 100.0).alias("surprise_pct"))
    events = news.classify(versions(spark, root), rules(spark)).withColumns(
        {"decision_time": when_decided, "surprise": surprise})
    featured = cut_lineage(news.per_symbol(news.event_features(events, one_hot=False)).select(
        "event_id", "version", "symbol", "event_type", "direction", "surprise_pct", "decision_time"))
    paired = asof_join(featured, prices, ["symbol"], "decision_time", "ts",
                       ["momentum_roc20", "volume_z20", "regime_risk_on", "vol_percentile252"],
                       chunk_seconds=30 * 86_400)
    return news.interactions(paired).select(
        "event_id", "version", "symbol", "matched_ts", "inter_surprise_x_momentum",
        "inter_surprise_x_volume_z", "inter_direction_x_regime", "inter_type_x_vol_regime")
