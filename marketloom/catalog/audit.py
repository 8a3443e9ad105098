"""Ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit
from ..plans import views
from ..session import cut_lineage
from .base import FILLS, LEDGER, num, register

STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def records(spark, root):
    return views.ledger_records(spark, root).select(
        "chain", "seq", F.date_format("ts", STAMP).alias("ts"), "type", "body")


CONTENT = """'{{"data":' || {body} || ',"prev_hash":"' || {prev} || '","seq":' || {seq}
  || ',"ts":"' || {ts} || '","type":"' || {type} || '"}}'"""


def _text(prev: str) -> str:
    return CONTENT.format(body="n.body", prev=prev, seq="n.seq", ts="n.ts", type="n.type")


CHAINED = f"""{LEDGER}, recs AS (SELECT chain, seq, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, type, body FROM ledger),
built(chain, seq, prev_hash, hash) AS (
  SELECT DISTINCT chain, CAST(0 AS BIGINT), '', repeat('0', 64) FROM recs
  UNION ALL SELECT n.chain, n.seq, b.hash, sha256({_text('b.hash')})
  FROM built b JOIN recs n ON n.chain = b.chain AND n.seq = b.seq + 1)"""


@register("hash_chain_build", f"""WITH RECURSIVE {CHAINED}
SELECT chain, seq, prev_hash, hash FROM built WHERE seq > 0""")
def _build(spark, root):
    return audit.build_chain(records(spark, root)).select("chain", "seq", "prev_hash", "hash")


SEGMENT = 16
SEGMENTED = f"""{LEDGER}, recs AS (SELECT chain, seq, (seq - 1) // {SEGMENT} AS segment,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, type, body FROM ledger),
built(chain, segment, seq, prev_hash, hash) AS (
  SELECT chain, segment, min(seq) - 1, '', sha256(chain || '#' || segment) FROM recs GROUP BY ALL
  UNION ALL SELECT n.chain, n.segment, n.seq, b.hash, sha256({_text('b.hash')})
  FROM built b JOIN recs n ON n.chain = b.chain AND n.segment = b.segment AND n.seq = b.seq + 1)"""


@register("hash_chain_segments", f"""WITH RECURSIVE {SEGMENTED}
SELECT chain, segment, seq, prev_hash, hash FROM built WHERE prev_hash <> ''""")
def _segments(spark, root):
    return audit.build_segments(records(spark, root), SEGMENT).select(
        "chain", "segment", "seq", "prev_hash", "hash")


def tampered(spark, root):
    """The built ledger with some bodies and some links altered afterwards."""
    built = audit.build_chain(records(spark, root))
    key = F.col("chain") * 31 + F.col("seq")
    return built.withColumns({
        "body": F.when(key % 101 == 0, F.concat("body", F.lit(" "))).otherwise(F.col("body")),
        "prev_hash": F.when(key % 211 == 5, F.reverse("prev_hash")).otherwise(F.col("prev_hash"))})


@register("hash_chain_verify", f"""WITH RECURSIVE {CHAINED}, k AS (
  SELECT *, (chain * 31 + seq) % 101 = 0 AS body_bad,
    (chain * 31 + seq) % 211 = 5 AND reverse(prev_hash) <> prev_hash AS link_bad
  FROM built WHERE seq > 0)
SELECT chain, count(*) AS n_records, count(*) FILTER (body_bad OR link_bad) = 0 AS ok,
  min(seq) FILTER (body_bad OR link_bad) AS first_bad_seq,
  count(*) FILTER (body_bad OR link_bad) AS n_problems FROM k GROUP BY chain""")
def _verify(spark, root):
    # A ledger is a stored table; verification reads it three times.
    return audit.verify_chain(cut_lineage(tampered(spark, root)))


@register("unknown_record_types", """SELECT event_type AS type, count(*) AS n FROM events
WHERE event_type NOT IN ('signal', 'proposal', 'risk_decision', 'order', 'fill', 'position', 'benchmark', 'note')
GROUP BY 1""")
def _types(spark, root):
    rows = views.table(spark, root, "events").withColumnRenamed("event_type", "type")
    return audit.unknown_types(rows).groupBy("type").agg(F.count("*").alias("n"))


@register("record_type_counts", f"""WITH {LEDGER} SELECT type, count(*) AS n, max(seq) AS last_seq
FROM ledger GROUP BY type""")
def _type_counts(spark, root):
    return views.ledger_records(spark, root).groupBy("type").agg(
        F.count("*").alias("n"), F.max("seq").alias("last_seq"))


@register("ledger_tail", """SELECT event_id, event_type FROM events
ORDER BY event_id DESC LIMIT 40""")
def _tail(spark, root):
    return audit.ledger_tail(views.table(spark, root, "events").select("event_id", "event_type"),
                             40, "event_id")


@register("canonical_json", """SELECT event_id, '{"k":' || json_extract(props, '$.k') || '}' AS canonical,
  sha256('{"k":' || json_extract(props, '$.k') || '}') AS digest FROM events""")
def _canonical(spark, root):
    rows = views.table(spark, root, "events").withColumn("canonical", audit.canonical_json("props"))
    return rows.select("event_id", "canonical", F.sha2("canonical", 256).alias("digest"))


RUNNING = f"""{FILLS}, s AS (SELECT *, CASE side WHEN 'BUY' THEN qty ELSE -qty END AS q FROM fills),
c AS (SELECT *, sum(q) OVER w AS run FROM s WINDOW w AS (PARTITION BY account, symbol ORDER BY seq)),
p AS (SELECT *, run - least(0, min(run) OVER w) AS position,
    lag(fill_price) OVER w AS previous_price FROM c
  WINDOW w AS (PARTITION BY account, symbol ORDER BY seq)),
positions AS (SELECT *, coalesce(lag(position) OVER (PARTITION BY account, symbol ORDER BY seq), 0)
  AS held_before FROM p)"""


# Some fills without a symbol, and one account without a name.
UNKEYED = f"""{FILLS}, unkeyed AS (SELECT CASE WHEN account <> 7 THEN account END AS account, seq,
    CASE WHEN seq % 97 <> 5 THEN symbol END AS symbol, side, qty, fill_price, ts FROM fills),{RUNNING.removeprefix(FILLS + ',').replace("FROM fills)", "FROM unkeyed)", 1)}"""


@register("running_positions", f"""WITH {UNKEYED} SELECT account, seq, symbol, side, {num('qty', 'qty', 7)},
  {num('held_before', 'held_before', 7)}, {num('position', 'position', 7)},
  {num('previous_price', 'previous_price', 7)} FROM positions""", digits=7)
def _running(spark, root):
    fills = views.fills(spark, root).withColumns({"account": F.when(F.col("account") != 7, F.col("account")),
                                                  "symbol": F.when(F.col("seq") % 97 != 5, F.col("symbol"))})
    return audit.running_positions(fills).select(
        "account", "seq", "symbol", "side", "qty", "held_before", "position", "previous_price")


START_CASH = 20_000_000.0
STATE = f"""{RUNNING}, grid AS (
  SELECT f.account, f.seq, y.symbol, p.position, p.fill_price
  FROM fills f JOIN (SELECT DISTINCT account, symbol FROM fills) y ON y.account = f.account
  LEFT JOIN positions p ON p.account = f.account AND p.seq = f.seq AND p.symbol = y.symbol),
filled AS (SELECT account, seq, symbol, coalesce(last_value(position IGNORE NULLS) OVER w
    * last_value(fill_price IGNORE NULLS) OVER w, 0) AS v FROM grid
  WINDOW w AS (PARTITION BY account, symbol ORDER BY seq)),
held AS (SELECT account, seq, sum(v) AS gross FROM filled GROUP BY ALL),
state AS (SELECT p.*, gross, {START_CASH} + sum(CASE side WHEN 'BUY' THEN -qty ELSE qty END * fill_price)
    OVER (PARTITION BY account ORDER BY seq) AS cash FROM positions p JOIN held USING (account, seq))"""


@register("account_equity", f"""WITH {STATE} SELECT account, seq, {num('cash + 1e-5', 'cash', 2)},
  {num('gross + 1e-5', 'gross', 2)}, {num('cash + gross + 1e-5', 'equity', 2)} FROM state""", digits=2)
def _equity(spark, root):
    # The offset keeps exact half cents off the rounding boundary in both engines.
    return audit.account_state(views.fills(spark, root), START_CASH).select(
        "account", "seq", *[(F.col(c) + 1e-5).alias(c) for c in ("cash", "gross", "equity")])


@register("ledger_audit", f"""WITH {STATE}, e AS (SELECT *, cash + gross AS equity FROM state)
SELECT account, seq, symbol, 'PENNY_STOCK' AS code FROM e WHERE side = 'BUY' AND fill_price < 1000
UNION ALL SELECT account, seq, symbol, 'SHORT' FROM e WHERE side = 'SELL' AND held_before <= 0
UNION ALL SELECT account, seq, symbol, 'OVERSELL' FROM e
  WHERE side = 'SELL' AND held_before > 0 AND qty > held_before + 1e-9
UNION ALL SELECT account, seq, symbol, 'NON_POSITIVE_EQUITY' FROM e WHERE equity <= 0
UNION ALL SELECT account, seq, symbol, 'OVER_EXPOSURE' FROM e
  WHERE equity > 0 AND gross > 0.95 * equity + 1e-9
UNION ALL SELECT account, seq, f.symbol, 'OVER_CONCENTRATION' FROM e JOIN filled f USING (account, seq)
  WHERE equity > 0 AND f.v > 0.25 * equity + 1e-9""")
def _audit(spark, root):
    # The price floor is set to where it bites on these unit prices.
    return audit.audit_fills(views.fills(spark, root), START_CASH, min_price=1000.0)
