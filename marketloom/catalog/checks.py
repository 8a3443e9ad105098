"""Guards, foreign files and report extracts as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, backtest, pit
from ..plans import views
from ..session import scratch_path
from ..sources import files, ledger_store, manifest, raw_store
from . import backtest as backtests
from .audit import CHAINED, records
from .base import BARS, num, register, when
from .decisions import LIMITS, RISK, risk_inputs


@register("receipt_times", "SELECT event_id, true AS known, true AS after_event FROM events")
def _receipt(spark, root):
    rows = views.table(spark, root, "events").withColumn("received_at", raw_store.receipt_time())
    return rows.select("event_id", F.col("received_at").isNotNull().alias("known"),
                       (F.col("received_at") >= F.col("ts").cast("timestamp")).alias("after_event"))


@register("foreign_ledger_problems", f"""WITH RECURSIVE {CHAINED}, k AS (
  SELECT *, (chain * 31 + seq) % 101 = 0 AS body_bad, (chain * 31 + seq) % 211 = 5 AND reverse(prev_hash) <> prev_hash AS link_bad
  FROM built WHERE seq > 0)
SELECT chain, seq, CASE WHEN link_bad THEN 'broken_link' ELSE 'bad_hash' END AS problem FROM k WHERE body_bad OR link_bad""")
def _foreign(spark, root):
    """Chains as JSON lines of another program, one folder each, some records forged."""
    key = F.col("chain") * 31 + F.col("seq")
    body = F.when(key % 101 == 0, F.regexp_replace("body", '"value_cents":', '"value_cents":1')).otherwise(F.col("body"))
    prev = F.when(key % 211 == 5, F.reverse("prev_hash")).otherwise(F.col("prev_hash"))
    line = F.concat(F.lit('{"seq": '), F.col("seq").cast("string"), F.lit(', "type": "'), F.col("type"), F.lit('", "ts": "'), F.col("ts"),
                    F.lit('", "prev_hash": "'), prev, F.lit('", "hash": "'), F.col("hash"), F.lit('", "data": '), body, F.lit("}"))
    path = scratch_path(spark, "foreign")
    built = audit.build_chain(records(spark, root))
    files.write_keyed_text(built.select("chain", line.alias("value")), "chain", "value", path)
    ledger = ledger_store.read_foreign_ledger(spark, path)
    return ledger_store.verify_foreign(ledger, ["chain"]).select(F.col("chain").cast("long").alias("chain"), "seq", "problem")


@register("file_manifest_drift", """SELECT 's_suppkey=' || s_suppkey AS path,
  CASE WHEN s_suppkey % 10 = 3 THEN 'added' WHEN s_suppkey % 10 = 4 THEN 'removed' ELSE 'changed' END AS status,
  CASE WHEN s_suppkey % 10 <> 3 THEN sha256(s_name || chr(10)) END AS expected,
  CASE WHEN s_suppkey % 10 <> 4 THEN sha256(s_name || CASE WHEN s_suppkey % 10 = 5 THEN ' (edited)' ELSE '' END || chr(10)) END AS actual
FROM supplier WHERE s_suppkey % 10 IN (3, 4, 5)""")
def _files(spark, root):
    """Settings as files, one per supplier, frozen and looked at again after some were edited, added or removed."""
    k = F.col("s_suppkey")
    rows = views.table(spark, root, "supplier").select("s_suppkey", F.col("s_name").alias("value"))
    frozen, now = scratch_path(spark, "frozen"), scratch_path(spark, "now")
    edited = F.when(k % 10 == 5, F.concat("value", F.lit(" (edited)"))).otherwise(F.col("value"))
    for part, path in ((rows.filter(k % 10 != 3), frozen), (rows.filter(k % 10 != 4).withColumn("value", edited), now)):
        files.write_keyed_text(part, "s_suppkey", "value", path)
    found = [manifest.file_manifest(spark, path, "*.txt").withColumn("path", F.substring_index("path", "/", 1)) for path in (frozen, now)]
    return manifest.drift(*found)


REPORT = "report"


def reports(spark, root):
    folder = scratch_path(spark, "reports")
    proposals, accounts, positions, market, universe = risk_inputs(spark, root)
    from ..operators import decisions
    decided = decisions.evaluate(proposals, accounts, positions, market, universe, LIMITS)
    # Records of all chains under one running number.
    ledger = views.table(spark, root, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("type"))
    ledger_store.write_reports(backtests.curve(spark, root), positions, ledger, decided.withColumn("seq", F.col("proposal_id")), folder)
    return folder


@register("report_equity", f"""WITH {backtests.CURVE} SELECT run, {when('ts', 'ts')}, {num('ln(round(equity, 4))', 'log_equity')} FROM curve""")
def _report_equity(spark, root):
    out = spark.read.schema("run string, ts timestamp, equity double").json(f"{reports(spark, root)}/equity")
    return out.select("run", "ts", F.log("equity").alias("log_equity"))


@register("report_positions", f"""WITH {RISK} SELECT account, symbol, {num('held', 'qty')} FROM pos""")
def _report_positions(spark, root):
    return spark.read.schema("account long, symbol string, qty double").json(f"{reports(spark, root)}/positions")


@register("report_tails", f"""WITH {RISK}
SELECT * FROM (SELECT 'ledger' AS report, event_id AS seq, event_type AS entry FROM events ORDER BY event_id DESC LIMIT 40)
UNION ALL SELECT * FROM (SELECT 'decisions', proposal_id, code FROM decided ORDER BY proposal_id DESC LIMIT 25)""")
def _report_tails(spark, root):
    folder = reports(spark, root)
    tail = spark.read.schema("seq long, type string").json(f"{folder}/ledger_tail")
    last = spark.read.schema("seq long, code string").json(f"{folder}/decisions")
    return (tail.select(F.lit("ledger").alias(REPORT), "seq", F.col("type").alias("entry"))
            .unionByName(last.select(F.lit("decisions").alias(REPORT), "seq", F.col("code").alias("entry"))))


CUTOFFS = ("1996-06-01 00:00:00", "2030-01-01 00:00:00")


@register("future_bar_guard", f"""WITH {BARS} SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS cutoff, max(ts) > t AS refused
FROM bars, (VALUES {', '.join(f"(TIMESTAMP '{c}')" for c in CUTOFFS)}) c(t) GROUP BY t""")
def _future(spark, root):
    bars = views.bars(spark, root)

    def refused(cutoff):
        try:
            pit.check_no_future_bars(bars, cutoff)
        except pit.LeakageError:
            return True
        return False
    return spark.createDataFrame([(c, refused(c)) for c in CUTOFFS], "cutoff string, refused boolean")


@register("unknown_weight_symbols", f"""WITH {RISK} SELECT proposal_id, symbol FROM prop p
WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = p.symbol)""")
def _unknown(spark, root):
    proposals = risk_inputs(spark, root)[0]
    return backtest.unknown_symbols(proposals, views.bars(spark, root)).select("proposal_id", "symbol")


HOURLY = """hourly AS (SELECT event_type AS run, date_trunc('hour', ts) AS ts, CAST(epoch_us(date_trunc('hour', ts)) // 3600000000 AS BIGINT) AS bar_no,
    sum(value) AS equity, count(*) AS trades FROM events GROUP BY ALL)"""


@register("intraday_days", f"""WITH {HOURLY} SELECT run, bar_no, {num('first_value(equity) OVER w', 'day_start_equity')},
  {num('equity - first_value(equity) OVER w', 'day_pnl')}, CAST(sum(trades) OVER w AS BIGINT) AS trades_today
FROM hourly WINDOW w AS (PARTITION BY run, CAST(ts AS DATE) ORDER BY bar_no)""")
def _intraday(spark, root):
    """Hourly bars, so that a day has a start, a profit and several trades."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    hourly = (views.table(spark, root, "events").groupBy(F.col("event_type").alias("run"), hour.alias("ts"))
              .agg(F.sum("value").alias("equity"), F.count("*").alias("n_trades"))
              .withColumn("bar_no", F.floor(F.unix_micros("ts") / 3_600_000_000)))
    return backtest.day_starts(hourly.drop("n_trades"), hourly.select("run", "bar_no", "n_trades")).select(
        "run", "bar_no", "day_start_equity", "day_pnl", "trades_today")
