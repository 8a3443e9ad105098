"""Hash-chained ledgers as Parquet tables or foreign JSON lines, and report extracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import GENESIS, RECORD_TYPES, canonical_json
from ..plans.ordered import chunk_scan, previous_row, rows_chunk

ENVELOPE = "seq long, ts string, type string, prev_hash string, hash string"


def append_ledger(ledger: DataFrame, path: str) -> None:
    """Append built records; an unknown record type fails the write."""
    known = F.assert_true(F.coalesce(F.col("type").isin(*RECORD_TYPES), F.lit(False)),
                          F.concat(F.lit("unknown record type: "), F.coalesce("type", F.lit("null"))))
    (ledger.withColumn("type", F.when(known.isNull(), F.col("type")))
     .write.mode("append").parquet(path))


def read_foreign_ledger(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines ledger: parsed envelope plus ``content``, the canonical text that was hashed.

    Folders named like ``chain=7`` come back as columns, so many chains can lie under one path.
    """
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    parsed = lines.withColumn("r", F.from_json("value", ENVELOPE))
    return parsed.select(*[c for c in lines.columns if c != "value"], "r.*", canonical_json("value", without="hash").alias("content"), F.get_json_object("value", "$.data").alias("data"))


def verify_foreign(ledger: DataFrame, chain: Sequence[str] = ()) -> DataFrame:
    """Problems of foreign chains (``chain``: columns that name one; none: one chain): records whose
    link or own hash is wrong."""
    seen = chunk_scan(ledger.withColumn("_one", F.lit(0)), ["_one", *chain], rows_chunk("seq"), ["seq"],
                      [previous_row("_b", F.col("hash"))])
    return (seen.withColumn("problem", F.when(
        ~F.coalesce(F.col("prev_hash") == F.coalesce(F.col("_b.v"), F.lit(GENESIS)), F.lit(False)),
        "broken_link").when(~F.coalesce(F.sha2("content", 256) == F.col("hash"), F.lit(False)), "bad_hash"))
        .filter("problem IS NOT NULL").select(*chain, "seq", "type", "problem"))


def write_reports(curve: DataFrame, positions: DataFrame, ledger: DataFrame, decisions: DataFrame,
                  folder: str, tail: int = 40, last_decisions: int = 25) -> None:
    """Equity, positions, ledger tail, latest decisions and their summary as JSON."""
    for name, view in report_views(curve, positions, ledger, decisions, tail, last_decisions).items():
        view.write.mode("overwrite").json(f"{folder}/{name}")


def report_views(curve: DataFrame, positions: DataFrame, ledger: DataFrame, decisions: DataFrame,
                 tail: int = 40, last_decisions: int = 25) -> dict[str, DataFrame]:
    from ..operators.audit import ledger_tail
    from ..operators.decisions import decision_summary
    return {
        "equity": curve.select("run", "ts", F.round("equity", 4).alias("equity")),
        "positions": positions.select("account", "symbol", F.round("qty", 6).alias("qty")),
        "ledger_tail": ledger_tail(ledger, tail),
        "decisions": ledger_tail(decisions, last_decisions),
        "decision_summary": decision_summary(decisions)}


def append_journal(entries: DataFrame, path: str) -> None:
    """Append-only research journal; the entry day partitions the table."""
    (entries.withColumn("day", F.to_date("recorded_at")).write.mode("append")
     .partitionBy("day").parquet(path))
