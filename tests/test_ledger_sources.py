"""Hash chains, foreign ledgers, stores and manifests."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from marketloom.operators import audit
from marketloom.sources import feature_store, ledger_store, manifest, raw_store


def python_chain(n):
    rows, last = [], "0" * 64
    for i in range(1, n + 1):
        record = {"seq": i, "ts": f"2024-01-01T00:00:{i:02d}+00:00", "type": "note",
                  "data": {"b": 100.0, "a": 1e-9, "k": i, "t": "é"}, "prev_hash": last}
        last = hashlib.sha256(json.dumps(record, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        rows.append({**record, "hash": last})
    return rows


def records(spark, rows):
    return spark.createDataFrame(
        [(7, r["seq"], r["ts"], r["type"], json.dumps(r["data"], sort_keys=True, separators=(",", ":"))) for r in rows],
        "chain int, seq long, ts string, type string, body string")


def test_build_equals_python_chain(spark):
    rows = python_chain(9)
    built = audit.build_chain(records(spark, rows)).orderBy("seq").collect()
    assert [r["hash"] for r in built] == [r["hash"] for r in rows]
    assert audit.verify_chain(audit.build_chain(records(spark, rows))).first()["ok"]


@pytest.mark.parametrize("column,bad", [("body", 4), ("prev_hash", 6), ("hash", 3)])
def test_tampering_is_found(spark, column, bad):
    built = audit.build_chain(records(spark, python_chain(8)))
    forged = built.withColumn(column, F.when(F.col("seq") == bad, F.concat(F.col(column), F.lit("0")))
                              .otherwise(F.col(column)))
    row = audit.verify_chain(forged).first()
    assert not row["ok"] and row["first_bad_seq"] == bad


def test_segments_verify_on_their_own(spark):
    built = audit.build_segments(records(spark, python_chain(10)), rows=4)
    anchor = F.sha2(F.concat_ws("#", F.col("chain").cast("string"), F.col("segment").cast("string")), 256)
    report = audit.verify_chain(built, ["chain", "segment"], anchor).collect()
    assert len(report) == 3 and all(r["ok"] for r in report)


def test_foreign_ledger(spark, tmp_path):
    rows = python_chain(6)
    path = tmp_path / "ledger.jsonl"
    path.write_text("\n".join(json.dumps(r, sort_keys=True) for r in rows) + "\n")
    assert ledger_store.verify_foreign(ledger_store.read_foreign_ledger(spark, str(path))).isEmpty()
    rows[2]["data"]["k"] = 99
    rows[4]["prev_hash"] = "1" * 64
    path2 = tmp_path / "forged.jsonl"
    path2.write_text("\n".join(json.dumps(r) for r in rows))
    found = ledger_store.verify_foreign(ledger_store.read_foreign_ledger(spark, str(path2))).orderBy("seq").collect()
    assert [(r["seq"], r["problem"]) for r in found] == [(3, "bad_hash"), (5, "broken_link")]


def test_ledger_sink_refuses_unknown_types(spark, tmp_path):
    built = audit.build_chain(records(spark, python_chain(3)))
    ledger_store.append_ledger(built, str(tmp_path / "l"))
    ledger_store.append_ledger(built.limit(1), str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == 4
    with pytest.raises(Exception, match="unknown record type"):
        ledger_store.append_ledger(built.withColumn("type", F.lit("rumour")), str(tmp_path / "m"))
    assert [r["seq"] for r in audit.ledger_tail(built, 2).collect()] == [2, 3]


def test_reports(spark, tmp_path):
    built = audit.build_chain(records(spark, python_chain(5)))
    curve = spark.createDataFrame([("r", 1, 100.123456)], "run string, ts int, equity double")
    positions = spark.createDataFrame([(1, "A", 0.12345678)], "account int, symbol string, qty double")
    decided = spark.createDataFrame([(1, True), (2, False), (3, True)], "seq long, allow boolean")
    ledger_store.write_reports(curve, positions, built, decided, str(tmp_path / "rep"), tail=2, last_decisions=2)
    read = lambda n: spark.read.json(str(tmp_path / "rep" / n)).collect()
    assert read("equity")[0]["equity"] == 100.1235 and len(read("ledger_tail")) == 2
    assert read("decision_summary")[0]["allowed"] == 2 and len(read("decisions")) == 2


def test_raw_store(spark, tmp_path):
    path = str(tmp_path / "raw")
    assert raw_store.read_raw(spark, path, "a").isEmpty()
    rows = spark.createDataFrame([("a", '{"x":1}', "2024-01-02 01:00:00", 2), ("a", '{"x":0}', "2024-01-01 09:00:00", 1),
                                  ("b", "{}", "2024-01-01 09:00:00", 3)], "source string, payload string, stored_at string, ingest_seq long")
    rows = rows.withColumn("stored_at", F.col("stored_at").cast("timestamp"))
    raw_store.append_raw(rows, path)
    raw_store.append_raw(rows.filter("source = 'a'").withColumn("ingest_seq", F.col("ingest_seq") + 10), path)
    got = raw_store.read_raw(spark, path, "a")
    assert [r["ingest_seq"] for r in got.collect()] == [1, 11, 2, 12]
    assert got.first()["payload"] == '{"x":0}'
    assert "PartitionFilters: [isnotnull(source" in got._jdf.queryExecution().toString()


def test_feature_store(spark, tmp_path):
    path = str(tmp_path / "f")
    assert feature_store.load_features(spark, path).isEmpty()
    rows = spark.createDataFrame([("A", "2024-01-02", "2024-01-02", 1.0, None), ("A", "2024-01-05", "2024-01-04", 2.0, 3.0)],
                                 "symbol string, as_of string, source_max_ts string, x double, y double")
    rows = rows.withColumns({c: F.col(c).cast("timestamp") for c in ("as_of", "source_max_ts")})
    feature_store.append_features(feature_store.envelope(rows, ["x", "y"]), path)
    assert feature_store.load_features(spark, path).count() == 2
    early = feature_store.load_features(spark, path, "2024-01-03 00:00:00").collect()
    assert [r["features"] for r in early] == [{"x": 1.0}]
    late = rows.withColumn("source_max_ts", F.timestamp_add("DAY", F.lit(9), F.col("as_of")))
    with pytest.raises(Exception, match="leakage at write time"):
        feature_store.append_features(feature_store.envelope(late, ["x"]), str(tmp_path / "g"))


def test_file_manifest(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.yaml").write_text("x: 1\n")
    (tmp_path / "c" / "b.yaml").write_text("y: 1\n")
    frozen = spark.createDataFrame(manifest.file_manifest(spark, str(tmp_path / "c"), "*.yaml").collect())
    assert frozen.filter("path = 'a.yaml'").first()["sha256"] == hashlib.sha256(b"x: 1\n").hexdigest()
    manifest.assert_frozen(frozen, manifest.file_manifest(spark, str(tmp_path / "c"), "*.yaml"))
    (tmp_path / "c" / "a.yaml").write_text("x: 2\n")
    (tmp_path / "c" / "d.yaml").write_text("z: 1\n")
    now = manifest.file_manifest(spark, str(tmp_path / "c"), "*.yaml")
    assert {r["path"]: r["status"] for r in manifest.drift(frozen, now).collect()} == {"a.yaml": "changed", "d.yaml": "added"}
    with pytest.raises(manifest.ManifestDrift):
        manifest.assert_frozen(frozen, now)


def test_one_file_per_key_without_a_committer(spark, tmp_path, monkeypatch):
    """Repeated and NULL keys, NULL lines; read back as Spark's partitioned text; few calls however many keys."""
    from pyspark.sql.readwriter import DataFrameWriter

    from marketloom.sources import files
    monkeypatch.setattr(DataFrameWriter, "text", lambda *a, **k: pytest.fail("written file by file through the committer"))
    rows = [(i % 400, f"line {i}") for i in range(800)] + [(None, "no key"), (7, None), (7, "\u00e9")]
    df = spark.createDataFrame(rows, "k long, value string").coalesce(1)
    folder = tmp_path / "with space"
    files.write_keyed_text(df, "k", "value", folder.as_uri())
    assert (folder / "k=7" / "part.txt").read_text() == "line 7\nline 407\n\n\u00e9\n"
    got = {(r["k"], r["value"]) for r in spark.read.text(str(folder)).collect()}
    assert got == {(k, v or "") for k, v in rows}
    assert manifest.file_manifest(spark, str(folder), "*.txt").count() == 401


def test_manifest_and_foreign_queries_write_in_place(spark, root, monkeypatch):
    import __spark_entry__ as driver
    from pyspark.sql.readwriter import DataFrameWriter
    monkeypatch.setattr(DataFrameWriter, "text", lambda *a, **k: pytest.fail("written file by file through the committer"))
    found = driver.queries()["file_manifest_drift"](spark, root)
    assert {r["status"] for r in found.collect()} <= {"added", "removed", "changed"}
    assert set(driver.queries()["foreign_ledger_problems"](spark, root).columns) == {"chain", "seq", "problem"}
