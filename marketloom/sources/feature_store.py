"""Point-in-time feature table in Parquet, partitioned by day of ``as_of``."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "symbol string, as_of timestamp, source_max_ts timestamp, features map<string,double>"


def envelope(rows: DataFrame, features: list[str]) -> DataFrame:
    """Wide feature columns into the fixed four-column row; NULL features are left out."""
    pairs = F.array_compact(F.array(*[
        F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("k"), F.col(f).alias("v")))
        for f in features]))
    return rows.select("symbol", "as_of", "source_max_ts", F.map_from_entries(pairs).alias("features"))


def append_features(rows: DataFrame, path: str) -> None:
    """Append rows; the write fails when any row used data newer than its ``as_of``."""
    guard = F.assert_true(F.coalesce(F.col("source_max_ts") <= F.col("as_of"), F.lit(False)),
                          F.concat(F.lit("leakage at write time: "), F.col("symbol")))
    checked = rows.withColumn("as_of", F.when(guard.isNull(), F.col("as_of")))
    (checked.withColumn("as_of_date", F.to_date("as_of"))
     .write.mode("append").partitionBy("as_of_date").parquet(path))


def append_sound(rows: DataFrame, path: str) -> DataFrame:
    """Append the rows that may be stored and return the others with the ``reason`` each was refused for."""
    reason = (F.when(F.col("as_of").isNull(), "missing_as_of").when(F.col("source_max_ts").isNull(), "missing_source")
              .when(F.col("source_max_ts") > F.col("as_of"), "source_after_as_of"))
    judged = rows.withColumn("reason", reason)
    append_features(judged.filter("reason IS NULL").drop("reason"), path)
    return judged.filter("reason IS NOT NULL")


def load_features(spark: SparkSession, path: str, until: str | None = None) -> DataFrame:
    """All rows, or those knowable at ``until``; the day partitions are pruned by it."""
    try:
        rows = spark.read.schema(SCHEMA + ", as_of_date date").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA)
    if until is not None:
        t = F.lit(until).cast("timestamp")
        rows = rows.filter((F.col("as_of_date") <= F.to_date(t)) & (F.col("as_of") <= t))
    return rows.drop("as_of_date")


def import_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows from JSON lines with ISO-8601 times."""
    return (spark.read.schema("symbol string, as_of string, source_max_ts string, "
                              "features map<string,double>").json(path)
            .withColumns({c: F.try_to_timestamp(F.col(c)) for c in ("as_of", "source_max_ts")}))
