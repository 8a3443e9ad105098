"""Append-only raw records and the landing folder of articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

# Microseconds survive only with an explicit format; the JSON default keeps milliseconds.
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
RAW_SCHEMA = "stored_at timestamp, payload string, ingest_seq long, source string, day string"

ARTICLE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("headline", T.StringType()),
    T.StructField("summary", T.StringType()), T.StructField("author", T.StringType()),
    T.StructField("created_at", T.StringType()), T.StructField("updated_at", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("symbols", T.ArrayType(T.StringType())),
    T.StructField("received_at", T.TimestampType()), T.StructField("arrival_seq", T.LongType())])


def append_raw(records: DataFrame, path: str) -> None:
    """Append (source, payload, stored_at, ingest_seq) rows as JSON lines by source and UTC day."""
    (records.withColumn("day", F.date_format("stored_at", "yyyy-MM-dd"))
     .write.mode("append").partitionBy("source", "day").option("timestampFormat", STAMP).json(path))


def read_raw(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Records of one source in storage order; only its partitions are read. Empty if none."""
    try:
        rows = spark.read.schema(RAW_SCHEMA).option("timestampFormat", STAMP).json(path)
    except AnalysisException:
        return spark.createDataFrame([], RAW_SCHEMA)
    return rows.filter(F.col("source") == source).orderBy("day", "ingest_seq")


def land_articles(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Stream of article JSON files; ``received_at`` falls back to the file's arrival time."""
    return (spark.readStream.schema(ARTICLE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
            .json(folder).withColumn("received_at", F.coalesce(
                F.col("received_at"), F.col("_metadata.file_modification_time"))))


def read_articles(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ARTICLE_SCHEMA).json(folder)


def receipt_time() -> Column:
    """Ingestion time, the only honest "known since"."""
    return F.current_timestamp()


def newest_page(articles: DataFrame, limit: int = 50) -> DataFrame:
    """Newest-first page."""
    return articles.orderBy(F.desc("updated_at"), F.desc("arrival_seq")).limit(limit)
