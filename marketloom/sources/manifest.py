"""Content fingerprints and drift against a frozen manifest."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ManifestDrift(Exception):
    """Files differ from the frozen manifest."""


def file_manifest(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, sha256) of the files under a folder of configuration files, paths relative to it."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(folder))
    root = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", folder).rstrip("/") + "/"
    name = F.substring(F.col("path"), F.instr(F.col("path"), root) + len(root), F.length("path"))
    return files.select(name.alias("path"), F.sha2("content", 256).alias("sha256"))


def content_manifest(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(path, sha256) of a text column."""
    return rows.select(F.col(key).cast("string").alias("path"),
                       F.sha2(F.col(content), 256).alias("sha256"))


def drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Paths that changed, appeared or vanished."""
    both = expected.select("path", F.col("sha256").alias("expected")).join(
        actual.select("path", F.col("sha256").alias("actual")), "path", "full_outer")
    return (both.filter(~F.col("expected").eqNullSafe(F.col("actual")))
            .withColumn("status", F.when(F.col("expected").isNull(), "added")
                        .when(F.col("actual").isNull(), "removed").otherwise("changed")))


def assert_frozen(expected: DataFrame, actual: DataFrame) -> None:
    found = drift(expected, actual).head(1)
    if found:
        raise ManifestDrift(str(found[0]))
