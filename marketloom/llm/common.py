"""Pieces that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path

__all__ = ["benchmark", "cut_lineage", "documents", "embeddings", "packed", "pages", "scratch_path", "tokenizer_file", "uniform", "unpacked", "word_count", "WORD"]

# Java form of the word pattern: runs without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/documents.parquet")


def benchmark(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/benchmark.parquet")


def embeddings(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/embeddings.parquet")


def pages(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/pages.parquet")


def packed(df: DataFrame) -> Column:
    """All columns of a row in one struct, so that whatever they are called meets no other name."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def unpacked(df: DataFrame, *replaced: str) -> list[Column]:
    """The columns that ``packed(df)`` took in, but for those that are replaced."""
    return [F.col(f"_row.`{c}`").alias(c) for c in df.columns if c not in replaced]


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*parts: Column) -> Column:
    """A repeatable number in [0, 1) made from the hash of ``parts``."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)).cast("double") / float(1 << 53)


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies; the same place on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)
