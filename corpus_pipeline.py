"""From raw documents to token ids: five stages, each a function of (spark, docs, sf_dir).

language id -> line dedup -> near duplicates -> source mix -> piece ids. A stage takes all that the
one before it kept; its result is written as Parquet and read again. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm import langid, line_dedup, mixing, ngram_join, pieces
from marketloom.llm.common import cut_lineage, documents, packed, tokenizer_file, unpacked
from marketloom.session import settled, tune

# A text with letters goes if known n-grams cover less of it than this.
MIN_COVERAGE = 0.1
# Row keys up to this number are broadcast to leave documents out; more are joined by shuffle.
BROADCAST_IDS = 2_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out what has no letter, no text or no language that was learned."""
    filters = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    seen = langid.identify(docs, filters)
    kept = seen.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("coverage") >= MIN_COVERAGE))
    return kept.select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cleans texts; a document whose every word stood in dropped lines goes."""
    cleaned = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_dropped") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return (cleaned.filter(F.col("text").isNotNull() & ~emptied)
            .withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of 5-word-shingle similarity 0.8 or more: that of smallest id.

    Rows are told apart by id and text, so rows under one id, or without an id, stay or go each for
    itself. Rows without an id come last in their group; under one id the smallest text hash comes
    first. Rows that repeat id and text are one. Texts without words are no copies of anything else.
    """
    # A few numbers per row; the tables of the join go as soon as they are written.
    rows = settled(spark, lambda: ngram_join.row_components(docs, n=5, num=80, den=100).select("doc_id", "text_hash", "lead"))
    key = [F.col("doc_id").alias("_out"), F.col("text_hash").alias("_out_hash")]
    out = (rows.filter(F.col("lead").isNotNull() & (ngram_join.row_key("doc_id", "text_hash") != F.col("lead")))
           .select(*key).distinct())
    again = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").select(*key)
    out, again = picked(out), picked(again)
    same = F.col("_id").eqNullSafe(F.col("_out")) & (F.col("_hash") == F.col("_out_hash"))
    own = docs.select(packed(docs), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"))
    kept = own.join(out, same, "left_anti")
    once = kept.join(again, same, "left_semi").dropDuplicates(["_id", "_hash"])
    return kept.join(again, same, "left_anti").unionByName(once).select(*unpacked(docs))


def picked(ids: DataFrame) -> DataFrame:
    ids = cut_lineage(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it.

    Rows are told apart by id, text and source. Of rows that agree in all three, as many get one
    copy more than the others as the mix says.
    """
    key = ["_id", "_hash", "_source"]
    copies = settled(spark, lambda: (
        mixing.mix(docs).groupBy(F.col("doc_id").alias("_of"), F.col("text_hash").alias("_of_hash"),
                                 F.col("source_key").alias("_of_source"))
        .agg(F.count("*").alias("_rows"), F.min("copies").alias("_least"), F.sum("copies").alias("_all"))
        .filter("_all > 0")))
    same = (F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_hash") == F.col("_of_hash"))
            & (F.col("_source") == F.col("_of_source")))
    own = docs.select(packed(docs), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"),
                      mixing.source_key("source").alias("_source"))
    one = (own.join(copies.filter("_rows = 1"), same)
           .select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_all"))).alias("_copy")))
    # Equal rows are counted first, so that the window has one row per content.
    equal = own.join(copies.filter("_rows > 1"), same).groupBy("_row", *key, "_rows", "_least", "_all").agg(
        F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*key).orderBy(F.xxhash64("_row"), "_row")) - F.col("_n")
    more = F.col("_all") - F.col("_least") * F.col("_rows")
    got = F.col("_least") * F.col("_n") + F.greatest(F.lit(0), F.least(more - before, F.col("_n")))
    many = (equal.withColumn("_got", got).filter("_got > 0")
            .select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_got"))).alias("_copy")))
    return one.unionByName(many).select(*unpacked(docs))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_chars, ids``."""
    encoded = pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"))
    return encoded.select("doc_id", "lang", "source", "n_chars", "ids")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("near_duplicates", near_duplicates),
          ("source_mix", source_mix), ("piece_ids", piece_ids)]

# Language filters, pivotal rounding and piece search are not for SQL; tests compare with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``."""
    docs = documents(tune(spark), sf_dir)
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
