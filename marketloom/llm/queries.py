"""Registered queries of the corpus operators, with SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog.base import Query
from ..session import tune
from . import hard_negatives, langid, line_dedup, merkle, mixing, ngram_join, phrase_index, pieces, pii, prefix_forest, sql, syncmers, token_store, url_filter
from .common import benchmark, documents, embeddings, pages, scratch_path, tokenizer_file

REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        REGISTRY[name] = Query(lambda spark, root: fn(tune(spark), root), sql)
        return fn
    return wrap


@register("op1_line_dedup", sql.LINE_DEDUP)
def op1(spark: SparkSession, root: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, root).select("doc_id", "text"))


@register("op9_source_mix")
def op9(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(documents(spark, root)).select("doc_id", "size", "source_size", "target", "taken")


@register("op4_token_store")
def op4(spark: SparkSession, root: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_store.write_tokens(documents(spark, root), path, tokenizer_file("byte_bpe_50k.json"))
    return token_store.checksums(token_store.read_tokens(spark, path))


@register("op7_language_id")
def op7(spark: SparkSession, root: str) -> DataFrame:
    docs = documents(spark, root).select("doc_id", "text", "lang")
    held = langid.held_out(F.col("doc_id"))
    filters = langid.train(docs.filter(~held))
    return (langid.identify(docs.select("doc_id", "text"), filters)
            .select("doc_id", held.alias("held_out"), "lang_pred", "score", "coverage"))


@register("op10_piece_round_trip")
def op10(spark: SparkSession, root: str) -> DataFrame:
    path = tokenizer_file("piece_bpe_32k.model")
    docs = documents(spark, root).select("doc_id", "text")
    back = pieces.decode(pieces.encode(docs, path), path)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
                       F.length("decoded").cast("long").alias("decoded_chars"),
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


@register("op3_url_filter", sql.URL_FILTER)
def op3(spark: SparkSession, root: str) -> DataFrame:
    captures = pages(spark, root).select("page_id", "url").withColumn("fetched_at", url_filter.fetched_at(F.col("page_id")))
    entries = url_filter.list_from_captures(captures)
    out = url_filter.filter_urls(captures, entries)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("page_id", "url", stamp("fetched_at"), "blocked", "match_kind", "match_key", stamp("listed_since"))


@register("op5_prefix_forest")
def op5(spark: SparkSession, root: str) -> DataFrame:
    vectors = embeddings(spark, root).select("vec_id", "embedding")
    return prefix_forest.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


@register("op8_syncmers")
def op8(spark: SparkSession, root: str) -> DataFrame:
    return syncmers.compare_with_edits(documents(spark, root))


@register("op2_ngram_jaccard_join", sql.NGRAM_JOIN)
def op2(spark: SparkSession, root: str) -> DataFrame:
    return ngram_join.similarity_components(documents(spark, root))


@register("op6_personal_data")
def op6(spark: SparkSession, root: str) -> DataFrame:
    found = pii.personal_data(documents(spark, root))

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(number, pii.KINDS)
    return found.select("doc_id", *counts, F.sha2(pii.printed(F.col("base")), 256).alias("base_sha256"),
                        pii.printed(pii.in_order(F.concat("base", "added"))).alias("spans"))


@register("op11_hard_negatives", sql.HARD_NEGATIVES)
def op11(spark: SparkSession, root: str) -> DataFrame:
    return hard_negatives.mine(embeddings(spark, root))


@register("op12_decontamination", sql.DECONTAMINATION)
def op12(spark: SparkSession, root: str) -> DataFrame:
    found = phrase_index.decontaminate(documents(spark, root), benchmark(spark, root))
    inside = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", inside.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"),
                        F.size("near_items").cast("long").alias("n_near_items"))


@register("op13_merkle_manifest", sql.MERKLE)
def op13(spark: SparkSession, root: str) -> DataFrame:
    docs = documents(spark, root)
    return merkle.audit(docs, merkle.fifth(F.col("doc_id")), merkle.lowered(F.col("text")))
