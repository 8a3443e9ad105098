"""NULLs, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketloom.llm import (langid, line_dedup, mixing, ngram_join, pieces, pii, prefix_forest, syncmers, token_store,
                            url_filter)
from marketloom.llm.common import scratch_path, tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("_row", "_id", "_d", "_key", "out", "words", "n", "g", "bucket", "halo", "size", "n_lines", "ids",
            "score", "blocked", "copies", "_copy", "template", "kind")


def odd_rows():
    long = " ".join(f"word{i % 700} of a very long text" for i in range(12000))
    texts = [None, "", " \n\t ", "a", "Ünï ▁ code 😀", long, long, "same line here now\nother", "same line here now\nmore",
             "same line here now\nthird", "same line here now\nthird"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 3}", None) for i, t in enumerate(texts)]
    return [*rows, rows[-1], (None, "no id at all", "en", "s1", 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    frame = spark.createDataFrame(odd_rows(), SCHEMA)
    return frame.select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def both(odd, empty, run):
    assert run(empty).count() == 0
    return run(odd).collect()


def test_line_dedup(odd, empty):
    rows = both(odd, empty, line_dedup.dedup_lines)
    assert len(rows) == len(odd_rows())
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[0]["text"] is None and by_id[0]["n_lines"] == 0
    assert by_id[7]["text"].startswith("same line") and by_id[8]["text"] == "more"
    assert [r["text"] for r in rows if r["doc_id"] == 10] == ["third", "third"]
    assert by_id[5]["_d"] == "x" and by_id[5]["n_dropped"] == 0


def test_mixing(odd, empty):
    rows = both(odd, empty, mixing.mix)
    assert len(rows) == len(odd_rows())
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)


def test_ngram_join(odd, empty):
    rows = both(odd, empty, ngram_join.similarity_components)
    got = sorted((r["doc_id"], r["component_id"]) for r in rows if r["doc_id"] is not None)
    assert [c for d, c in got if d in (0, 1, 2)] == [0, 1, 2]
    assert [c for d, c in got if d in (5, 6)] == [5, 5] and [c for d, c in got if d in (9, 10)] == [9, 9, 9]
    assert len(rows) == len(odd_rows())


def test_token_store(spark, odd, empty):
    for docs, n in ((empty, 0), (odd, len(odd_rows()))):
        path = scratch_path(spark, "test")
        token_store.write_tokens(docs, path, tokenizer_file("byte_bpe_50k.json"))
        rows = sorted(token_store.read_tokens(spark, path).collect(), key=lambda r: r["start"])
        assert len(rows) == n
        assert [r["start"] for r in rows] == [sum(len(q["ids"]) for q in rows[:i]) for i in range(n)]
        assert all(r["ids"][-1] == token_store.END for r in rows)


def test_language(odd, empty):
    filters = langid.train(empty)
    assert {r["lang_pred"] for r in langid.identify(odd, filters).collect()} == {"und"}
    rows = both(odd, empty, lambda d: langid.identify(d, langid.train(odd)))
    assert {r["doc_id"]: r["lang_pred"] for r in rows if r["doc_id"] in (0, 1, 2, 3)} == {
        0: "und", 1: "und", 2: "und", 3: "en"}
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_pieces(odd, empty):
    path = tokenizer_file("piece_bpe_32k.model")
    rows = both(odd, empty, lambda d: pieces.decode(pieces.encode(d, path), path))
    assert all(r["decoded"] == (r["text"] or "") for r in rows)


def test_syncmers(odd, empty):
    rows = both(odd, empty, syncmers.compare_with_edits)
    assert len(rows) == len(odd_rows())
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[5]["fingerprint"] == by_id[6]["fingerprint"] and by_id[5]["near_next"] == 1.0


def test_personal_data(odd, empty):
    assert len(both(odd, empty, pii.personal_data)) == len(odd_rows())


def test_forest(spark):
    schema = "vec_id long, embedding array<float>, label int"
    v = [(i, [float(i % 3), 1.0, -1.0], 0) for i in range(40)]
    v += [(100, None, 0), (101, [0.0, 0.0, 0.0], 0), (102, [None, 1.0, 1.0], 0), (103, [float("nan"), 1.0, 1.0], 0),
          (None, [1.0, 1.0, 1.0], 0), (104, [1.0, 2.0], 0), v[0]]
    base = spark.createDataFrame(v, schema)
    rows = prefix_forest.nearest(base, base.filter("vec_id % 10 = 0")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got[0] == [3, 6, 9, 12, 15] and set(got) == {0, 10, 20, 30}
    assert prefix_forest.nearest(base.limit(0), base.limit(0)).count() == 0


def test_urls(spark):
    urls = [None, "", "not a url", "http://A.Example.com:80/x/y?q#f", "http://u@b.example.com", "http://[::1]/", "http:///x"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls + urls)], "page_id long, url string")
    pages = pages.withColumn("fetched_at", F.lit("2024-01-05").cast("timestamp")).withColumn("key", F.lit("x"))
    entries = spark.createDataFrame(
        [("domain", "example.com", "add", "2024-01-05"), ("host", "b.example.com", "add", "2024-01-01"),
         ("host", "b.example.com", "remove", "2024-01-05"), ("prefix", "a.example.com/x", "add", "2023-01-05"),
         (None, "x", "add", "2024-01-01"), ("host", "y", None, "2024-01-01")],
        "kind string, key string, action string, at string").select("kind", "key", "action",
                                                                  F.col("at").cast("timestamp").alias("listed_at"))
    rows = {r["page_id"]: r for r in url_filter.filter_urls(pages, entries).collect()}
    assert len(rows) == 2 * len(urls) and rows[0]["key"] == "x"
    assert [i for i, r in rows.items() if r["blocked"] and i < len(urls)] and not rows[0]["blocked"]
    assert (rows[3]["match_kind"], rows[3]["match_key"]) == ("prefix", "a.example.com/x")
    assert rows[4]["match_key"] == "example.com"
    assert url_filter.filter_urls(pages.limit(0), entries).count() == 0
    assert url_filter.filter_urls(pages, entries.limit(0)).filter("blocked").count() == 0


def test_pipeline_stages(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
        out = stage(spark, odd, "")
        assert out.count() <= 2 * len(odd_rows())
        if name != "piece_ids":
            assert out.columns == odd.columns, name
