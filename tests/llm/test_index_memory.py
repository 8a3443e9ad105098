"""What a reader, writer or worker of the phrase index holds at once."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from marketloom.llm import phrase_index
from marketloom.llm.common import scratch_path


def row_groups(spark, path):
    """Rows of every row group of the table at ``path``."""
    files = spark.read.parquet(path).inputFiles()
    metas = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in files]
    return [m.row_group(k).num_rows for m in metas for k in range(m.num_row_groups)]


def long_docs(spark, n=24):
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randrange(10_000)}" for _ in range(400))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def test_a_full_shard_is_a_row_group_alone(spark, monkeypatch):
    monkeypatch.setattr(phrase_index, "GROUP_BYTES", 2048, raising=False)
    path = scratch_path(spark, "phrases")
    index = phrase_index.build_index(long_docs(spark), path, 500)
    assert index.count() == 24 and row_groups(spark, path) == [1] * 24


def test_marked_shards_are_written_like_the_index(spark, monkeypatch):
    monkeypatch.setattr(phrase_index, "GROUP_BYTES", 2048, raising=False)
    docs = long_docs(spark, 6)
    items = docs.select(F.col("doc_id").alias("item_id"), "text")
    paths = []

    def noted(session, kind):
        paths.append(scratch_path(session, kind))
        return paths[-1]

    index = phrase_index.build_index(docs, scratch_path(spark, "phrases"), 500)
    monkeypatch.setattr(phrase_index, "scratch_path", noted)
    got = phrase_index.search(index, items, block_bytes=1000)
    assert [(r["doc_id"], r["items"], r["near_items"]) for r in got.orderBy("doc_id").collect()] == [(i, [str(i)], [str(i)]) for i in range(6)]
    assert paths and all(set(row_groups(spark, p)) == {1} for p in paths)


def test_shards_go_to_one_python_function_for_a_small_benchmark(spark, monkeypatch):
    plans = []
    kept = phrase_index.cut_lineage

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("MapInArrow"))
        return kept(df)

    index = phrase_index.build_index(long_docs(spark, 2), scratch_path(spark, "phrases"))
    monkeypatch.setattr(phrase_index, "cut_lineage", noted)
    phrase_index.search(index, spark.createDataFrame([(1, "a b c")], "item_id long, text string"))
    assert plans[-1] == 1


def test_documents_without_words_do_not_fill_a_shard_without_end(spark):
    docs = spark.createDataFrame([(i, None if i % 2 else "") for i in range(500)], "doc_id long, text string").coalesce(1)
    index = phrase_index.build_index(docs, scratch_path(spark, "phrases"), 100)
    assert [r[0] for r in index.select(F.size("doc_ids")).collect()] == [100] * 5
    got = phrase_index.search(index, spark.createDataFrame([(1, "a b c")], "item_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(500))


@pytest.mark.parametrize("rows", [1, 3, 1 << 16])
def test_documents_of_a_shard_come_in_batches(monkeypatch, rows):
    monkeypatch.setattr(phrase_index, "ROWS", rows)
    # The line: two words, none, three words, one word, each with an empty place behind.
    spans = np.array([[0, 2], [4, 6], [8, 9]])
    batches = list(phrase_index._documents(pa.array([7, None, 7, 9]), np.array([2, 0, 3, 1]), spans,
                                           [(0, "1"), (0, "3"), (3, "1")], [(2, "5")]))
    assert len(batches) == max(1, -(-4 // rows))
    assert [list(r.values()) for b in batches for r in b.to_pylist()] == [
        [7, 2, [{"start": 0, "end": 2}], ["1", "3"], []],
        [None, 0, [], [], []],
        [7, 3, [{"start": 0, "end": 2}], [], ["5"]],
        [9, 1, [{"start": 0, "end": 1}], ["1"], []]]


def test_windows_ranked_in_parts_lose_nothing(monkeypatch):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n)).encode()
    line, sizes = phrase_index.words([text(60) for _ in range(5)])
    batch = phrase_index._shard("s", [0] * 5, [sizes], [line])
    wins = phrase_index.Windows.of([text(25).decode() for _ in range(4)], list(range(4)), 3)
    shard = phrase_index.Shard({c: phrase_index._values(batch, c, 0) for c in ("n_words", "terms", "counts", "steps")}, wins.terms)
    found = lambda f: [set(zip(*map(np.ndarray.tolist, f(r)))) for r in wins.rows.values()]
    whole = found(shard.phrases), found(lambda r: shard.proximities(r, 5))
    assert all(map(any, whole))
    monkeypatch.setattr(phrase_index, "ROWS", 2)
    steps = [len(ranked) for r in wins.rows.values() for _, _, ranked, _, _ in shard.candidates(r)]
    assert max(steps) <= 2
    assert whole == (found(shard.phrases), found(lambda r: shard.proximities(r, 5)))
