"""Where scratch tables go."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from marketloom.session import scratch_path


def session(master, shared=None):
    context = SimpleNamespace(master=master, folder=None)
    context.getCheckpointDir = lambda: context.folder
    context.setCheckpointDir = lambda path: setattr(context, "folder", path)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: shared or default))


def test_scratch_folder():
    assert scratch_path(session("spark://host:7077", "hdfs:/shared"), "t").startswith("hdfs:/shared/t-")
    assert "marketloom-ckpt-" in scratch_path(session("local[4]"), "t")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            scratch_path(session(master), "t")


def test_settled_results_outlive_their_scratch_tables(spark):
    import os

    from marketloom.session import cut_lineage, settled
    made = []

    def table(n):
        out = cut_lineage(spark.range(n))
        made.append(out.inputFiles()[0].removeprefix("file://"))
        return out

    def make():
        inner = settled(spark, lambda: table(5).filter("id > 1"))
        made.append(inner.inputFiles()[0].removeprefix("file://"))
        assert not os.path.exists(made[0]) and os.path.exists(made[1])
        return inner.join(table(10), "id")

    out = settled(spark, make)
    assert sorted(r["id"] for r in out.collect()) == [2, 3, 4] and out.count() == 3
    assert not any(map(os.path.exists, made)) and len(made) == 3
    kept = cut_lineage(spark.range(3))
    assert kept.count() == 3
    with pytest.raises(ZeroDivisionError):
        settled(spark, lambda: 1 / 0)
    assert settled(spark, lambda: spark.range(2)).count() == 2


def test_python_batches_are_bounded_in_bytes(spark):
    """Long texts meet a model in many small batches, not in one of 10,000 rows."""
    import pandas as pd

    from marketloom.operators import news
    from marketloom.session import tune
    tune(spark)

    def model(headline, summary):
        return pd.DataFrame({"event_type": "jobs", "event_direction": "neutral",
                             "confidence": [1.0 / len(summary)] * len(summary)})
    docs = spark.range(600, numPartitions=1).select(F.lit("h").alias("headline"), F.repeat(F.lit("x"), 100_000).alias("summary"))
    fewest = news.classify_with(docs, model, "m").agg(F.min("confidence").alias("c")).first()["c"]
    assert 1 / fewest <= 120
