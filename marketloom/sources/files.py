"""Many small text files, one per key, written by tasks."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What Spark calls the folder of a NULL key.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def write_keyed_text(rows: DataFrame, key: str, line: str, folder: str) -> None:
    """One file per value of ``key`` (a whole number): ``folder/key=7/part.txt`` with its lines in input order.

    The layout is that of ``partitionBy(key).text(folder)``, whose committer moves and re-permits every
    file several times: on a mounted file system that takes far longer than the file itself, so tasks
    write the files in place there. A repeated task writes the same files again. Other stores take
    Spark's writer. NULL lines are empty lines.
    """
    named = rows.select(F.coalesce(F.col(key).cast("string"), F.lit(NULL_FOLDER)).alias("_k"),
                        F.coalesce(line, F.lit("")).alias("_v"), F.monotonically_increasing_id().alias("_n"), F.col(key))
    # A stated number of partitions: small rows must not make one task write all files.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = named.repartition(tasks, "_k").sortWithinPartitions("_k", "_n")
    place = urlsplit(folder)
    if place.scheme not in ("", "file"):
        dealt.select(key, "_v").write.partitionBy(key).text(folder)
        return
    base = unquote(place.path) if place.scheme else folder
    os.makedirs(base)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, done = None, None, 0
        try:
            for batch in batches:
                for k, v in zip(batch.column("_k").to_pylist(), batch.column("_v").to_pylist()):
                    if k != now:
                        if out is not None:
                            out.close()
                        where = os.path.join(base, f"{key}={k}")
                        os.makedirs(where, exist_ok=True)
                        now, out, done = k, open(os.path.join(where, "part.txt"), "w", encoding="utf-8", newline=""), done + 1
                    out.write(v + "\n")
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([done], pa.int64())})

    dealt.select("_k", "_v").mapInArrow(write, "files long").agg(F.sum("files")).first()
