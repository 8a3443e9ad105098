"""Arrow batches in tasks: columns added row by row to what came in."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Rows in an Arrow batch: texts may be long, and a batch is held in memory as a whole.
BATCH_ROWS = 500


def small_batches(df: DataFrame) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


@contextmanager
def batches_of(spark: SparkSession, rows: int, size: str = "32m") -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows and about ``size`` for the jobs that run inside."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows),
              "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column; NULL counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def int_lists(parts: list[bytes]) -> pa.ListArray:
    """A list<int32> column from the bytes of little-endian 32-bit numbers of each row."""
    values = np.frombuffer(b"".join(parts), dtype="<i4")
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def list_bytes(column: pa.ListArray) -> list[bytes]:
    """The other way round; NULL lists are empty."""
    values = column.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
    offsets = column.offsets.to_numpy()
    return [values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]


def appended(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with columns added, or replaced where the name is taken."""
    kept = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + list(columns.values()),
                                      names=kept + list(columns))
