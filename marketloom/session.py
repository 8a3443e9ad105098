"""Session settings and checkpoint helper."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Scratch paths made since the innermost ``settled`` call began.
_MADE: ContextVar[list[str] | None] = ContextVar("scratch_paths", default=None)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every job of this package expects."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # A Python worker holds an Arrow batch as a whole, several times over: bounded in bytes, not in rows only.
        "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    }.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "marketloom",
                  memory: str = "8g", **extra: str) -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", memory)
               # Plans here hold hundreds of expressions; recording a call site for each is slow.
               .config("spark.python.sql.dataFrameDebugging.enabled", "false")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared checkpoint folder.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only a session that runs
    in this one process (a developer machine) may go without, and gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="marketloom-ckpt-"))
    path = f"{context.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back (runs the plan).

    A columnar table instead of an RDD checkpoint keeps column pruning and size statistics for
    the plans that read it.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The written result of ``make()``, with everything written on the way to it deleted.

    For stages whose intermediate tables nobody reads once the result is on disk. The result does
    not depend on them any more, so a lost executor costs nothing. Calls may be nested: an inner
    result belongs to the outer call. Shuffle files go with the plans that made them, when the driver
    collects its garbage; that is asked for here.
    """
    outer = _MADE.get()
    made: list[str] = []
    token = _MADE.set(made)
    try:
        df = make()
        path = scratch_path(spark, "table")
        df.write.parquet(path)
        schema = df.schema
    finally:
        _MADE.reset(token)
    made.remove(path)
    if outer is not None:
        outer.append(path)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for old in made:
        place = jvm.org.apache.hadoop.fs.Path(old)
        place.getFileSystem(conf).delete(place, True)
    del df
    gc.collect()
    jvm.System.gc()
    return spark.read.schema(schema).parquet(path)
