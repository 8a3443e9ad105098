"""Order-dependent plans that never put a whole key into one task.

A key (symbol, account, session) may hold a large share of the table, so plain
``Window.partitionBy(key)`` is avoided. Two shapes replace it:

* *bounded look-back* (rolling frames): rows are numbered on the bar calendar, cut into chunks of
  ``chunk_bars`` bars, and each chunk also receives the last ``lookback`` bars before it. The
  window then partitions by (key, chunk).
* *unbounded look-back* (running totals, last known value): each chunk is summarised with a
  partially aggregating ``groupBy``, the small summaries are scanned in chunk order, and the
  carry is joined back on the same (key, chunk) hash partitioning the inner window uses. Chunks
  cut by time are cut again by depth where a key is dense (``split_heavy``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

CHUNK_BARS = 8192
CHUNK_ROWS = 65536
# A task takes this many rows of a chunk at most where chunks are cut by time.
MAX_ROWS = 1 << 20


# ---------------------------------------------------------------- calendar

def bar_calendar(bars: DataFrame, ts: str = "ts") -> DataFrame:
    """Distinct bar times numbered 1..N, as ``(ts, bar_no)``.

    Times are ranked inside calendar months; only the one-row-per-month counts pass through an
    unpartitioned window.
    """
    times = bars.select(ts).distinct().withColumn("_month", F.date_trunc("month", ts))
    before = (times.groupBy("_month").agg(F.count("*").alias("_n"))
              .select("_month", F.coalesce(
                  F.sum("_n").over(Window.orderBy("_month").rowsBetween(
                      Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")))
    ranked = times.withColumn(
        "_rn", F.row_number().over(Window.partitionBy("_month").orderBy(ts)))
    return (ranked.join(before, "_month")
            .select(ts, (F.col("_before") + F.col("_rn")).cast("long").alias("bar_no")))


def number_bars(bars: DataFrame, ts: str = "ts") -> DataFrame:
    return bars.join(bar_calendar(bars, ts), ts)


def with_halo(df: DataFrame, lookback: int, position: str = "bar_no",
              chunk_bars: int = CHUNK_BARS, lookahead: int = 0) -> DataFrame:
    """Add ``_chunk`` and ``_home``; rows that other chunks look at are repeated there."""
    at = lambda shift: F.floor((F.col(position) + shift) / chunk_bars)
    return (df.withColumn("_chunk", F.explode(F.sequence(at(-lookahead), at(lookback))))
            .withColumn("_home", F.col("_chunk") == at(0)))


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter("_home").drop("_chunk", "_home")


# ---------------------------------------------------------------- depth

def equi_depth(df: DataFrame, order: Sequence[str], rows: int = CHUNK_ROWS, out: str = "_part",
               total: int | None = None) -> DataFrame:
    """``df`` with a chunk number that rises with ``order`` (NULL first) and holds about ``rows`` rows.

    The split points are sampled by Spark's range partitioning, so the depth of a chunk does not
    depend on how the values are spread. Only rows that agree in all of ``order`` cannot be split:
    end it with something that tells rows apart. The result is written once, so that every plan
    over it sees the same numbers, also after a task was run again.
    """
    total = df.count() if total is None else total
    ranged = df.repartitionByRange(max(1, -(-total // rows)), *[F.col(c).asc_nulls_first() for c in order])
    return cut_lineage(ranged.withColumn(out, F.spark_partition_id().cast("long")))


def split_heavy(rows: DataFrame, group: Sequence[str], counts: DataFrame, order: Sequence[str],
                max_rows: int, out: str, untied: bool = True) -> DataFrame | None:
    """``rows`` with a number that cuts groups of more than ``max_rows`` into chunks of equal depth.

    ``counts``: one written row per group with its number of rows ``n``. Rows of other groups get 0.
    Returns None if no group is that large. Rows that agree in ``order`` may be parted unless
    ``untied`` is false. The heavy rows are range-partitioned by (group, order), so that a key holding
    nearly all rows is still spread over all tasks.
    """
    heavy = counts.filter(F.col("n") > max_rows)
    total = heavy.agg(F.sum("n")).first()[0]
    if not total:
        return None
    named = heavy.select(*[F.col(c).alias(f"_heavy_{i}") for i, c in enumerate(group)])
    same = None
    for i, c in enumerate(group):
        equal = F.col(c).eqNullSafe(F.col(f"_heavy_{i}"))
        same = equal if same is None else same & equal
    light = rows.join(named, same, "left_anti").withColumn(out, F.lit(0).cast("long"))
    many = rows.join(named, same, "left_semi")
    if untied:
        many = many.withColumn("_tie", F.monotonically_increasing_id())
    parts = equi_depth(many, [*group, *order, *(["_tie"] if untied else [])], max_rows, out, total)
    return light.unionByName(parts.drop("_tie"))


def parted(rows: DataFrame, keys: Sequence[str], apart: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` of the keys that are not in ``apart`` (one row per key), and the other rows (None if it is empty).

    ``apart`` is written first. NULL is a key like any other.
    """
    apart = cut_lineage(apart.select(*[F.col(k).alias(f"_apart_{i}") for i, k in enumerate(keys)]))
    if apart.isEmpty():
        return rows, None
    same = None
    for i, k in enumerate(keys):
        equal = F.col(k).eqNullSafe(F.col(f"_apart_{i}"))
        same = equal if same is None else same & equal
    return rows.join(apart, same, "left_anti"), rows.join(apart, same, "left_semi")


def numbered(df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str], out: str,
             max_rows: int = MAX_ROWS) -> DataFrame:
    """``df`` with the 1-based position of each row within its key in ``order``.

    Keys of at most ``max_rows`` rows are numbered in one window; those that hold more are scanned chunk by
    ``chunk``. Only the key columns are read to tell them apart.
    """
    large = df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > max_rows)
    small, rest = parted(df, keys, large)
    small = small.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return small if rest is None else small.unionByName(chunk_scan(rest, keys, chunk, order, [ordinal(out)]))


# ---------------------------------------------------------------- scans

@dataclass(frozen=True)
class Scan:
    """One running quantity: ``kind`` is sum, max, min or last (last non-null value)."""

    out: str
    kind: str
    value: Column
    inclusive: bool = True


def running_sum(out: str, value: Column, inclusive: bool = True) -> Scan:
    return Scan(out, "sum", value, inclusive)


def running_max(out: str, value: Column, inclusive: bool = True) -> Scan:
    return Scan(out, "max", value, inclusive)


def running_min(out: str, value: Column, inclusive: bool = True) -> Scan:
    return Scan(out, "min", value, inclusive)


def last_known(out: str, value: Column, inclusive: bool = True) -> Scan:
    return Scan(out, "last", value, inclusive)


def ordinal(out: str) -> Scan:
    """1-based position of the row within its key."""
    return Scan(out, "sum", F.lit(1).cast("long"), True)


def chunk_scan(df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str],
               scans: Sequence[Scan], max_rows: int | None = None) -> DataFrame:
    """Evaluate ``scans`` over each key in ``order``; ``chunk`` must not decrease in that order.

    With ``max_rows``, chunks that hold more rows are cut at sampled split points, whatever the
    spread of the key's rows: the chunk summaries are written while the call is made, counted, and
    used as they are where no chunk is that large.

    Rows with a NULL key are a key of their own, and a NULL chunk comes first in its key: both are
    put in structs, which are equal where their fields are NULL, so no row is lost in the join.
    """
    work = df.withColumn("_k", F.struct(*[F.col(k) for k in keys])).withColumn("_c", F.struct(chunk.alias("c")))
    keys = ["_k"]
    for i, scan in enumerate(scans):
        work = work.withColumn(f"_v{i}", scan.value)
    position = F.struct(*[F.col(c) for c in order])

    summary = []
    for i, scan in enumerate(scans):
        v = F.col(f"_v{i}")
        if scan.kind == "last":
            summary.append(F.max_by(v, F.when(v.isNotNull(), position)).alias(f"_p{i}"))
        else:
            summary.append(getattr(F, scan.kind)(v).alias(f"_p{i}"))
    over_chunks = (Window.partitionBy(*keys).orderBy("_c")
                   .rowsBetween(Window.unboundedPreceding, -1))
    summaries = work.groupBy(*keys, "_c").agg(*summary, F.count("*").alias("n"))
    if max_rows is not None:
        summaries = cut_lineage(summaries)
        parted = split_heavy(work, [*keys, "_c"], summaries, order, max_rows, "_s")
        if parted is not None:
            # Cut chunks follow each other inside the chunk they come from.
            work = parted.withColumn("_c", F.struct(F.col("_c.c").alias("c"), F.col("_s").alias("s"))).drop("_s")
            summaries = work.groupBy(*keys, "_c").agg(*summary)
    carry = summaries.select(
        *keys, "_c",
        *[(F.last(f"_p{i}", ignorenulls=True) if s.kind == "last"
           else getattr(F, s.kind)(f"_p{i}")).over(over_chunks).alias(f"_carry{i}")
          for i, s in enumerate(scans)])

    inside = Window.partitionBy(*keys, "_c").orderBy(*order)
    out = work.join(carry, [*keys, "_c"])
    results = []
    for i, scan in enumerate(scans):
        w = inside.rowsBetween(Window.unboundedPreceding, 0 if scan.inclusive else -1)
        v, c = F.col(f"_v{i}"), F.col(f"_carry{i}")
        if scan.kind == "last":
            results.append(F.coalesce(F.last(v, ignorenulls=True).over(w), c).alias(scan.out))
        elif scan.kind == "sum":
            zero = F.lit(0)
            results.append((F.coalesce(F.sum(v).over(w), zero) + F.coalesce(c, zero))
                           .alias(scan.out))
        else:
            pick = F.greatest if scan.kind == "max" else F.least
            results.append(pick(getattr(F, scan.kind)(v).over(w), c).alias(scan.out))
    return out.select(*[F.col(c) for c in df.columns], *results)


def seconds_chunk(ts: str, seconds: int) -> Column:
    """Fixed-width time chunk for rows ordered by ``ts``."""
    return F.floor(F.unix_micros(F.col(ts)) / (seconds * 1_000_000))


def rows_chunk(seq: str, rows: int = CHUNK_ROWS) -> Column:
    """Chunk for rows ordered by a dense sequence number: at most ``rows`` rows per chunk."""
    return F.floor(F.col(seq) / rows)


def previous_row(out: str, value: Column) -> Scan:
    """The preceding row's value, wrapped in a struct field ``v`` so that nulls count as rows."""
    return Scan(out, "last", F.struct(value.alias("v")), False)


# ---------------------------------------------------------------- as-of join

def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str,
              take: Sequence[str], chunk_seconds: int = 86_400,
              tolerance_seconds: float | None = None,
              right_order: Sequence[str] = (), max_rows: int = MAX_ROWS) -> DataFrame:
    """Each left row with the newest right row of the same key at or before its time.

    Both sides are stacked and scanned once, so no key is expanded and nothing is broadcast. Chunks
    are cut by time and, where a key holds more than ``max_rows`` in one, by sampled split points.
    ``take`` columns come from the right side; with a tolerance, older matches become NULL.
    Right rows with equal times are ordered by ``right_order``; the last one is taken. Every left
    row comes back once; one with a NULL key or time matches nothing.
    """
    by = list(by)
    right = right.dropna(subset=[*by, right_ts])
    payload = F.struct(F.col(right_ts).alias("_rts"), *[F.col(c) for c in take])
    lefts = left.select(*by, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"),
                        F.struct(*[F.col(c) for c in left.columns]).alias("_l"))
    rights = right.select(*by, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"),
                          payload.alias("_r"),
                          F.struct(F.lit(0), *[F.col(c) for c in right_order]).alias("_o"))
    stacked = lefts.unionByName(rights, allowMissingColumns=True)
    scanned = chunk_scan(stacked, by, seconds_chunk("_t", chunk_seconds), ["_t", "_side", "_o"],
                         [last_known("_hit", F.col("_r"))], max_rows).filter("_side = 1")
    hit = F.when(F.col("_t").isNotNull() & ~F.array_contains(F.array(*[F.col(k).isNull() for k in by]), True), F.col("_hit"))
    if tolerance_seconds is not None:
        fresh = (F.unix_micros("_t") - F.unix_micros("_hit._rts")
                 <= int(tolerance_seconds * 1_000_000))
        hit = F.when(fresh, hit)
    scanned = scanned.withColumn("_hit", hit)
    taken = [F.col(f"_hit.{c}").alias(c) for c in take]
    return scanned.select("_l.*", F.col("_hit._rts").alias(f"matched_{right_ts}"), *taken)
