"""Event studies: prices after news, return distributions, decay estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import CHUNK_ROWS, MAX_ROWS, asof_join, equi_depth
from ..session import cut_lineage

# Minutes after receipt at which the price is taken.
OFFSETS = (0, 1, 5, 15, 30, 60)


def news_speed(events: DataFrame, ticks: DataFrame, offsets: Sequence[int] = OFFSETS,
               chunk_seconds: int = 3600) -> DataFrame:
    """Last tick price at each offset after receipt: one row per (event, offset).

    events(event_id, symbol, received_at, …), ticks(symbol, ts, price).
    """
    probes = events.withColumn("offset_min", F.explode(F.array(*[F.lit(int(o)) for o in offsets])))
    probes = probes.withColumn("probe_ts", F.timestamp_add("MINUTE", F.col("offset_min"),
                                                           F.col("received_at")))
    hit = asof_join(probes, ticks, ["symbol"], "probe_ts", "ts", ["price"], chunk_seconds)
    return hit.withColumnRenamed("matched_ts", "price_ts")


def event_returns(speed: DataFrame, keys: Sequence[str] = ("event_id", "symbol")) -> DataFrame:
    """Return from the price at receipt to each later offset."""
    base = speed.filter("offset_min = 0").select(*keys, F.col("price").alias("_p0"))
    later = speed.filter("offset_min > 0")
    return (later.join(base, list(keys))
            .withColumn("event_return", F.try_divide(F.col("price"), F.col("_p0")) - 1).drop("_p0"))


def exact_median(rows: DataFrame, by: Sequence[str], value: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``by, median`` of the known values, exact for groups of any size.

    Rows are dealt into chunks of equal depth by (group, value); the counts per chunk say which chunk
    holds the middle ranks of a group, and only rows of those chunks are put in order.
    """
    rows = cut_lineage(rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v")))
    parts = equi_depth(rows.withColumn("_tie", F.monotonically_increasing_id()), [*by, "_v", "_tie"], chunk_rows)
    group = F.struct(*[F.col(c) for c in by])
    counts = parts.groupBy(group.alias("_g"), "_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_g")
    total = F.sum("n").over(whole)
    placed = counts.select("_g", "_part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"),
                           F.floor((total + 1) / 2).alias("_low"), F.floor(total / 2 + 1).alias("_high"))
    end = F.col("_before") + F.col("n")
    middle = placed.filter(((F.col("_low") > F.col("_before")) & (F.col("_low") <= end))
                           | ((F.col("_high") > F.col("_before")) & (F.col("_high") <= end))).drop("n")
    order = F.row_number().over(Window.partitionBy("_g", "_part").orderBy("_v")) + F.col("_before")
    return (parts.withColumn("_g", group).join(middle, ["_g", "_part"]).withColumn("_i", order)
            .filter((F.col("_i") == F.col("_low")) | (F.col("_i") == F.col("_high")))
            .groupBy("_g").agg(F.avg("_v").alias("median")).select("_g.*", "median"))


def event_study(returns: DataFrame, by: Sequence[str], max_rows: int = MAX_ROWS) -> DataFrame:
    """Distribution of event returns per group and offset.

    The median of groups up to ``max_rows`` comes from their values; where a group is larger, all
    medians are selected by :func:`exact_median`.
    """
    keys = [*by, "offset_min"]
    returns = cut_lineage(returns.filter(F.col("event_return").isNotNull()).select(*keys, "event_return"))
    r = F.col("event_return")
    stats = [F.count("*").alias("n"), F.avg(r).alias("mean_return"), F.stddev_samp(r).alias("deviation"),
             F.avg((r > 0).cast("double")).alias("win_rate"), F.min(r).alias("min_return"), F.max(r).alias("max_return")]
    largest = returns.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= max_rows:
        return returns.groupBy(*keys).agg(*stats, F.percentile(r, F.lit(0.5)).alias("median_return"))
    middle = exact_median(returns, keys, "event_return").select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("median").alias("median_return"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return returns.groupBy(*keys).agg(*stats).join(middle, same, "left").drop(*[f"_{k}" for k in keys])


def decay_fit(profile: DataFrame, taus: Sequence[float], by: str = "event_type",
              x: str = "offset_min", y: str = "strength", weight: str = "n") -> DataFrame:
    """Best exponential decay constant per group by weighted least squares of y on exp(-x/τ).

    ``profile`` has a few rows per group (one per offset), so the grid costs a few rows each.
    The constant with the highest R² wins, the smaller one on ties.
    """
    grid = profile.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus])))
    w, d, v = F.col(weight), F.exp(-F.col(x) / F.col("tau")), F.col(y)
    sums = grid.groupBy(by, "tau").agg(
        F.sum(w).alias("w"), F.sum(w * d).alias("d"), F.sum(w * v).alias("v"),
        F.sum(w * d * d).alias("dd"), F.sum(w * d * v).alias("dv"), F.sum(w * v * v).alias("vv"))
    c = F.col
    cov = c("dv") - c("d") * c("v") / c("w")
    sd, sv = c("dd") - c("d") ** 2 / c("w"), c("vv") - c("v") ** 2 / c("w")
    scored = sums.withColumns({"r2": F.try_divide(cov * cov, sd * sv),
                               "slope": F.try_divide(cov, sd)})
    return (scored.filter("r2 IS NOT NULL").groupBy(by)
            .agg(F.max_by(F.struct("tau", "slope", "r2"), F.struct("r2", -F.col("tau"))).alias("_b"))
            .select(by, "_b.tau", "_b.slope", "_b.r2"))
