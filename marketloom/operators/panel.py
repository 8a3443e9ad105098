"""Bar panels: dense grid, wide/long reshaping, panel guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import (CHUNK_BARS, bar_calendar, chunk_scan, last_known)


def densify(bars: DataFrame, chunk_bars: int = CHUNK_BARS) -> DataFrame:
    """Every symbol at every bar time; cells absent from ``bars`` are NULL.

    The bar numbers of a symbol are generated chunk by chunk and equi-joined to the calendar.
    """
    calendar = bar_calendar(bars)
    top = calendar.agg(F.max("bar_no").alias("n")).scalar()
    cells = (bars.select("symbol").distinct()
             .withColumn("_n", top)
             .withColumn("_block", F.explode(
                 F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / chunk_bars))))
             .withColumn("bar_no", F.explode(F.sequence(
                 F.col("_block") * chunk_bars + 1,
                 F.least((F.col("_block") + 1) * chunk_bars, F.col("_n"))))))
    grid = cells.join(calendar, "bar_no").select("symbol", "ts", "bar_no")
    return grid.join(bars, ["symbol", "ts"], "left")


def forward_fill(panel: DataFrame, columns: list[str],
                 chunk_bars: int = CHUNK_BARS) -> DataFrame:
    """Opt-in fill of NULL cells with the last known value of the symbol."""
    filled = chunk_scan(panel, ["symbol"], F.floor(F.col("bar_no") / chunk_bars), ["bar_no"],
                        [last_known(f"_f_{c}", F.col(c)) for c in columns])
    return filled.select(*[F.col(f"_f_{c}").alias(c) if c in columns else F.col(c)
                           for c in panel.columns])


def to_wide(panel: DataFrame, value: str, symbols: list[str]) -> DataFrame:
    """One column per listed symbol."""
    return panel.groupBy("ts").pivot("symbol", symbols).agg(F.max(value))


def to_long(wide: DataFrame, value: str = "price") -> DataFrame:
    """Inverse of :func:`to_wide`, dropping missing cells."""
    names = [c for c in wide.columns if c != "ts"]
    return wide.unpivot("ts", names, "symbol", value).filter(F.col(value).isNotNull())


def stack_features(panel: DataFrame, features: list[str]) -> DataFrame:
    """Feature columns to (symbol, ts, feature, value) rows, NULLs kept."""
    return panel.unpivot(["symbol", "ts"], features, "feature", "value")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column; applied at each numeric source."""
    floating = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floating else F.col(c)
                       for c in df.columns])


def drop_benchmark(panel: DataFrame, benchmark: str) -> DataFrame:
    return panel.filter(F.col("symbol") != benchmark)


def liquidity_screen(bars: DataFrame, minimum_adv: float, n: int = 20,
                     chunk_bars: int = CHUNK_BARS) -> DataFrame:
    """``n``-bar average traded value per symbol and whether it clears ``minimum_adv``."""
    from ..functions.rolling import BarFrame, flag
    from ..plans.ordered import drop_halo, number_bars, with_halo

    frame = BarFrame()
    value: Column = F.col("price") * F.col("volume")
    panel = with_halo(number_bars(bars), n, chunk_bars=chunk_bars).withColumn("_value", value)
    panel = panel.withColumn("adv", frame.full(F.avg, F.col("_value"), n))
    return drop_halo(panel).select("symbol", "ts", "adv",
                                   flag(F.col("adv") >= minimum_adv).alias("liquid"))
