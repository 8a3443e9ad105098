"""Trailing frames with exact warm-up on a numbered bar panel.

Frames are RANGE frames over the integer ``bar_no``, so a bar missing from the long table counts
as a missing cell of the dense grid: the frame is then short and the result NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


class BarFrame:
    """Frames over (symbol, chunk) in bar order."""

    def __init__(self, keys: tuple[str, ...] = ("symbol", "_chunk"), order: str = "bar_no"):
        self._base = Window.partitionBy(*keys).orderBy(order)
        self.price, self.volume = F.col("price"), F.col("volume")
        self.bench = F.col("bench_price")

    def back(self, column: Column, n: int) -> Column:
        """The value exactly ``n`` bars ago, NULL when that cell is missing."""
        return F.max(column).over(self._base.rangeBetween(-n, -n))

    def ahead(self, column: Column, n: int) -> Column:
        """The value exactly ``n`` bars later; the panel needs a look-ahead halo for it."""
        return F.max(column).over(self._base.rangeBetween(n, n))

    def full(self, aggregate, column: Column, n: int) -> Column:
        """``aggregate`` over the last ``n`` bars, NULL unless all ``n`` cells are present."""
        w = self._base.rangeBetween(1 - n, 0)
        return F.when(F.count(column).over(w) == n, aggregate(column).over(w))


def ratio(a: Column, b: Column) -> Column:
    """Division with NULL instead of an error or an infinity for a zero divisor."""
    return F.try_divide(a, b)


def nonzero(c: Column) -> Column:
    return F.when(c != 0, c)


def flag(condition: Column) -> Column:
    """1.0 / 0.0; an unknown comparison is 0.0, as in warm-up."""
    return F.coalesce(condition, F.lit(False)).cast("double")
