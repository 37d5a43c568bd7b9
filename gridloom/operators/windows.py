"""Window features of a series: every function gives a column, so one select over several of
them with the same partition and order is one exchange and one sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from gridloom.functions.keys import col


class Series:
    """Rows of `keys` in the order of an integer column."""

    def __init__(self, keys: Sequence[str] = ("y", "x"), order: str = "month_idx"):
        self.keys, self.order = list(keys), order

    @property
    def spec(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.order)

    def rows(self, before: int | None) -> WindowSpec:
        """The row and so many before it; None: all before it."""
        return self.spec.rowsBetween(Window.unboundedPreceding if before is None else -before, 0)

    def months(self, before: int) -> WindowSpec:
        """Rows whose order lies at most so far back: gaps shrink the frame."""
        return self.spec.rangeBetween(-before, 0)

    def mean_months(self, c: str, months: int = 3) -> Column:
        return F.avg(c).over(self.months(months - 1))

    def std_months(self, c: str, months: int = 3) -> Column:
        """0 where the frame holds one value."""
        return F.coalesce(F.stddev_samp(c).over(self.months(months - 1)), F.lit(0.0))

    def mean_rows(self, c: str, n: int | None) -> Column:
        return F.avg(c).over(self.rows(None if n is None else n - 1))

    def before(self, c: str, n: int = 1) -> Column:
        return F.lag(c, n).over(self.spec)

    def step(self, c: str) -> Column:
        """Difference to the row before; null on the first."""
        return col(c) - self.before(c)

    def momentum(self, c: str) -> Column:
        """Difference to the row before; 0 on the first."""
        return col(c) - F.coalesce(self.before(c), col(c))

    def acceleration(self, c: str) -> Column:
        return col(c) - 2.0 * F.coalesce(self.before(c), col(c)) + F.coalesce(self.before(c, 2), col(c))

    def rate(self, c: str, n: int = 6) -> Column:
        """Difference to the mean of the last n rows."""
        return col(c) - F.coalesce(self.mean_rows(c, n), col(c))

    def deseasoned(self, c: str, n: int = 12) -> Column:
        return col(c) - self.mean_rows(c, n)

    def sustained(self, c: str, short: int = 6, long: int = 12) -> Column:
        return self.mean_rows(c, short) - self.mean_rows(c, long)

    def filled(self, c: str) -> Column:
        """The last value that is not null."""
        return F.last(c, ignorenulls=True).over(self.rows(None))
