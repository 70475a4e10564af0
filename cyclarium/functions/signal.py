"""Expressions on signals. Missing values are NULL; NaN never reaches an aggregate."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Lowest precision, in µm.
MIN_PRECISION = 5e-4
#: Bases per µm.
STRETCH_DNA, STRETCH_RNA = 1 / 8.8e-4, 1 / 7e-4


def defined(z: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(~F.isnan(z) & (F.abs(z) < float("inf")), z)


def percentile(z: str | Column, p: float) -> Column:
    """Linear percentile of an aggregate, ``p`` in [0, 1]."""
    return F.percentile(z, F.lit(p))


def extent(z: str | Column) -> Column:
    """Difference of the 95th and the 5th percentile."""
    return percentile(z, 0.95) - percentile(z, 0.05)


def median_deviation(z: str | Column) -> Column:
    """Half the distance between the outer thirds."""
    return (percentile(z, 2 / 3) - percentile(z, 1 / 3)) / 2


def step(z: str | Column, over: WindowSpec, n: int = 1) -> Column:
    """Difference to the ``n``-th row before, which is NULL where either is missing."""
    return F.col(z) - F.lag(z, n).over(over) if isinstance(z, str) else z - F.lag(z, n).over(over)


def last_defined(z: str | Column, over: WindowSpec) -> Column:
    """Latest value before this row that isn't missing."""
    return F.last(z, ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, -1))


def next_defined(z: str | Column, over: WindowSpec) -> Column:
    """Next value after this row that isn't missing."""
    return F.first(z, ignorenulls=True).over(over.rowsBetween(1, W.unboundedFollowing))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def reference_percentile(values: Column, p: float) -> Column:
    """Percentile of an array by the non-standard rule h = n * p: x[h] if h is whole, else between x[int(h)] and the next."""
    x = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    n = F.size(x)
    h = n * F.lit(p)
    k = F.floor(h).cast("int")
    at = lambda i: F.element_at(x, (F.least(F.greatest(i, F.lit(0)), n - 1) + 1).cast("int"))
    between = at(k) + (h - k) * (at(k + 1) - at(k))
    return F.when(n == 0, None).when(k <= 0, at(F.lit(0))).when(k >= n, at(n - 1)).when(h == k, at(k)).otherwise(between)


def complement(sequence: Column) -> Column:
    """Reverse complement of a DNA sequence."""
    return F.reverse(F.translate(sequence, "acgtACGT", "tgcaTGCA"))


def round9(x: Column) -> Column:
    """Rounded for comparison between engines."""
    return F.round(x, 9)
