"""Small column builders used by several operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS = 1_000_000


def rolling(fn: Callable[[Column], Column], col: Column | str, frame: WindowSpec, min_count: int) -> Column:
    """``fn(col)`` over ``frame``, null until ``min_count`` non-null values are in it."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(F.count(col).over(frame) >= min_count, fn(col).over(frame))


def floored(col: Column, floor: float) -> Column:
    """``max(col, floor)`` that keeps a missing value missing."""
    return F.when(col.isNotNull(), F.greatest(col, F.lit(float(floor))))


def as_ordinal(col: Column, dtype: T.DataType) -> Column:
    """A time or whole-number column as a 64-bit integer (microseconds for times)."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(col.cast("timestamp"))
    if isinstance(dtype, T.DateType):
        return F.unix_micros(col.cast("timestamp"))
    return col.cast("long")


def seconds(n: float) -> Column:
    """A day-time interval of ``n`` seconds, exact to the microsecond."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n).cast("decimal(18,6)"))


def rate(cond: Column) -> Column:
    """Share of rows for which ``cond`` holds."""
    return F.avg(cond.cast("double"))


def preceding(w: WindowSpec, n: int) -> WindowSpec:
    """The ``n`` rows before the current one."""
    return w.rowsBetween(-n, -1)


def so_far(w: WindowSpec) -> WindowSpec:
    """Everything up to and including the current row."""
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
