"""Column helpers with IEEE semantics, and the comparison quantiser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x)) if isinstance(x, (int, float)) else F.col(x)


def fdiv(a, b) -> Column:
    """a / b as IEEE does: division by zero gives an infinity or NaN, nulls stay null."""
    a, b = num(a), num(b)
    zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, F.when(a.isNotNull(), zero)).otherwise(F.try_divide(a, b))


def finite(x) -> Column:
    """True where x is neither null, NaN nor infinite."""
    x = num(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INF)


def clip(x, low: float, high: float) -> Column:
    return F.least(F.greatest(num(x), F.lit(float(low))), F.lit(float(high)))


def quantised(x, k: int) -> Column:
    """x cut to k decimals on a grid whose edges no average of cents falls on; NaN and infinities give null.

    Both engines of a comparison must use it, as their round() differ.
    """
    x = num(x)
    return F.when(finite(x), F.floor(x * F.lit(10.0**k) + F.lit(0.5003)).cast("double") / F.lit(10.0**k))


def quantised_sql(x: str, k: int) -> str:
    """The same in DuckDB."""
    return f"CASE WHEN isfinite({x}) THEN floor(({x}) * CAST({10**k} AS DOUBLE) + CAST(0.5003 AS DOUBLE)) / CAST({10**k} AS DOUBLE) END"


def first_where(predicate, ord_col="ord") -> Column:
    """Aggregate: the first position that satisfies a predicate, else null."""
    return F.min(F.when(predicate, F.col(ord_col)))
